"""Column -> Column expressions.  Everything here is built from
``pyspark.sql.functions`` so it stays inside whole-stage codegen."""
