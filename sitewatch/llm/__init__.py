"""Operators for preparing language-model training data.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports
it; ``__spark_entry__.py`` registers its queries only where it is present.
"""
