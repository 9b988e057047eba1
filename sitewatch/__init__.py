"""sitewatch: site-change analytics as Spark DataFrame operators.

All projects (websites) are processed in one job: ``project_id`` is a key column
and every per-project loop of a classic crawler becomes a join, window or
aggregate.  Sub-packages:

* ``functions``  Column -> Column expressions (text, URLs, schedules, labels)
* ``sources``    table readers and writers (snapshots, sitemaps, jobs, sinks)
* ``operators``  DataFrame -> DataFrame operators (changes, budget, index, ...)
* ``plans``      whole-job compositions and the registered query set
* ``streaming``  Structured Streaming versions of intake and change detection
"""

__version__ = "0.1.0"
