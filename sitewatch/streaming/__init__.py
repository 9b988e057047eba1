"""Structured Streaming versions of job intake (ST1), change detection (ST2),
delivery status (ST3) and the per-run crawl job (ST4).

Every stream keeps its checkpoint in the shared checkpoint folder, so a
restarted query resumes from its offsets and state.  Sinks are idempotent per
micro-batch (batch id or run id partitions), so a replayed batch overwrites
instead of duplicating.
"""
