"""Readers and writers: snapshot tables, sitemaps, job intake, sinks."""
