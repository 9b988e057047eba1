"""Free JSON as VARIANT: metadata of payloads and tables keeps any shape, and paths in it are typed when read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def free_json(text) -> Column:
    """JSON text as a variant; null if it is none."""
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text)


def json_field(text, path: str) -> Column:
    """The value at a path of a JSON text, as a variant of any shape."""
    return F.try_variant_get(free_json(text), path, "variant")


def field(metadata, path: str, kind: str = "string") -> Column:
    """The value at ``path`` as ``kind``; null where it is missing or of another kind."""
    return F.try_variant_get(F.col(metadata) if isinstance(metadata, str) else metadata, path, kind)


def as_json(metadata) -> Column:
    """A variant as JSON text, as tables at rest hold it."""
    return F.to_json(F.col(metadata) if isinstance(metadata, str) else metadata)
