"""ST2: change detection of fetched pages as they arrive.

What is known of a page -- its id, current revision and that one's hash -- is keyed state
of the stream (RocksDB), seeded from the page and revision tables.  The fetches of a URL
in a micro-batch go through it in one pass in order of ``seq``; no table is read or
copied.  Class and reason come from the batch operator's rules (J3), ids from J10's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text
from ..operators import changes as ch
from ..operators import crawl
from ..operators.ranking import latest_per_key
from ..session import ship_package
from .common import use_rocksdb_state

STATE = "page_id string, revision_id string, content_sha256 string"
LOOKS = ("project_id string, url string, seq long, run_id string, status_code int, content_sha256 string, known_id string, "
         "old_revision_id string, old_content_sha256 string, page_id string, revision_id string, is_new_revision boolean")


def _digest(*parts: str | None) -> str:
    return hashlib.sha256("|".join(p for p in parts if p is not None).encode()).hexdigest()


class _PageHistory(StatefulProcessor):
    """Per (project, URL): each fetch beside what was known before it, and what is afterwards."""

    def init(self, handle) -> None:
        self.page = handle.getValueState("page", STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.page.update((initialState["page_id"], initialState["revision_id"], initialState["content_sha256"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        project_id, url = key
        was = known = self.page.get() or (None, None, None)
        # some hundred bytes a fetch of this one URL in this one micro-batch
        for seq, run_id, status, sha in sorted(((r["seq"], r["run_id"], r["status_code"], r["content_sha256"]) for r in rows), key=_order):
            page_id, revision_id, stored = known
            same = page_id is not None and revision_id is not None and bool(stored) and (sha is None or stored == sha)
            fresh = status == 200 and not same
            if fresh:
                page = page_id or crawl.PAGE_ID_PREFIX + _digest(project_id, url)
                known = (page, crawl.REVISION_ID_PREFIX + _digest(page, run_id), sha)
            yield Row(project_id=project_id, url=url, seq=seq, run_id=run_id, status_code=status, content_sha256=sha, known_id=page_id,
                      old_revision_id=revision_id, old_content_sha256=stored, page_id=known[0], revision_id=known[1], is_new_revision=fresh)
        if known != was:
            self.page.update(known)

    def close(self) -> None:
        pass


def _order(fetch: tuple) -> tuple:
    return tuple((x is not None, x) for x in fetch)


def first_states(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """The state to start from; of a URL that the catalogue holds twice the greatest page id counts."""
    pages = latest_per_key(pages, ["project_id", "url"], ["id"], ["id", "project_id", "url", "current_revision_id"])
    return ch.known_pages(pages, revisions).withColumnsRenamed({"old_revision_id": "revision_id", "old_content_sha256": "content_sha256"})


def change_stream(fetches: DataFrame, pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """A stream of fetches (project_id, url, status_code, seq, run_id and ``content_sha256`` or a
    raw ``body``) as a row each: change_class, change_reason, old_revision_id, and the page and
    revision as they are after it.

    ``pages`` (id, project_id, url, current_revision_id) and ``revisions`` (id, content_sha256)
    are read when the stream starts for the first time.
    """
    spark: SparkSession = fetches.sparkSession
    use_rocksdb_state(spark)
    ship_package(spark)
    if "content_sha256" not in fetches.columns:
        fetches = fetches.withColumn("content_sha256", F.when(F.col("status_code") == 200, text.fingerprint("body")))
    given = fetches.select("project_id", "url", F.col("seq").cast("long").alias("seq"), "run_id", F.col("status_code").cast("int").alias("status_code"),
                           "content_sha256")
    looks = given.groupBy("project_id", "url").transformWithState(
        _PageHistory(), LOOKS, "append", "none", initialState=first_states(pages, revisions).groupBy("project_id", "url"))
    cls, reason = ch.change_class(F.col("known_id").isNull(), F.lit(False), F.col("status_code"), F.col("old_revision_id"),
                                  F.col("old_content_sha256"), F.col("content_sha256"))
    return looks.select("project_id", "url", "seq", "run_id", F.col("known_id").isNull().alias("is_new_page"), cls.alias("change_class"),
                        reason.alias("change_reason"), "old_revision_id", "page_id", "revision_id", "is_new_revision", "status_code", "content_sha256")
