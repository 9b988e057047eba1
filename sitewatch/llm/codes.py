"""Vector code compression with memoised grid cells (operator 13).

A vector of whole numbers is cut into ``PARTS`` equal parts; each part is coded by the
nearest of the ``ENTRIES`` entries of its place's codebook.  Codebooks start as the
parts of the rows of smallest ids and are fitted in ``ROUNDS`` rounds over all rows:
assign, then replace each entry by the floor of its parts' mean.

The nearest entry of a part is found by the cell of a coarse grid that the part lies
in.  An entry whose least distance to the cell's box is above another's greatest is
dominated in all of the box.  The other entries are worked out once a cell, kept by the
hash of the cell (its coordinates are compared too: colliding cells get all entries),
and only they are evaluated exactly for the part.  Squared distances are whole numbers,
so ties (lower index) are exact.

Each round a task adds up its own rows (at most parts x entries x components numbers)
and Spark adds the tasks' sums; the driver holds the codebooks alone.  A task keeps at
most ``MOST_CELLS`` cells of each part and begins anew beyond that: a cell is only work
saved.

Defined cases: see ``wholes`` for the rows that take part; so do only vectors whose
length is a multiple of ``PARTS`` above zero.  With fewer rows than entries there are
fewer entries.  Rows of equal id are ordered by their vectors.  Errors are null where a
long cannot hold them.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.session import materialize

from .common import in_arrow, table
from .wholes import as_longs, exact, lengths, matrix, size, sums_of, whole_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
CELL = 256                  # side of a grid cell
MOST_CELLS = 1 << 17
STEP = 1 << 14              # rows or cells worked on together
SALTS = 16
ODD = 0x9E3779B97F4A7C15


class Cells:
    """For one codebook, the entries that may be nearest in each grid cell seen so far."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.evaluated = 0
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.cells = np.zeros((0, self.book.shape[1]), dtype=np.int64)
        self.open = np.zeros((0, len(self.book)), dtype=bool)

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        """(cell, entry): not farther at best than another entry at worst."""
        top = max(size(cells) * CELL + CELL, size(self.book))
        lo = exact(cells * CELL, 4 * top * top * cells.shape[1])[:, None, :]
        e = exact(self.book, 4 * top * top * cells.shape[1])[None, :, :]
        hi = lo + (CELL - 1)
        least = ((e - np.minimum(np.maximum(e, lo), hi)) ** 2).sum(axis=2)
        most = (np.maximum(abs(e - lo), abs(e - hi)) ** 2).sum(axis=2)
        return (least <= most.min(axis=1)[:, None]).astype(bool)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """(row, entry): entries to evaluate."""
        cells = x // CELL
        keys = np.zeros(len(x), dtype=np.uint64)
        for j in range(cells.shape[1]):
            keys = (keys + cells[:, j].astype(np.uint64)) * np.uint64(ODD)
            keys ^= keys >> np.uint64(31)
        mine, first, of = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, mine)
        known = np.zeros(len(mine), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == mine
        if not known.all():
            fresh = first[~known]
            if len(self.keys) + len(fresh) > MOST_CELLS:
                self._forget()
                fresh = first
            keys_ = np.concatenate([self.keys, keys[fresh]])
            order = np.argsort(keys_)
            self.keys = keys_[order]
            self.cells = np.concatenate([self.cells, cells[fresh]])[order]
            self.open = np.concatenate([self.open, self._undominated(cells[fresh])])[order]
            at = np.searchsorted(self.keys, mine)
        at = at[of]
        out = self.open[at]
        out[(self.cells[at] != cells).any(axis=1)] = True       # another cell of the same hash
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, ties to the lower index."""
        codes, errors = [np.zeros(0, dtype=np.int64)], []
        for i in range(0, len(x), STEP):
            part = x[i:i + STEP]
            row, entry = np.nonzero(self.candidates(part))
            self.evaluated += len(row)
            top = max(size(part), size(self.book))
            bound = 4 * top * top * part.shape[1]
            d = ((exact(part, bound)[row] - exact(self.book, bound)[entry]) ** 2).sum(axis=1)
            best = np.minimum.reduceat(d, np.searchsorted(row, np.arange(len(part))))
            hit = np.flatnonzero(d == best[row])
            _, first = np.unique(row[hit], return_index=True)
            codes.append(entry[hit[first]])
            errors.append(best)
        kind = object if any(e.dtype == object for e in errors) else np.int64
        return np.concatenate(codes), np.concatenate([np.zeros(0, dtype=kind), *errors])


def _parts(column: pa.Array, dim: int) -> np.ndarray:
    return matrix(column, dim).reshape(len(column), PARTS, dim // PARTS)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's (part, entry, place, sum, n)."""
    n_parts, n_entries, width = books.shape
    cells = [Cells(b) for b in books]
    total = np.zeros(books.shape, dtype=object)
    count = np.zeros((n_parts, n_entries), dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _parts(batch.column(0), n_parts * width)
        for p in range(n_parts):
            codes, _ = cells[p].nearest(x[:, p])
            order = np.argsort(codes, kind="stable")
            used, first = np.unique(codes[order], return_index=True)
            part = exact(x[:, p], size(x[:, p]) * len(x))
            total[p, used] += np.add.reduceat(part[order], first, axis=0).astype(object)
            count[p] += np.bincount(codes, minlength=n_entries)
    p, e = np.nonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(p, width).astype(np.int32)), pa.array(np.repeat(e, width).astype(np.int32)),
         pa.array(np.tile(np.arange(width), len(p)).astype(np.int32)),
         pa.array([Decimal(int(s)) for s in total[p, e].ravel()], pa.decimal128(38)), pa.array(np.repeat(count[p, e], width))],
        names=["part", "entry", "place", "total", "n"])


def fit(rows: DataFrame, dim: int) -> np.ndarray:
    """The codebooks (part, entry, component) of the rows (id, v) of one length."""
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).select("v").collect()
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), PARTS, dim // PARTS).swapaxes(0, 1).copy()
    for _ in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        parts = in_arrow(rows.select("v"), lambda it, s=shared: _sums(it, s.value),
                         "part int, entry int, place int, total decimal(38,0), n long")
        books = books.copy()
        for r in sums_of(parts, ["part", "entry", "place"], ["total", "n"]):
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of rows (id, v, label); a code has two hex digits a part."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    given = rows.select("id", "label", "v")
    kinds = [given.schema[c].dataType.simpleString() for c in ("id", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        cells = [Cells(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch.column(2), books.shape[0] * books.shape[2])
            found = [cells[p].nearest(x[:, p]) for p in range(PARTS)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            bound = sum(size(e) for _, e in found)
            errors = sum(exact(e, bound) for _, e in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in codes]), as_longs(errors)],
                names=["id", "label", "code", "error"])

    return in_arrow(given, run, f"id {kinds[0]}, label {kinds[1]}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, i] for p, i in enumerate(bytes.fromhex(code))])


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = None,
             scale: int = SCALE) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(id, label, code, error, dim) of every row that takes part, and the codebooks by length."""
    rows = whole_vectors(df, vec_id, vector, scale, label)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    out = df.sparkSession.createDataFrame([], f"id {kinds[0]}, label {kinds[1]}, code string, error long, dim int")
    books = {}
    for dim in lengths(rows):
        if dim and dim % PARTS == 0:
            own = rows.where(F.col("dim") == dim)
            books[dim] = fit(own, dim)
            out = out.union(materialize(encode(own, books[dim]), "codes").withColumn("dim", F.lit(dim)))
    return out, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, its error summed over rows of equal label, nulls together.

    A frequent label's rows are dealt over ``SALTS`` keys; its sum is there once for each.
    """
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    sums = coded.groupBy("label").agg(whole.alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = coded.withColumn("s", F.pmod(F.xxhash64("code"), F.lit(SALTS)).cast("int"))
    return (salted.join(sums, salted["label"].eqNullSafe(sums["of"]) & (salted["s"] == sums["salt"]))
            .select(*coded.columns, "label_error"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"), label="label")
    hashes = F.create_map(*[x for d, b in books.items() for x in (F.lit(d), F.lit(digest(b)))]) if books else None
    out = with_label_error(coded)
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                      (hashes[F.col("dim")] if books else F.lit("")).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """For vectors of one length: each round's assignment and codebook are a table of its own."""
    nearest = """a{0} AS MATERIALIZED (
  SELECT vec_id, part, any_value(x) AS x, any_value(label) AS label, min(d) // 16 AS error, min(d) % 16 AS entry
  FROM (SELECT vec_id, part, x, label, 16 * list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, e)]) + entry AS d
        FROM parts JOIN b{0} USING (part)) GROUP BY vec_id, part)"""
    update = """s{0} AS (
  SELECT part, entry, i, sum(x[i])::BIGINT AS t, count(*) AS n FROM a{0}, (SELECT unnest(range(1, (SELECT any_value(len(x)) FROM parts) + 1)) AS i)
  GROUP BY part, entry, i),
b{1} AS MATERIALIZED (
  SELECT part, b{0}.entry, coalesce(m.e, b{0}.e) AS e FROM b{0} LEFT JOIN (
    SELECT part, entry, list((t - (t % n + n) % n) // n ORDER BY i) AS e FROM s{0} GROUP BY part, entry) AS m USING (part, entry))"""
    steps = [x for r in range(ROUNDS) for x in (nearest.format(r), update.format(r, r + 1))] + [nearest.format(ROUNDS)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, [floor(4096 * c::DOUBLE)::BIGINT FOR c IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS x FROM kept, (SELECT unnest(range(8)) AS part)),
b0 AS MATERIALIZED (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS e FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),
{(", " + chr(10)).join(steps)},
rows AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
         FROM a{ROUNDS} GROUP BY vec_id),
labels AS (SELECT label, sum(error)::BIGINT AS label_error FROM rows GROUP BY label),
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM rows JOIN labels ON rows.label IS NOT DISTINCT FROM labels.label, books
"""


OP13_SQL = _op13_sql()
