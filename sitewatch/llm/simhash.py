"""SimHash near-duplicates by a binary trie self-join (operator 8).

Fingerprints: words are what stands between ASCII white space, A-Z in lower
case; h is the XXH64 of each ``shingle`` words in a row; a bit is 1 if more than
half of all h have it.  Equal fingerprints are one node from the start.

Links (at most ``distance`` differing bits): the 64 bits fall into distance + 1
blocks, so two linked fingerprints agree in one block at least.  The fingerprints
that agree in a block form a trie; its node pairs are traversed together from the
root, differing bits add up, and a pair is left once they exceed the budget, or
once all its leaves are in one component already.  A trie far above the mean
size is split into parts by hash, and each pair of parts is a task of its own.
A task reports its components as links to their smallest member, never all
pairs; alternating stars over those links give the components of the whole.

Defined cases: null and empty texts have no words and fingerprint zero, and are
linked like any other; a null doc_id is never a component's id unless no other
is in it; repeated rows are rows of the same component; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.session import materialize

from .common import free_name, in_arrow, table

SHINGLE, DISTANCE, SEED = 4, 4, 42
PART = 8192                # fingerprints of one trie task, or four times the mean if that is more
TASK_ROWS = 100_000        # fingerprints that a Python worker holds at a time, beside one whole trie
LEAF = 64                  # node pairs with so few pairs of leaves are compared at once


def shingle_hashes(text: str, shingle: int = SHINGLE) -> list[int]:
    words = text.encode().lower().split()       # bytes: A-Z and ASCII white space only
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.append(0, ends[:-1])[:len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]


def _majority(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """Fingerprints of documents with so many hashes each (one at least)."""
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.cumsum([0, *sizes[:-1]])
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.array(sizes)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    docs: list[int] = []
    sizes: list[int] = []
    for i, t in enumerate(texts):
        if t and (h := shingle_hashes(t, shingle)):
            hashes += h
            docs.append(i)
            sizes.append(len(h))
        if docs and (len(hashes) > 200_000 or i == len(texts) - 1):
            out[docs] = _majority(hashes, sizes)
            hashes, docs, sizes = [], [], []
    if docs:
        out[docs] = _majority(hashes, sizes)
    return out


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """``df`` without ``text`` and with ``out``: the fingerprint as a signed long."""
    keep = [c for c in df.columns if c.lower() not in (text.lower(), out.lower())]
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(free_name(df, "text_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(len(keep)).to_pylist(), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(fp)], names=[*keep, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]]
    return in_arrow(given, run, ", ".join([*fields, f"`{out}` long"]))


class _Forest:
    """Components of numbered leaves: ``label`` is the smallest number in each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> bool:
        changed = False
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return changed
            changed = True
            i, j = i[apart], j[apart]
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
            self.label = parent[self.label]


def _cross(lo1, n1, lo2, n2):
    """All pairs of members of two ranges, for many pairs of ranges."""
    total = n1 * n2
    at = np.repeat(np.cumsum(total) - total, total)
    k = np.arange(len(at)) - at
    width = np.repeat(n2, total)
    return np.repeat(lo1, total) + k // width, np.repeat(lo2, total) + k % width


def trie_components(fp: np.ndarray, roots: np.ndarray, budget: int) -> np.ndarray:
    """Labels (smallest position) of the components linked within pairs of ranges.

    ``fp`` (unsigned) rises within each range; a row of ``roots`` is lo1, hi1, lo2, hi2: a
    trie against another, or against itself.
    """
    forest = _Forest(len(fp))
    if not len(roots):
        return forest.label
    # neighbours first: what they link need not be visited
    inside = np.zeros(len(fp), dtype=bool)
    inside[np.concatenate([np.arange(lo, hi - 1) for lo, hi, lo2, _ in roots if lo == lo2 and hi > lo + 1] or [np.zeros(0, int)])] = True
    i = np.flatnonzero(inside)
    close = np.bitwise_count(fp[i] ^ fp[i + 1]) <= budget if len(i) else np.zeros(0, bool)
    forest.join(i[close], i[close] + 1)
    ones: dict[int, np.ndarray] = {}
    changes = np.append(0, np.cumsum(forest.label[1:] != forest.label[:-1]))
    stale = False
    levels: dict[int, list[np.ndarray]] = {63: [np.column_stack([roots, np.zeros(len(roots), dtype=np.int64)])]}
    while levels:
        bit = min(levels)                       # deepest first: few node pairs wait
        pairs = levels[bit].pop()
        if not levels[bit]:
            del levels[bit]
        if len(pairs) > 65536:
            levels.setdefault(bit, []).append(pairs[65536:])
            pairs = pairs[:65536]
        lo1, hi1, lo2, hi2, used = pairs.T
        n1, n2 = hi1 - lo1, hi2 - lo2
        if stale and (n1 * n2).sum() > len(fp):
            changes, stale = np.append(0, np.cumsum(forest.label[1:] != forest.label[:-1])), False
        one = (changes[hi1 - 1] == changes[lo1]) & (changes[hi2 - 1] == changes[lo2]) & (forest.label[lo1] == forest.label[lo2])
        pairs, n1, n2 = pairs[~one], n1[~one], n2[~one]
        leaf = (n1 * n2 <= LEAF) | (bit < 0)
        if leaf.any():
            a, b = _cross(pairs[leaf, 0], n1[leaf], pairs[leaf, 2], n2[leaf])
            ok = forest.label[a] != forest.label[b]
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= budget
            stale |= forest.join(a[ok], b[ok])
        pairs = pairs[~leaf]
        if not len(pairs):
            continue
        if bit not in ones:
            ones[bit] = np.append(0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64))
        lo1, hi1, lo2, hi2, used = pairs.T
        mid1, mid2 = hi1 - (ones[bit][hi1] - ones[bit][lo1]), hi2 - (ones[bit][hi2] - ones[bit][lo2])
        same = (lo1 == lo2) & (hi1 == hi2)
        nxt = np.concatenate([np.column_stack(x) for x in (
            (lo1, mid1, lo2, mid2, used), (mid1, hi1, mid2, hi2, used), (lo1, mid1, mid2, hi2, used + 1),
            *([(mid1[~same], hi1[~same], lo2[~same], mid2[~same], used[~same] + 1)]))])
        lo1, hi1, lo2, hi2, used = nxt.T
        nxt = nxt[(hi1 > lo1) & (hi2 > lo2) & (used <= budget) & ~((lo1 == lo2) & (hi1 == lo1 + 1) & (hi2 == hi1))]
        if len(nxt):
            levels.setdefault(bit - 1, []).append(nxt)
    return forest.label


def _tasks(frame: dict[str, np.ndarray], budget: int) -> pa.RecordBatch:
    """Links of whole tasks: rows of (block, value, a, b, side, fingerprint)."""
    fp = frame["fp"].view(np.uint64)
    keys = [frame[c] for c in ("block", "value", "a", "b")]
    order = np.lexsort((fp, frame["side"], *reversed(keys)))
    fp, side = fp[order], frame["side"][order]
    keys = [k[order] for k in keys]
    new = np.zeros(len(fp), dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    cut = new.copy()
    cut[1:] |= side[1:] != side[:-1]
    cut[:1] = new[:1] = True
    lo = np.flatnonzero(cut)
    hi = np.append(lo[1:], len(fp))
    roots = np.column_stack([lo, hi, lo, hi])
    cross = keys[2][lo] != keys[3][lo]
    first = new[lo]
    pairs = np.flatnonzero(cross[:-1] & first[:-1] & ~first[1:])
    roots = np.concatenate([roots[~cross], np.column_stack([lo[pairs], hi[pairs], lo[pairs + 1], hi[pairs + 1]])])
    label = trie_components(fp, roots, budget)
    i = np.flatnonzero(label != np.arange(len(fp)))
    out = fp.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(out[i]), pa.array(out[label[i]])], names=["u", "v"])


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): links between the distinct fingerprints ``fp`` of ``nodes`` that join what is linked."""
    blocks = distance + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    n = nodes.count()
    most = max(PART, 4 * ceil(n / 2 ** (edges[1] - edges[0])))
    value = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1).cast("long"))
             for lo, hi in zip(edges, edges[1:])]
    dealt = nodes.select("fp", F.posexplode(F.array(*value)).alias("block", "value"))
    sizes = dealt.groupBy("block", "value").count().where("count > 1")
    rows = (dealt.join(sizes, ["block", "value"])
            .withColumn("parts", F.ceil(F.col("count") / most).cast("int"))
            .withColumn("side", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("block", "value", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "fp"))
    key = ["block", "value", "a", "b"]
    tasks = nodes.sparkSession.sparkContext.defaultParallelism
    tasks = max(tasks, ceil(blocks * n / TASK_ROWS), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append({c: batch.column(c).to_numpy() for c in (*key, "side", "fp")})
            size += batch.num_rows
            if size >= TASK_ROWS:
                frame = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                # the last task may go on in the next batch
                tail = np.ones(size, dtype=bool)
                for c in key:
                    tail &= frame[c] == frame[c][-1]
                if not tail.all():
                    yield _tasks({c: x[~tail] for c, x in frame.items()}, distance)
                held = [{c: x[tail] for c, x in frame.items()}]
                size = int(tail.sum())
        if size:
            yield _tasks({c: np.concatenate([h[c] for h in held]) for c in held[0]}, distance)

    return in_arrow(rows, run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) that is not its component's smallest.

    Alternating large and small stars; each round is a table in the shared folder.
    """
    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while before != (now := state(e)):
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return e.select("u", F.col("v").alias("root"))


def classes(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) for every distinct ``fp`` of ``rows``."""
    nodes = materialize(rows.select("fp").distinct(), "fingerprints")
    star = components(links(nodes, distance))
    return nodes.join(star, nodes["fp"] == star["u"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``df``."""
    docs = with_fingerprint(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")),
                            shingle=shingle).withColumnRenamed("fingerprint", "fp")
    docs = materialize(docs, "simhash")
    roots = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes(docs, distance), "fp"), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             distance: int = DISTANCE) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row of smallest doc_id stays.

    Rows that share id and text are one row here; null ids come last.
    """
    key = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"),
                   F.xxhash64(F.col(f"`{text}`")).alias("h1"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("h2"))
    docs = materialize(with_fingerprint(df.select(key.alias("key"), F.col(f"`{text}`").alias("text")), shingle=shingle)
                       .withColumnRenamed("fingerprint", "fp"), "simhash")
    roots = docs.groupBy("fp").agg(F.min("key").alias("key")).join(classes(docs, distance), "fp")
    mine, theirs = ([free_name(df, f"{of}_{x}") for x in ("id", "h1", "h2")] for of in ("row", "kept"))
    stay = roots.groupBy("root").agg(F.min("key").alias("key")).select(*[F.col(f"key.{x}").alias(n) for x, n in zip(("id", "h1", "h2"), theirs)])
    rows = df.withColumns(dict(zip(mine, (F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`")), F.xxhash64(F.lit(1), F.col(f"`{text}`"))))))
    same = F.col(mine[0]).eqNullSafe(F.col(theirs[0])) & (F.col(mine[1]) == F.col(theirs[1])) & (F.col(mine[2]) == F.col(theirs[2]))
    return rows.join(stay, same, "left_semi").dropDuplicates(mine).select(*[F.col(f"`{c}`") for c in df.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
