"""Benchmark decontamination by a prefix-filtered set join (operator 11).

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.
An item's windows are its runs of ``WORDS`` words; an item of fewer words is one
window.  A window is a set of shingles of ``SHINGLE`` words (all of it, where it is
shorter) with their places in it.  A document holds the window only if it holds every
one of its shingles, so of the shingles in order of rarity a prefix of one is enough:

1. the benchmark's shingles are counted over all documents;
2. a window's necessary token is its rarest shingle (ties: the first);
3. a document's shingles join these tokens.  A match at word p of a token that stands
   at word o of a window can only be the window at p - o: it goes unless that and the
   window's length fit into the document (positional and length bound);
4. the window's words are compared there, by their hashes and then byte by byte.

Equal words have equal hashes, so no occurrence is lost; the comparison of bytes lets
none through that is none.  The benchmark is the query set: its items go to the tasks
in blocks of at most ``BLOCK_BYTES`` of words (an item longer than that in overlapping
parts), however many there are, and each block reads the documents twice.  Documents
are never shuffled or gathered by a word: a passage that every document holds costs
each task its own rows alone.  Where there are several blocks, their findings meet by
document.

Defined cases: null and wordless texts have no words and no hits; an item without
words has no windows; a null item_id counts as the empty one; items that share an id
are one item; repeated rows of documents are a row each; a null doc_id stays null;
other columns of either table are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.session import materialize

from .common import in_arrow, table

WORDS, SHINGLE = 10, 3
BLOCK_BYTES = 2 << 20       # of the items' words that a task holds together
SLICE = 1 << 20             # bytes hashed at a time
PAIRS = 1 << 18             # matches compared at a time
BITS = 20                   # of the table that most shingles are dismissed by

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IN_WORD = np.ones(256, dtype=bool)
for a, b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    IN_WORD[a:b + 1] = False
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
PLACES = np.array([pow(0xBF58476D1CE4E5B9, j + 1, 1 << 64) for j in range(WORDS)], dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(LOWER.tobytes()))


@dataclass
class Words:
    """The words of several texts behind one another; text d has words first[d] to first[d + 1]."""
    data: np.ndarray        # bytes in lower case, a line end behind each text
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[1:] = IN_WORD[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])     # the last byte is a line end: an even number
        starts, ends = edges[::2], edges[1::2]
        behind = np.cumsum(np.array([0] + [len(t) + 1 for t in texts], dtype=np.int64))
        return cls(data, starts, ends, np.searchsorted(starts, behind))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.starts, self.ends)

    def joined(self) -> tuple[bytes, np.ndarray]:
        """The words with one blank behind each, and where each begins there."""
        begin = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])
        inside = IN_WORD[self.data]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        return np.where(inside, self.data, np.uint8(32))[keep].tobytes(), begin


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and apart."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(out):
        j = int(np.searchsorted(ends, starts[i] + SLICE, side="right"))
        if j == i:      # one span of more than a slice
            out[i], j = _long_hash(data[starts[i]:ends[i]]), i + 1
        else:
            a = starts[i]
            sums = _sums(data[a:ends[j - 1]])
            s = starts[i:j] - a
            out[i:j] = (sums[ends[i:j] - a] - sums[s]) * _powers()[1][s]
        i = j
    out ^= out >> np.uint64(32)
    return out * MIX


_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of BASE and of its inverse, mod 2^64, for the places of a slice."""
    if not _POWERS:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(SLICE + 1, base, dtype=np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x, dtype=np.uint64))
    return _POWERS


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the bytes times the powers of their places."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers()[0][:len(data)], out=out[1:])
    return out


def _long_hash(data: np.ndarray) -> int:
    total = 0
    for at in range(0, len(data), SLICE):
        total += int(_sums(data[at:at + SLICE])[-1]) * pow(BASE, at, 1 << 64)
    return total % (1 << 64)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, the runs that cross texts included."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += hashes[j:j + n] * PLACES[j]
    out ^= out >> np.uint64(29)
    return out * MIX


class Tokens:
    """A set of shingle hashes, in order, with a small table that dismisses most others."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.unique(hashes)
        self.seen = np.zeros(1 << BITS, dtype=bool)
        self.seen[self.keys >> np.uint64(64 - BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the hashes, place among the keys) of those in the set."""
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - BITS)])
        k = np.searchsorted(self.keys, hashes[at])
        ok = (k < len(self.keys)) & (self.keys[np.minimum(k, len(self.keys) - 1)] == hashes[at])
        return at[ok], k[ok]


class Block:
    """The windows of some items, each once."""

    def __init__(self, items: list[tuple[str, bytes]]):
        ids = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(ids)}
        words = Words.of([t for _, t in items])
        self.ids, self.hashes = ids, words.hashes()
        self.text, self.begin = words.joined()
        seen: dict[bytes, int] = {}
        at, size, owners = [], [], []
        for d, (item, _) in enumerate(items):
            a, b = int(words.first[d]), int(words.first[d + 1])
            n = min(WORDS, b - a)
            for s in range(a, b - n + 1 if n else a):
                w = seen.setdefault(self._bytes(s, n), len(at))
                if w == len(at):
                    at.append(s)
                    size.append(n)
                    owners.append(set())
                owners[w].add(number[item])
        self.at, self.size = np.array(at, dtype=np.int64), np.array(size, dtype=np.int64)
        self.owners = [sorted(x) for x in owners]
        self.kinds = {n: np.flatnonzero(np.minimum(self.size, SHINGLE) == n) for n in sorted({min(x, SHINGLE) for x in size})}

    def _bytes(self, word: int, n: int) -> bytes:
        return self.text[self.begin[word]:self.begin[word + n] - 1]

    def window(self, w: int) -> bytes:
        return self._bytes(int(self.at[w]), int(self.size[w]))

    def tokens(self) -> dict[int, Tokens]:
        """By length, all shingles of all windows."""
        return {n: Tokens(np.concatenate([h for _, _, h in self.shingled(n)])) for n in self.kinds}

    def shingled(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place in the window, which of the kind's windows reach so far, their shingles there)."""
        windows, every = self.kinds[n], shingles(self.hashes, n)
        for o in range(WORDS - n + 1 if n == SHINGLE else 1):
            has = np.flatnonzero(self.size[windows] - n >= o)
            yield o, has, every[self.at[windows[has]] + o]


class Prefixes:
    """By length, the necessary tokens and for each the windows and places that it stands for."""

    def __init__(self, block: Block, tokens: dict[int, Tokens], counts: dict[int, np.ndarray]):
        self.kinds = {}
        for n, windows in block.kinds.items():
            least = np.full(len(windows), np.iinfo(np.int64).max)
            place = np.zeros(len(windows), dtype=np.int64)
            key = np.zeros(len(windows), dtype=np.uint64)
            for o, has, h in block.shingled(n):
                c = counts[n][np.searchsorted(tokens[n].keys, h)]
                better = c < least[has]
                put = has[better]
                least[put], place[put], key[put] = c[better], o, h[better]
            found = Tokens(key)
            k = np.searchsorted(found.keys, key)
            order = np.argsort(k, kind="stable")
            first = np.searchsorted(k[order], np.arange(len(found.keys) + 1))
            self.kinds[n] = found, first, windows[order], place[order]


def _count(batches: Iterator[pa.RecordBatch], tokens: dict[int, Tokens]) -> Iterator[pa.RecordBatch]:
    counts = {n: np.zeros(len(t.keys), dtype=np.int64) for n, t in tokens.items()}
    for batch in batches:
        words = Words.of([x or b"" for x in batch.column(0).to_pylist()])
        hashes = words.hashes()
        for n, t in tokens.items():
            at, k = t.find(shingles(hashes, n))
            d = np.searchsorted(words.first, at, side="right") - 1
            counts[n] += np.bincount(k[at + n <= words.first[d + 1]], minlength=len(t.keys))
    for n, c in counts.items():
        k = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, dtype=np.int32)), pa.array(k.astype(np.int32)), pa.array(c[k])],
                                         names=["size", "k", "n"])


def matches(words: Words, block: Block, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window."""
    hashes, none = words.hashes(), np.zeros(0, dtype=np.int64)
    starts, windows = [none], [none]
    for n, (tokens, first, win, place) in prefixes.kinds.items():
        at, k = tokens.find(shingles(hashes, n))
        many = first[k + 1] - first[k]
        upto = np.cumsum(many)
        for lo, hi in _parts(upto, PAIRS):
            p, c = at[lo:hi], many[lo:hi]
            row = np.repeat(np.arange(hi - lo), c)
            post = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[k[lo:hi]], c)
            w, start = win[post], p[row] - place[post]
            d = np.searchsorted(words.first, p[row], side="right") - 1
            fits = (start >= words.first[d]) & (start + block.size[w] <= words.first[d + 1])
            w, start = w[fits], start[fits]
            for j in range(WORDS):
                o = np.minimum(j, block.size[w] - 1)
                same = hashes[start + o] == block.hashes[block.at[w] + o]
                w, start = w[same], start[same]
            starts.append(start)
            windows.append(w)
    start, window = np.concatenate(starts), np.concatenate(windows)
    if len(start):
        text, begin = words.joined()
        ends = begin[start + block.size[window]] - 1
        ok = np.fromiter((text[a:b] == block.window(w) for a, b, w in zip(begin[start].tolist(), ends.tolist(), window.tolist())),
                         dtype=bool, count=len(start))
        start, window = start[ok], window[ok]
    return start, window


def _parts(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs whose sums stay below ``most``, or of one; ``upto``: running sums."""
    lo = 0
    while lo < len(upto):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + most, side="right")))
        yield lo, hi
        lo = hi


def _search(batches: Iterator[pa.RecordBatch], block: Block, prefixes: Prefixes, every: bool) -> Iterator[pa.RecordBatch]:
    """A row for each document, or for each that is hit; columns id, k1, k2 and text."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        words = Words.of([x or b"" for x in batch.column(3).to_pylist()])
        start, window = matches(words, block, prefixes)
        d = np.searchsorted(words.first, start, side="right") - 1
        hits: list[list] = [[] for _ in range(batch.num_rows)]
        owners: list[set] = [set() for _ in range(batch.num_rows)]
        for x, w in zip(*(v.tolist() for v in _distinct(d, window))):
            owners[x].update(block.owners[w])
        step = np.zeros(len(words.starts) + 1, dtype=np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + block.size[window], -1)
        hit = np.cumsum(step)[:-1] > 0
        new = hit & ~np.concatenate([[False], hit[:-1]])
        docs = words.first[:-1]
        new[docs[docs < len(hit)]] |= hit[docs[docs < len(hit)]]      # a run ends with its text
        begins = np.flatnonzero(new)
        stop = np.zeros(len(hit) + 1, dtype=bool)
        stop[:-1] = ~hit | new
        stop[-1] = True
        stops = np.flatnonzero(stop)
        ends = stops[np.searchsorted(stops, begins + 1)]
        of = np.searchsorted(words.first, begins, side="right") - 1
        for x, a, b in zip(of.tolist(), (begins - words.first[of]).tolist(), (ends - words.first[of]).tolist()):
            hits[x].append({"start": a, "end": b})
        rows = np.arange(batch.num_rows) if every else np.unique(d)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(i).take(at) for i in range(3)]
            + [pa.array(np.diff(words.first)[rows], pa.int64()), pa.array([hits[i] for i in rows.tolist()], spans),
               pa.array([sorted(block.ids[o] for o in owners[i]) for i in rows.tolist()], pa.list_(pa.string()))],
            names=["id", "k1", "k2", "n_words", "hits", "items"])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[keep], b[keep]


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items with words, at most ``BLOCK_BYTES`` at a time; the driver holds a partition of items and a block."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("binary").alias("data"))
    block: list[tuple[str, bytes]] = []
    size = 0
    for item, data in rows.where("data is not null").toLocalIterator():
        words = words_of(bytes(data))
        a = 0
        while a < len(words):
            b, n = a, 0
            while b < len(words) and (n < BLOCK_BYTES or b - a < 2 * WORDS):
                n += len(words[b]) + 1
                b += 1
            if block and size + n > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((item, b" ".join(words[a:b])))
            size += n
            a = b if b == len(words) else b - WORDS + 1     # no window is lost between parts
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, hits, items) a document row.

    ``hits``: spans (start, end) of its word places inside windows, of each block without
    overlaps and in order; ``items``: the ids of the items with a window in it, in order.
    """
    spark = docs.sparkSession
    t = F.col(f"`{text}`")
    given = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"),
                        t.cast("binary").alias("data"))
    kind = given.schema["id"].dataType.simpleString()
    schema = f"id {kind}, k1 long, k2 long, n_words long, hits array<struct<start: long, end: long>>, items array<string>"
    out = None
    for items in item_blocks(benchmark, item_id, item_text):
        block = Block(items)
        tokens = block.tokens()
        shared = spark.sparkContext.broadcast(tokens)       # as many shingles as a block has words
        counts = {n: np.zeros(len(t.keys), dtype=np.int64) for n, t in tokens.items()}
        counted = in_arrow(given.select("data"), lambda it, s=shared: _count(it, s.value), "size int, k int, n long")
        for r in counted.groupBy("size", "k").agg(F.sum("n").alias("n")).collect():
            counts[r["size"]][r["k"]] = r["n"]
        state = spark.sparkContext.broadcast((block, Prefixes(block, tokens, counts)))
        first = out is None
        found = in_arrow(given, lambda it, s=state, e=first: _search(it, *s.value, every=e), schema)
        if first:
            out = found
            continue
        more = materialize(found, "contamination").dropDuplicates(["id", "k1", "k2"])
        more = more.select(F.col("id").alias("i"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("hits").alias("h"), F.col("items").alias("t"))
        none = F.array()
        out = (out.join(more, out["id"].eqNullSafe(more["i"]) & (out["k1"] == more["h1"]) & (out["k2"] == more["h2"]), "left")
               .select("id", "k1", "k2", "n_words",
                       F.array_sort(F.array_distinct(F.concat("hits", F.coalesce("h", none)))).alias("hits"),
                       F.array_sort(F.array_union("items", F.coalesce("t", none))).alias("items")))
        out = materialize(out, "contamination")
    if out is None:     # nothing to look for
        out = in_arrow(given, _words_alone, schema)
    return out.select(F.col("id").alias("doc_id"), "n_words", "hits", "items")


def _words_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = Block([])
    return _search(batches, block, Prefixes(block, {}, {}), every=True)


def words_hit(hits):
    """The number of places in spans that may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(F.array_sort(hits), zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
        F.greatest(a["upto"], s["end"]).alias("upto")), lambda a: a["n"])


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = words_hit(F.col("hits"))
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM ip),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) AS k),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM dp),
hit AS (SELECT doc_id, item_id, p, n FROM dw JOIN iw USING (n, s)),
places AS (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM places GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
