"""Line dedup with content-defined chunks of lines (operator 10).

A text is cut into lines at line ends; the sentences of a line count as so many lines
(cut behind the marks of ``BOUNDARY``), and so do the parts of a sentence of more than
``LONG`` bytes (cut behind words, or behind letters where no blanks are, by the hash of
what stands there).  Empty lines count for nothing.

A polynomial hash rolls over the hashes of the lines and of what stands between them:
at each line it covers that line and the next ones, two at least and as many as make
``MIN_BYTES``.  Where a window of lines occurs again anywhere, the chunk goes on; it
begins and ends where the rolling hash is that of no other place.  So a chunk's
boundaries depend on the lines beside them alone, come back after a shift, and a
repeated chunk is found whole, wherever it stands.  A chunk has two lines or more: a
lone common sentence stays.

A window is removed everywhere but at its first place (smallest doc_id, then place).
Windows of a document that lie alike in one other make a chunk, and its bytes are
compared with those at that place first; a line goes if a removed chunk covers it, so
each line stays somewhere.  Hashes only say what to compare: a
collision may keep a copy, and never removes anything else.

Windows are counted by hash alone, as partial counts.  A Bloom filter of the repeated
hashes (bounded in size) dismisses the others where they lie; the texts that are moved are
those with something to compare or to remove.  No place gathers a frequent
window's occurrences other than as a partial minimum and count, and joins on a frequent
hash can be split.

Defined cases: null texts stay null and empty ones empty; a null doc_id comes after
all others; rows that share id and text are one document and are treated alike;
extra columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.operators.bloom import bloom_filter, may_hold
from sitewatch.session import materialize

from .common import in_arrow, table
from .decontam import span_hashes

MIN_BYTES = 40                          # of a window of lines
LONG, WORDS, LETTERS = 128, 7, 16       # bytes of a sentence that is cut, mean words and letters between cuts
# a line end, marks of sentences (with quotes and brackets that close them) before a blank, or of scripts that set none
BOUNDARY = re.compile(rb"""\n|((?:[.!?]|\xe2\x80\xa6|\xd8\x9f|\xdb\x94|\xe0\xa5\xa4|\xd6\x89)["')\]]*) """
                      rb"|((?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)+(?:\xe3\x80\x8d|\xe3\x80\x8f|\xe2\x80\x9d)*) ?")
WORD = re.compile(rb"[^ ]+")
LETTER = re.compile(rb"[^\x80-\xbf][\x80-\xbf]*")
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BETWEEN, LAST, MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
KEY = ["id", "h1"]                      # of a document: its id and a hash of its text
MARKS, CLOSING, BLANK, LINE_END = np.zeros(256, bool), np.zeros(256, bool), 0x20, 0x0A
MARKS[list(b".!?")] = CLOSING[list(b"\"')]")] = True
LONG_MARKS = (b"\xe2\x80\xa6", b"\xd8\x9f", b"\xdb\x94", b"\xe0\xa5\xa4", b"\xd6\x89")      # those of BOUNDARY beside them
UNSET = (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f")                              # those that need no blank


def lines(data: bytes) -> tuple[array, array]:
    """Starts and ends of the lines, sentences and parts of long ones, in order; none is empty."""
    starts, ends = array("q"), array("q")
    at = 0
    for m in BOUNDARY.finditer(data):
        end = m.end(m.lastindex) if m.lastindex else m.start()
        if end > at:
            _add(data, at, end, starts, ends)
        at = m.end()
    if len(data) > at:
        _add(data, at, len(data), starts, ends)
    return starts, ends


def _add(data: bytes, start: int, end: int, starts: array, ends: array) -> None:
    """A line; a long one in parts, cut behind words, and in words that are long behind letters, by what stands there."""
    if end - start > LONG:
        for m in WORD.finditer(data, start, end):
            a, b = m.span()
            if b - a > LONG:
                before = a
                for x in LETTER.finditer(data, a, b):
                    if x.end() < b and xxhash.xxh64_intdigest(data[before:x.end()]) % LETTERS == 0:
                        starts.append(start)
                        ends.append(x.end())
                        start = x.end()
                    before = x.start()
            elif b < end and _cuts(data[a], data[(a + b) // 2], data[b - 1], b - a):
                starts.append(start)
                ends.append(b)
                start = b + 1
    if start < end:
        starts.append(start)
        ends.append(end)


def _cuts(first, middle, last, size):
    """Whether a long line is cut behind a word of these bytes and this size; also for arrays of them."""
    return (first * 167 + middle * 59 + last * 23 + size * 101) % WORDS == 0


def _lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts behind one another with a line end behind each, where each begins, and starts and ends of all ``lines``."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    blank = np.flatnonzero(data == BLANK)
    blank = blank[blank > 0]
    # what stands before a blank and the quotes and brackets there
    before = blank - 1
    closing = np.flatnonzero(CLOSING[data[before]])
    while len(closing):
        before[closing] -= 1
        closing = closing[before[closing] >= 0]
        closing = closing[CLOSING[data[before[closing]]]]
    mark = (before >= 0) & MARKS[data[np.maximum(before, 0)]]
    for m in LONG_MARKS:
        last = np.flatnonzero(data[before] == m[-1])        # few: in ASCII none (a place before the text is a line end's)
        here = before[last] >= len(m) - 1
        for i, x in enumerate(m[::-1][1:], 1):
            here &= data[np.maximum(before[last] - i, 0)] == x
        mark[last] |= here
    at = np.sort(np.concatenate([np.flatnonzero(data == LINE_END), blank[mark]]))
    starts, ends = np.concatenate([[0], at[:-1] + 1]), at
    some = ends > starts
    starts, ends = starts[some], ends[some]
    # texts with marks that need no blank, and long lines with long words, go through lines()
    odd = np.array([any(m in t for m in UNSET) for t in texts], dtype=bool)
    long = np.flatnonzero((ends - starts > LONG) & ~odd[np.searchsorted(begin, starts, side="right") - 1])
    words, behind = _words(data, starts[long], ends[long])
    of = long[np.searchsorted(ends[long], behind)]
    odd[np.searchsorted(begin, words[behind - words > LONG], side="right") - 1] = True
    cut = behind[(behind < ends[of]) & _cuts(*(data[x].astype(np.int64) for x in (words, (words + behind) // 2, behind - 1)), behind - words)]
    starts, ends = np.sort(np.concatenate([starts, cut + 1])), np.sort(np.concatenate([ends, cut]))
    some = (ends > starts) & ~odd[np.searchsorted(begin, starts, side="right") - 1]
    starts, ends = [starts[some]], [ends[some]]
    for i in np.flatnonzero(odd).tolist():
        for x, of in zip(lines(texts[i]), (starts, ends)):
            of.append(np.array(x, dtype=np.int64) + begin[i])
    starts, ends = np.sort(np.concatenate(starts)), np.sort(np.concatenate(ends))
    return data, begin, starts.astype(np.int64), ends.astype(np.int64)


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in some lines, between blanks."""
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[1:] = (np.cumsum(step[:-1], dtype=np.int8) > 0) & (data != BLANK)
    edges = np.flatnonzero(inside[1:] != inside[:-1])       # behind each text a line end lies outside
    return edges[::2], edges[1::2]


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, rolling hash) of the window of lines at each line that has one."""
    data, begin, starts, ends = _lines_of(texts)
    n = len(starts)
    # the line at which a window ends: the next one at least
    upto = np.maximum(np.arange(n) + 1, np.searchsorted(ends, starts + MIN_BYTES))
    of = np.searchsorted(begin, starts, side="right") - 1
    at = np.flatnonzero(upto < n)
    at = at[of[upto[at]] == of[at]]
    if not len(at):
        return at, at, at, np.zeros(0, dtype=np.uint64)
    line = span_hashes(data, starts, ends)
    # what stands between lines is short: its bytes alone, behind one another
    size = starts[1:] - ends[:-1]
    upto_size = np.cumsum(size)
    gaps = data[np.repeat(ends[:-1] + size - upto_size, size) + np.arange(upto_size[-1])]
    between = span_hashes(gaps, upto_size - size, upto_size)
    power, inverse = _powers(n)
    sums = np.zeros(n, dtype=np.uint64)
    np.cumsum((line[:-1] + between * BETWEEN) * power[:n - 1], out=sums[1:])
    to = upto[at]
    rolled = (sums[to] - sums[at]) * inverse[at] + line[to] * power[to - at] * LAST
    rolled ^= rolled >> np.uint64(31)
    return of[at], starts[at] - begin[of[at]], ends[to] - starts[at], rolled * MIX


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, rolling hash) of the windows of one text."""
    return windows_of([data])[1:]


_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse, mod 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, BASE_INVERSE)):
            x = np.full(max(n, 1 << 12), base, dtype=np.uint64)
            x[0] = 1
            _POWERS[i] = np.cumprod(x, dtype=np.uint64)
    return _POWERS


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, h1, ws): the windows (start, len, a) of each document (id, h1, data)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, start, size, rolled = windows_of([x or b"" for x in batch.column(2).to_pylist()])
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)),
                                                pa.array(rolled.view(np.int64))], names=["start", "len", "a"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(ends), cells)], names=[*KEY, "ws"])

    return in_arrow(docs, run, f"id {kind}, h1 long, ws array<struct<start: int, len: int, a: long>>")


def chunks_of(hits: DataFrame) -> DataFrame:
    """(id, h1, start, len, of_id, of_h1, of_start): runs of windows (start, len, of_id, of_h1, of_start) of a
    document's ``ws`` (in order) that lie alike in one other document, or in this one at another place."""
    kind = hits.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            start, size, of_id, of_h1, of_start = lists.flatten().flatten()
            a, n, f, h = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (start, size, of_start, of_h1))
            who = of_id.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.ones(len(a), dtype=bool)
            if len(a):
                new[1:] = ((row[1:] != row[:-1]) | (who[1:] != who[:-1]) | (h[1:] != h[:-1]) | (a[1:] - f[1:] != a[:-1] - f[:-1])
                           | (a[1:] > a[:-1] + n[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(a))[:len(first)] - 1
            at = pa.array(row[first])
            own = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(a[first].astype(np.int32)), pa.array((a[last] + n[last] - a[first]).astype(np.int32)),
                 of_id.take(own), pa.array(h[first]), pa.array(f[first].astype(np.int32))], names=[*KEY, "start", "len", "of_id", "of_h1", "of_start"])

    return in_arrow(hits, run, f"id {kind}, h1 long, start int, len int, of_id {kind}, of_h1 long, of_start int")


def remove_repeated_chunks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``df`` with repeated chunks taken out of ``text``; ``removed`` names a column for their number."""
    t = F.col(f"`{text}`")
    others = [c for c in df.columns if c not in (text, removed)]
    docs = df.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(t).alias("h1"), t.cast("binary").alias("data"),
                     F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row"))
    found = materialize(occurrences(docs.select(*KEY, "data")), "windows")
    flat = found.select(*KEY, F.explode("ws").alias("w")).select(*KEY, "w.start", "w.len", "w.a")
    again = materialize(flat.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"), "repeated")
    hits = may_hold(flat, ["a"], bloom_filter(again, ["a"]))       # one that is not repeated has its first place where it is
    place = F.struct(F.col("id").isNull().alias("none"), *KEY, "start")
    first = hits.groupBy("a").agg(F.min(place).alias("f"))
    later = hits.join(first, "a").where(~place.eqNullSafe(F.col("f")))
    later = later.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct(        # as many as the document has
        "start", "len", F.col("f.id").alias("of_id"), F.col("f.h1").alias("of_h1"), F.col("f.start").alias("of_start")))).alias("ws"))
    chunks = materialize(chunks_of(later), "chunks")

    # the bytes at the first places, from the documents that hold some
    asked = ["of_id", "of_h1", "of_start", "len"]
    holding = chunks.select(*asked).distinct().groupBy("of_id", "of_h1").agg(F.collect_list(F.struct("of_start", "len")).alias("ws"))
    held = bloom_filter(chunks.select(F.col("of_id").alias("id"), F.col("of_h1").alias("h1")).distinct(), KEY)
    cut = _met(may_hold(docs.select(*KEY, "data"), KEY, held).dropDuplicates(KEY), holding, "inner")
    bytes_ = cut.select("of_id", "of_h1", "data", F.explode("ws").alias("w")).select(
        "of_id", "of_h1", "w.of_start", "w.len", F.substring("data", F.col("w.of_start") + 1, F.col("w.len")).alias("bytes"))
    b = bytes_.withColumnsRenamed({c: f"b_{c}" for c in asked})
    same = chunks["of_id"].eqNullSafe(b["b_of_id"]) & (chunks["of_h1"] == b["b_of_h1"]) & (chunks["of_start"] == b["b_of_start"]) & (chunks["len"] == b["b_len"])
    compared = chunks.join(b, same).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "len", "bytes"))).alias("ws"))
    compared = compared.withColumnsRenamed({"id": "of_id", "h1": "of_h1"})

    # only documents with something to remove are moved
    maybe = bloom_filter(chunks.select(*KEY).distinct(), KEY)
    gone = F.filter("ws", lambda w: F.substring("data", w["start"] + 1, w["len"]) == w["bytes"])
    touched = _met(may_hold(docs, KEY, maybe), compared, "left").select("row", "data", F.coalesce(gone, F.array().cast(_SPANS)).alias("gone"))
    rest = may_hold(docs, KEY, maybe, absent=True).select("row", F.col("data").cast("string").alias("text"), F.lit(0).alias("n"))
    out = _cut(touched).unionByName(rest)
    cols = [F.col("text").alias(text) if c == text else F.col(f"row.c{others.index(c)}").alias(c) for c in df.columns if c != removed]
    return out.select(*cols, *([F.col("n").alias(removed)] if removed else []))


_SPANS = "array<struct<start: int, len: int, bytes: binary>>"


def _cut(touched: DataFrame) -> DataFrame:
    """(row, text, n): ``data`` without the windows (start, len) ``gone``, and the number of chunks that they make."""
    data, gone = F.col("data"), F.col("gone")
    # what stays: between the end of one removed window, its separator included, and the start of the next
    stays = touched.select("row", "data", "gone", F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: _behind(data, g["start"] + g["len"]))).alias("ends"),
                           F.concat(F.transform(gone, lambda g: g["start"]), F.array(F.octet_length(data))).alias("starts"))
    ends, starts = F.col("ends"), F.col("starts")
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(data, a + 1, F.greatest(b - a, F.lit(0))).cast("string"))
    # windows that overlap or touch are one chunk
    apart = F.size(F.filter(F.zip_with(ends, starts, lambda a, b: b > a), lambda x: x))
    outer = (F.element_at(starts, 1) > 0).cast("int") + (F.element_at(ends, -1) < F.octet_length(data)).cast("int")
    some = F.size(gone) > 0
    return stays.select("row", F.when(some, F.array_join(pieces, "")).otherwise(data.cast("string")).alias("text"),
                        F.when(some, apart - outer + 1).otherwise(F.lit(0)).alias("n"))


def _met(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Documents with what was found of them (of_id, of_h1, ...); null ids are equal."""
    return docs.join(found, docs["id"].eqNullSafe(found["of_id"]) & (docs["h1"] == found["of_h1"]), how)


def _behind(data, end):
    """The place after a chunk's separator, a line end or a blank; in scripts without blanks there may be none."""
    return end + F.substring(data, end + 1, F.lit(1)).isin(bytearray(b"\n"), bytearray(b" ")).cast("int")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="removed_chunks")
