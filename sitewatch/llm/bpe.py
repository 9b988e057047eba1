"""Byte-level BPE encoding and decoding with DuckDB recursive queries (operator 1).

Each Spark task owns an in-memory DuckDB that holds the merge table
``(a, b) -> m`` derived from the rank file.  The pieces of the split pattern
that a slice of texts contains are loaded once per distinct piece as rows of
token positions; a recursive query contracts, per piece and round, the leftmost
pair of smallest rank until no pair is in the table.  Decoding joins the token
rows with the vocabulary and aggregates the bytes in order of position.

Defined cases: a null or empty text has no tokens and decodes to no bytes; an
empty table stays empty; repeated rows are encoded each; other columns, null
ones too, pass through unless named like the output column, which replaces it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, in_arrow, strings, table

SLICE_CHARS = 1 << 20      # of texts encoded together
SLICE_IDS = 256 << 10      # decoded together
KNOWN_CHUNKS = 300_000     # chunks a worker remembers; beyond it starts anew (only speed depends on it)
PIECE_BYTES = 512 << 10    # bytes of new pieces that one recursive query takes
MARKS = frozenset(".,!?")
ROUNDS = 24                # rounds of one recursive query; longer pieces go through several

_CONTRACT = """
WITH RECURSIVE state AS (
  SELECT s.w, s.pos, s.tok, s.npos, s.nxt, mm.m AS k, 0 AS round
  FROM start s LEFT JOIN merges mm ON mm.a = s.tok AND mm.b = s.nxt
  UNION ALL
  SELECT n.w, n.pos, n.tok, n.npos, n.nxt, CASE WHEN n.fresh THEN mm.m ELSE n.k END, n.round
  FROM (
    SELECT s.w, s.pos, CASE WHEN s.pos = b.at THEN b.m ELSE s.tok END AS tok,
           CASE WHEN s.pos = b.at THEN b.gnpos ELSE s.npos END AS npos,
           CASE WHEN s.pos = b.at THEN b.gnxt WHEN s.npos = b.at THEN b.m ELSE s.nxt END AS nxt,
           s.k, s.pos = b.at OR s.npos = b.at AS fresh, s.round + 1 AS round
    FROM state s JOIN (
      SELECT x.w, x.best >> 32 AS m, (x.best & 4294967295)::INT AS at, x.gone, g.npos AS gnpos, g.nxt AS gnxt
      FROM (SELECT w, min((k::BIGINT << 32) | pos) AS best, arg_min(npos, (k::BIGINT << 32) | pos) AS gone
            FROM state WHERE k IS NOT NULL AND round < {rounds} GROUP BY w) x
      JOIN state g ON g.w = x.w AND g.pos = x.gone
    ) b ON b.w = s.w
    WHERE s.pos <> b.gone
  ) n LEFT JOIN merges mm ON n.fresh AND mm.a = n.tok AND mm.b = n.nxt
)
SELECT s.w, s.pos, s.tok, s.round = {rounds} AS open
FROM state s JOIN (SELECT w, max(round) AS round FROM state GROUP BY w) l ON l.w = s.w AND l.round = s.round
ORDER BY s.w, s.pos
"""

# Long pieces, for which one contraction a round would be quadratic: a round
# contracts the leftmost occurrence of the smallest rank and, left to right, the
# next ones of that rank, as long as no contraction makes a pair of smaller rank
# with a neighbour (then the single contractions would turn there first, and so
# does the next round).  The result is the same.
_CONTRACT_RUNS = """
WITH pairs AS (
  SELECT w, pos, tok, lag(tok) OVER p AS prv, lead(tok) OVER p AS nxt, lead(tok, 2) OVER p AS nxt2,
         lag(tok, 2) OVER p AS prv2, row_number() OVER p AS i
  FROM state WINDOW p AS (PARTITION BY w ORDER BY pos)
), ranked AS (
  SELECT pairs.*, mm.m AS k, min(mm.m) OVER (PARTITION BY w) AS best
  FROM pairs LEFT JOIN merges mm ON mm.a = pairs.tok AND mm.b = pairs.nxt
), hits AS (
  SELECT *, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM ranked WHERE k = best
), chosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY i) AS nth FROM hits) WHERE nth % 2 = 1
), sided AS (
  SELECT *, CASE WHEN lag(i) OVER (PARTITION BY w ORDER BY i) = i - 2 THEN best ELSE prv END AS left_tok FROM chosen
), turns AS (
  SELECT s.w, min(s.i) AS upto FROM sided s
  LEFT JOIN merges l ON l.a = s.left_tok AND l.b = s.best
  LEFT JOIN merges r ON r.a = s.best AND r.b = s.nxt2
  WHERE l.m < s.best OR r.m < s.best GROUP BY s.w
), done AS (
  SELECT c.w, c.i, c.best FROM chosen c LEFT JOIN turns t ON t.w = c.w WHERE t.upto IS NULL OR c.i <= t.upto
)
SELECT r.w, r.pos, CASE WHEN d.i IS NULL THEN r.tok ELSE d.best END AS tok
FROM ranked r LEFT JOIN done d ON d.w = r.w AND d.i = r.i LEFT JOIN done e ON e.w = r.w AND e.i = r.i - 1
WHERE e.i IS NULL
"""


class Engine:
    """A DuckDB with the tables of one rank file, and the chunks encoded so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # \s of the pattern is Unicode white space
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cut = regex.compile(r"(?= \P{White_Space})")
        self.odd = re.compile(r" (?:\s|\Z)")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        rows = [(self.ranks.get(t[:i]), self.ranks.get(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t))]
        rows = np.array([x for x in rows if x[0] is not None and x[1] is not None], dtype=np.int32).reshape(-1, 3)
        self._load("merges", pa.table({n: pa.array(rows[:, i]) for i, n in enumerate("abm")}))
        ids = sorted(self.ranks, key=self.ranks.get)
        self._load("vocabulary", pa.table({"tok": pa.array([self.ranks[t] for t in ids], pa.int32()),
                                           "bytes": pa.array(ids, pa.binary())}))
        self.tokens = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()}
        self.raw: dict[str, bytes] = {}     # chunk -> its ids as int32 bytes
        self.led: dict[str, bytes] = {}     # the same for " " + chunk

    def _load(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _contract(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces as int32 bytes."""
        out: list[bytes] = []
        group: list[bytes] = []
        size = 0
        for p in [*pieces, None]:
            if group and (p is None or size + len(p) > PIECE_BYTES):
                out += self._contract_group(group)
                group, size = [], 0
            if p is not None:
                group.append(p)
                size += len(p)
        return out

    def _contract_group(self, pieces: list[bytes]) -> list[bytes]:
        lens = np.array([len(p) for p in pieces])
        tok = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ends = np.cumsum(lens)
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), lens)
        pos = (np.arange(len(tok)) - np.repeat(ends - lens, lens)).astype(np.int32)
        out: list[bytes] = [b""] * len(pieces)
        long = lens > 4 * ROUNDS
        if long.any():
            rows = long[w]
            lw, lpos, ltok = self._contract_long(w[rows], pos[rows], tok[rows])
            self._cut(out, lw, ltok)
            w, pos, tok = w[~rows], pos[~rows], tok[~rows]
        while len(w):
            last = np.append(w[1:] != w[:-1], True)
            self.con.register("start", pa.table({
                "w": w, "pos": pos, "tok": tok, "npos": pa.array(np.append(pos[1:], 0).astype(np.int32), mask=last),
                "nxt": pa.array(np.append(tok[1:], 0).astype(np.int32), mask=last)}))
            r = self.con.execute(_CONTRACT.format(rounds=ROUNDS)).fetchnumpy()
            self.con.unregister("start")
            still = np.asarray(r["open"], dtype=bool)
            w, pos, tok = (np.asarray(r[c]) for c in ("w", "pos", "tok"))
            self._cut(out, w[~still], tok[~still])
            w, pos, tok = w[still], pos[still], tok[still]
        return out

    def _contract_long(self, w, pos, tok):
        """The recursion of ``_CONTRACT_RUNS``, one statement a round so that old rounds are dropped."""
        self._load("state", pa.table({"w": w, "pos": pos, "tok": tok}))
        n = -1
        while n != (n := self.con.execute("SELECT count(*) FROM state").fetchone()[0]):
            self.con.execute(f"CREATE OR REPLACE TABLE state AS {_CONTRACT_RUNS}")
        r = self.con.execute("SELECT w, pos, tok FROM state ORDER BY w, pos").fetchnumpy()
        return (np.asarray(r[c]) for c in ("w", "pos", "tok"))

    @staticmethod
    def _cut(out: list[bytes], w: np.ndarray, tok: np.ndarray) -> None:
        if len(w):
            at = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            data, at4 = np.ascontiguousarray(tok, dtype=np.int32).tobytes(), np.append(at, len(w)) * 4
            for i, a, b in zip(w[at].tolist(), at4[:-1].tolist(), at4[1:].tolist()):
                out[i] = data[a:b]

    def _chunks(self, text: str) -> tuple[list[str], list[str]]:
        """The text cut before every single blank that a word follows: a match of the
        pattern never spans such a place.  First the part before the first cut, then the
        others without their blank."""
        if not self.odd.search(text) and not text.startswith(" "):
            first, *rest = text.split(" ")
            return [first], rest
        parts = [p for p in self.cut.split(text) if p]
        if parts and self.cut.match(parts[0]):
            return [], [p[1:] for p in parts]
        return parts[:1], [p[1:] for p in parts[1:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes."""
        if len(self.raw) + len(self.led) > KNOWN_CHUNKS:
            self.raw, self.led = {}, {}
        cut = [self._chunks(t) for t in texts]
        raw = {c for a, _ in cut for c in a}.difference(self.raw)
        led = set().union(*(b for _, b in cut)).difference(self.led)
        self._learn(self.raw, raw, "")
        self._learn(self.led, led, " ")
        return [b"".join([self.raw[c] for c in a] + list(map(self.led.__getitem__, b))) for a, b in cut]

    def _learn(self, known: dict[str, bytes], chunks: set[str], lead: str) -> None:
        """Ids of new chunks.  Letters alone are one match of the pattern, and one mark behind them is another."""
        plain = {c for c in chunks if c.isalpha()}
        marked = {c for c in chunks.difference(plain) if c[-1:] in MARKS and c[:-1].isalpha()}
        stems = list(plain.union([c[:-1] for c in marked]).difference(known))
        split = {c: self.pattern.findall(lead + c) for c in chunks.difference(plain, marked)}
        rest = list({p for ps in split.values() for p in ps})
        ids = self._ids([(lead + c).encode() for c in stems] + [p.encode() for p in rest])
        known.update(zip(stems, ids))
        for c in marked:
            known[c] = known[c[:-1]] + self.tokens[c[-1].encode()]
        pieces = dict(zip(rest, ids[len(stems):]))
        for c, ps in split.items():
            known[c] = b"".join(map(pieces.__getitem__, ps))

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces as int32 bytes; one that is itself a token is that token."""
        out = list(map(self.tokens.get, pieces))
        todo = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(todo, self._contract([pieces[i] for i in todo])):
            out[i] = x
        return out

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Bytes of each list of ids."""
        lens = np.diff(offsets)
        out = [b""] * len(lens)
        if len(ids):
            self.con.register("seq", pa.table({
                "d": np.repeat(np.arange(len(lens), dtype=np.int32), lens),
                "pos": np.arange(len(ids), dtype=np.int32), "tok": ids}))
            rows = self.con.sql("SELECT d, list(bytes ORDER BY pos) AS parts FROM seq JOIN vocabulary USING (tok) "
                                "GROUP BY d").to_arrow_table()
            for d, parts in zip(rows["d"].chunks, rows["parts"].chunks):
                # the bytes of a list's members lie behind one another
                flat = parts.flatten()
                flat = flat.cast(pa.large_binary())
                at = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset:flat.offset + len(flat) + 1]
                at = at[np.append(0, np.cumsum(parts.value_lengths().to_numpy()))].tolist()
                data = memoryview(flat.buffers()[2])
                for i, a, b in zip(d.to_pylist(), at, at[1:]):
                    out[i] = data[a:b].tobytes()
            self.con.unregister("seq")
        return out


_engines: dict[tuple[str, str], Engine] = {}


def engine(path: str, pattern: str) -> Engine:
    """One engine a Python worker and rank file, kept between tasks."""
    if (path, pattern) not in _engines:
        _engines[path, pattern] = Engine(path, pattern)
    return _engines[path, pattern]


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _replacing(df: DataFrame, name: str, kind: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name.lower() != name.lower()]
    return ", ".join([*fields, f"`{name}` {kind}"])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the ids of ``text`` as array<int>, without special tokens."""
    keep = [c for c in df.columns if c.lower() != out.lower()]
    # the text goes in under its own name, whatever else the table holds
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free_name(df, "text_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = engine(ranks_path, pattern)
        for batch in batches:
            texts = strings(batch.column(len(keep)))
            for a, b in _slices([len(t) for t in texts], SLICE_CHARS):
                parts = e.encode(texts[a:b])
                ids = np.frombuffer(b"".join(parts), dtype=np.int32)
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
                col = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns[:len(keep)], col], names=[*keep, out])

    return in_arrow(given, run, _replacing(df, out, "array<int>"))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that the ids stand for (null ids: no bytes)."""
    keep = [c for c in df.columns if c.lower() != out.lower()]
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").cast("array<int>").alias(free_name(df, "ids_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = engine(ranks_path, pattern)
        for batch in batches:
            col = batch.column(len(keep))
            lens = col.value_lengths().fill_null(0).to_numpy()
            for a, b in _slices(lens.tolist(), SLICE_IDS):
                part = col.slice(a, b - a)
                ends = np.append(0, np.cumsum(lens[a:b]))
                data = e.decode(ends, part.flatten().to_numpy().astype(np.int32))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns[:len(keep)], pa.array(data, pa.binary())],
                                                 names=[*keep, out])

    return in_arrow(given, run, _replacing(df, out, "binary"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode(encode(docs, path, P.PATTERN).drop("text"), path, P.PATTERN)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
