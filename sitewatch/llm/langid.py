"""Language identification (operator 9): sparse multinomial logistic regression on
TF-IDF character n-grams, trained with FTRL-proximal, then temperature calibration.

Features: the lower-cased text with every run of other characters than letters as
one blank; its 1- to 3-grams hashed to ``DIM`` buckets; 1 + log of the count times
the inverse document frequency, to unit length.  Document frequencies count all
rows that may be learned from.  Every language of these rows is learned; weights
come from at most ``PER_LANG`` rows of each (those of smallest id hash), and from
fewer a language where there are more than ``MOST_ROWS / PER_LANG`` languages, so
that they are at most ``MOST_ROWS`` in all, or ``FEWEST`` a language.  Every fifth
is kept back to find the temperature.  The elastic net (l1, l2) leaves most weights
at zero.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text when no row has a language; rows whose crc32(doc_id) mod 4 is 2 and rows
without lang teach nothing; repeated rows are predicted each and, of rows that share
an id, one teaches weights; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.session import materialize

from .common import free_name, held_out, in_arrow, smallest_by_hash, table

DIM = 1 << 14
NGRAMS = 3
PER_LANG, MOST_ROWS, FEWEST = 600, 60_000, 50   # bounds of the sample that weights are learned from
CUT = 1 << 18                       # characters hashed together
UNKNOWN = "und"
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def counts(text: str | None) -> np.ndarray | None:
    """Occurrences of each bucket; None without a letter."""
    if not text:
        return None
    letter = _is_letter()
    out = np.zeros(DIM, dtype=np.int64)
    tail = np.full(1, 32, dtype=np.uint32)      # a text begins and ends with a blank
    seen = False
    for a in range(0, len(text), CUT):
        c = np.frombuffer(text[a:a + CUT].lower().encode("utf-32-le"), dtype=np.uint32)
        c = np.where(letter[c], c, 32).astype(np.uint32)
        c = np.concatenate([tail, c] + [np.full(1, 32, dtype=np.uint32)] * (a + CUT >= len(text)))
        blank = c == 32
        keep = np.append(True, ~(blank[1:] & blank[:-1]))
        c = c[keep]
        seen = seen or len(c) > 1 and bool((c != 32).any())
        h = np.zeros(len(c), dtype=np.uint64)
        fresh = max(0, len(tail) - 1) if a else 0      # n-grams that end in the tail are counted already
        for n in range(1, NGRAMS + 1):
            if len(c) < n:
                break
            h = (h[:len(c) - n + 1] if n > 1 else h) + c[n - 1:].astype(np.uint64) * _PRIMES[n - 1]
            done = max(0, fresh + 1 - (n - 1)) if a else 0
            x = h[done:] ^ (h[done:] >> np.uint64(29))
            out += np.bincount(((x * _PRIMES[0]) >> np.uint64(50)).astype(np.int64), minlength=DIM)
        tail = c[-(NGRAMS - 1):]
    return out if seen else None


def tfidf(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text, of unit length."""
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    return at, x / (np.sqrt((x * x).sum()) or 1.0)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray         # (DIM + 1, languages); the last row is the bias
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.weights[DIM]

    def predict(self, text: str | None) -> tuple[str, float]:
        n = counts(text) if self.langs else None
        if n is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*tfidf(n, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 1.0, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.001, epochs: int = 4) -> np.ndarray:
    """Weights by follow-the-regularised-leader, one update a row."""
    z = np.zeros((DIM + 1, classes))
    n = np.zeros((DIM + 1, classes))

    def weights(at):
        return np.where(np.abs(z[at]) > l1, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(at)
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(DIM + 1))


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of smallest log loss on rows kept back."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(10), 200))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                     F.col(f"`{lang}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{doc_id}`")).alias("h"))
    docs = docs.where(F.col("lang").isNotNull() & ~held_out())
    ids = docs.select("lang", "h").distinct()
    n_langs = max(1, docs.select("lang").distinct().count())
    per_lang = min(PER_LANG, max(FEWEST, MOST_ROWS // n_langs))
    cutoffs = smallest_by_hash(ids, "lang", ["h"], per_lang).groupBy("lang").agg(F.max("h").alias("upto")).collect()
    langs = sorted(r["lang"] for r in cutoffs)
    upto = {r["lang"]: r["upto"] for r in cutoffs}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_, total = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            rows = []
            for t, l, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (n := counts(t)) is None:
                    continue
                at = np.flatnonzero(n)
                df_[at] += 1
                total += 1
                if l in upto and h <= upto[l]:
                    rows.append((l, h, at.astype(np.int32).tobytes(), n[at].astype(np.int32).tobytes()))
            if rows:
                yield batch_of(rows)
        # the counts of a task are one row without language
        yield batch_of([(None, total, np.flatnonzero(df_).astype(np.int32).tobytes(), df_[df_ > 0].astype(np.int64).tobytes())])

    def batch_of(rows):
        l, h, a, n = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(l, pa.string()), pa.array(h, pa.int64()), pa.array(a, pa.binary()),
                                           pa.array(n, pa.binary())], names=["lang", "h", "at", "n"])

    schema = "lang string, h long, at binary, n binary"
    out = in_arrow(docs.select("text", "lang", "h"), extract, schema)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_, total, any_row = np.zeros(DIM, dtype=np.int64), 0, False
        for batch in batches:
            rows = []
            for l, h, a, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if l is None:
                    df_[np.frombuffer(a, dtype=np.int32)] += np.frombuffer(n, dtype=np.int64)
                    total, any_row = total + h, True
                else:
                    rows.append((l, h, a, n))
            if rows:
                yield batch_of(rows)
        if any_row:
            yield batch_of([(None, total, np.flatnonzero(df_).astype(np.int32).tobytes(), df_[df_ > 0].astype(np.int64).tobytes())])

    # tasks' counts are added up before they come to the driver; of rows with one id one stays
    out = in_arrow(out.repartition(8, "lang", "h"), add_up, schema)
    out = materialize(out, "langid")
    sums, sample = out.where("lang IS NULL"), out.where("lang IS NOT NULL")
    df_, total = np.zeros(DIM, dtype=np.int64), 0
    for r in sums.collect():        # a row of at most DIM numbers from each of the eight tasks
        df_[np.frombuffer(r["at"], dtype=np.int32)] += np.frombuffer(r["n"], dtype=np.int64)
        total += r["h"]
    idf = np.log((1 + total) / (1 + df_)) + 1
    rows, kept = [], []
    number = {l: i for i, l in enumerate(langs)}
    picked = sample.groupBy("lang", "h").agg(F.min(F.struct("at", "n")).alias("x")).orderBy("h", "lang").collect()
    for r in picked:                # at most MOST_ROWS rows, or FEWEST a language
        n = np.zeros(DIM, dtype=np.int64)
        n[np.frombuffer(r["x"]["at"], dtype=np.int32)] = np.frombuffer(r["x"]["n"], dtype=np.int32)
        (kept if r["h"] % 5 == 0 else rows).append((*tfidf(n, idf), number[r["lang"]]))
    model = Model(langs, idf, ftrl(rows, len(langs)) if langs else np.zeros((DIM + 1, 0)))
    if kept:
        model.temperature = best_temperature(np.array([model.logits(a, x) for a, x, _ in kept]), np.array([y for *_, y in kept]))
    return model


def predict(df: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``df`` with the predicted language and its calibrated probability."""
    keep = [c for c in df.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(free_name(df, "text_")))
    state = df.sparkSession.sparkContext.broadcast(model)       # (DIM + 1) x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [state.value.predict(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array([l for l, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                names=[*keep, lang_out, score_out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]]
    return in_arrow(given, run, ", ".join([*fields, f"`{lang_out}` string, `{score_out}` double"]))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
