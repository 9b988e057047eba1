"""Quality score by a byte-level convolutional network in numpy (operator 2).

A byte has a learned embedding and one more channel that tells whether it ends an
echo of the bytes before (words repeated); ``FILTERS`` learned filters of ``WIDTH`` bytes slide
with a stride over chunks that overlap so far that every window of the whole
document lies in one.  A chunk keeps each filter's largest response; a document
the largest and the mean over its chunks, and a logistic layer makes one
probability of the two.

Learned from at most ``PER_LABEL`` labelled rows of each label (smallest id hash)
and of each at most ``TRAIN_CHUNKS`` chunks spread over its length; scores are
always of whole documents.

Defined cases: null and empty texts are padding alone and get the network's score
for it; without labels of both kinds every score is 0.5; rows whose crc32(doc_id)
mod 4 is 2 and null labels teach nothing; repeated rows are scored each and, of
rows that share an id, one teaches; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, held_out, in_arrow, smallest_by_hash, table

CHUNK, WIDTH, STRIDE, EMBED, FILTERS = 512, 8, 2, 6, 24
STEP = CHUNK - WIDTH + STRIDE           # from one chunk to the next; no window is lost
PER_LABEL, TRAIN_CHUNKS = 1200, 5
EPOCHS, BATCH, RATE = 8, 32, 0.01
SHORT = (15, 200)                       # bytes of the short pieces that training adds, one a row
TOGETHER = 256                          # chunks that go through the network at a time
THRESHOLD = 0.7
LAGS = range(2, 25)                     # bytes back at which a run of equal bytes counts as an echo
CHANNELS = EMBED + 1


def echoes(x: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK): true where four bytes end that stood up to 24 bytes before in the chunk."""
    out = np.zeros(x.shape, dtype=bool)
    for lag in LAGS:
        one = (x[:, lag:] == x[:, :-lag]) & (x[:, lag:] != 0)
        two = one[:, 1:] & one[:, :-1]
        out[:, lag + 3:] |= two[:, 2:] & two[:, :-2]
    return out


def chunks(data: bytes) -> np.ndarray:
    """(chunks, CHUNK) overlapping chunks of the whole data, padded with 0."""
    n = max(1, -(-(len(data) - (WIDTH - STRIDE)) // STEP))
    flat = np.zeros((n - 1) * STEP + CHUNK, dtype=np.uint8)
    flat[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::STEP]


@dataclass
class Network:
    embed: np.ndarray           # (256, EMBED)
    filters: np.ndarray         # (WIDTH * CHANNELS, FILTERS)
    bias: np.ndarray            # (FILTERS,)
    out: np.ndarray             # (2 * FILTERS + 1,)

    @classmethod
    def fresh(cls) -> Network:
        rnd = np.random.default_rng(11)
        return cls(*(x.astype(np.float32) for x in (
            rnd.normal(0, 0.5, (256, EMBED)), rnd.normal(0, (WIDTH * CHANNELS) ** -0.5, (WIDTH * CHANNELS, FILTERS)),
            np.zeros(FILTERS), rnd.normal(0, 0.1, 2 * FILTERS + 1))))

    def windows(self, x: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * CHANNELS): what each filter sees."""
        e = np.empty((len(x), CHUNK, CHANNELS), dtype=np.float32)
        e[:, :, :EMBED] = self.embed[x]
        e[:, :, EMBED] = echoes(x)
        return np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), WIDTH * CHANNELS, axis=1)[:, ::STRIDE * CHANNELS]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS): each filter's largest response, at least 0."""
        w = self.windows(x)
        y = np.ascontiguousarray(w).reshape(-1, WIDTH * CHANNELS) @ self.filters
        return np.maximum(y.reshape(len(x), -1, FILTERS).max(axis=1) + self.bias, 0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        top = np.zeros((len(texts), FILTERS), dtype=np.float32)
        total = np.zeros((len(texts), FILTERS), dtype=np.float64)
        number = np.zeros(len(texts), dtype=np.int64)
        held, owner, size = [], [], 0

        def flush():
            nonlocal held, owner, size
            if size:
                own = np.concatenate(owner)
                p = self.pooled(np.concatenate(held))
                np.maximum.at(top, own, p)
                np.add.at(total, own, p)
                held, owner, size = [], [], 0

        for i, t in enumerate(texts):
            x = chunks((t or "").encode())
            number[i] = len(x)
            for a in range(0, len(x), TOGETHER):
                part = x[a:a + TOGETHER]
                if size + len(part) > TOGETHER:
                    flush()
                held.append(part)
                owner.append(np.full(len(part), i))
                size += len(part)
        flush()
        if not len(texts):
            return np.zeros(0)
        f = np.concatenate([top, total / number[:, None], np.ones((len(texts), 1))], axis=1)
        return 1 / (1 + np.exp(-np.clip(f @ self.out, -50, 50)))


def fit(rows: list[tuple[bytes, int]]) -> Network:
    """Adam on the log loss, both labels with equal weight; gradients reach the embeddings
    and filters only through the places that won the pooling."""
    net = Network.fresh()
    y = np.array([l for _, l in rows], dtype=np.float32)
    if not len(rows) or y.min() == y.max():
        net.out[:] = 0
        return net
    rnd, step = np.random.default_rng(5), 0
    # short pieces of the same rows, so that shortness itself says nothing
    at, size = rnd.random(len(rows)), rnd.integers(*SHORT, len(rows))
    texts = [d for d, _ in rows] + [d[int(a * max(0, len(d) - n)):][:n] for (d, _), a, n in zip(rows, at, size)]
    y = np.concatenate([y, y])
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    data = []
    for d in texts:
        x = chunks(d)
        data.append(np.array(x[np.unique(np.linspace(0, len(x) - 1, TRAIN_CHUNKS).astype(int))]))
    params = [net.embed, net.filters, net.bias, net.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(EPOCHS):
        order = rnd.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a:a + BATCH]
            x = np.concatenate([data[i] for i in pick])
            number = np.array([len(data[i]) for i in pick])
            own = np.repeat(np.arange(len(pick)), number)
            w = net.windows(x)
            resp = (np.ascontiguousarray(w).reshape(-1, WIDTH * CHANNELS) @ net.filters).reshape(len(x), -1, FILTERS)
            at = resp.argmax(axis=1)                                            # (chunks, FILTERS)
            pool = np.maximum(np.take_along_axis(resp, at[:, None], axis=1)[:, 0] + net.bias, 0)
            starts = np.cumsum(number) - number
            top = np.maximum.reduceat(pool, starts)
            mean = np.add.reduceat(pool, starts) / number[:, None]
            f = np.concatenate([top, mean, np.ones((len(pick), 1))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(f @ net.out, -50, 50)))
            d = (weight[pick] * (p - y[pick]) / len(pick))[:, None]
            g_out = (f * d).sum(axis=0)
            g_f = d * net.out
            won = pool == top[own]
            won = won / np.maximum(np.add.reduceat(won, starts), 1)[own]
            g_pool = (won * g_f[own, :FILTERS] + g_f[own, FILTERS:2 * FILTERS] / number[own][:, None]) * (pool > 0)
            seen = w[np.arange(len(x))[:, None], at]                            # (chunks, FILTERS, WIDTH * CHANNELS)
            g_filters = np.einsum("cfw,cf->wf", seen, g_pool)
            g_seen = (g_pool[:, :, None] * net.filters.T[None]).reshape(len(x), FILTERS, WIDTH, CHANNELS)[..., :EMBED]
            places = at[:, :, None] * STRIDE + np.arange(WIDTH)
            values = np.take_along_axis(x[:, None, :].repeat(FILTERS, axis=1), places, axis=2)
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, values.reshape(-1), g_seen.reshape(-1, EMBED))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in enumerate((g_embed, g_filters, g_pool.sum(axis=0), g_out)):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                params[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Network:
    known = (labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{quality}`").cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("doc_id")))
    picked = smallest_by_hash(known, "y", ["h", "doc_id"], PER_LABEL)
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # at most 2 * PER_LABEL rows: a broadcast of proven size
    rows = docs.join(F.broadcast(picked), "doc_id").select("text", "y", "h", "doc_id")
    cut = in_arrow(rows, _heads, "data binary, y int, h long, doc_id string")
    got = cut.groupBy("doc_id").agg(F.min(F.struct("h", "y", "data")).alias("x")).select("x.*").orderBy("h", "data").collect()
    return fit([(bytes(r["data"]), r["y"]) for r in got])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts reduced to the chunks that training looks at."""
    for batch in batches:
        data = []
        for t in batch.column(0).to_pylist():
            b = (t or "").encode()
            x = chunks(b)
            if len(x) > TRAIN_CHUNKS:
                b = b"".join(x[i].tobytes() for i in np.unique(np.linspace(0, len(x) - 1, TRAIN_CHUNKS).astype(int)))
            data.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), batch.column(1), batch.column(2),
                                          batch.column(3).cast(pa.string())], names=["data", "y", "h", "doc_id"])


def score(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability that a document is of label 1."""
    keep = [c for c in df.columns if c.lower() != out.lower()]
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(free_name(df, "text_")))
    state = df.sparkSession.sparkContext.broadcast(net)         # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = state.value.scores(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(got, pa.float64())], names=[*keep, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]]
    return in_arrow(given, run, ", ".join([*fields, f"`{out}` double"]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", held_out()), net).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
