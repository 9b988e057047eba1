import base64
import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken

from sitewatch.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts():
    rnd = random.Random(3)
    kinds = ["", " ", "  ", " a", "a ", "a  b", "\n x\t y \n\n", "it's we'll 'tis", "a b   c　 d", "x\x1cy \x1f z",
             "naïve café übergröße", "日本語 テスト 文章", "привет мир", "<|endoftext|> hi", "1234567 89", "!!! ??? ... ---",
             "a" * 5000, "ab" * 3000, "🙂🙃 👍🏽 é", " \n a", "\r\n\r\n b", "   lead", "trail   "]
    alphabet = "abcdeé  \n\t'!1  日"
    kinds += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(300)]
    kinds += ["".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (97, 400, 3000)]
    return kinds


def test_ids_equal_the_library(library):
    e = bpe.Engine(PATH, P.PATTERN)
    texts = some_texts()
    got = [np.frombuffer(b, dtype=np.int32).tolist() for b in e.encode(texts)]
    for t, g in zip(texts, got):
        assert g == library.encode_ordinary(t), t[:80]


def test_runs_contract_like_single_steps():
    """Ranks in which a later merge is smaller than one of its parts."""
    rnd = random.Random(5)
    for _ in range(12):
        tokens = [bytes([i]) for i in range(256)]
        extra = set()
        for _ in range(12):
            extra.add(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(2, 5))))
        extra = sorted(extra, key=lambda _: rnd.random())
        ranks = {t: i for i, t in enumerate([*tokens, *extra])}
        e = object.__new__(bpe.Engine)
        e.con = bpe.duckdb.connect()
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                if t[:i] in ranks and t[i:] in ranks]
        rows = np.array(rows, dtype=np.int32).reshape(-1, 3)
        e._load("merges", bpe.pa.table({n: rows[:, i] for i, n in enumerate("abm")}))
        e.byte = np.arange(256, dtype=np.int32)
        words = [bytes(rnd.choice(b"ab") for _ in range(n)) for n in (3, 9, 30, 90, 97, 120, 200)]
        for w, got in zip(words, e._contract(words)):
            assert np.frombuffer(got, dtype=np.int32).tolist() == step_by_step(w, ranks)


def step_by_step(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_rows_and_odd_columns(spark, library):
    rows = [(1, None, "k"), (None, "", "k"), (2, "the cat sat", None), (2, "the cat sat", None), (3, "x " * 70000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string").repartition(2)
    got = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r["ids"]) == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, PATH, P.PATTERN), PATH, P.PATTERN).count() == 0


def test_query(spark, library, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op1_bpe(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
