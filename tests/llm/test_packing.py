import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sitewatch.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids + [0]


def check(rows, texts, library, capacity=2048):
    """rows as the query gives them, against texts by doc_id; the number of sequences over the least possible."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc, key=str) == sorted(texts, key=str)
    total = 0
    for d, rs in by_doc.items():
        ids = library(texts[d])
        total += len(ids)
        rs.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rs] == list(range(-(-len(ids) // capacity)))
        for r in rs:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and len(part) == r["length"] <= capacity
            assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for rs in by_seq.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [sum(x["length"] for x in rs[:i]) for i in range(len(rs))]
        assert rs[-1]["offset"] + rs[-1]["length"] <= capacity
    return len(by_seq) / -(-total // capacity)


def test_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(packing.op5_packing(spark, sf).collect(), texts, library) < 1.03


def test_words_equal_whole_texts(library):
    w = packing.Words(PATH)
    rnd = random.Random(2)
    texts = ["", " \n", "It's WE'LL ΑΣ ΣΑΣ İI ſ ß É é e ́x", "a b　c d\x1ce\x85f", "日本語 <|endoftext|> 12345!!",
             "x" * 9000, "a​b c"]
    texts += ["".join(rnd.choice("aÉé 'sS1!́ΣİI\n ") for _ in range(50)) for _ in range(200)]
    for t, ids in zip(texts, w.ids(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library(t)[:-1], repr(t)


def test_each_step_is_the_best_one():
    rnd = random.Random(4)
    for _ in range(30):
        cap = rnd.choice([8, 20])
        lengths = [rnd.randrange(1, cap + 1) for _ in range(40)]
        for n in range(1, len(lengths) + 1):
            now = gaps(packing._place_all(lengths[:n], cap), lengths, cap)
            before = gaps(packing._place_all(lengths[:n - 1], cap), lengths, cap)
            tries = [before + [cap - lengths[n - 1]]]
            tries += [before[:i] + [g - lengths[n - 1]] + before[i + 1:] for i, g in enumerate(before) if g >= lengths[n - 1]]
            assert squares(now) == min(map(squares, tries))


def gaps(seqs, lengths, cap):
    return [cap - sum(lengths[i] for i in s) for s in seqs]


def squares(gs):
    return sum(gs.count(g) ** 2 for g in set(gs) if g)


def test_odd_rows_and_shards(spark, library):
    schema = "doc_id long, text string, Place string, length int"
    texts = {1: None, 2: "", None: "a b", 3: "word " * 9001, 4: "x", **{i: "some words here " * (i % 50) for i in range(10, 300)}}
    df = spark.createDataFrame([(d, t, "z", None) for d, t in texts.items()], schema).repartition(3)
    rows = packing.pack(packing.pieces(df, PATH), shard=100).collect()
    check(rows, {d: t or "" for d, t in texts.items()}, library)
    assert len({r["sequence_id"] >> 32 for r in rows}) > 1
    twice = packing.packed_documents(df.where("doc_id = 3").unionByName(df.where("doc_id = 3"))).collect()
    assert sorted((r["piece"]) for r in twice) == sorted(2 * list(range(5)))
    assert packing.packed_documents(spark.createDataFrame([], schema)).collect() == []


def test_ids_on_request(spark, library):
    df = spark.createDataFrame([(1, "word " * 3000)], "doc_id long, text string")
    rows = sorted(packing.pieces(df, PATH, with_ids=True).collect(), key=lambda r: r["piece"])
    assert sum((list(r["ids"]) for r in rows), []) == library("word " * 3000)


def test_separators_with_white_space_at_the_ends(library):
    w = packing.Words(PATH)
    texts = ["a\x1fb foo\n", " a\x1cb", "\n\x1d\n", "\x1e", " \x1f ", "\x1f x. \x1c,\n", "　a\x1db\x85"]
    for t, ids in zip(texts, w.ids(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library(t)[:-1], repr(t)


def test_every_letter_before_a_mark():
    """Against the library: each letter, alone and behind another, with a full stop or a comma behind it."""
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    words = [lead + c + m for c in letters for lead in ("", "a") for m in ".,"]
    mine = packing.Words(PATH)
    for a in range(0, len(words), 50_000):
        part = words[a:a + 50_000]
        want = library.encode_batch(part, add_special_tokens=False)
        wrong = [w for w, e, ids in zip(part, want, mine.ids(part)) if list(np.frombuffer(ids, dtype="<u4")) != e.ids]
        assert wrong == []


def test_letters_go_through_the_model_alone_with_marks_behind_them_or_without(library):
    class Asked:
        def __init__(self, tokenizer):
            self.tokenizer, self.words = tokenizer, []

        def encode_batch_fast(self, words, **more):
            self.words += words
            return self.tokenizer.encode_batch_fast(words, **more)

    w = packing.Words(PATH)
    w.tokenizer = Asked(w.tokenizer)
    texts = ["Abc abc,!! Été$$$ naïveté. ſtraße### ŉa", "abc's it'll x1 (a) abc'' 'abc", "".join(f" {c}a{c}{m}" for c in packing._LATIN for m in ("", ".", "<|")),
             "".join(f" ab{chr(m)} é{chr(m)}{chr(m)}" for m in range(33, 127))]
    for t, ids in zip(texts, w.ids(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library(t)[:-1], repr(t)
    asked = set(w.tokenizer.words)
    assert {",!!", "$$$", ".", "###", "'", "''"} < asked and not asked & {"abc", "abc,!!", "été$$$", "naïveté", "naïveté.", "ſtraße###", "ŉa", "abc''"}
