import random

import pytest
import xxhash

from sitewatch.llm import linededup as L


def brute(rows):
    """(doc_id, text after removal, chunks removed) for (doc_id, text) rows; compares bytes only."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, *keys(r[1])))
    seen, out = set(), {}
    for d, t in docs:
        data = t.encode()
        gone = []
        for a, b in spans(data):
            if data[a:b] in seen:
                gone.append((a, b))
            seen.add(data[a:b])
        kept, at, n = b"", 0, 0
        for a, b in gone:
            n += a > at or not n
            kept += data[at:a]
            at = b + (data[b:b + 1] in (b"\n", b" "))
        out[d, t] = ((kept + data[at:]).decode(), n)
    return [(d, *out.get((d, t), (t, 0))) for d, t in rows]


def spans(data):
    """Windows: each line with the next ones, one at least, as many as make 40 bytes."""
    starts, ends = L.lines(data)
    for i, a in enumerate(starts):
        b = next((b for b in ends[i + 1:] if b - a >= 40), None)
        if b is not None:
            yield a, b


def keys(text):
    """Order of texts with the same id: the two hashes that stand for the text."""
    def signed(x):
        return x - 2 ** 64 if x >= 2 ** 63 else x
    h1 = signed(xxhash.xxh64_intdigest(text.encode(), 42))
    one = xxhash_int(1, 42)
    return h1, signed(xxhash.xxh64_intdigest(text.encode(), one))


def xxhash_int(value, seed):
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed)


def test_windows_are_rolled_as_they_are_defined_and_come_back_after_a_shift():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(6))
    lines = [". ".join(" ".join(word() for _ in range(4)) for _ in range(rnd.choice([1, 1, 1, 2, 6, 12]))) + "." for _ in range(60)]
    lines[7:7] = ["", "a", "b", "", "c", " d", "x y" * 70, "天地玄黄宇宙洪荒。" * 30]
    text = "\n".join(lines).encode()
    starts, ends = L.lines(text)
    assert all(a < b for a, b in zip(starts, ends)) and all(text[b:a] in (b"\n", b"\n\n", b" ", b"") for b, a in zip(ends, starts[1:]))
    at, size, rolled = L.windows(text)
    assert list(zip(at.tolist(), (at + size).tolist())) == list(spans(text))
    content = [text[a:a + n] for a, n in zip(at, size)]
    assert len(set(rolled.tolist())) == len(set(content))
    for lead in (b"new line\n", b"new. lines. here.\n", b"x\ny\nz\n"):
        moved, m, r = L.windows(lead + text)
        shifted = dict(zip(r.tolist(), ((lead + text)[a:a + n] for a, n in zip(moved, m))))
        assert all(shifted[h] == c for h, c in zip(rolled.tolist(), content))
    for few in (b"", b"one line", b"a\nb", b"\n\n"):
        assert len(L.windows(few)[0]) == 0


def test_equal_lines_between_other_separators_differ():
    a, b = (L.windows(f"a line of some words here{x}another line of some words".encode())[2].tolist() for x in ("\n", "\n\n"))
    assert len(a) == len(b) == 1 and a != b


def some_rows(rnd):
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(7))
    line = lambda: ". ".join(" ".join(word() for _ in range(4)) for _ in range(rnd.choice([1, 1, 2, 5]))) + "."
    passages = ["\n".join(line() for _ in range(rnd.choice([1, 2, 6]))) for _ in range(12)]
    rows = []
    for d in range(120):
        parts = [line() for _ in range(rnd.randrange(5))]
        parts += [rnd.choice(passages) for _ in range(rnd.randrange(4))]
        rnd.shuffle(parts)
        rows.append((d, "\n".join(parts)))
    return rows + [(200, rows[5][1]), (201, rows[5][1] + "\nmore"), (3, rows[3][1]), (3, rows[4][1])]


def test_equals_brute_force(spark):
    rows = some_rows(random.Random(7)) + [(None, None), (300, ""), (301, "\n\n\n"), (302, None), (None, some_rows(random.Random(7))[9][1]),
                                          (303, ("very long line with words. " * 4000) + "\n" + "short\n" * 500)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, Start string, times int").repartition(4)
    got = L.remove_repeated_chunks(df, removed="n")
    assert got.columns == ["doc_id", "text", "Start", "times", "n"]
    assert sorted(((r["doc_id"], r["text"], r["n"]) for r in got.collect()), key=str) == sorted(brute(rows), key=str)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.remove_repeated_chunks(none).collect() == []


def test_equal_hashes_are_not_enough(spark, monkeypatch):
    """With every chunk of one hash, only chunks of equal bytes go."""
    rows = [(1, "aaaa bbbb cccc dddd eeee. ffff gggg hhhh iiii."), (2, "jjjj kkkk llll mmmm nnnn. oooo pppp qqqq rrrr."),
            (3, "aaaa bbbb cccc dddd eeee. ffff gggg hhhh iiii.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    real = L.occurrences
    from pyspark.sql import functions as F
    one = lambda w: F.struct(w["start"].alias("start"), w["len"].alias("len"), F.lit(1).cast("long").alias("a"))
    monkeypatch.setattr(L, "occurrences", lambda docs: real(docs).withColumn("ws", F.transform("ws", one)))
    assert {r["doc_id"]: r["text"] for r in L.remove_repeated_chunks(df).collect()} == {1: rows[0][1], 2: rows[1][1], 3: ""}


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = L.op10_line_dedup(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
    assert sum(r["removed_chunks"] for r in got) > 0


def passages_in_other_lines(spark, rnd, lines, words, within="\n", n=60):
    """Share of the lines of passages, each set in two texts of other lines, that the later text loses; lines of others it loses."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    line = lambda: " ".join(word() for _ in range(words))
    around = lambda: [line() for _ in range(rnd.randrange(5, 20))]
    rows, passage, others = [], {}, {}
    for d in range(n):
        p = [line() for _ in range(lines)]
        for i in (d, 1000 + d):
            before, behind = around(), around()
            rows.append((i, within.join(before + p + behind)))
            passage[i], others[i] = p, before + behind
    got = {r["doc_id"]: r["text"] for r in L.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == t for d, t in rows if d < 1000)
    gone = sum(x not in got[1000 + d] for d in range(n) for x in passage[1000 + d])
    return gone / (n * lines), sum(x not in got[1000 + d] for d in range(n) for x in others[1000 + d])


@pytest.mark.parametrize("within", ["\n", ". "])
def test_passages_inside_a_run_are_found(spark, within):
    """Against the passages themselves, without chunks()."""
    rnd = random.Random(11)
    for lines in (2, 5, 10):
        assert passages_in_other_lines(spark, rnd, lines, 8, within) == (1.0, 0)
    share, others = passages_in_other_lines(spark, rnd, 12, 5, within)      # lines shorter than a chunk
    assert share > 0.5 and others == 0


@pytest.mark.parametrize("within", ["\n", ". "])
@pytest.mark.parametrize("lines", [5, 8, 10])
def test_passages_of_some_lines_are_found(spark, within, lines):
    """0.9 or better of their lines, short and long ones, and none of the others'."""
    rnd = random.Random(lines)
    for words in (6, 9, 14):
        share, others = passages_in_other_lines(spark, rnd, lines, words, within)
        assert share >= 0.9 and others == 0


@pytest.mark.parametrize("within", ["\n", ". "])
def test_a_lone_common_sentence_stays(spark, within):
    """A sentence of many words in many texts, each time beside other ones."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    line = lambda: " ".join(word() for _ in range(9))
    common = [line() for _ in range(3)]
    rows = [(d, within.join([line(), rnd.choice(common), line(), rnd.choice(common), line()])) for d in range(200)]
    got = {r["doc_id"]: r["text"] for r in L.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows)


def test_columns_of_any_name_pass_through(spark):
    names = ["id", "h1", "h2", "data", "row", "gone", "ws", "__gone", "__id", "start", "a", "_block", "_w0"]
    text = "a line of some words here\nanother line of some words"
    rows = [(i, text, *[f"{n}{i}" for n in names]) for i in (1, 2)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = sorted(tuple(r) for r in L.remove_repeated_chunks(df, removed="n").collect())
    assert got == [(*rows[0], 0), (2, "", *rows[1][2:], 1)]


def test_a_copy_leaves_no_short_lines(spark):
    text = "a longer sentence that is a chunk by its own length. Oh. another one that is long enough to be a chunk. No"
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in L.remove_repeated_chunks(df).collect()} == {1: text, 2: ""}


@pytest.mark.parametrize("letters, blank, end, least", [
    ("abcdefghijklmnop", " ", "! ", 1), ("abcdefghijklmnop", " ", "? ", 1), ("天地玄黄宇宙洪荒日月盈昃辰宿列张", "", "。", 1),
    ("abcdefghijklmnop", " ", " ", 0.6), ("天地玄黄宇宙洪荒日月盈昃辰宿列张", "", "", 0.6), ("天地玄黄宇宙洪荒日月盈昃辰宿列张", "", "，", 0.6)])
def test_passages_inside_a_line_without_full_stops(spark, letters, blank, end, least):
    """Share of a passage's letters that the later of two lines around it loses; the rest of both stays."""
    rnd = random.Random(5)
    part = lambda: blank.join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(8))
    some = lambda n: end.join(part() for _ in range(n)) + end
    rows, around, size = [], {}, 0
    for d in range(40):
        p = some(10)
        size += len(p)
        for i in (d, 1000 + d):
            around[i] = some(rnd.randrange(8, 16)), some(rnd.randrange(8, 16))
            rows.append((i, around[i][0] + p + around[i][1]))
    got = {r["doc_id"]: r["text"] for r in L.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == t for d, t in rows if d < 1000)
    assert all(got[1000 + d].startswith(around[1000 + d][0].rstrip()) and got[1000 + d].endswith(around[1000 + d][1]) for d in range(40))
    assert sum(len(t) - len(got[d]) for d, t in rows) >= least * size - 80 * 40 * (least == 1)


def test_a_lone_long_line_goes_where_it_repeats(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    line = " ".join(word() for _ in range(60))
    rows = [(1, line), (2, line), (3, f"One sentence here. Another one.\n{line}\nA third sentence. And one more.")]
    got = {r["doc_id"]: r["text"] for r in L.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: line, 2: "", 3: "One sentence here. Another one.\nA third sentence. And one more."}


def test_what_stands_between_lines_is_hashed_alone(monkeypatch):
    told = []

    def counted(data, starts, ends):
        told.append(len(data))
        return hashes(data, starts, ends)

    hashes = L.span_hashes
    monkeypatch.setattr(L, "span_hashes", counted)
    text = b"One sentence here. Another\n\none there\xe2\x80\xa6 " * 50
    of, start, size, rolled = L.windows_of([text, b"", b"\xe3\x80\x82" * 9, text])
    assert told[0] > 2 * len(text) and told[1] < len(text) // 2
    assert (rolled[of == 0] == rolled[of == 3]).all() and len(set(rolled.tolist())) < len(rolled) // 4
