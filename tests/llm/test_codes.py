import hashlib
import math

import duckdb
import numpy as np

from sitewatch.llm import codes

ODD = [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [float("inf")] * 8, 1), (903, [None] + [1.0] * 7, None),
       (904, [], 2), (905, [1.0, 2.0, 3.0], 2), (906, [1e300] * 8, 2)]


def brute(rows):
    """{(id, code, error, label, digest)} with Python's integers; rows of one length."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows
            if v and len(v) % 8 == 0 and all(x is not None and math.isfinite(x) and abs(x) * 4096 < 2 ** 53 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 8
    parts = [[v[p * w:(p + 1) * w] for p in range(8)] for _, v, _ in kept]
    books = [[list(r[p]) for r in parts[:16]] for p in range(8)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e)), i) for i, e in enumerate(books[p])) for p in range(8)] for x in parts]

    for _ in range(6):
        found = assign()
        for p in range(8):
            for i in range(len(books[p])):
                own = [x[p] for x, f in zip(parts, found) if f[p][1] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    flat = ",".join(str(c) for b in books for e in b for c in e)
    return sorted((repr(i), "".join(f"{c:02x}" for _, c in f), sum(d for d, _ in f), lab, hashlib.sha256(flat.encode()).hexdigest())
                  for (i, _, lab), f in zip(kept, assign()))


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(parts)
    coded, books = codes.compress(df, label="label")
    out = codes.with_label_error(coded).collect()
    sums = {}
    for r in out:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in out)
    return sorted((repr(r["id"]), r["code"], r["error"], r["label"], codes.digest(books[r["dim"]])) for r in out), books


def vectors(n, dim, seed=1, spread=0.3):
    rnd = np.random.default_rng(seed)
    return [(i, [float(x) for x in rnd.standard_normal(dim) * spread], [None, 1, 2][i % 3]) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(300, 16)
    rows += [(5000 + i, rows[3][1], 1) for i in range(40)] + rows[:4] + [(None, rows[5][1], None)] + ODD
    assert run(spark, rows)[0] == brute(rows)


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, [float((i * k) % 3) / 4096 for k in range(1, 9)], i % 2) for i in range(200)]
    assert run(spark, rows)[0] == brute(rows)


def test_wide_numbers_are_exact(spark):
    rows = vectors(60, 8, spread=1e5)
    assert run(spark, rows)[0] == brute(rows)
    far = vectors(20, 8, spread=2.0 ** 39)      # errors may be beyond a long
    coded, _ = codes.compress(spark.createDataFrame(far, "vec_id long, embedding array<double>, label int"), label="label")
    rows = codes.with_label_error(coded).collect()
    got = sorted((repr(r["id"]), r["code"], r["error"]) for r in rows)
    assert {r["label_error"] for r in rows} == {None}
    assert got == [(i, c, e if e < 2 ** 63 else None) for i, c, e, _, _ in brute(far)]


def test_few_rows_many_lengths_and_none(spark):
    few, other = vectors(5, 8), [(i + 100, v, lab) for i, v, lab in vectors(20, 24)]
    got, books = run(spark, few + other + ODD)
    assert got == sorted(brute(few) + brute(other)) and {d: b.shape for d, b in books.items()} == {8: (8, 5, 1), 24: (8, 16, 3)}
    assert run(spark, ODD)[0] == [] and run(spark, [])[0] == []


def test_other_columns_and_names(spark):
    df = spark.createDataFrame([(i, v, "x", lab) for i, v, lab in vectors(20, 8)], "id long, v array<double>, code string, dim int")
    assert codes.compress(df, "id", "v")[0].count() == 20


def test_cells_keep_what_may_be_nearest(monkeypatch):
    monkeypatch.setattr(codes, "CELL", 512)
    rnd = np.random.default_rng(5)
    book, x = rnd.integers(-2000, 2000, (16, 2)), rnd.integers(-3000, 3000, (5000, 2))
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    cells = codes.Cells(book)
    got, error = cells.nearest(x)
    assert (got == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    assert cells.evaluated < 5000 * 8 and len(cells.keys) < 250
    monkeypatch.setattr(codes, "MOST_CELLS", 50)            # forgotten cells, and hashes that all collide
    assert (codes.Cells(book).nearest(x)[0] == got).all()
    monkeypatch.setattr(codes, "ODD", 0)
    monkeypatch.setattr(codes, "MOST_CELLS", 1 << 17)
    assert (codes.Cells(book).nearest(x)[0] == got).all()


def test_decode_is_within_the_error(spark):
    rows = vectors(50, 16)
    coded, books = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    whole = {i: np.floor(4096 * np.array(v)).astype(np.int64) for i, v, _ in rows}
    for r in coded.collect():
        assert ((codes.decode(r["code"], books[16]) - whole[r["id"]]) ** 2).sum() == r["error"]


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    df = codes.op13_codes(spark, sf)
    cur = con.execute(codes.OP13_SQL)
    assert df.columns == [c[0] for c in cur.description]
    assert sorted(tuple(r) for r in df.collect()) == sorted(cur.fetchall())
