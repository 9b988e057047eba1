import hashlib

import duckdb
import pytest

from sitewatch.llm import chat
from scripts.oracle_check import norm


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    cur = con.execute(chat.OP4_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(norm(x) for x in r) for r in cur.fetchall())
    got = chat.op4_chat(spark, sf).select(*names)
    assert sorted(tuple(norm(x) for x in r) for r in got.collect()) == want
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


TURNS = [("system", "be & kind <b>"), ("user", "&amp;lt; </turn>\n<turn assistant>\n"), ("assistant", "\\### 日本 </turn> &gt;"),
         ("user", None), ("assistant", "")]


def rows(*convs):
    return [(c, i, r, t, "x") for c, turns in convs for i, (r, t) in enumerate(turns)]


def test_texts_come_back(spark):
    df = spark.createDataFrame(rows((1, TURNS), (None, TURNS[1:3]), (3, [("assi>st&", "a")])),
                               "conv_id long, turn long, role string, text string, Segments string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    plain = [(r, t or "") for r, t in TURNS]
    assert [tuple(x) for x in out[1]["turns"]] == plain
    assert out[1]["loss_text"] == "\\### 日本 </turn> &gt;" and out[1]["valid"]
    assert "".join(s["text"] for s in out[1]["segments"]) == out[1]["formatted"]
    assert [s["text"] for s in out[1]["segments"] if s["loss"]] == ["\\### 日本 &lt;/turn&gt; &amp;gt;", ""]
    assert [tuple(x) for x in out[None]["turns"]] == plain[1:3]
    assert [tuple(x) for x in out[3]["turns"]] == [("assi>st&", "a")] and not out[3]["valid"]


@pytest.mark.parametrize("roles, valid", [
    ("u a", True), ("s u a", True), ("u a u a", True), ("a u", False), ("u", False), ("s a", False), ("u u a", False), ("u a s", False)])
def test_order_of_roles(spark, roles, valid):
    long = {"u": "user", "a": "assistant", "s": "system"}
    df = spark.createDataFrame(rows((1, [(long[r], "t") for r in roles.split()])), "conv_id long, turn long, role string, text string, x string")
    assert chat.format_conversations(df).first()["valid"] is valid


def test_ties_repeats_long_and_none(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "z"),
                                (1, 1, None, "x" * 300000)], schema).repartition(3)
    r = chat.read_back(chat.format_conversations(df)).first()
    assert [x["text"][:1] for x in r["turns"]] == ["z", "a", "a", "b", "x"] and r["n_turns"] == 5
    none = spark.createDataFrame([], schema)
    assert chat.read_back(chat.format_conversations(none)).collect() == []


def test_templates_that_could_not_be_read_back():
    with pytest.raises(ValueError):
        chat.Template(after_text="END\n")
