import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format as cf


def chats(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = cf.format_chats(df)
    return {r.conv_id: r for r in out.select("conv_id", "formatted", "loss_spans", cf.read_turns(out["formatted"]).alias("turns"), cf.read_loss(out["formatted"], out["loss_spans"]).alias("loss")).collect()}


ROWS = [
    (1, 2, "assistant", r"\### Assistant: </turn> ok\ "),
    (1, 1, "user", "é\n</turn>\n### user: x"),
    (1, 3, "assistant", " </turn><turn> "),
    (1, 0, "system", ""),
    (2, 0, "user", None),
    (2, None, "a: b#<\\", "first"),
    (3, 0, "user", "same"),
    (3, 0, "user", "same"),
    (None, 0, None, "no id 🙂"),
]


def test_round_trip(spark):
    got = chats(spark, ROWS)
    for conv in (1, 2, 3, None):
        turns = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in ROWS if c == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in turns]
        assert got[conv].loss == "".join(x for _, r, x in turns if r == "assistant")
        spans = [got[conv].formatted[s.start : s.start + s.length] for s in got[conv].loss_spans]
        assert len(spans) == sum(r == "assistant" for _, r, _ in turns)
    assert got[1].formatted.count("### assistant: ") == 1
    assert got[3].formatted == "### user: same </turn><turn> same </turn>\n"


def test_query_against_sql(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    got = sorted((tuple(r) for r in cf.op10_chat_format(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(con.execute(cf.OP10_SQL).fetchall(), key=str)
    own = next(r for r in got if r[0] == -7)
    text = cf.ADDED_TEXT
    assert own[1:5] == (2, hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("rows", [[]])
def test_empty_table(spark, rows):
    assert chats(spark, rows) == {}


def test_long_roles_texts_and_conversations(spark):
    rows = [(1, 0, ":" * 100_000, "x"), (1, 1, "r" * 100_000, "y"), (2, 0, "assistant", "ü<" * 2_500_000), (2, 1, "user", "#" * 5_000_000)]
    rows += [(3, k, "assistant" if k % 2 else "user", f"é{k} " * 50) for k in range(6400)]
    got = chats(spark, rows)
    for conv in (1, 2, 3):
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for c, _, r, x in rows if c == conv]
        assert got[conv].loss == "".join(x for c, _, r, x in rows if c == conv and r == "assistant")
    for s in got[3].loss_spans[:50]:
        assert got[3].formatted[s.start : s.start + s.length].startswith("é")


def test_rows_without_an_id_are_alone(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "b"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    got = sorted(len(r.t) for r in cf.format_chats(df).select(cf.read_turns(F.col("formatted")).alias("t")).collect())
    assert got == [1, 2]


def test_spans_over_many_goes_and_blocks(spark, monkeypatch):
    rows = [(1, k, "assistant" if k % 7 < 4 else "user", f"t{k} é#" * (k % 3)) for k in range(900)] + [(2, k, "assistant", "x") for k in range(600)] + [(3, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spans = lambda: {r.conv_id: (r.formatted, [tuple(s) for s in r.loss_spans]) for r in cf.format_chats(df).collect()}
    want = spans()
    for go in (1, 7, 10_000):
        monkeypatch.setattr(cf, "GO", go)
        assert spans() == want
    for c, (text, found) in want.items():
        learned = [t for i, _, r, t in rows if i == c and r == "assistant"]
        assert [cf_unescaped(text[a : a + n]) for a, n, _, _ in found] == learned
        assert [text.encode()[at : at + n].decode() for _, _, at, n in found] == [text[a : a + n] for a, n, _, _ in found]


def cf_unescaped(text):
    import re

    return re.sub(r"\\(.)", r"\1", text)


def test_long_conversations_take_linear_time(spark):
    import time

    seconds = []
    for n in (6_000, 48_000):
        df = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], "some text") for k in range(n)], "conv_id long, turn long, role string, text string").cache()
        df.count()
        began = time.perf_counter()
        assert cf.format_chats(df).select("loss_spans").first()[0][-1].length == 9
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 8 * max(seconds[0], 1.5)
