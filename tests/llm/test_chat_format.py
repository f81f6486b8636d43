from pyspark.sql import functions as F

from sievelab.llm.chat_format import escape, format_chats, parse_chats, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"


def test_round_trip_merging_and_odd_rows(spark):
    rows = [
        (1, 0, "user", "a ### b </turn>\n \\ \\h \\\\l", 1),
        (1, 1, "user", None, 1),
        (1, 2, "assistant", "### User: x</part>", 1),
        (1, 3, "assistant", "", 1),
        (2, None, None, "null turn", 1),
        (2, 5, "odd: role </", "t\\", 1),
        (2, 5, "odd: role </", "t\\", 1),
        (None, 0, "assistant", "lone", 1),
        (3, 0, "user", "long " * 50_000, 1),
    ]
    out = format_chats(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["conv_id", "n_turns", "n_merged", "formatted", "loss_spans"]
    back = {r.conv_id: r for r in parse_chats(out).collect()}
    merged = {r.conv_id: (r.n_turns, r.n_merged) for r in out.collect()}
    assert merged == {1: (4, 2), 2: (3, 2), None: (1, 1), 3: (1, 1)}
    for conv in (1, 2, 3, None):
        want = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == want
        assert back[conv].loss_texts == [t for r, t in want if r == "assistant"]
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_escapes_are_reversible(spark):
    from itertools import product

    texts = [("".join(p),) for n in range(5) for p in product("\\h#<", repeat=n)] + [("####</</\\l\\\\h",)]
    df = spark.createDataFrame(texts, "t string").withColumn("e", escape(F.col("t")))
    assert df.filter(unescape(F.col("e")) != F.col("t")).count() == 0
    assert df.filter(F.col("e").contains("###") | F.col("e").contains("</")).count() == 0


def test_long_conversations_merge_across_chunks(spark):
    from itertools import groupby

    from sievelab.llm import chat_format as m

    n = 3 * m.CHUNK + 7
    rows = [(9, i, "user" if i // 5 % 3 else "assistant", f"t{i} ###" * (i % 4)) for i in range(n)]
    rows += [(8, i, "user", "same") for i in range(m.CHUNK)] + [(7, i, "assistant", str(i)) for i in range(m.CHUNK + 1)]
    rows += [(6, 0, "", "no role"), (6, 1, "", "again"), (6, 2, "user", "x")]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    counts = {r.conv_id: (r.n_turns, r.n_merged) for r in out.collect()}
    back = {r.conv_id: r for r in parse_chats(out).collect()}
    for conv in (6, 7, 8, 9):
        own = [(r[2], r[3]) for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == own
        assert back[conv].loss_texts == [t for r, t in own if r == "assistant"]
        assert counts[conv] == (len(own), len(list(groupby(own, lambda t: t[0]))))
