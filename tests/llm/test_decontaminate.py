import random

from sievelab.llm import decontaminate as d

DOCS = "doc_id long, text string, items string"
ITEMS = "item_id long, text string, doc_id int"


def brute(text, items, window):
    words = d.item_words(text)
    hit, found = set(), set()
    for item, t in items:
        w = d.item_words(t)
        n = min(len(w), window)
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if wins and tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n, letters="abc": " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, text(rng.randint(1, 14))) for i in range(25)] + [(90, None), (91, " .,"), (92, text(6)), (92, text(6))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)]
    docs += [(1, items[0][1]), (None, items[3][1]), (500, None), (501, ""), (502, "Ab C-d É,f " * 4000)]
    for window in (3, 5, 10):
        df = spark.createDataFrame([(*r, "x") for r in docs], DOCS)
        out = d.find_contamination(df, spark.createDataFrame([(*r, 0) for r in items], ITEMS), window=window).collect()
        got = sorted((r.n_words, r.n_hit, r["items"], r.doc_id or -1) for r in out)
        assert got == sorted((*brute(t, items, window), i or -1) for i, t in docs)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("ab") for _ in range(12))) for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice("ab") for _ in range(80)), "") for i in range(40)], DOCS)
    bench = spark.createDataFrame([(*r, 0) for r in items], ITEMS)
    one = sorted(d.find_contamination(docs, bench).collect())
    monkeypatch.setattr(d, "BLOCK_WORDS", 30)
    assert len(d.item_blocks(bench, "item_id", "text")) == 10
    assert sorted(d.find_contamination(docs, bench).collect()) == one


def test_spans_are_cut_out_and_covered_documents_go(spark):
    passage = "One two, three FOUR five six seven eight nine ten"
    rows = [
        (1, f"é keep this (begin) {passage}! and all of this stays, too: a b c d e f g h i j k", "c"),
        (2, passage, "c"), (3, None, "c"), (4, "clean text", "c"),
    ]
    bench = spark.createDataFrame([(7, passage.lower() + " eleven", 0)], ITEMS)
    out = {r.doc_id: r for r in d.remove_spans(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert sorted(out) == [1, 3, 4] and out[3].text is None and out[4].text == "clean text"
    assert out[1].text == "é keep this (begin) ! and all of this stays, too: a b c d e f g h i j k"
    assert d.remove_spans(spark.createDataFrame([], DOCS), bench).count() == 0
    none = d.find_contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], ITEMS)).collect()
    assert all(r.n_hit == 0 and r["items"] == [] for r in none)
