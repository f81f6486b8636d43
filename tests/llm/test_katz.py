import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sievelab.llm import katz as k

SCHEMA = "doc_id long, text string, score string, row int"


def brute(rows):
    """The model from its definition, with dictionaries; also the sum of probabilities of some contexts."""
    toks = lambda t: re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, t in rows:
        if i % 3:
            w = toks(t)
            uni.update(w)
            bi.update(zip(["<s>", *w], w))
            ctx.update(["<s>", *w[:-1]])
    one, two = (k.discounts(Counter(c.values())) for c in (uni, bi))
    n = sum(uni.values())
    p1 = {w: float(k.discounted([c], one)[0]) / n for w, c in uni.items()}
    unk = 1 - sum(p1.values())
    after = defaultdict(dict)
    for (v, w), c in bi.items():
        after[v][w] = float(k.discounted([c], two)[0]) / ctx[v]
    alpha = {v: (1 - sum(s.values())) / (1 - sum(p1[w] for w in s)) for v, s in after.items()}
    prob = lambda v, w: after[v][w] if w in after.get(v, {}) else alpha.get(v, 1.0) * p1.get(w, unk)
    for v in list(after)[:20]:
        assert abs(sum(prob(v, w) for w in uni) + prob(v, "?unknown?") - 1) < 1e-9
    out = []
    for i, t in rows:
        w = toks(t)
        base = sum(math.log10((uni[x] + 1) / (n + len(uni) + 1)) for x in w)
        score = sum(math.log10(prob(v, x)) for v, x in zip(["<s>", *w], w))
        out.append((i, i % 3 == 0, len(w), sum(x in uni for x in w), n, round(base, 6), round(score, 6)))
    return sorted(out)


def rows_of(n):
    rng = random.Random(9)
    words = [f"W{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 80)))) for i in range(n)]


def rounded(rows):
    return sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows)


def test_against_the_definition(spark):
    rows = rows_of(150) + [(200, None), (201, ""), (202, "never seen words"), (5, "repeated id")]
    df = spark.createDataFrame([(*r, "c", 0) for r in rows], SCHEMA)
    assert rounded(k.score_texts(df, F.col("doc_id") % 3 == 0).collect()) == brute(rows)


def test_texts_cut_over_blocks_and_empty_tables(spark):
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in rows_of(40)], SCHEMA).coalesce(1)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c a", "a"], "held": [False, True]})
    class Task:
        @staticmethod
        def partitionId():
            return 3
    old, size = k.TaskContext.get, k.BLOCK
    try:
        k.TaskContext.get, k.BLOCK = (lambda: Task), 2
        blocks = [k.Block.of(b.to_pylist()[0]) for b in k._blocks(iter([batch]))]
    finally:
        k.TaskContext.get, k.BLOCK = old, size
    assert [len(b.tokens) for b in blocks] == [2, 2, 2, 1] and blocks[0].before[0] == k.BEGIN
    assert blocks[1].before[0] == blocks[0].words[blocks[0].tokens[1]] and blocks[2].before[0] == blocks[1].words[blocks[1].tokens[1]]
    assert k.score_texts(df.limit(0), F.lit(False)).count() == 0
    only = k.score_texts(df.limit(3), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score <= 0 for r in only)


def test_factors_worked_out_by_hand():
    # counts of counts as 1 / r**2: (r / (r + 1) - 1 / 6) / (5 / 6)
    even = k.discounts({r: 3600 * 3600 / r**2 for r in range(1, 41)})
    assert [round(float(x), 9) for x in even] == [0.0, 0.4, 0.6, 0.7, 0.76, 0.8, 1.0]


def test_factors_stay_below_one_for_counts_out_of_line():
    for odd in ({1: 1000, 2: 300, 3: 120, 4: 60, 5: 400, 6: 30}, {1: 10, 2: 50, 3: 90}, {7: 3}, {}, {1: 5, 40: 1}, {r: 100 for r in range(1, 41)}):
        d = k.discounts(odd)
        assert all(0 < x < 1 for x in d[1:6]) and list(d[1:6]) == sorted(d[1:6]) and d[6] > 0
    assert k.smoothed_slope({r: 100 for r in range(1, 41)}) == k.FLATTEST
    # more keys seen five times than four: the plain estimate would raise a count of four
    assert 5 * 400 / (4 * 60) > 1
