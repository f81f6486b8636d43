import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sievelab.llm import spelling_variants as v
from sievelab.llm.q_spelling_variants import misprinted, spelling_variants

SCHEMA = "doc_id long, text string, word string, key int"
LOW = str.maketrans(v.UPPER, v.LOWER)


def counted(rows, shortest=6, least=5):
    """Words from the contract, with dictionaries."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    """All words against all words."""
    around = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, others in around.items():
        top = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = top if top and n[top] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def vocabulary(rng, size, letters="abcé"):
    words = {}
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        for _ in range(rng.randint(1, 4)):
            words[w] = int(5 * 6 ** rng.uniform(0, 5))
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]])
            if len(w) < 6:
                break
    return words


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    for letters in ("ab", "abcé", "abcdefghijklmnopéÿ×"):
        n = vocabulary(rng, 250, letters)
        df = spark.createDataFrame(list(n.items()), "word string, n long")
        assert shown(v.group_variants(df)) == grouped(n)


def test_words_of_texts(spark):
    rng = random.Random(2)
    base = list(vocabulary(rng, 40, "abcdefÉé"))
    rows = [(i, " ".join(rng.choices(base, k=60)).replace("a", rng.choice("aA"))) for i in range(30)]
    rows += [(0, "ÉCOLES x÷y ABCDEFß-abcdefß" * 9), (0, "ÉCOLES x÷y ABCDEFß-abcdefß" * 9), (31, None), (32, ""), (33, "1234567 ______"), (34, "longword" * 5000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    words = v.corpus_words(df, misprinted)
    assert {r.word: r.n for r in words.collect()} == counted(rows)
    assert v.group_variants(v.corpus_words(spark.createDataFrame([], SCHEMA), misprinted)).count() == 0


def test_null_ids_are_empty_text(spark):
    df = spark.createDataFrame([(None, "abcdefgh " * 5)], "doc_id long, text string")
    assert [r.n for r in v.corpus_words(df).collect()] == [5]


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(3)
    for _ in range(300):
        places = sorted(rng.sample(range(9), rng.randint(3, 7)))
        prefix = [(p, rng.randint(1, 9)) for p in places]
        got = v.pivots(prefix)
        cost = dict(prefix)
        assert len(got) == 2 and got[1] - got[0] >= 2
        assert sum(cost[p] for p in got) == min(cost[a] + cost[b] for a in places for b in places if b - a >= 2)


def test_query_on_a_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect()
    assert shown(spelling_variants(spark, sf)) == grouped(counted([(r.doc_id, r.text) for r in docs]))


def test_no_side_of_a_join_is_broadcast(spark, monkeypatch):
    texts = []
    monkeypatch.setattr(v, "written", lambda df, name, with_path=False, real=v.written: (
        texts.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name, with_path))[1])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        words = spark.createDataFrame([("garden", 50), ("gardon", 2), ("gardens", 9), ("window", 4)], "word string, n long")
        out = v.group_variants(words)
        texts.append(out._jdf.queryExecution().executedPlan().toString())
        assert {r.word: r.root for r in out.collect()} == {"garden": "garden", "gardon": "garden", "gardens": "garden", "window": "window"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sum("SortMergeJoin" in t for t in texts) >= 4
    assert not any("Broadcast" in t for t in texts)
