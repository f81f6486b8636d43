import random
import re

import pyarrow as pa

from sievelab.llm import near_dup as d

SCHEMA = "doc_id long, text string, component_id string, kept int"


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def edited(rng, text, share):
    return " ".join(rng.choice("xyzw") + str(rng.random()) if rng.random() < share else w for w in text.split())


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(1000 + i, text(rng.randint(1, 120))) for i in range(60)]
    base = text(200)
    rows += [(300 + i, edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05]))) for i in range(60)]
    passage = text(70)
    rows += [(100 + i, passage + " " + text(rng.randint(0, 60))) for i in range(60)]
    chain = text(150).split()
    rows += [(600 + i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(12)]
    rows += [(700 + i, base) for i in range(20)]
    rows += [(800, None), (801, ""), (802, " \n "), (803, "One TWO"), (804, "one two"), (805, "one two three"), (806, "É é"), (807, "é é")]
    rng.shuffle(rows)
    out = d.near_duplicates(spark.createDataFrame([(*r, "c", 0) for r in rows], SCHEMA)).collect()
    assert sorted(tuple(r) for r in out) == brute(rows)


def test_null_ids_repeated_ids_and_empty_tables(spark):
    a, b = "alpha beta gamma delta epsilon", "one two three four five"
    rows = [(1, a, "c", 0), (2, a, "c", 0), (2, b, "c", 0), (3, b, "c", 0), (None, a, "c", 0), (9, "zz yy", "c", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in d.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (9, 9, True)]
    kept = d.keep_first(df)
    assert kept.columns == ["doc_id", "text", "component_id", "kept"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 9]
    assert d.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_estimate_similarity_and_fill():
    rng = random.Random(3)
    base = [f"a{i}" for i in range(500)]
    texts = [" ".join(base), " ".join(base[:250] + [f"b{i}" for i in range(250)]), "one", "one two three four five"]
    elements, ends = d.shingle_sets(pa.array([*texts, None, ""]))
    rows = d.sketches(elements, ends)
    assert rows.shape == (4, d.COORDINATES) and list(ends[3:]) == [ends[3]] * 3
    a, b = (shingles(t) for t in texts[:2])
    assert abs((rows[0] == rows[1]).mean() - len(a & b) / len(a | b)) < 0.12
    assert rng


def test_pairs_are_compared_once_and_members_without_partners_go(spark, monkeypatch):
    """Rounds after the first compare new pairs only, so texts do not move again for pairs that have failed."""
    rng = random.Random(21)
    base = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(70):  # near the threshold on both sides, with different first centres
        at = rng.randint(0, 40)
        rows.append((i, " ".join(base[at : at + 220] + [f"n{i}x{j}" for j in range(rng.randint(0, 24))])))
    seen, confirmed = [], d.confirmed

    def watched(pairs, texts):
        seen.append({tuple(r) for r in pairs.select("u", "v").collect()})
        return confirmed(pairs, texts)

    monkeypatch.setattr(d, "confirmed", watched)
    out = d.near_duplicates(spark.createDataFrame([(*r, "c", 0) for r in rows], SCHEMA)).collect()
    assert sorted(tuple(r) for r in out) == brute(rows)
    assert len(seen) > 1 and all(not (a & b) for k, a in enumerate(seen[1:]) for b in seen[1 + k + 1 :])
