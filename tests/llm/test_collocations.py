import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from sievelab.llm import collocations as c

SCHEMA = "doc_id long, lang string, text string, phrase string, n int, words string"


def brute(rows, least, top, share=100):
    """The contract, with dictionaries."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(w[i : i + m] for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cand = {p for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = set()
        for q in cand:
            for m in range(2, len(q)):
                covered |= {q[i : i + m] for i in range(len(q) - m + 1) if 100 * counts[q] >= share * counts[q[i : i + m]]}
        rank = []
        for p in cand - covered:
            a = counts[p]
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rank)[:top], 1)]
    return sorted(out)


def shown(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(rng, size):
    words = ["The", "of", "café", "a", "漢", "it's", "é", "x-y", "\x00", "𝄞"]
    rows = []
    for _ in range(size):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "!?", "  "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "fr", None, ""]), text))
    return rows + [("en", None), (None, ""), ("fr", "alone"), ("fr", " , "), ("de", "only once here"), ("en", "new york city " * 40 + "york new. new york")]


def table(spark, rows):
    return spark.createDataFrame([(i // 2 or None, lang, text, "clash", 1, "clash") for i, (lang, text) in enumerate(rows)], SCHEMA)


def test_equals_brute_force_in_blocks_of_any_size(spark, monkeypatch):
    rows = corpus(random.Random(1), 60)
    for block, least, top, share in ((2_000_000, 3, 2000, 100), (50, 3, 7, 100), (9, 2, 50, 60)):
        monkeypatch.setattr(c, "BLOCK", block)
        batches = [pa.RecordBatch.from_pydict({"lang": ["und" if x is None else x for x, _ in rows], "text": [t or "" for _, t in rows]})]
        total = Counter()
        monkeypatch.setattr(c, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("I", (), {"partitionId": staticmethod(lambda: 0)}))}))
        for batch in c._blocks(iter(batches)):
            b = c.Block(batch.to_pylist()[0])
            for size in range(1, 6):
                every = len(np.unique(b.fingerprints(b.places(size), size)))
                found, ranks = b.phrases(size, np.ones(every, bool))
                assert sorted(set(ranks)) == list(range(every))
                for lang, phrase, n in zip(*found.to_pydict().values()):
                    total[lang, phrase] += n
        monkeypatch.undo()
        want = Counter()
        for lang, text in rows:
            low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
            for piece in re.split("[.,;:!?\n-\r]", low):
                w = re.findall("[^ \t]+", piece)
                want.update(("und" if lang is None else lang, " ".join(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
        assert total == want
        assert shown(c.collocations(table(spark, rows), least, top, share)) == brute(rows, least, top, share)


def test_empty_tables_and_repeated_rows(spark):
    assert c.collocations(table(spark, [])).count() == 0
    assert c.collocations(table(spark, [("en", None), (None, "")])).count() == 0
    rows = [("en", "Big data big data, big deal")] * 30
    assert shown(c.collocations(table(spark, rows), 30)) == brute(rows, 30, 2000)


def test_phrases_with_one_fingerprint_are_told_apart(monkeypatch):
    monkeypatch.setattr(c, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("I", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batch = next(c._blocks(iter([pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["a b a b c d c d c d"]})])))
    block = c.Block(batch.to_pylist()[0])
    monkeypatch.setattr(block, "fingerprints", lambda places, size: np.zeros(len(places), c.U))
    got = block.phrases(2, np.ones(1, bool))[0].to_pydict()
    assert dict(zip(got["phrase"], got["n"])) == {"a b": 2, "b a": 1, "b c": 1, "c d": 3, "d c": 2}


def test_scores_past_64_bits(spark):
    value = spark.range(1).selectExpr(
        "cast(1000 as decimal(4,0)) * cast(9000000000000000 as decimal(16,0)) * cast(9999999999999999 as decimal(16,0))"
        " div (cast(8999999999999999 as decimal(16,0)) * cast(9999999999999998 as decimal(16,0))) AS s"
    ).first().s
    assert value == 1000 * 9000000000000000 * 9999999999999999 // (8999999999999999 * 9999999999999998)
