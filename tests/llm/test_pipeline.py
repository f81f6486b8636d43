from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline as p
from sievelab.llm.bpe import codec  # noqa: F401  the stages use it
from sievelab.llm.common import table
from sievelab.llm.decontaminate import item_words
from sievelab.llm.q_bpe import tokenizer_path
from test_near_dup import brute as components
from test_quality_rules import brute as counts

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    seen = []
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append((name, {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()}))
        if name != "token_ids":
            assert docs.columns == before.columns
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}

    name, before, after = seen[0]
    for i, r in before.items():
        n, _, symbols, _, repeats = counts(r.text)
        if n < 10 or 100 * repeats > 20 * n or symbols > 0.1 * n:
            assert i not in after
    gone = [i for i in before if i not in after and labels.get(i) == 1 and counts(before[i].text)[0] >= 10]
    assert len(gone) <= 0.02 * len(before)

    name, before, after = seen[1]
    assert sum(labels.get(i) == 1 for i in before) - sum(labels.get(i) == 1 for i in after) <= 2

    name, before, after = seen[2]
    assert sorted(after) == [i for i, _, _, kept in components([(i, r.text) for i, r in before.items()]) if kept]

    name, before, after = seen[3]
    items = [item_words(r.text) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    changed = Counter()
    for i, r in before.items():
        words = item_words(r.text)
        hit = any(tuple(words[j : j + 10]) in windows for j in range(len(words) - 9))
        changed[hit, i in after and after[i].text != r.text] += 1
        if not hit:
            assert after[i].text == r.text
        elif i in after:
            left = item_words(after[i].text)
            assert len(left) < len(words) and after[i].n_chars == len(after[i].text)
    assert changed[True, True] > 0

    name, before, after = seen[4]
    library = Tokenizer.from_file(tokenizer_path())
    assert {i: r.ids for i, r in after.items()} == {i: library.encode(r.text, add_special_tokens=False).ids for i, r in before.items()}
    assert sorted(r.doc_id for r in p.run(spark, SF).collect()) == sorted(after)
