import re
from collections import Counter

from sievelab.llm.quality_rules import RULES, keep_by_rules, rule_verdicts

SCHEMA = "doc_id long, text string, n_words string, kept int"


def brute(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_counts_and_verdicts(spark):
    good = "Here is the plain text of a page that was made for people to read."
    texts = [
        None, "", " \n\t", "one", good, good, "a b c d e " * 3, "x\ny\nx\n\n \nx", "the end " * 20_000,
        "w$ " * 12 + good, "ünï cödé 漢字 😀 the of and to in is", good + "\n" + good, "a b c d e a b c d e a b c d",
    ]
    rows = [(i if i else None, t, "clash", 7) for i, t in enumerate(texts)]
    out = rule_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t, *_ in rows:
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed)
    assert by[4].kept and by[5].kept and not by[9].kept and by[9].failed == ["symbols"]
    kept = keep_by_rules(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n_words", "kept"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)
    assert rule_verdicts(spark.createDataFrame([], SCHEMA), RULES).count() == 0


def test_one_projection_without_user_functions(spark):
    plan = rule_verdicts(spark.range(3).selectExpr("id doc_id", "'a b' text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Aggregate" not in plan
