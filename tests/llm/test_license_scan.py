import math
import re
from collections import Counter

from sievelab.llm import license_scan as m
from sievelab.llm.common import table
from sievelab.llm.license_texts import Template, templates
from sievelab.llm.q_license_scan import license_scan


def header(text):
    block = re.match(m.COMMENT_BLOCK.replace("*+", "*"), text)
    if block:
        return block[1].split("\n")
    out = []
    for line in text.split("\n"):
        if not re.match(r"\s*(#|//|--|;|%|\*|/\*|(rem|dnl)\b|$)", line, re.I):
            break
        out.append(line)
    return out


def units_of(path, text):
    joined = "\n".join("" if re.fullmatch("[^A-Za-z0-9]*", x) else x for x in header(text))
    parts = [x for x in [joined, *re.split("\n\n+", joined)] if re.search(m.MENTION, x)]
    whole = [text] if re.match(m.LICENSE_FILE, path.split("/")[-1]) and text else []
    return list(dict.fromkeys([x for x in text.split("\n") if re.search(m.MENTION, x)] + parts + whole))


def brute(files, rows):
    units = {f: units_of(*f) for f in files}
    every = [m.template_terms(u) for us in units.values() for u in us] + [m.template_terms(r.text) for r in rows]
    df = Counter(t for u in every for t in u)
    vec = lambda c: {t: (1 + math.log(k)) * (math.log((1 + len(every)) / (1 + df[t])) + 1) for t, k in c.items()}
    size = lambda v: math.sqrt(sum(w * w for w in v.values()))
    own = {}
    for f, us in units.items():
        fits = []
        for u in map(m.template_terms, us):
            for r in rows:
                a, b = vec(u), vec(m.template_terms(r.text))
                cos = sum(w * b.get(t, 0) for t, w in a.items()) / size(a) / size(b) if a else 0
                if cos >= m.LEAST[r.form] and all(t in u for t in r.must.split()):
                    fits.append((-round(cos, 9), r.licence))
        if fits:
            score, name = min(fits)
            own[f] = (name, round(-score, 6))
    grants = {}
    for (path, _), (name, score) in own.items():
        if re.match(m.LICENSE_FILE, path.split("/")[-1]):
            grants.setdefault(path.rpartition("/")[0], []).append((-score, path, name))
    out = []
    for path, text in files:
        mine = own.get((path, text), (None, None))
        here = path.rpartition("/")[0]
        parents = [here] + [here[:i] for i in range(len(here) - 1, -1, -1) if i == 0 or here[i] == "/"]
        near = next((d for d in parents if d in grants), None)
        name = mine[0] or (min(grants[near])[2] if near is not None else None)
        out.append((path, *mine, name, None if mine[0] else near))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = templates()
    files = [
        ("LICENSE", "Released under the MIT License.\nwith more words"), ("a/x.py", "code\ncode"), ("a/b/LICENSE.txt", m.TEMPLATES["GPL-3.0"]),
        ("a/b/y.py", "# licensed under the apache license, version 2.0\ncode"), ("a/b/c/d/z.py", "nothing here"), ("a/bc/z.py", "nothing"),
        ("e/COPYING", "All rights reserved, no licence is given to you."), ("e/f.py", ""), ("a/b/LICENSE-2", m.TEMPLATES["MIT"]),
        ("g/h.py", "the license of these many other words that say nothing"), ("g/i.py", "the license of these many other words that say nothing"),
        ("k/COPYING.txt", next(r.text for r in rows if r.licence == "GPL-2.0" and r.form == "text")), ("k/a/b.c", "/* Copyright X\n *\n * of it */\nx"),
        ("k/s.sh", "#!/bin/sh\n# SPDX-License-Identifier: BSD-3-Clause\n\nx"), ("k/all.c", "// Copyright of all\n//\n// lines are comments"),
    ]
    df = spark.createDataFrame([(*f, "c") for f in files], "path string, text string, license string")
    got = sorted((tuple(r) for r in m.scan(df).collect()), key=str)
    assert got == brute(files, rows)
    by = {r[0]: r for r in got}
    assert by["a/b/c/d/z.py"][3] in ("GPL-3.0", "MIT") and by["e/f.py"][4] == "" and by["k/a/b.c"][3:] == ("GPL-2.0", "k")
    again = m.scan(df.union(df)).collect()
    assert len(again) == 2 * len(files) and len({(r.path, r.own_license) for r in again}) == len(files)
    odd = spark.createDataFrame([(None, None, "c"), (None, "x", "c"), ("p", None, "c")], df.schema)
    assert m.scan(odd).count() == 3 and m.scan(df.limit(0)).count() == 0


def commented(text, mark):
    about = ["A file that sorts things.", "", "Copyright 2020 Foo Inc.", "All rights reserved.", "", *text.split("\n")]
    if mark == "/*":
        return "/*\n" + "".join(f" * {x}\n" for x in about) + " */\nint x;\n"
    return "#!/bin/sh\n" + "".join(f"{mark} {x}\n" for x in about) + "\nrun it\n"


def test_standard_texts_headers_and_ids(spark):
    files = {}
    for i, t in enumerate(templates()):
        if t.form == "text":
            files[f"{i}/LICENSE"] = (f"The licence\nCopyright (c) 2021 Some Person\n\n{t.text}", t.licence)
        elif t.form == "id":
            files[f"{i}/x.py"] = (f"# {t.text}\ncode", t.licence)
        elif t.form == "header":
            files[f"{i}/x.c"] = (commented(t.text, "/*"), t.licence)
            files[f"{i}/x.sh"] = (commented(t.text, "#"), t.licence)
        else:
            files[f"{i}/x.txt"] = ("some words\n" + t.text.replace("\n", " ") + "\nmore words", t.licence)
    misses = [
        "Copyright 2020 Foo. Licensed under the Foo Proprietary License, Version 2.0.", "# SPDX-License-Identifier: Foo-9", "Released under the Foo License.",
        "This work is licensed under the Foo Public License, version 2.", "copyright law is a matter of the state",
        "This software is confidential. You shall use it only under the license agreement that you entered into with Foo. No license is granted "
        "to copy, modify or distribute the software, in source or binary form, with or without fee.",
    ]
    files |= {f"miss{i}/LICENSE": (text, None) for i, text in enumerate(misses)}
    df = spark.createDataFrame([(p, text) for p, (text, _) in files.items()], "path string, text string")
    got = {r.path: r.own_license for r in m.scan(df).collect()}
    assert got == {p: name for p, (_, name) in files.items()}


def test_many_lines_and_own_templates(spark):
    long = "\n".join(["# a comment"] * 50_000) + "\n" + "word " * 200_000
    df = spark.createDataFrame([("d/LICENSE", long), ("d/e", "house rules of the house license"), ("x", "/*" + "*\n" * 20_000)], "path string, text string")
    rows = [Template("House", "notice", "rules of the house license", "house")]
    got = {r.path: r for r in m.scan(df, rows=rows).collect()}
    assert got["d/e"].own_license == "House" and got["d/LICENSE"].own_license is None and got["x"].license is None


def test_notices_in_documents_are_found(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = {r.doc_id: r for r in license_scan(spark, sf).collect()}
    assert sorted(rows) == sorted(texts)
    for i, text in texts.items():
        says = [k for k, v in m.TEMPLATES.items() if v in text.split("\n")]
        assert rows[i].own_license == (says[0] if says else None)


def test_native(spark):
    plan = m.scan(spark.range(3).selectExpr("'a' path", "'license' text"))._jdf.queryExecution().toString()
    units = spark.range(3).select(m.units_of(m.F.lit("license"), m.F.lit("a")))._jdf.queryExecution().toString()
    assert "Python" not in plan + units and "Cartesian" not in plan + units
