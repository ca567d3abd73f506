import hashlib
import textwrap

from pyspark.sql import functions as F

from loomq.llm import licence_scan as ls

from llm_cases import SCHEMA

MIT = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + ls.KNOWN["MIT"]


def test_canonical_forms(spark):
    texts = ["", "  A--B\n\nC ", "Copyright 2020 X\nThe Licence, sub-license; whilst\n(c) y\n© z\nAll rights reserved.\nend", "organisation licence licence", "a_b ÄÖ ß 12.5", "copyright\n", "x copyright stays"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ls.one_spelling(ls.canonical(F.col("t"))).alias("c")).collect()
    for r in rows:
        assert r.c == ls.canonical_text(r.t), r.t
    assert ls.canonical_text(texts[2]) == "the license sublicense while end"


def test_lookup(spark, odd, none):
    known = ls.KNOWN | {"MIT-full": "MIT License\n\n" + ls.KNOWN["MIT"]}
    texts = [MIT, MIT.upper().replace(" ", "\n"), MIT.replace("Software", "Programme"), ls.KNOWN["ISC"], "intro\nreleased under the MIT Licence!\nx\nLicensed under CC BY-NC 4.0\nReleased under the MIT License.", None, ""]
    df = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.licence, r.notices) for r in ls.scan(df, known).collect()}
    assert got[0][0] == "MIT-full" and got[2][0] is None and got[3][0] == "ISC"
    assert got[4] == (None, ["CC-BY-NC-4.0-notice", "MIT-notice"]) and got[5] == got[6] == (None, [])
    rows = ls.scan(odd).collect()
    assert len(rows) == odd.count() and {r.digest for r in rows if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert ls.scan(none).count() == 0 and ls.scan(df, {}).count() == len(texts)


def test_wrapped_licences(spark):
    wrap = lambda t, width: textwrap.fill(t, width, break_long_words=False, break_on_hyphens=False)
    isc = ls.KNOWN["ISC"].replace("that the above ", "that the above\n")
    mit = "Copyright 2020 Some One\n" + ls.KNOWN["MIT"].replace("AUTHORS OR ", "AUTHORS OR\n")
    cases = [("ISC", isc), ("MIT", mit)] + [(n, wrap(ls.KNOWN[n], w)) for n in ("MIT", "ISC", "0BSD") for w in (1, 24, 40, 61, 72, 79, 80)]
    df = spark.createDataFrame([(k, t, None, None) for k, (_, t) in enumerate(cases)], SCHEMA)
    got = {r.doc_id: r.licence for r in ls.scan(df).collect()}
    assert [got[k] for k in range(len(cases))] == [n for n, _ in cases]
    gone = ["Copyright 2020 X", "  * Copyright (c) The Authors", "(C) 2021-2022 Me", "Copyright: Some One", "Copyright the Go Authors", "© any one", "All rights reserved."]
    stay = ["copyright notice, this list", "COPYRIGHT HOLDERS BE LIABLE", "copyright owner or", "(c) You must retain", "(c) the licenses granted", "Copyright", "copyright law.", "copyrighted works"]
    lines = spark.createDataFrame([(f"{t}\nend",) for t in gone + stay], "t string").select("t", ls.one_spelling(ls.canonical(F.col("t"))).alias("c")).collect()
    assert [r.c == "end" for r in lines] == [True] * len(gone) + [False] * len(stay)
    assert all(r.c == ls.canonical_text(r.t) for r in lines)


def plain_runs(text, known):
    """Every run of lines, brought to canonical form by itself, looked up among the known texts' canonical forms."""
    names = {}
    for n in sorted(known):
        for t in [known[n]] if isinstance(known[n], str) else known[n]:
            names.setdefault(ls.canonical_text(t), n)
    lines = (text or "").split("\n")
    return sorted({names[c] for i in range(len(lines)) for j in range(i, len(lines)) if (c := ls.canonical_text("\n".join(lines[i : j + 1]))) in names and c})


def test_runs_of_lines_equal_brute_force(spark):
    import random

    known = {"cc0": "This work is CC0.", "pd": "Public domain", "one": "Unencumbered", "two": "Do as you like.\nSub-license it, per cent by percent, in any noncommercial organisation.", "long": "Use it.\nCopyright 2020 Me\nNo warranty is given whilst\nyou use it.", "deep": ("Use it.", "Use it. Twice.")}
    pieces = ["This work is CC0.", "this work", "is cc0", "PUBLIC DOMAIN!", "unencumbered", "Do as you like.", "sublicense it, percent by per", "cent, in any non commercial organization", "Sub", "license it, percent by percent, in any non-commercial organisation", "Use it.", "No warranty is given while", "you use it.", "(c) 2021 X", "Twice.", "", "other words", "is given"]
    rng = random.Random(4)
    texts = [None, "", *("\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(1500)), "\n".join(["x", *known["two"].split("\n"), "y"])]
    runs = ls.Runs(known)
    for t in texts:
        assert runs.found(t) == plain_runs(t, known), t
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").selectExpr("*", "1 AS digest", "2 AS licence", "3 AS notices")
    got = {r.doc_id: r.notices for r in ls.scan(df, known).collect()}
    assert got == {k: plain_runs(t, known) for k, t in enumerate(texts)}
    assert any(len(x) > 1 for x in got.values())


def test_licences_inside_longer_texts(spark):
    from loomq.llm.licence_texts import FOLDER, common

    whole = {f.name.removesuffix(".txt"): f.read_text() for f in sorted(FOLDER.glob("*.txt"))}
    texts = [(k, f"def f():\n    return 1\n\n{t}\n\nmore of it, " + "and more " * 50_000) for k, t in enumerate(whole.values())]
    got = {r.doc_id: r.notices for r in ls.scan(spark.createDataFrame(texts, "doc_id bigint, text string"), common()).collect()}
    assert all(name in got[k] for k, name in enumerate(whole)), {n: got[k] for k, n in enumerate(whole) if n not in got[k]}
