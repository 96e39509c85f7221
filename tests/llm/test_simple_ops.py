"""Shards, urls, licences, lines: small cases and brute force."""

import gc
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from tidegrid.llm import common, jaccard, licence_texts as licences, licenses, lines, shards, urls
from tidegrid.llm.queries import URL_RULES

DOCS = "doc_id long, text string, source string, pid int, n int"


def test_shards(spark):
    rows = [(i, None if i % 7 == 0 else "é" * (i * 37 % 50), "s", 1, 2) for i in range(200)] + [(None, "x", "s", 1, 2), (5, "dup", "s", 1, 2), (5, "dup", "s", 1, 2)]
    got = shards.shard_by_bytes(spark.createDataFrame(rows, DOCS), 8).collect()
    total = sum(r["size"] for r in got)
    assert len(got) == 203 and total == sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(8))
    assert max(abs(sum(x["size"] for x in v) - total / 8) for v in by.values()) <= max(r["size"] for r in got) + 1
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [r["doc_id"] for r in order]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    at, slots, want = 0, Counter(), []  # a prefix sum over all rows, in plain Python
    for i, n, c in sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])):
        k = at * 8 // total
        want.append((i, n, c, k, slots[k]))
        at, slots[k] = at + n, slots[k] + 1
    assert [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in order] == want
    assert {r["text_crc32"] for r in got if r["doc_id"] == 5} == {zlib.crc32(("é" * 35).encode()), zlib.crc32(b"dup")}
    assert shards.shard_by_bytes(spark.createDataFrame([], DOCS)).count() == 0


def test_url_rules(spark):
    cases = [
        ("http://a.Example.COM/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("http://example.com/en/6#f", "example.com", "/en/6", "com/en/", "block"),
        ("https://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"), ("https://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        ("https://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), ("ftp://b.org", "b.org", "", None, "allow"), ("b.org/es/", "", "", None, "allow"),
        (None, "", "", None, "allow"), ("x://org/es/a://b", "org", "/es/a://b", "org/es/", "block"), ("h://É.com?q/en/", "É.com", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, none, URL_RULES).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]
    assert urls.filter_urls(pages.limit(0), none, URL_RULES).count() == 0


def test_reputation_shrinks(spark):
    rows = [(i, "http://bad.spam.org/x") for i in range(40)] + [(100 + i, f"http://h{i % 20}.good.com/") for i in range(200)] + [(900, "http://new.spam.org/"), (901, "http://new.good.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = spark.createDataFrame([(p, int("spam" in u)) for p, u in rows if p < 900], "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.filter_urls(pages, bad, []).collect()}
    assert got[0]["verdict"] == "block" and got[100]["verdict"] == "allow" and got[901]["verdict"] == "allow"
    assert got[900]["bad_rate"] > got[901]["bad_rate"] and got[0]["bad_rate"] >= got[900]["bad_rate"]


def test_odd_columns_stay(spark):
    """Columns with the operators' own names, on every path."""
    text = "a line that is shared by all the sites here\nown words of number {}"
    names = "doc_id long, text string, source string, _bad int, _row int, _home int, _hash string, _once string, once string, digest int"
    df = spark.createDataFrame([(i, text.format(i % 9), f"s{i}", 1, 2, 3, "h", "o", "p", i) for i in range(12)], names)
    for limit in (100, 0):
        got = lines.clean_lines(df, broadcast_lines=limit)
        assert got.columns == [*df.columns, "n_lines", "n_removed"]
        assert {(r["_bad"], r["_row"], r["_home"], r["n_removed"], r["text"]) for r in got.collect()} == {(1, 2, 3, 1, f"own words of number {i}") for i in range(9)}
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["digest"], r["_once"]) for r in kept.collect()) == [(0, 0, "o")]  # near copies


def test_licences(spark):
    rows = [
        (1, "intro\nReleased under the MIT License.\nend", "a/b/c.txt"), (2, "Licensed under CC BY-NC 4.0.", "a/LICENSE"), (3, "nothing here", "a/b/d.txt"), (4, "nothing", "z/q.txt"),
        (5, None, "a/x"), (6, "text", None), (7, "", "top.txt"), (8, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files.", "a/b/e/COPYING.md"),
        (9, "?", "a/b/e/f/g"), (10, "Licensed under the Apache License, Version 2.0.", "NOTICE"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r["doc_id"]: (r["licence"], r["origin"], r["from_folder"]) for r in licenses.scan_licences(df).collect()}
    assert got[1] == ("MIT", "own", "a/b") and got[2] == ("CC-BY-NC-4.0", "own", "a") and got[3] == ("CC-BY-NC-4.0", "inherited", "a")
    assert got[4] == ("Apache-2.0", "inherited", "") and got[5] == ("CC-BY-NC-4.0", "inherited", "a") and got[6] == (None, "none", None)
    assert got[7] == ("Apache-2.0", "inherited", "") and got[8][0] == "MIT" and got[9] == ("MIT", "inherited", "a/b/e")
    assert licenses.scan_licences(df.limit(0)).count() == 0


def test_licence_texts_and_deep_paths(spark):
    """Opening lines of usual licence files; a file 70 directories deep inherits from its own directory."""
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed."
    deep = "/".join(f"d{i}" for i in range(70))
    rows = [
        (1, gpl, "g/LICENSE"), (2, "x = 1", "g/a.py"), (3, "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "l/COPYING"),
        (4, "BSD 3-Clause License\n\nCopyright (c) 2020, Somebody\n\n" + licences.BSD_GRANT.replace(", ", ",\n"), "b/LICENSE.txt"), (5, "ISC License\n\nCopyright (c) 2020, Somebody\n\n" + licences.ISC_GRANT, "i/LICENSE"),
        (6, "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nprint(1)", "h/a.py"),
        (7, licences.MIT_GRANT, f"{deep}/LICENSE"), (8, "y", f"{deep}/f.py"), (9, "Licensed under CC BY-NC 4.0.", "d0/LICENSE"), (10, "z", f"{deep}/more/f.py"),
    ] + [(100 + i, f"the and of to in is that it was for {i} words of plain text", f"p/{i}") for i in range(60)]
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got[1] == ("GPL-3.0", "own") and got[2] == ("GPL-3.0", "inherited") and got[3] == ("LGPL-3.0", "own") and got[4][0].startswith("BSD") and got[5] == ("ISC", "own")
    assert got[6] == ("GPL-3.0", "own") and got[8] == ("MIT", "inherited") and got[10] == ("MIT", "inherited") and got[100] == (None, "none")


def test_licence_pruning_is_exact(spark):
    """Units that lack all telling terms stay below the threshold."""
    idf = {t: 1.0 + (i % 5) for i, t in enumerate(sorted({x for _, s in licenses.TEMPLATES for x in licenses.terms_of(s)}))}
    telling = set(licenses.telling_terms(idf, 0.6))
    for _, s in licenses.TEMPLATES:
        own = licenses.terms_of(s)
        assert sum((n * idf[t]) ** 2 for t, n in own.items() if t not in telling) < 0.36 * sum((n * idf[t]) ** 2 for t, n in own.items())



def test_line_dedup_is_brute_force_on_both_paths(spark):
    common, local = "this line stands on many sites", "this line stands on one site only"
    rows = [(i, f"{common}\nown line number {i} of this text\n{local if i % 20 == 0 else 'x'}", f"s{i % 20}", 0, 1) for i in range(60)]
    rows += [(100, None, "s1", 0, 1), (101, "", "s1", 0, 1), (102, common, "s1", 0, 1), (103, f"{common}\n{common}\n", None, 0, 1), (1, rows[1][1], "s1", 0, 1), (104, "short", "s1", 0, 1)]
    df = spark.createDataFrame(rows, DOCS)
    sites = defaultdict(set)
    for _, t, s, *_ in rows:
        for line in (t or "").split("\n"):
            if s is not None and len(line) >= 20:
                sites[line].add(s)
    bad = {line for line, s in sites.items() if len(s) >= 10}
    want = sorted((str(i), None if t is None else "\n".join(x for x in t.split("\n") if x not in bad)) for i, t, *_ in rows)
    for limit in (1000, 0):
        got = lines.clean_lines(df, broadcast_lines=limit)
        assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == want
        assert got.columns == [*df.columns, "n_lines", "n_removed"]
        assert got.agg(F.sum("n_removed")).first()[0] == sum(x in bad for _, t, *_ in rows for x in (t or "").split("\n"))
        assert lines.clean_lines(df.limit(0), broadcast_lines=limit).count() == 0


def test_line_spread_near_the_threshold_is_exact(spark):
    rows = [(k * 1000 + s, f"a line that {n} sites hold, number {k}", f"site{s}") for k, n in enumerate((9, 10, 11, 300)) for s in range(n)]
    bad = lines.boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), lg_k=5)
    assert bad.count() == 3


def test_lines_kept_in_one_place_on_both_paths(spark):
    common, other = "this line stands on many sites", "this other line stands on many sites"
    rows = [(i, f"{common}\nown {i}\n{other}\n{common}", f"s{i}", 0, 1) for i in range(5, 20)]
    rows += [(3, f"{other}\nx\n{other}", "s1", 0, 1), (1, common, None, 0, 1), (None, common, "s2", 0, 1), (5, rows[0][1], "s5", 0, 1), (30, None, "s1", 0, 1)]
    want = [(str(i), f"{common}\nown {i}" if i == 5 else f"own {i}", 4) for i in (5, *range(5, 20))]
    want = sorted([*want, ("3", f"{other}\nx", 3), ("1", "", 1), ("None", "", 1), ("30", None, 0)], key=str)
    df = spark.createDataFrame(rows, DOCS)
    for limit in (1000, 0):
        got = lines.clean_lines(df, broadcast_lines=limit, keep_in="doc_id").collect()
        assert sorted([(str(r["doc_id"]), r["text"], r["n_lines"]) for r in got], key=str) == want
        assert all(r["n_removed"] == r["n_lines"] - len(r["text"].split("\n")) or r["text"] == "" for r in got if r["text"] is not None)


def test_staging_gives_the_drivers_native_memory_back(spark):
    jvm, pid = spark._jvm, spark.sparkContext._gateway.proc.pid
    resident = lambda: int(re.search(r"\nRss:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024
    rows = common.stage(spark.range(1), "small")
    held = [jvm.java.nio.ByteBuffer.allocateDirect(65_536) for _ in range(3200)]  # 200 MB in blocks below the size that the C library maps by itself
    kept = held[::20]  # freed blocks between held ones
    full = resident()
    del held
    gc.collect()
    for _ in range(3):
        jvm.java.lang.System.gc()
        time.sleep(0.5)
    assert common.stage(rows, "small").count() == 1
    assert kept and resident() < full - 40
