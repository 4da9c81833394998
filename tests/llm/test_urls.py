"""URL verdicts against a plain reading of the rules."""

import random
import re

from gleanery.llm import urls


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), a == "block", h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, False, None, "allow"))
    return host, path, best[2], best[3]


def judged(spark, rows, rules):
    df = spark.createDataFrame([(i, u, "r") for i, u in rows], "page_id long, url string, rule string")
    out = urls.judge(df, "page_id", "url", urls.rule_table(spark, rules), sorted({len(p) for _, p, _ in rules}))
    return sorted(map(tuple, out.collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["http://", "HTTPS://", "x://a://", "", "//"]) + ".".join(r.choice(["a", "Example", "example", "org", "com", "www", ""]) for _ in range(r.randint(1, 4)))
             + r.choice(["", "/", "/es/", "/en/1", "/en/123?x=/de/", "/fr/a#b", "/de", "/de/é", "/ES/", "//es/", "?q=/", "#f", ":80/es/"])) for i in range(600)]
    rows += [(1, None), (2, ""), (None, "http://a.org/x"), (7, "http://b.example.org/es/1"), (7, "http://b.example.org/es/1"), (8, "http://" + "a." * 300 + "org/" + "p/" * 2000)]
    for rules in (urls.RULES, (("org", "/e", "block"), ("a.org", "", "allow"), ("example.org", "/e", "allow"), ("com", "/d", "block"), ("com", "/d", "allow"))):
        assert judged(spark, rows, rules) == sorted([(i, *brute(u, rules)) for i, u in rows], key=str)


def test_empty(spark):
    assert judged(spark, [(1, "http://a.org/")], urls.RULES)[0][3] == "org/"
    df = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(df, "page_id", "url", urls.rule_table(spark, urls.RULES), [1]).collect() == []


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = urls.judge(df, "page_id", "url", urls.rule_table(spark, urls.RULES), [1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_very_long_hosts(spark):
    """Only endings with as many labels as a rule's host are made."""
    import time

    df = spark.createDataFrame([(1, "http://" + "a." * 20000 + "org/x"), (2, "http://" + "." * 20000 + "com/de/")], "page_id long, url string")
    began = time.time()
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.judge(df, "page_id", "url", urls.rule_table(spark, urls.RULES)).collect())
    assert got == [(1, "org/", "allow"), (2, "com/de/", "block")] and time.time() - began < 30
