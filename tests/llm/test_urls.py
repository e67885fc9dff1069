import re
import time

from glyphmill.llm import urls
from glyphmill.llm.queries import URL_RULES
from glyphmill.llm.urls import Cascade, judge_urls

URLS = [
    None, "", "no scheme", "http://COM/en/", "http://a.com/en/1", "https://example.com/en/71", "https://x.Example.com/en/7?q", "http://notexample.com/en/7",
    "http://a.example.net/de/8", "http://example.net/de/9#x", "http://net/de", "http://a.org/es/?x", "http://org?/es/", "http://a.b.c.d.org/es/x", "ftp://x#://com/en/",
    "http://com./en/", "http://.com/en/", "http://com:80/en/", "x://y://com/en/", "http://ÀB.com/en/\n", "http://a.com/EN/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_equals_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(3, URLS[3], "", 2)], "page_id long, url string, host string, rule long")
    got = judge_urls(pages, URL_RULES).collect()
    assert {tuple(r) for r in got} == {(i, *brute(u)) for i, u in enumerate(URLS)}
    assert len(got) == len(URLS) + 1


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).collect() == []
    assert judge_urls(spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string"), []).collect()[0].verdict == "allow"


def test_cascade_is_exact_with_many_levels(spark, monkeypatch):
    from pyspark.sql import functions as F

    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 20000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    for name, value in (("LEAST_BITS", 64), ("BITS_PER_KEY", 4), ("PAGE", 1 << 10)):
        monkeypatch.setattr(urls, name, value)
    cascade = Cascade(listed, universe)
    assert len(cascade.levels) > 2
    got = {r.key for r in universe.where(cascade.holds(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()}


def test_a_long_list_has_no_bound(spark):
    from pyspark.sql import functions as F

    n = (1 << 20) + 5
    cascade = Cascade(spark.range(n).select(F.concat(F.lit("k"), "id")), spark.range(2 * n).select(F.concat(F.lit("k"), "id")))
    universe = spark.range(2 * n).select("id", F.concat(F.lit("k"), "id").alias("key"))
    assert universe.where(cascade.holds(F.col("key")) != (F.col("id") < n)).count() == 0


def test_long_hosts(spark):
    hosts = ["a." * 16_000 + "com", "b" * 100_000 + ".org", "." * 5000]
    pages = spark.createDataFrame([(i, f"http://{h}/en/") for i, h in enumerate(hosts)], "page_id long, url string")
    judge_urls(pages, URL_RULES).collect()
    at = time.perf_counter()
    judged = judge_urls(pages, URL_RULES)
    built = time.perf_counter() - at
    got = {r.page_id: (r.rule, r.verdict) for r in judged.collect()}
    assert got == {i: brute(f"http://{h}/en/")[2:] for i, h in enumerate(hosts)}
    assert time.perf_counter() - at - built < 2
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()


def test_rules_as_a_table(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    assert {tuple(r) for r in judge_urls(pages, rules).collect()} == {(i, *brute(u)) for i, u in enumerate(URLS)}
