"""URL filters against plain Python and SQL."""

import random
import re

from tests.oracle import compare, connect
from tidemark.llm import urls
from tidemark.llm.queries import ORACLES, QUERIES

RULES = "host string, path string, verdict string"
LOWER = {code: code + 32 for code in range(65, 91)}


def _plain(pages, rules, default="allow"):
    best = {}
    for host, path, verdict in rules:
        if verdict is not None:
            key = ((host or "").translate(LOWER), path or "")
            best[key] = max(verdict, best.get(key, verdict))
    out = []
    for page, url in pages:
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].translate(LOWER), found[2]) if found else ("", "")
        fits = [
            (len(h + p), len(h), h + p, v)
            for (h, p), v in best.items()
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        out.append((page, host, path, *(max(fits)[2:] if fits else (None, default))))
    return sorted(out, key=str)


def _got(frame):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in frame.collect()), key=str)


def test_nested_rules_and_odd_addresses(spark):
    draw = random.Random(6)
    labels, paths = ["a", "b", "com", "co", "x-y", "é", "a0", ""], ["", "/", "/a", "/a/", "/a/b", "/b/a/", "/é", "//"]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randrange(1, 5)))
    rules = [(host(), draw.choice(paths), draw.choice(["allow", "block"])) for _ in range(120)]
    rules += [(None, None, "block"), ("", "/b", "allow"), ("COM", "/A", "block"), ("com", "/A", "allow"), ("a", "/", None)]
    pages = [(i, f"http{draw.choice(['', 's'])}://{host()}{draw.choice(paths)}{draw.choice(['', 'a/b', '?q=/a', '#/a', ':80/'])}") for i in range(3000)]
    pages += [(i, pages[1][1]) for i in range(3000, 4000)]
    pages += [(None, None), (None, ""), (7, "no scheme"), (7, "://"), (7, "://"), (8, "x://A.COM/A?://b"), (9, "\n://a\nb.com/x\ny"), (10, "http://com/" + "a/" * 50000)]
    told = spark.createDataFrame([(*page, "x", "y") for page in pages], "page_id bigint, url string, host string, rule string").repartition(5)
    assert _got(urls.judge_urls(told, spark.createDataFrame(rules, RULES))) == _plain(pages, rules)
    some = rules[:9]
    assert _got(urls.judge_urls(told, spark.createDataFrame(some, RULES), default="block")) == _plain(pages, some, "block")


def test_empty_tables(spark):
    pages, rules = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string"), spark.createDataFrame([], RULES)
    assert _got(urls.judge_urls(pages, rules)) == [(1, "a.b", "/c", None, "allow")]
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame([("a", "/", "block")], RULES)).count() == 0


def test_a_busy_host_is_cut_into_parts_that_all_know_the_rules_above(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        pages = [(i, f"http://s{i % 3}.busy.net/en/{i}") for i in range(6000)] + [(i, f"http://h{i}.org/fr/") for i in range(6000, 9000)]
        rules = [("net", "/", "block"), ("busy.net", "/en/1", "allow"), ("s1.busy.net", "/en/", "block"), ("", "/fr", "block")]
        frame = spark.createDataFrame(pages, "page_id bigint, url string")
        assert _got(urls.judge_urls(frame, spark.createDataFrame(rules, RULES))) == _plain(pages, rules)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op13_url_filters"](spark, folder), connect(folder), ORACLES["op13_url_filters"]) == []
