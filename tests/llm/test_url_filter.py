from pyspark.sql import functions as F

from framelark.llm import url_filter as uf


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [h + p for _, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_rules(spark, odd_pages):
    verdicts = {h + p: v for v, h, p in uf.RULES}
    got = uf.judge(odd_pages).collect()
    want = [(r.page_id, *brute(r.url)) for r in odd_pages.collect()]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(want, key=str)
    assert all(r.verdict == verdicts.get(r.rule, r.verdict) and r.verdict in ("allow", "block") for r in got)


def test_trees_learn(spark):
    rows = [(i, f"http://{'spam-' if i % 2 else ''}host{i % 7}.{'bad' if i % 2 else 'good'}/{i}{'?a=1&b=2' if i % 4 == 1 else ''}", i % 2) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, blocked int")
    lexical = uf.lexical(pages).join(pages.select("page_id", "blocked"), "page_id")
    model = uf.fit(lexical.where("page_id < 300").drop("page_id", "host", "path"))
    held = uf.blocked(lexical.where("page_id >= 300"), model).collect()
    assert all((r.chance >= 0.5) == (r.page_id % 2 == 1) for r in held)


def test_lexical_values(spark):
    pages = spark.createDataFrame([(1, "https://a-b.c.net/x/y1?p=2&q=3"), (2, None)], "page_id long, url string")
    got = {r.page_id: r for r in uf.lexical(pages).collect()}
    assert (got[1].f0, got[1].f1, got[1].f4, got[1].f5, got[1].f7, got[1].f8) == (30, 2, 2, 2, 1, 1)
    assert got[2].f0 == 0 and got[2].f3 == 0


def test_no_labels_and_empty(spark, no_pages):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, "")], "page_id long, url string")
    assert {r.verdict for r in uf.judge(pages).collect()} == {"allow"}
    assert uf.judge(no_pages).count() == 0


def test_no_python_in_the_plan(odd_pages):
    plan = uf.judge(odd_pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert F is not None


def test_long_and_repeated_urls(spark):
    long = "http://www.EXAMPLE.com/en/" + "a/b1" * 30_000 + "?" + "p=1&" * 5_000
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([long, long, "http://x.net/fr/", "http://net.org/?q"])], "page_id long, url string")
    got = {r.page_id: r for r in uf.judge(pages).collect()}
    assert all((got[i].host, got[i].path, got[i].rule) == brute(long) for i in (0, 1)) and got[0].verdict == got[1].verdict == "allow"
    assert got[2].verdict == "block" and got[3].rule is None
