import random
import time

import duckdb
import pytest

from tidemark.llm import url_filter as uf

URLS = [
    "http://a.example.net/en/1?x#y", "https://example.net/en", "https://EXAMPLE.net/en/", "http://xexample.net/en/2", "net://net/", "http://net", "http://org/fr/",
    "http://a.org/fr/x", "http://a.org/de/x", "http://example.com/de/", "http://b.example.com/de", "ftp://host", "nothing", "", None, "a://b://c/d", "http://h?x/y", "http://a.net:80/en/", "http://É.net/\n/en/", "://net/x", "http:///en/", "http://a.net./",
]


def brute(url, rules=uf.RULES, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(str(r)), len(r.host), r.verdict == "allow"), default=None)
    return host, path, str(best) if best else None, best.verdict if best else default


def frame(spark, urls):
    return spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")


def test_query_matches_brute_force_and_sql(spark, tmp_path):
    path = str(tmp_path / "pages.parquet")
    frame(spark, URLS).coalesce(1).write.parquet(path)
    got = sorted(tuple(r) for r in uf.op8_url_filter(spark, str(tmp_path)).collect())
    assert got == [(k, *brute(u)) for k, u in enumerate(URLS)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(con.execute(uf.OP8_SQL).fetchall())


def test_any_rules(spark):
    rng = random.Random(1)
    hosts = ["a", "b.a", "c.b.a", "net", "x.net"]
    paths = ["/", "/p", "/p/", "/p/q", "/pq", "/p/q/r/"]
    rules = [uf.Rule(rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.5]
    urls = [f"s://{rng.choice(['', 'w.', 'b.', 'zb.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'q', '/r/', 'z?p'])}" for _ in range(150)] + URLS
    want = [(k, *brute(u, rules, "block")) for k, u in enumerate(urls)]
    assert sorted(tuple(r) for r in uf.filter_urls(frame(spark, urls), rules, "block").collect()) == want
    held = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert sorted(tuple(r) for r in uf.filter_urls(frame(spark, urls), held, "block").collect()) == want


def test_empty_tables(spark):
    assert uf.filter_urls(frame(spark, []).limit(0)).collect() == []
    assert {r.rule for r in uf.filter_urls(frame(spark, URLS), []).collect()} == {None}


def test_many_rules_of_one_host():
    rules = [uf.Rule("block", "big.example", f"/page{k}") for k in range(100_000)]
    trie = uf.Trie(rules)
    began = time.perf_counter()
    for k in range(2000):
        path = f"/page{k}x{'y' * (k % 9)}"
        assert trie.find("www.big.example", path).path == f"/page{k}"
    assert time.perf_counter() - began < 5
    assert trie.find("big.example", "/pag") is None


@pytest.mark.parametrize("most", [1, 2, 7])
def test_rules_beyond_one_trie(spark, monkeypatch, most):
    monkeypatch.setattr(uf, "MOST_RULES", most)
    rules = [uf.Rule(v, h, p) for v in ("block", "allow") for h in ("a", "b.a", "net") for p in ("/", "/p") if (v, h) != ("allow", "a")]
    urls = ["s://b.a/p/q", "s://a/pq", "s://x.net/p", "s://b.a/", *URLS]
    want = [(k, *brute(u, rules)) for k, u in enumerate(urls)]
    assert sorted(tuple(r) for r in uf.filter_urls(frame(spark, urls), rules).collect()) == want
    held = spark.createDataFrame(rules + rules[:3], "verdict string, host string, path string")
    assert sorted(tuple(r) for r in uf.filter_urls(frame(spark, urls), held).collect()) == want


def test_very_long_url(spark):
    url = "http://a." + "b." * 100_000 + "example.net/en/" + "x/" * 2_000_000
    (r,) = uf.filter_urls(frame(spark, [url])).collect()
    assert (r.rule, r.verdict, len(r.path)) == ("example.net/en/", "allow", 4_000_004)
