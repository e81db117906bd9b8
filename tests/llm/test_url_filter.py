from collections import defaultdict

from lakejoin.llm import url_filter
from lakejoin.llm.queries import URL_RULES

from llm_data import DATA


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min([path.index(c) for c in "?#" if c in path] + [len(path)])]


def rule(host, path):
    best = None
    for _, text in URL_RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best)):
            best = text
    return best


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.COM/en/1?x#y", "https://www.example.com/en/", "http://x.net/es/2", "http://net/fr/", "ftp://h?q/z", "noscheme/en",
            "", None, "http://", "http://com", "http://xcom/en/", "a://b://c/d", "HTTP://É.com/En/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(df, URL_RULES).collect():
        host, path = parse(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule(host, path)), r
        if r["rule"]:
            assert r["verdict"] == dict((t, v) for v, t in URL_RULES)[r["rule"]]


def test_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = url_filter.judge(pages, URL_RULES).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert (r["host"], r["path"]) == parse(r["url"])
        assert r["verdict"] in ("allow", "block")


def test_tree_generalises_and_judges(spark):
    rows = []
    for i in range(200):
        rows += [(f"http://good.org/news/{i}",), (f"http://bad.org/win/{i}",), (f"http://bad.org/about/slug-number-{i}",)]
    rules = [("allow", "good.org/news/"), ("block", "bad.org/win/1"), ("allow", "bad.org/about/slug-number-1")]
    df = spark.createDataFrame(rows + [("http://new.org/win/7",), ("http://new.org/news/7",)], "url string")
    out = {r["url"]: r for r in url_filter.judge(df, rules).collect()}
    assert out["http://bad.org/win/77"]["verdict"] == "block" and out["http://bad.org/win/77"]["template"] == "/win/{n}"
    assert out["http://bad.org/about/slug-number-77"]["verdict"] == "allow"
    assert out["http://bad.org/about/slug-number-77"]["template"] == "/about/*"
    assert out["http://new.org/win/7"]["verdict"] == "block" and out["http://new.org/news/7"]["verdict"] == "allow"


def test_small_sections_and_deep_paths_keep_their_labels(spark):
    """A blocked section of under 2% among allowed ones, and two branches below the fourth segment."""
    sections = [f"c{chr(97 + i // 10)}-{chr(97 + i % 10)}" for i in range(59)] + ["dx"]
    rules = [("allow", "hot.org/c"), ("block", "hot.org/dx/a")]
    urls = [f"http://hot.org/{x}/{y}" for x in sections for y in ("aa", "ab", "ac", "ad", "ae", "af", "b")]
    deep = "deep.org/p/q/r/s/"
    rules += [("block", f"{deep}bad/a"), ("allow", f"{deep}good/a")]
    urls += [f"http://{deep}{x}/{y}" for x in ("bad", "good") for y in [*(f"a{chr(97 + i)}" for i in range(20)), "b"]]
    out = {r["url"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert out["http://hot.org/dx/b"] == "block" and out["http://hot.org/ca-a/b"] == "allow"
    assert (out[f"http://{deep}bad/b"], out[f"http://{deep}good/b"]) == ("block", "allow")


def test_nothing_labelled_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "http://a/b", "h"), (1, None, "h")], "page_id long, url string, host string")
    out = url_filter.judge(df, [])
    assert out.columns[:4] == ["page_id", "url", "host", "host_"]
    assert {r["verdict"] for r in out.collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0


def test_deep_paths_of_unlike_hosts_open_no_levels(spark, monkeypatch):
    """One host is blocked, the other allowed: nothing divides within a host, however deep the paths."""
    tables = []
    staged = url_filter.shared.staged
    monkeypatch.setattr(url_filter.shared, "staged", lambda df: tables.append(1) or staged(df))
    deep = "/".join(f"s{i}" for i in range(41))
    rows = [(i, f"http://{'example.com/en' if i % 2 else 'example.com/de'}/{deep}/p{i}".replace("example.com/de", "good.com/de")) for i in range(40)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in got)
    assert len(tables) <= 2 * url_filter.LEVELS + 4
