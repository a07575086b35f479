import pytest
from pyspark.sql import functions as F

from fieldloom.functions.numeric import beta_inc
from fieldloom.llm.url_rules import INLINE_RULES, RULES, beta_above, domain_of, judge_urls, suffix_of


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule(host, path):
    best = None
    for verdict, text in RULES:
        name, _, prefix = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            best = max(best or (0,), (len(text), text, verdict))
    return best[1:] if best else (None, None)


URLS = [
    None, "", "no scheme", "http://", "://x", "HTTP://WWW.Example.NET/en/1", "http://example.net", "http://net/", "http://a.net?x=/en/", "http://anet/", "http://x.example.com/de/#", "http://example.com/deep",
    "http://É.org/fr/x", "http://org/fr", "http://org/fr/", "a://b://c.net/", "http://h.net:80/", "http://u@x.org/fr/y?z#q", "http://x.example.net/EN/", "http://x\n.net/a\nb",
]


def test_parts_and_rules_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: r for r in judge_urls(df, none).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        text, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, text), url
        assert got[i].verdict == (verdict or got[i].verdict)


def test_bad_hosts_are_blocked_and_few_pages_are_shrunk(spark):
    pages, labels = [], []
    for host, n, good in (("good.site.xyz", 300, 290), ("bad.site.xyz", 300, 20), ("new.site.xyz", 1, 0), ("unseen.site.xyz", 2, None), ("other.abc", 200, 190), ("hot.site.xyz", 2000, 1900)):
        for j in range(n):
            pages.append((len(pages), f"https://{host}/p{j}"))
            if good is not None:
                labels.append((pages[-1][0], int(j < good)))
    labels.append(labels[0])
    df = spark.createDataFrame(pages, "page_id long, url string").repartition(4)
    got = {r.host: r.verdict for r in judge_urls(df, spark.createDataFrame(labels, "page_id long, good int")).collect()}
    assert got == {"good.site.xyz": "allow", "bad.site.xyz": "block", "new.site.xyz": "allow", "unseen.site.xyz": "allow", "other.abc": "allow", "hot.site.xyz": "allow"}


def test_suffixes_and_domains(spark):
    want = {
        "www.bbc.co.uk": ("co.uk", "bbc.co.uk"), "a.b.example.com": ("com", "example.com"), "example.com.": ("com", "example.com"), "10.0.0.1": ("address", "10.0.0.1"),
        "10.0.0.1:8080": ("address", "10.0.0.1"), "[2001:db8::1]:443": ("address", "[2001:db8::1]"), "user:pw@x.org:80": ("org", "x.org"), "co.uk": ("uk", "co.uk"),
        "localhost": ("localhost", "localhost"), "": ("", ""), "x.com.au..": ("com.au", "x.com.au"), "shop.nic.io": ("io", "nic.io"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string").select("host", suffix_of(F.col("host")).alias("s"), domain_of(F.col("host")).alias("d"))
    assert {r.host: (r.s, r.d) for r in df.collect()} == want


def test_posterior_probability(spark):
    cases = [(0.5, 3.0), (2.0, 2.0), (30.0, 70.0), (0.1, 1.9), (400.0, 620.0), (1.0, 9.0), (45.0, 55.0)]
    for rate in (0.5, 0.3):
        got = spark.createDataFrame(cases, "a double, b double").select("a", "b", beta_above(rate, F.col("a"), F.col("b")).alias("p")).collect()
        for r in got:
            assert r.p == pytest.approx(1 - beta_inc(r.a, r.b, rate), abs=1e-5)


def test_host_domain_and_suffix_each_decide(spark):
    """An unlabelled host goes by its domain, one of an unlabelled domain by its suffix; a labelled host by itself."""
    pages, labels = [], []

    def add(host, n, good):
        for j in range(n):
            pages.append((len(pages), f"http://{host}/{j}"))
            if good is not None:
                labels.append((pages[-1][0], int(j < good)))

    for i in range(30):
        add(f"h{i}.bad.com", 40, 2)
        add(f"h{i}.fine.com", 40, 39)
        add(f"www.d{i}.junk", 40, 1)
        add(f"www.d{i}.co.uk", 40, 39)
        add(f"h{i}.mixed.com", 40, 38 if i % 2 else 3)
    for host in ("new.bad.com", "new.fine.com", "www.new.junk", "www.new.co.uk", "new.mixed.com"):
        add(host, 1, None)
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.host: r.verdict for r in judge_urls(df, spark.createDataFrame(labels, "page_id long, good int")).collect()}
    assert [got[f"h{i}.mixed.com"] for i in (2, 3)] == ["block", "allow"] and got["new.mixed.com"] == "allow"
    assert (got["new.bad.com"], got["new.fine.com"], got["www.new.junk"], got["www.new.co.uk"]) == ("block", "allow", "block", "allow")


def test_many_rules_and_odd_ids(spark):
    """More rules than one expression holds give what each one gives; null and repeated page ids keep their rows."""
    many = [*RULES, *[("block", f"h{i}.example.net/p{i}") for i in range(2 * INLINE_RULES)], ("allow", "h7.example.net/p7/x"), ("allow", "h8.example.net/")]
    urls = [*URLS, "http://h7.example.net/p7/xy", "http://www.h7.example.net/p7", "http://h8.example.net/p8", "http://h9.example.net/", "http://h9.example.net/en/"]
    df = spark.createDataFrame([(None if i % 3 else 1, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    none = spark.createDataFrame([(1, 1), (1, 0), (None, 0)], "page_id long, good int")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in judge_urls(df, none, rules=many).collect())

    def longest(host, path):
        fits = [(len(t), t) for _, t in many if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        return max(fits)[1] if fits else None

    assert got == sorted((str(None if i % 3 else 1), *parts(u), str(longest(*parts(u)))) for i, u in enumerate(urls))


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([(1, 1)], "page_id long, good int")).count() == 0
