import random
import re

import pytest
from pyspark.sql import functions as F

import compare
from lodestream.llm import host_reputation as H

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x?q#f", "http://example.net/en/", "http://xexample.net/en/a", "ftp://net/",
    "http://net", "http://a.net?x=/en/", "http://a.net#/en/", "http://b.org/fr/z", "http://b.org/fr", "http://org/fr/", "x://y://z/p",
    "http://example.com/de/1", "http://sub.example.com/de", "http://example.com/en/de/", "http://É.net/Ü", "http://user@h.com:80/p/é?x",
    "://h/p", "http://a.example.net/EN/", "http://a.b.co.uk/x", "http://co.uk/x", "http://localhost/x", "http://1.2.3.4/x", "http://a..net/x",
]


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :]).group()
    best = None
    for text, says in H.RULES:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = text, says
    return host, path, best


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rule, says = H.rule_of()
    rows = H.with_host(frame).select("page_id", "host", "path", rule.alias("r"), says.alias("v")).collect()
    for r in rows:
        host, path, best = plain(URLS[r.page_id])
        assert (r.host, r.path, r.r, r.v) == (host, path, *(best or (None, None)))


def test_groups(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.example.com", "example.com", "localhost", "", "a.gov.fr"]
    rows = H.with_groups(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    assert {r.host: (r.domain, r.suffix) for r in rows} == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "x.example.com": ("example.com", "com"),
        "example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""), "a.gov.fr": ("a.gov.fr", "gov.fr"),
    }


def test_user_port_dot_and_addresses(spark):
    same = ["example.com", "example.com:8080", "me@example.com", "me:pw@example.com:", "example.com.", "example.com.:80", "a.example.com:1"]
    own = {"10.0.0.1": "10.0.0.1", "10.0.0.1:80": "10.0.0.1", "[::1]": "[::1]", "u@[::1]:8": "[::1]"}
    rows = H.with_groups(spark.createDataFrame([(h,) for h in [*same, *own]], "host string")).collect()
    found = {r.host: (r.domain, r.suffix) for r in rows}
    assert found == dict.fromkeys(same, ("example.com", "com")) | {h: (d, d) for h, d in own.items()}


def plain_posterior(units, mu):
    """{unit: (mean, a, b)} of {unit: (n, bad)} with prior means mu."""
    beyond = sum((b - n * mu[u]) ** 2 - n * mu[u] * (1 - mu[u]) for u, (n, b) in units.items())
    scale = sum(n * (n - 1) * mu[u] * (1 - mu[u]) for u, (n, b) in units.items())
    rho = min(H.MOST, max(H.LEAST, beyond / scale)) if scale > 0 else H.MOST
    w = round(1 / rho - 1, 6)
    out = {}
    for u, (n, b) in units.items():
        x, y = mu[u] * w + b, (1 - mu[u]) * w + n - b
        out[u] = x / (x + y), x, y
    return out


def test_reputation_by_hand(spark):
    rng = random.Random(2)
    hosts = {}
    for d in range(12):
        for h in range(rng.randrange(1, 6)):
            n = rng.choice([0, 1, 5, 60])
            hosts[f"h{h}.d{d}.{rng.choice(['com', 'org', 'co.uk'])}"] = (n, sum(rng.random() < (0.8 if d == 3 else 0.1) for _ in range(n)))
    got = {r.host: r for r in H.reputation(spark.createDataFrame([(h, n, b) for h, (n, b) in hosts.items()], "host string, n long, bad long")).collect()}

    def suffix(h):
        return "co.uk" if h.endswith("co.uk") else h.rsplit(".", 1)[1]

    def domain(h):
        return ".".join(h.split(".")[1:])

    def summed(name):
        out = {}
        for h, (n, b) in hosts.items():
            m, c = out.get(name(h), (0, 0))
            out[name(h)] = m + n, c + b
        return out

    total, bad = (sum(v[k] for v in hosts.values()) for k in (0, 1))
    s = plain_posterior(summed(suffix), dict.fromkeys(summed(suffix), (bad + 0.5) / (total + 1)))
    d = plain_posterior(summed(domain), {x: s[suffix("h." + x)][0] for x in summed(domain)})
    h = plain_posterior(hosts, {x: d[domain(x)][0] for x in hosts})
    for x, (mean, a, b) in h.items():
        assert got[x].mean == pytest.approx(mean, rel=1e-5)
        assert got[x].low == pytest.approx(mean - H.DEVIATIONS * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5, rel=1e-4, abs=1e-6)


def test_bad_hosts_are_blocked_and_shrunk(spark):
    pages = [(i, f"http://bad.x.com/{i}") for i in range(40)] + [(100 + i, f"http://good.y.com/{i}") for i in range(200)]
    pages += [(900, "http://new.x.com/"), (901, "http://once.y.com/"), (901, "http://once.y.com/"), (None, None), (902, "http://a.net/")]
    outcomes = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(200)] + [(901, 1), (None, 1), (900, None), (900, 7)]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("n", F.lit(1))
    out = H.filter_urls(frame, spark.createDataFrame(outcomes, "page_id long, bad int"))
    assert out.count() == len(pages)
    says = {r.page_id: r.verdict for r in out.collect()}
    assert says[0] == "block" and says[100] == "allow" and says[901] == "allow" and says[902] == "block"
    rate = {r.host: r.bad_rate for r in out.collect()}
    assert rate["bad.x.com"] > rate["new.x.com"] > rate["good.y.com"]
    empty = H.filter_urls(frame.limit(0), spark.createDataFrame([], "page_id long, bad int"))
    assert empty.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark, sf):
    assert compare.difference(spark, compare.duck(sf), sf, "op3_host_reputation") is None
