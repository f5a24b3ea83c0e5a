"""URL filter by empirical-Bayes host reputation, in DataFrame functions only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import cut_lineage, table, unlink

#: Rules as (host and path, verdict); the longest that fits wins. Fixed by the query's contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Second-level names that together with a two-letter country make a public suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: What is taken off a host for grouping, one after the other (user, port, final dots), and hosts that are addresses.
ASIDE = (r"^[\s\S]*@", r":[0-9]*\z", r"\.+\z")
ADDRESS = r"^([0-9]+(\.[0-9]+){3}\z|\[)"
#: A host is blocked if the lower bound of its rate of bad pages is above LIMIT.
LIMIT, DEVIATIONS = 0.25, 1.0
#: Bounds of the correlation within a group, from which a prior's weight follows.
LEAST, MOST = 0.001, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path; both are empty for a null or a url without ://."""
    start = F.locate("://", F.col(url))
    rest = F.when(start > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = rest.substr(F.length(raw) + 1, F.length(rest))
    return pages.withColumns({"host": F.translate(raw, UPPER, LOWER), "path": F.regexp_extract(after, r"^[^?#]*", 0)})


def rule_of(rules=RULES) -> tuple[F.Column, F.Column]:
    """(longest rule that fits host and path or null, its verdict)."""
    rule, verdict = None, None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, path = text.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def with_groups(hosts: DataFrame) -> DataFrame:
    """hosts with suffix and domain: the public suffix, and it with one more label. A host without a dot is its own.

    User, port and final dots do not count, so example.com:8080 is grouped with
    example.com; an address in numbers or brackets is its own domain and suffix.
    """
    suffix = (
        r"[^.]+\.(?:" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2}$",
        r"[^.]+\.[^.]+$",
    )
    named = hosts.withColumn("_name", F.col("host"))
    for part in ASIDE:
        named = named.withColumn("_name", F.regexp_replace("_name", part, ""))
    own = F.col("_name").rlike(ADDRESS)
    long, short = (F.regexp_extract("_name", s, 0) for s in suffix)
    domain = F.when(own, F.col("_name")).when(long != "", long).when(short != "", short).otherwise(F.col("_name"))
    tail = F.when(~own, F.regexp_extract("domain", r"\.(.*)$", 1)).otherwise("")
    grouped = named.withColumn("domain", domain).withColumn("suffix", F.when(tail != "", tail).otherwise(F.col("domain")))
    return grouped.drop("_name")


def _shrunk(units: DataFrame, name: str) -> DataFrame:
    """Posterior of each unit (bad, n, prior mean mu): a, b and mean.

    How much the prior weighs is read off the data: the variance of the units'
    counts beyond the binomial gives the correlation of pages in one unit.
    """
    beyond = F.sum((F.col("bad") - F.col("n") * F.col("mu")) ** 2 - F.col("n") * F.col("mu") * (1 - F.col("mu")))
    scale = F.sum(F.col("n") * (F.col("n") - 1) * F.col("mu") * (1 - F.col("mu")))
    rho = F.when(F.col("scale") > 0, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.col("beyond") / F.col("scale"))))
    totals = units.agg(beyond.alias("beyond"), scale.alias("scale"))
    both = units.withColumn("weight", totals.select(F.round(1 / F.coalesce(rho, F.lit(MOST)) - 1, 6)).scalar())
    a, b = F.col("mu") * F.col("weight") + F.col("bad"), (1 - F.col("mu")) * F.col("weight") + F.col("n") - F.col("bad")
    return both.withColumns({f"{name}_a": a, f"{name}_b": b, f"{name}_mean": a / (a + b)}).drop("mu", "weight")


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, n, bad, mean, low): posterior rate of bad pages of each host.

    hosts (host, n, bad) count the labelled pages of each. The overall rate is
    the prior of a suffix, its posterior mean that of its domains, theirs that
    of hosts: beta-binomial at each level, so a host without labels has its
    domain's rate and one with many its own. low is the mean less DEVIATIONS
    standard deviations of the posterior.
    """
    named = cut_lineage(with_groups(hosts))
    count = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    overall = named.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("mu"))
    suffixes = _shrunk(named.groupBy("suffix").agg(*count).withColumn("mu", overall.scalar()), "s")
    suffixes = cut_lineage(suffixes.select("suffix", F.col("s_mean").alias("mu")))
    domains = named.groupBy("suffix", "domain").agg(*count)
    domains = _shrunk(domains.join(suffixes, "suffix"), "d")
    domains = cut_lineage(domains.select("domain", F.col("d_mean").alias("mu")))
    out = _shrunk(named.join(domains, "domain"), "h")
    total = F.col("h_a") + F.col("h_b")
    spread = F.sqrt(F.col("h_a") * F.col("h_b") / (total * total * (total + 1)))
    known = cut_lineage(out.select("host", "n", "bad", F.col("h_mean").alias("mean"), (F.col("h_mean") - DEVIATIONS * spread).alias("low")))
    for done in (named, suffixes, domains):
        unlink(done)
    return known


def filter_urls(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict and the host's labelled pages, mean and lower bound.

    outcomes are (page_id, bad), bad 0 or 1: other and null values are no
    outcome, repeated ones count as often. A page's rule decides; without one it
    is blocked if the host's lower bound exceeds LIMIT. Pages are counted by
    host before anything is joined; what is joined back is a row for each host,
    written first, so that a host with a third of all pages is split.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "n_labelled", "bad_rate", "bad_bound")]
    placed = with_host(pages, url).select(*kept, "host", "path")
    told = outcomes.select(F.col(page_id).alias("_page"), F.col("bad").alias("_bad")).filter("_bad IN (0, 1)")
    pairs = with_host(pages, url).select(F.col(page_id).alias("_page"), "host")
    seen = pairs.join(told, "_page").groupBy("host").agg(F.count("*").alias("n"), F.sum("_bad").cast("long").alias("bad"))
    hosts = (
        pairs.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
        .unionByName(seen)
        .groupBy("host")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    )
    known = reputation(hosts)
    rule, says = rule_of(rules)
    known = known.select("host", F.col("n").alias("__n"), F.col("mean").alias("__mean"), F.col("low").alias("__low"))
    own = F.when(F.col("__low") > LIMIT, "block").otherwise("allow")
    return placed.join(known, "host").select(
        *kept, "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"),
        F.col("__n").alias("n_labelled"), F.col("__mean").alias("bad_rate"), F.col("__low").alias("bad_bound"),
    )


def op3_host_reputation(spark, sf_dir):
    """Host, path, rule and verdict of every page.

    labels are keyed by document; a label counts as the outcome of the page of
    the same number, bad if its quality is 0 or it is toxic.
    """
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes)
    return out.select("page_id", "host", "path", "rule", "verdict", "n_labelled")


_DIGITS = f"""least({MOST}, greatest({LEAST}, beyond / scale))"""


def _shrink_sql(name: str, units: str) -> str:
    return f"""
{name}_w AS (SELECT round(1 / coalesce(CASE WHEN scale > 0 THEN {_DIGITS} END, {MOST}) - 1, 6) AS weight FROM (
  SELECT sum((bad - n * mu) ** 2 - n * mu * (1 - mu)) AS beyond, sum(n * (n - 1) * mu * (1 - mu)) AS scale FROM {units})),
{name} AS (SELECT * EXCLUDE (mu, weight), mu * weight + bad AS a, (1 - mu) * weight + n - bad AS b,
  (mu * weight + bad) / (mu * weight + bad + (1 - mu) * weight + n - bad) AS mean FROM {units}, {name}_w)"""


OP3_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
o AS (SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 THEN 0 END AS bad FROM labels),
c AS (SELECT host, count(o.bad)::BIGINT AS n, coalesce(sum(o.bad), 0)::BIGINT AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '{ASIDE[0]}', ''), '{ASIDE[1]}', ''), '{ASIDE[2]}', '') AS name FROM c),
d AS (SELECT *, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN regexp_matches(name, '[^.]+\.({"|".join(SECOND_LEVEL)})\.[a-z]{{2}}$')
    THEN regexp_extract(name, '[^.]+\.(?:{"|".join(SECOND_LEVEL)})\.[a-z]{{2}}$')
    WHEN regexp_matches(name, '[^.]+\.[^.]+$') THEN regexp_extract(name, '[^.]+\.[^.]+$') ELSE name END AS domain FROM f),
e AS (SELECT *, CASE WHEN NOT regexp_matches(name, '{ADDRESS}') AND regexp_extract(domain, '\.(.*)$', 1) <> '' THEN regexp_extract(domain, '\.(.*)$', 1) ELSE domain END AS suffix FROM d),
su AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM e) AS mu FROM e GROUP BY suffix),{_shrink_sql("sp", "su")},
du AS (SELECT e.domain, sum(e.n)::BIGINT AS n, sum(e.bad)::BIGINT AS bad, any_value(sp.mean) AS mu FROM e JOIN sp USING (suffix) GROUP BY e.domain),{_shrink_sql("dp", "du")},
hu AS (SELECT e.host, e.n, e.bad, dp.mean AS mu FROM e JOIN dp USING (domain)),{_shrink_sql("hp", "hu")},
k AS (SELECT host, n, mean - {DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM hp),
v AS (SELECT p.*, k.n AS n_labelled, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE WHEN k.low > {LIMIT} THEN 'block' ELSE 'allow' END AS own FROM p JOIN k USING (host))
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
  WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' ELSE own END AS verdict, n_labelled FROM v
"""
