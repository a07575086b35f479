"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes give every host, registered domain and suffix a count of good pages. A host's rate is shrunk towards its
domain's through a beta-binomial prior, the domain's towards its suffix's, the suffix's towards all pages'. How strongly, is
estimated by moments from how much the rates at that level differ. A url is blocked if even the upper bound of its host's posterior, a
quantile of that beta distribution, is too low.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._util import cut_lineage

#: (verdict, host/path) pairs.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Pseudo-pages of a prior lie between these, whatever the moments say.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0
#: Second labels below a two-letter country code that make, with it, a public suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Rules up to which matching is one expression; more are looked up by host in the workers.
INLINE_RULES = 100
#: Points of each of the two sums that give a posterior probability.
_POINTS = 400


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits. A rule fits its host and all subdomains of it.

    Of rules of one length the greater text wins.
    """
    ordered = sorted(rules, key=lambda r: (len(r[1]), r[1]))
    if len(ordered) > INLINE_RULES:
        found = _looked_up(ordered)(host, path)
        return found["rule"], found["verdict"]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, pattern in ordered:  # longer rules end up outside
        name, _, prefix = pattern.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule = F.when(fits, F.lit(pattern)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _looked_up(ordered: list[tuple[str, str]]):
    """A column function (host, path) -> (rule, verdict): the rules by host, tried for the host and every domain above it."""
    by_name: dict[str, list[tuple[str, str, str]]] = {}
    for what, pattern in reversed(ordered):
        name, _, prefix = pattern.partition("/")
        by_name.setdefault(name, []).append((f"/{prefix}", pattern, what))

    @F.arrow_udf("rule string, verdict string")
    def look_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in batches:
            found = []
            for host, path in zip(hosts.to_pylist(), paths.to_pylist()):
                best, at = None, 0
                while at >= 0:
                    hit = next((r for r in by_name.get(host[at:], ()) if path.startswith(r[0])), None)
                    if hit and (best is None or (len(hit[1]), hit[1]) > (len(best[1]), best[1])):
                        best = hit
                    at = host.find(".", at) + 1 or -1
                found.append({"rule": best[1], "verdict": best[2]} if best else {"rule": None, "verdict": None})
            yield pa.array(found, pa.struct([("rule", pa.string()), ("verdict", pa.string())]))

    return look_up


def _site(host: Column) -> tuple[Column, Column, Column]:
    """Whether a host is an address, its name without user, port and final dots, and how many labels its public suffix has."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    name = F.regexp_replace(bare, r"\.+$", "")
    address = name.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$")
    labels = F.split(name, r"\.")
    top, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    double = (F.size(labels) > 2) & (F.length(top) == 2) & second.isin(*SECOND_LEVEL)
    return address, name, F.when(double, 2).otherwise(1)


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two as in ``co.uk`` (SECOND_LEVEL); ``address`` for IP addresses."""
    address, name, n = _site(host)
    return F.when(address, F.lit("address")).otherwise(F.when(n == 2, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1)))


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and the label before it; an IP address is its own."""
    address, name, n = _site(host)
    return F.when(address, name).otherwise(F.when(n == 2, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2)))


def beta_above(rate: float, a: Column, b: Column) -> Column:
    """Probability that a beta(a, b) variable exceeds ``rate``; JVM-side.

    Its density is summed by Simpson's rule on the scale of log(x / (1 - x)), on which it is smooth and has thin tails, left and right of ``rate``.
    """
    mode, reach = F.log(a / b), 8 * F.sqrt(1 / a + 1 / b)
    low, high = mode - reach - 30 / a, mode + reach + 30 / b
    at = F.least(F.greatest(F.lit(math.log(rate / (1 - rate))), low), high)
    height = lambda u: -a * F.log1p(F.exp(-u)) - b * F.log1p(F.exp(u))

    def area(start: Column, end: Column) -> Column:
        step = (end - start) / _POINTS
        weight = lambda i: F.when((i == 0) | (i == _POINTS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        points = F.sequence(F.lit(0), F.lit(_POINTS))
        return step * F.aggregate(points, F.lit(0.0), lambda s, i: s + weight(i) * F.exp(height(start + step * i) - height(mode)))

    below, above = area(low, at), area(at, high)
    return above / (below + above)


def _strength(children: DataFrame, by: str) -> DataFrame:
    """(by, strength): pseudo-pages of the prior for the children in each parent, by moments of beta-binomial rates."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    sums = children.where("n > 0").groupBy(by).agg(
        F.count("*").alias("g"), F.sum(n).alias("total"), F.sum(k).alias("good"), F.sum(n * n).alias("squares"), F.sum(k * k / n).alias("scatter")
    )
    rate = F.col("good") / F.col("total")
    spread = (F.col("scatter") - F.col("good") * rate) / F.nullif(rate * (1 - rate), F.lit(0.0)) - (F.col("g") - 1)
    room = F.col("total") - F.col("squares") / F.col("total") - (F.col("g") - 1)
    alike = F.when(room > 0, spread / F.nullif(room, F.lit(0.0)))  # correlation of two pages of one child
    strength = F.when(alike > 0, F.greatest(F.lit(LEAST_PRIOR), F.least(F.lit(MOST_PRIOR), 1 / F.nullif(alike, F.lit(0.0)) - 1))).otherwise(F.lit(MOST_PRIOR))
    return sums.select(by, strength.alias("strength"))


def host_reputation(pages: DataFrame) -> DataFrame:
    """(host, n, mean, size) of the beta posterior of each host's rate of good pages, from rows (host, good) with ``good`` 1, 0 or null.

    The posterior is beta(mean * size, (1 - mean) * size). Hosts without labelled pages have their domain's rate and the prior's size.
    """
    hosts = pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("k"))
    hosts = cut_lineage(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    everything = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean_0"))
    all_suffixes = _strength(suffixes.withColumn("one", F.lit(1)), "one").select(F.col("strength").alias("s_0"))
    weak = F.lit(LEAST_PRIOR)

    def shrunk(mean: str, strength: Column) -> Column:
        return (F.col("k") + strength * F.col(mean)) / (F.col("n") + strength)

    top = suffixes.crossJoin(F.broadcast(everything)).join(F.broadcast(all_suffixes), F.lit(True), "left")  # one row each
    level1 = top.withColumn("mean_1", shrunk("mean_0", F.coalesce("s_0", weak))).select("suffix", "mean_1")
    level1 = level1.join(_strength(domains, "suffix").withColumnRenamed("strength", "s_1"), "suffix", "left")
    level2 = domains.join(level1, "suffix").withColumn("mean_2", shrunk("mean_1", F.coalesce("s_1", weak))).select("domain", "mean_2")
    level2 = level2.join(_strength(hosts, "domain").withColumnRenamed("strength", "s_2"), "domain", "left")
    size = F.col("n") + F.coalesce("s_2", weak)
    out = hosts.join(level2, "domain").withColumn("mean", shrunk("mean_2", F.coalesce("s_2", weak)))
    return out.select("host", "n", "mean", size.alias("size"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    least_rate: float = 0.5,
    confidence: float = 0.95,
) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``.

    ``outcomes`` has (id_col, good): labelled pages, good 1 or 0; repeated ids count once, as good only if all say so. The longest
    rule decides; where none fits, a host is blocked if the ``confidence`` quantile of its posterior rate of good pages is below
    ``least_rate``, so hosts without enough evidence pass. Rows with null or repeated ids are judged one by one; a null id has no outcome. A null url or one without ``://`` has host and path
    empty and is judged as that host. An empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = outcomes.where(F.col("good").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("good").alias("good"))
    reputation = host_reputation(rows.join(labels, "id", "left").select("host", "good"))
    above = beta_above(least_rate, F.col("mean") * F.col("size"), (1 - F.col("mean")) * F.col("size"))
    bad = F.when(F.col("mean") < least_rate, above < 1 - confidence).otherwise(F.lit(False))
    blocked = cut_lineage(reputation.where(bad).select("host", F.lit(True).alias("bad")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # Only blocked hosts are joined.
    judged = rows.withColumns({"rule": rule, "by_rule": verdict}).join(blocked, "host", "left")
    method = F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"))
