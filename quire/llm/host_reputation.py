"""URL filter: rules first, then empirical-Bayes host reputation. DataFrame operations only.

Labelled page outcomes (bad or not) are counted by host, registered domain (last two labels) and
suffix (last label). Rates shrink down this tree: a suffix towards the overall rate, a domain
towards its suffix, a host towards its domain, each by a beta prior whose strength is the
beta-binomial moment estimate of its level. The verdict of a page that no rule decides follows
from a posterior bound: block where ``mean - z * sd`` of its host's bad rate exceeds ``max_bad``,
so thin evidence never blocks. Hosts without labels get their domain's posterior mean as prior.

Counts are aggregated before they move and joined back as small written tables; a host with a
third of all pages is one aggregated row.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and counts
as the host ``''``; labels of unknown pages and null labels are ignored; several labels of a page
count each; repeated pages are judged each; empty tables give no rows (pages) or the overall prior
(labels); other columns of ``pages`` stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

#: The query's rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_BAD, Z = 0.5, 1.0
#: Limits of the estimated prior strength, in labelled pages.
LEAST, MOST = 2.0, 200.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> Column:
    """The last two labels, or the whole host if it has fewer."""
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(two == "", host).otherwise(two)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def prior_strength(units: DataFrame) -> float:
    """Beta-binomial moment estimate over units with n labelled pages, k of them bad: with the
    weighted mean p and variance v of k/n, kappa = (p(1-p) - v) / (v - p(1-p) * units / sum n)."""
    r = units.filter("n > 0").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("units"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"),
    ).first()  # four sums
    if not r["n"]:
        return LEAST
    p = r["k"] / r["n"]
    v = r["kk"] / r["n"] - p * p
    beyond = v - p * (1 - p) * r["units"] / r["n"]
    return min(MOST, max(LEAST, (p * (1 - p) - v) / beyond)) if beyond > 0 else MOST


def host_posteriors(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each host of ``pages`` (page_id, host): labelled, bad, and mean and sd of its
    posterior bad rate. ``labels`` holds page_id and bad (boolean)."""
    per_page = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    hosts = pages.join(per_page, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    hosts = C.stored(hosts.select("host", registered_domain(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    base = (total["k"] + 1) / (total["n"] + 2)
    by_suffix, by_domain, by_host = (prior_strength(x) for x in (suffixes, domains, hosts))
    suffixes = suffixes.select("suffix", ((F.col("k") + by_suffix * base) / (F.col("n") + by_suffix)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.col("k") + by_domain * F.col("suffix_mean")) / (F.col("n") + by_domain)).alias("domain_mean"))
    a, b = F.col("k") + by_host * F.col("domain_mean"), F.col("n") - F.col("k") + by_host * (1 - F.col("domain_mean"))
    out = hosts.join(domains, ["domain", "suffix"]).select("host", F.col("n").alias("labelled"), F.col("k").alias("bad"), a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    return out.select("host", "labelled", "bad", mean.alias("mean"), F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1)).alias("sd"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """``pages`` with host, path, rule, verdict, labelled, bad and bad_bound added (replacing
    columns of these names)."""
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host.alias("host"))
    found = C.stored(host_posteriors(own, labels).select("host", "labelled", "bad", (F.col("mean") - z * F.col("sd")).alias("bound")), "host-reputation")
    # the input travels in one struct, so no name of it can clash
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path")).join(found, "host")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("bound") > max_bad, "block").otherwise("allow"))
    added = {"host": F.col("host"), "path": F.col("path"), "rule": rule, "verdict": verdict, "labelled": F.col("labelled"), "bad": F.col("bad"), "bad_bound": F.col("bound")}
    return rows.select(*[F.col("row")[c].alias(c) for c in pages.columns if c not in added], *[x.alias(c) for c, x in added.items()])
