"""URL filter: fixed host and path rules, and empirical-Bayes host reputation for the rest.

A host's reputation is the share of good pages among its labelled ones, shrunk towards its
registered domain, that towards its public suffix, and that towards all pages. Each level's
prior is beta-binomial; its strength is fitted by the method of moments to how far the groups
below it differ more than chance allows. A page is let through if the lower posterior bound of
its host reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift.llm.common import ascii_lower, settled

#: Public suffixes of two labels that are told apart from plain top-level domains.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.au", "org.uk")
#: Prior strengths outside these bounds are not believed.
WEAKEST, STRONGEST = 2.0, 10000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(tail, r"^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does.

    ``rules`` holds (verdict, ``host/path``). A rule fits its host and all subdomains if the
    path starts with the rule's. Of rules of one length the first by text wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=False):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def registered_domain(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; a host of one label is its own both."""
    two = "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES)
    suffix = F.regexp_extract(host, rf"(?:^|\.)({two}|[^.]*)$", 1)
    domain = F.regexp_extract(host, rf"((?:^|[^.]*\.)(?:{two}|[^.]*))$", 1)
    return F.when(domain == "", host).otherwise(domain), suffix


def strength(groups: DataFrame) -> Column:
    """Beta-binomial prior strength of groups with ``n`` trials and ``k`` successes, by moments."""
    d = groups.filter("n > 0").agg(
        F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("m"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"),
    )
    p = F.col("k") / F.col("n")
    spread = (F.col("kk") - F.col("k") * p) / (p * (1 - p)) - (F.col("m") - 1)
    room = F.col("n") - F.col("nn") / F.col("n") - (F.col("m") - 1)
    rho = F.when((p > 0) & (p < 1) & (room > 0) & (spread > 0), F.least(spread / room, F.lit(1.0)))
    fitted = F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.coalesce((1 - rho) / rho, F.lit(STRONGEST))))
    return d.select(fitted.alias("strength")).scalar()


def host_reputation(outcomes: DataFrame, z: float) -> DataFrame:
    """One row per host: ``host, n, good, posterior_mean, lower_bound``.

    ``outcomes`` has ``host`` and ``good`` (1, 0, or null for a page without a label). Hosts
    without labels get their domain's belief, with the full width of the prior.
    """
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    domain, suffix = registered_domain(F.col("host"))
    hosts = settled(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # One success and one failure more, so that the rate exists without any label.
    rate = hosts.agg((F.sum("k") + 1) / (F.sum("n") + 2)).scalar()
    of_suffix = strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("k") + of_suffix * rate) / (F.col("n") + of_suffix)).alias("suffix_mean"))
    of_domain = strength(domains)
    domains = domains.join(suffixes, "suffix").select(
        "domain", ((F.col("k") + of_domain * F.col("suffix_mean")) / (F.col("n") + of_domain)).alias("domain_mean"))
    beliefs = hosts.join(domains, "domain").withColumn("strength", strength(hosts))
    total = F.col("n") + F.col("strength")
    mean = (F.col("k") + F.col("strength") * F.col("domain_mean")) / total
    bound = mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (total + 1))
    return beliefs.select("host", "n", F.col("k").alias("good"), mean.alias("posterior_mean"), bound.alias("lower_bound"))


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5, z: float = 1.645,
) -> DataFrame:
    """Every row of ``pages`` with its verdict.

    ``pages`` has ``page_id`` and ``url``; ``labels`` has ``page_id`` and ``good``; other columns
    of either are not looked at. A fitting rule decides; else ``allow`` if the host's lower
    posterior bound reaches ``threshold``, else ``block``. Null and malformed URLs share the
    empty host. Several labels of one page count as good only if all are; a page without an
    identifier has no label. Repeated pages are judged and counted each. Empty tables give
    an empty result; without labels every host has the bound of the bare prior.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    good = labels.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    outcomes = parsed.select("page_id", "host").join(good, "page_id", "left").select("host", "good")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return parsed.join(host_reputation(outcomes, z), "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("lower_bound") >= threshold, F.lit("allow")).otherwise("block")).alias("verdict"),
        F.round("posterior_mean", 6).alias("posterior_mean"), F.round("lower_bound", 6).alias("lower_bound"),
    )
