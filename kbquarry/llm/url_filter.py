"""URL filters by rules and by host reputation (DataFrame functions only).

Reputation: labelled page outcomes (1 bad, 0 good) are summed by host, registered domain and suffix.  Each level's
rates follow a beta distribution around the level above, whose strength comes from the spread between its members
(method of moments), so that a host with few labels is drawn towards its domain, and that towards its suffix.  A host is
blocked if the lower bound of its posterior bad rate is over ``block_over``.

Defined cases: a null url, or one without "://", has an empty host and path and the verdict of the pooled rate; null
outcomes are no labels; a host without labels has the bound that its domain's rate gives for no outcomes, else its suffix's,
else the pooled rate's, which is drawn to 0.5 with strength 2 and no surer than its own labels; with no labels at all that
is 0.5 with strength 2.  Repeated rows count as often as they occur.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, save

#: Suffixes of two labels under which names are registered; all others have one label.  A parameter of hosts().
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host/path text, verdict) that fits, and its verdict; null if none does.  One expression a rule,
    longest first: the list is part of the plan and meant for tens of rules."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def domains(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def beta_prior(groups: DataFrame) -> tuple[float, float]:
    """Pooled rate and prior strength of groups with n outcomes, k of them bad: a few sums, the only thing collected."""
    n, k = F.col("n"), F.col("k")
    t = groups.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(n * n).alias("n2"), F.count("*").alias("g"), F.sum(k * k / n).alias("k2n")).first()
    if not t["n"]:
        return 0.5, 2.0
    p = t["k"] / t["n"]
    spread = p * (1 - p) * (t["n"] - t["n2"] / t["n"] - (t["g"] - 1))
    rho = (t["k2n"] - t["k"] * p - p * (1 - p) * (t["g"] - 1)) / spread if spread > 0 else 0.001
    rho = min(0.5, max(0.001, rho))
    return p, (1 - rho) / rho


def reputation(outcomes: DataFrame, z: float = 1.645, others: DataFrame | None = None) -> DataFrame:
    """Posterior by host from ``outcomes`` (host, bad): host, n, k, mean, lower (mean - z posterior deviations).  Hosts of
    ``others`` (host) without labels come with n = k = 0."""
    hosts = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    domain, suffix = domains(F.col("host"))
    hosts = save(hosts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    by_domain = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    (p, s_suffix), (_, s_domain), (_, s_host) = beta_prior(by_suffix), beta_prior(by_domain), beta_prior(hosts)
    n, k = F.col("n"), F.col("k")
    suffixes = by_suffix.select("suffix", ((k + s_suffix * p) / (n + s_suffix)).alias("m_suffix"))
    names = by_domain.join(suffixes, "suffix").select("domain", ((k + s_domain * F.col("m_suffix")) / (n + s_domain)).alias("m_domain"))
    known = hosts.join(names, "domain").select("host", "n", "k", F.col("m_domain").alias("m"), F.lit(float(s_host)).alias("s"))
    if others is not None:
        # by host, not by page: a host's pages meet once
        bare = others.select("host").distinct().join(hosts.select("host"), "host", "left_anti").select("host", domain.alias("domain"), suffix.alias("suffix"))
        placed = bare.join(names, "domain", "left").join(suffixes, "suffix", "left")
        t = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
        near = F.coalesce("m_domain", "m_suffix")
        strength = F.when(near.isNotNull(), float(s_host)).otherwise(float(min(s_host, t[0] + 2)))
        none = F.lit(0).cast("long")
        known = known.unionByName(placed.select("host", none.alias("n"), none.alias("k"), F.coalesce(near, F.lit((t[1] + 1) / (t[0] + 2))).alias("m"), strength.alias("s")))
    a, b = k + F.col("s") * F.col("m"), n - k + F.col("s") * (1 - F.col("m"))
    mean = a / (a + b)
    return known.select("host", "n", "k", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], block_over: float = 0.5) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict, bad_rate and lower.  ``outcomes``: page_id, bad; one row a
    page, of which any part may be missing."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    labelled = parts.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id")
    known = reputation(labelled, others=parts)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") > block_over, "block").otherwise("allow")
    return parts.join(known.select("host", "mean", "lower"), "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("mean").alias("bad_rate"), "lower"
    )
