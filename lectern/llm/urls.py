"""URL filter: rules first, then the host's reputation (empirical Bayes).

Pages that a rule judges are the labelled outcomes: blocked or allowed.  Each
host's rate of blocked pages is shrunk towards its registered domain's, that
one's towards its suffix's, and that one's towards all pages', by
beta-binomial priors whose weights are fitted by moments at each level.  A
page that no rule fits is blocked if the lower bound of its host's posterior
rate is above the limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import ascii_lower, attach, drop, others, quoted, written


@dataclass(frozen=True)
class Reputation:
    """Limits of the method's verdict."""

    max_blocked_rate: float = 0.5
    z: float = 1.645
    least_prior: float = 2.0
    most_prior: float = 1_000.0
    #: Suffixes of more than one label, under which a registered domain has one label more: a parameter, as registries change.
    suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "com.tr")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, ascii_lower(host)).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null.

    A rule is ``host/path``: it fits its host and all subdomains, if the
    path starts with the rule's.  Of equally long ones the first in text
    order is taken.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {verdict}")
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _place(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _suffix(place: Column, suffixes: tuple[str, ...]) -> Column:
    """The public suffix; an address in numbers is its own."""
    out = F.substring_index(place, ".", -1)
    for s in suffixes:
        out = F.when((place == s) | place.endswith("." + s), F.lit(s)).otherwise(out)
    return F.when(place.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), place).otherwise(out)


def _domain(place: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    head = F.substring(place, F.lit(1), F.length(place) - F.length(suffix) - 1)
    return F.when(place == suffix, place).otherwise(F.concat(F.substring_index(head, ".", -1), F.lit("."), suffix))


def _weight(units: DataFrame, how: Reputation) -> float:
    """Prior weight of a level: what the units' rates vary beyond binomial noise."""
    rate = F.col("bad") / F.col("n")
    s = units.where("n > 0").agg(F.count("*").alias("k"), F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("n")).alias("inverse")).first()
    spread = (s.v or 0.0) - s.m * (1 - s.m) * s.inverse if s.k else 0.0
    return how.most_prior if spread <= 0 else min(how.most_prior, max(how.least_prior, s.m * (1 - s.m) / spread - 1))


def reputations(judged: DataFrame, how: Reputation) -> tuple[DataFrame, int]:
    """One row a host (posterior, lower, blocked) and the number of hosts; needs host and rule_verdict."""
    bad = F.sum((F.col("rule_verdict") == "block").cast("bigint"))
    hosts = judged.groupBy("host").agg(F.count("rule_verdict").alias("n"), F.coalesce(bad, F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("_place", _place(F.col("host")))
    hosts = written(hosts.withColumn("suffix", _suffix(F.col("_place"), how.suffixes)).withColumn("domain", _domain(F.col("_place"), F.col("suffix"))).drop("_place"))
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    held, whole = hosts, domains
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("k")).first()
    base = every.bad / every.n if every.n else 0.0
    n_hosts, n_domains = hosts.count(), domains.count()

    def shrunk(weight: float, prior: Column) -> Column:
        return (F.col("bad") + F.lit(weight) * prior) / (F.col("n") + F.lit(weight))

    suffixes = suffixes.select("suffix", shrunk(_weight(suffixes, how), F.lit(base)).alias("of_suffix"))
    domains = attach(domains, suffixes, "suffix", every.k)
    domains = domains.select("domain", shrunk(_weight(domains, how), F.col("of_suffix")).alias("of_domain"))
    weight = _weight(hosts, how)
    hosts = attach(hosts, domains, "domain", n_domains).withColumn("posterior", shrunk(weight, F.col("of_domain")))
    sd = F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col("n") + F.lit(weight + 1)))
    hosts = hosts.withColumn("lower", F.col("posterior") - how.z * sd)
    out = written(hosts.select("host", "posterior", "lower", (F.col("lower") > how.max_blocked_rate).alias("blocked")))
    drop(held)
    drop(whole)
    return out, n_hosts


def judge(df: DataFrame, rules: list[tuple[str, str]], how: Reputation | None = None, url: str = "url") -> DataFrame:
    """df with host, path, rule (or null), verdict and the host's posterior and lower bound.

    A null url, or one without ://, has an empty host and path; such pages
    share the reputation of the empty host, which has no labels of its own.
    Repeated pages count as often as they occur; an empty table gives an
    empty table; columns named like an output are replaced.
    """
    how = how or Reputation()
    made = ["host", "path", "rule", "rule_verdict", "verdict", "posterior", "lower", "blocked", "_rule"]
    host, path = split_url(quoted(url))
    x = df.select(*[quoted(c) for c in others(df, *made)], host.alias("host"), path.alias("path"))
    x = x.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    x = x.withColumn("rule", F.col("_rule.rule")).withColumn("rule_verdict", F.col("_rule.verdict")).drop("_rule")
    table, n = reputations(x.select("host", "rule_verdict"), how)
    x = attach(x, table, "host", n)
    other = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return x.withColumn("verdict", F.coalesce("rule_verdict", other)).drop("rule_verdict", "blocked")
