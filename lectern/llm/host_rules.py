"""Quality rules of documents and of the hosts that they come from.

Native: one scan computes the rules' figures in the row, without shuffling
text.  Failures are summed by host, each host's rate is shrunk towards all
hosts by a beta prior fitted to them, and the host's verdict goes back to its
documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.expr import let
from lectern.llm.shared import attach, quoted, written

WORD_BREAK = r"[\x20\x09-\x0D]+"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the rules and of the host verdict."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 50
    #: A host is rejected if its failure rate is above this with the given z.
    max_host_rate: float = 0.5
    z: float = 2.326
    #: Bounds of the fitted prior's weight, in documents.
    least_prior: float = 2.0
    most_prior: float = 10_000.0


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def _covered(names: Column) -> Column:
    """Words within windows whose name occurs twice or more."""

    def fold(sorted_names: Column) -> Column:
        n = F.size(sorted_names)
        same = lambda a, b: F.get(sorted_names, a)["h"] == F.get(sorted_names, b)["h"]
        repeated = F.filter(sorted_names, lambda e, k: ((k > 0) & same(k - 1, k)) | ((k < n - 1) & same(k, k + 1)))
        starts = F.sort_array(F.transform(repeated, lambda e: e["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    named = F.sort_array(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.lit(0).cast("bigint")).otherwise(let(named, fold))


def figures(text: Column) -> Column:
    """Struct of the rules' figures of one text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        names = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.when(F.size(w) > WINDOW, let(names, _covered)).otherwise(F.lit(0).cast("bigint")).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint")
    return F.struct(let(_words(text), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("n_symbols"))


def measure(df: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, failed."""
    out = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    x = df.drop(*[c for c in [*out, "base_failed", "failed", "_f"] if c != text]).withColumn("_f", figures(quoted(text)))
    x = x.withColumns({c: F.col(f"_f.l.{c}" if "line" in c else "_f.n_symbols" if c == "n_symbols" else f"_f.w.{c}") for c in out}).drop("_f")
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    more = (100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"))
    return x.withColumn("base_failed", base).withColumn("failed", base | more)


def host_verdicts(measured: DataFrame, rules: Rules, host: str = "source") -> tuple[DataFrame, int]:
    """One row a host: n, n_failed, posterior mean and lower bound, rejected; and the number of hosts.

    The prior is fitted by moments: what the hosts' rates vary beyond
    binomial noise.  With one host, or no such variance, its weight is the
    largest allowed.
    """
    hosts = measured.where(quoted(host).isNotNull()).groupBy(quoted(host).alias(host)).agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("bigint")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n")
    s = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("n_failed").alias("f"), F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("n")).alias("inverse")).first()
    if not s.k:
        mean, weight = 0.5, rules.least_prior
    else:
        mean = s.f / s.n
        spread = (s.v or 0.0) - s.m * (1 - s.m) * s.inverse
        weight = rules.most_prior if spread <= 0 else min(rules.most_prior, max(rules.least_prior, mean * (1 - mean) / spread - 1))
    posterior = (F.col("n_failed") + F.lit(weight * mean)) / (F.col("n") + F.lit(weight))
    sd = F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col("n") + F.lit(weight + 1)))
    out = hosts.withColumn("posterior", posterior).withColumn("lower", F.col("posterior") - rules.z * sd)
    return out.withColumn("host_rejected", F.col("lower") > rules.max_host_rate), s.k


def judge(df: DataFrame, rules: Rules | None = None, text: str = "text", host: str = "source") -> DataFrame:
    """Figures, base_failed, host_rejected and kept for each row of df (its text stays behind).

    A null or empty text has zero words and fails the base rules.  A row with
    a null host belongs to no host: only the base rules judge it.  Repeated
    rows are counted and judged as often as they occur; an empty table gives
    an empty table; columns named like an output are replaced.
    """
    rules = rules or Rules()
    held = written(measure(df, rules, text).drop(text, "host_rejected", "kept"))
    hosts, n = host_verdicts(held, rules, host)
    out = attach(held, hosts.select(quoted(host), "host_rejected"), host, n)
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
