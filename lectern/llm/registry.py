"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, host_rules, langid, mih, mixing, pii, quality, repeats, simhash, urls
from lectern.llm.shared import documents

#: Rules of the URL query.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those that aren't held out."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))
    docs = documents(spark, sf_dir).withColumn("held_out", fold == 2)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated to source shares that go as the square root of their size."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.replicate(docs, temperature=0.5, size=1.0, seed=42).select("doc_id", "source", "text", "n_copies", "copy")


OP2_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) * (SELECT sum(n) FROM n) / (SELECT sum(sqrt(n)) FROM n) / n AS rate FROM n),
c AS (SELECT source, list_transform(range(0, 120), lambda k: list_sum(list_transform(range(0, k + 1),
        lambda j: exp(-rate + j * ln(rate) - lgamma(j + 1))))) AS cdf FROM r),
u AS (SELECT doc_id, source, text,
        (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':1:draw42'), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS u
      FROM documents),
d AS (SELECT doc_id, u.source, text, len(list_filter(cdf, lambda x: x <= u))::BIGINT AS n_copies
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, text, n_copies, unnest(range(1, n_copies + 1))::BIGINT AS copy FROM d WHERE n_copies > 0
"""


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once 100-byte passages that occur earlier are removed."""
    return repeats.remove(documents(spark, sf_dir).select("doc_id", "text"), digests=True)


OP3_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM t WHERE n >= 100)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
m AS (SELECT *, coalesce(p > max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100, true) AS new FROM r),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM m),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, island),
listed AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda k: CASE WHEN k < len(a)
        THEN substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE b[k] END) + 1, 2 * (a[k + 1] - (CASE WHEN k = 0 THEN 0 ELSE b[k] END))) ELSE substr(h, 2 * b[k] + 1) END), '') END)) AS kept_sha256
FROM t LEFT JOIN listed USING (doc_id)
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that aren't held out."""
    held_out = lambda: F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels.where(~held_out()))
    return quality.score(docs.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "score", "predicted")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest others, by sign codes, of every vector whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    coded = mih.sign_codes(rows, "embedding").select("id", "code")
    found = mih.search(coded, coded.where("id % 50 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP5_SQL = """
WITH d AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, i.vec_id,
    len(list_filter(range(1, 65), lambda k: (coalesce(q.embedding[k], 0) > 0) <> (coalesce(i.embedding[k], 0) > 0)))::INTEGER AS distance
    FROM d q JOIN d i ON q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance
FROM p QUALIFY rank <= 10
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest document that it is linked to."""
    found = simhash.cluster(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = pii.detect(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the rules', else its host's reputation."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(level: str, prior: str) -> str:
    """CTEs of one level: its prior weight, and its units' shrunk rates."""
    return f"""
w_{level} AS (SELECT CASE WHEN count(*) = 0 THEN 1000.0 WHEN coalesce(var_samp(bad / n), 0) - avg(bad / n) * (1 - avg(bad / n)) * avg(1.0 / n) <= 0 THEN 1000.0
    ELSE least(1000.0, greatest(2.0, avg(bad / n) * (1 - avg(bad / n)) / (coalesce(var_samp(bad / n), 0) - avg(bad / n) * (1 - avg(bad / n)) * avg(1.0 / n)) - 1)) END AS w
    FROM {level}s WHERE n > 0),
r_{level} AS (SELECT u.*, (u.bad + (SELECT w FROM w_{level}) * {prior}) / (u.n + (SELECT w FROM w_{level})) AS of_{level} FROM {level}s u"""


SUFFIXES = "(^|\\.)(" + "|".join(x.replace(".", "\\.") for x in urls.Reputation.suffixes) + ")$"
OP9_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(instr(url, '://') > 0, false) AS has,
    regexp_extract(url, '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
q AS (SELECT page_id,
    CASE WHEN has THEN translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN has THEN regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p),
rules(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)}),
split AS (SELECT verdict, rule, split_part(rule, '/', 1) AS rh, substr(rule, instr(rule, '/')) AS rp FROM rules),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS rv FROM q, split
    WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
j AS (SELECT q.*, m.rule, m.rv FROM q LEFT JOIN m USING (page_id)),
places AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS place FROM j),
suffixed AS (SELECT *, CASE WHEN regexp_matches(place, '^[0-9]+(\\.[0-9]+){{3}}$') THEN place WHEN regexp_matches(place, '{SUFFIXES}') THEN ltrim(regexp_extract(place, '{SUFFIXES}'), '.')
    ELSE split_part(place, '.', -1) END AS suffix FROM places),
hosts AS (SELECT host, any_value(suffix) AS suffix,
    any_value(CASE WHEN place = suffix THEN place ELSE split_part(left(place, length(place) - length(suffix) - 1), '.', -1) || '.' || suffix END) AS domain,
    count(rv)::DOUBLE AS n, count(*) FILTER (rv = 'block')::DOUBLE AS bad FROM suffixed GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
{_level_sql("suffix", "(SELECT sum(bad) / greatest(sum(n), 1) FROM suffixs)").lstrip()}),
{_level_sql("domain", "s.of_suffix").lstrip()} JOIN r_suffix s USING (suffix)),
{_level_sql("host", "d.of_domain").lstrip()} JOIN r_domain d USING (domain))
SELECT page_id, j.host, path, rule, coalesce(rv, CASE WHEN of_host - 1.645 * sqrt(of_host * (1 - of_host) / (n + (SELECT w FROM w_host) + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN r_host h ON j.host = h.host
"""


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document by its own rules and its source's failure rate."""
    judged = host_rules.judge(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM t WHERE len(ws) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS k FROM g),
p AS (SELECT DISTINCT doc_id, i + unnest(range(0, 8)) AS at FROM h WHERE k > 1),
c AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
f AS (SELECT t.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f),
a AS (SELECT *, (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines) AS failed FROM b),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS bad FROM a WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(bad) / sum(n) AS mean, coalesce(var_samp(bad / n), 0) - avg(bad / n) * (1 - avg(bad / n)) * avg(1 / n) AS spread FROM hosts),
w AS (SELECT mean, CASE WHEN spread <= 0 THEN 10000.0 ELSE least(10000.0, greatest(2.0, mean * (1 - mean) / spread - 1)) END AS w FROM s),
r AS (SELECT source, n, w, (bad + w * mean) / (n + w) AS post FROM hosts, w),
v AS (SELECT source, post - 2.326 * sqrt(post * (1 - post) / (n + w + 1)) > 0.5 AS rejected FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM a LEFT JOIN v USING (source)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_mix": op2_mix,
    "op3_repeats": op3_repeats,
    "op4_quality": op4_quality,
    "op5_topk": op5_topk,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_bpe": op8_bpe,
    "op9_urls": op9_urls,
    "op10_host_rules": op10_host_rules,
}
ORACLES: dict[str, str] = {"op2_mix": OP2_SQL, "op3_repeats": OP3_SQL, "op5_topk": OP5_SQL, "op9_urls": OP9_SQL, "op10_host_rules": OP10_SQL}
