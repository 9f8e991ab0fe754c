"""Response cache as an append-only table: latest entry by key, expiry, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Seconds that an entry of each kind lives.
TTL = {
    "search_results": 3600,
    "paper_metadata": 7 * 86400,
    "citations": 86400,
    "author": 7 * 86400,
    "journal": 30 * 86400,
    "verification": 86400,
    "oa_status": 7 * 86400,
    "keyword_counts": 86400,
    "web_search": 3600,
}


def expires_at(created: Column, entity_type: Column, ttl: dict[str, int] | None = None, default: int = 3600) -> Column:
    seconds = F.lit(default)
    for k, s in (ttl or TTL).items():
        seconds = F.when(entity_type == k, F.lit(s)).otherwise(seconds)
    return created + F.make_dt_interval(secs=seconds)


def latest(log: DataFrame, key: str = "key", order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The table after all puts: the newest entry of each key."""
    by = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def live(table: DataFrame, as_of: Column) -> DataFrame:
    return table.where(F.col("expires_at") > as_of)


def expired(table: DataFrame, as_of: Column) -> DataFrame:
    """What an eviction removes."""
    return table.where(F.col("expires_at") <= as_of)


def put(table: DataFrame, entries: DataFrame) -> DataFrame:
    """The table with entries inserted, replacing those of the same key; of entries with one key the last created counts."""
    new = latest(entries)
    return table.join(new.select("key"), "key", "left_anti").unionByName(new)


def lookup(table: DataFrame, keys: DataFrame, as_of: Column) -> DataFrame:
    """Keys with their live value, or null."""
    return keys.join(live(table, as_of), "key", "left")


def clear(table: DataFrame) -> DataFrame:
    """The table without its entries."""
    return table.limit(0)


def read_through(table: DataFrame, asked: DataFrame, fetch: Callable[[DataFrame], DataFrame], as_of: Column, ttl: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, table): asked keys (key, entity_type) from live entries, else fetched and kept as long as their kind lives.

    ``fetch`` gives (key, value, failed) of the missing keys, each asked
    once.  Failures are answered (value null) but never kept.  An expired
    entry counts as missing and is replaced.
    """
    wanted = asked.select("key", "entity_type").dropDuplicates(["key"])
    hits = lookup(table.select("key", "value", "expires_at"), wanted, as_of)
    found = fetch(hits.where("expires_at IS NULL").select("key", "entity_type")).select("key", F.when(~F.col("failed"), F.col("value")).alias("fetched"), "failed")
    answers = hits.join(found, "key", "left")
    answers = answers.select("key", "entity_type", F.coalesce("value", "fetched").alias("value"), F.col("expires_at").isNotNull().alias("from_cache"), F.coalesce("failed", F.lit(False)).alias("failed"))
    fresh = answers.where("NOT from_cache AND NOT failed").select("key", "entity_type", "value", as_of.alias("created_at"), expires_at(as_of, F.col("entity_type"), ttl).alias("expires_at"))
    return answers, put(table.select("key", "entity_type", "value", "created_at", "expires_at"), fresh)


def stats(table: DataFrame, as_of: Column) -> DataFrame:
    """Entries and live entries by kind, and over all kinds (entity_type ``*``)."""
    x = table.rollup("entity_type").agg(F.count("*").alias("entries"), F.count_if(F.col("expires_at") > as_of).alias("live_entries"), F.grouping("entity_type").alias("_all"))
    return x.select(F.when(F.col("_all") == 1, "*").otherwise(F.col("entity_type")).alias("entity_type"), "entries", "live_entries")
