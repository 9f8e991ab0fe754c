"""Shared folders, written tables and size-checked joins."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from lectern.folders import shared_folder

#: Rows up to which a lookup table may be broadcast; it is counted first.
BROADCAST_ROWS = 20_000
#: Ways into which a hot key of a larger lookup is split.
SALTS = 32
#: A key is hot with this share of all rows, and so many at least: there are never more hot keys than 1 / HOT_SHARE.
HOT_SHARE, HOT_ROWS = 1e-4, 100_000

_written: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; the folder is the cluster's scratch space
            return


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here.

    The table outlives any executor.  It is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the table behind written(), once nothing reads it any more."""
    for item in list(_written):
        if any(item[1] in f for f in df.inputFiles()[:1]):
            _written.remove(item)
            _remove(*item)


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def same_name(spark: SparkSession) -> Callable[[str], str]:
    """What two names have in common if the session takes them for one."""
    return str if spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower


def others(df: DataFrame, *names: str) -> list[str]:
    """df's columns but for those named like one of ``names``."""
    same = same_name(df.sparkSession)
    gone = {same(n) for n in names}
    return [c for c in df.columns if same(c) not in gone]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    same = same_name(df.sparkSession)
    held = {same(c) for c in df.columns}
    while same(name) in held:
        name = "_" + name
    return name


def schema_of(df: DataFrame, columns: Iterable[str], made: dict[str, str]) -> StructType:
    """df's fields of these names, then the made ones (name: type)."""
    return StructType([df.schema[c] for c in columns] + [StructField(name, DataType.fromDDL(kind)) for name, kind in made.items()])


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema), for columns of any name: mapInArrow takes a dot for a field's."""
    inner = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator) -> Iterator:
        for batch in run(batches):
            yield batch.rename_columns(inner.names)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(renamed, inner).toDF(*schema.names)


def row_hash(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """A hash of a row's values, nulls told from others; maps have no hash and are left out."""
    some = [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.name not in but]
    return F.xxhash64(*some, *[c.isNull() for c in some])


def attach(df: DataFrame, small: DataFrame, key: str, rows: int, how: str = "left") -> DataFrame:
    """Join a lookup with one row a key, whatever share of df one key holds.

    ``rows`` is the lookup's counted size: up to BROADCAST_ROWS it is
    broadcast.  Beyond that df's hot keys are counted (at most 1 / HOT_SHARE
    of them), their rows dealt to SALTS places by a hash of the row, and
    their rows of the lookup repeated there; all others meet by their key.
    """
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), key, how)
    names = [c for c in small.columns if c != key]
    counts = df.groupBy(quoted(key).alias("_key")).agg(F.count("*").alias("_n"))
    least = max(HOT_ROWS, int(HOT_SHARE * (counts.agg(F.sum("_n")).first()[0] or 0)))
    hot = F.broadcast(written(counts.where(F.col("_n") > least).select("_key", F.lit(SALTS).alias("_ways"))))
    ways = F.coalesce("_ways", F.lit(1))
    left = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("_all"), quoted(key).alias("_key"), row_hash(df, (key,)).alias("_hash"))
    left = left.join(hot, "_key", "left").withColumn("_place", F.pmod("_hash", ways).cast("int"))
    right = small.select(quoted(key).alias("_key"), F.struct(*[quoted(c) for c in names]).alias("_found")).join(hot, "_key", "left")
    right = right.withColumn("_place", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_ways")
    joined = left.join(right, ["_key", "_place"], how)
    field = lambda of, c: F.col(of)[c].alias(c)
    rest = [c for c in df.columns if c != key]
    return joined.select(field("_all", key), *[field("_all", c) for c in rest], *[field("_found", c) for c in names])


def survivors(df: DataFrame, cluster: Callable[[DataFrame], DataFrame], text: str, doc_id: str) -> DataFrame:
    """df's rows that are the first of their component: one of each group.

    ``cluster`` gives (_id, _row, component) of (_id, _row, _body) rows; _row
    names the values of a row.  First is a total order on (id, _row), null
    ids last, so a retried task chooses the same; rows that share an id but
    no component don't touch each other, and rows with a null id are told
    apart by their values.
    """
    row = unused(df, "_row")
    marked = df.withColumn(row, row_hash(df))
    ident = quoted(doc_id)
    found = written(cluster(marked.select(ident.alias("_id"), F.col(row).alias("_row"), quoted(text).alias("_body"))))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("m"))
    first = written(first.select(F.col("m._id").alias("_i"), F.col("m._row").alias("_r")))
    # the ids grow with the documents: they are never broadcast, at any size
    kept = marked.join(first.hint("shuffle_hash"), ident.eqNullSafe(F.col("_i")) & (F.col(row) == F.col("_r")), "left_semi")
    if not found.groupBy("_id", "_row").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id, row])
    drop(found)
    return kept.select(*[quoted(c) for c in df.columns])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
