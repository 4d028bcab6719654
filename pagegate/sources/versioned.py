"""Keyed tables that a stream updates: every version is written beside the others and counts once it is committed.

    store/rows/version=7/bucket=3/...parquet     the keys that version 7 changed
    store/commits/version=7/...parquet           one row: version 7 is whole, and how many rows it has

A row goes to the bucket of its key's hash. Readers take the committed versions and resolve each key to its newest one; buckets
are a partition column, so a look-up of keys reads their buckets alone. A version that failed half-way has no commit and is
not seen; the next attempt at the same version replaces what it left. A version that is committed is never written again, so
a micro-batch that a restarted stream repeats changes nothing. `compact` writes all keys' newest rows as one base version; until it
is committed readers stay with the old ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
C = F.col


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def commits(spark: SparkSession, store: str) -> DataFrame:
    """version, base (whether it holds all keys), rows."""
    schema = "version bigint, base boolean, rows bigint"
    if not exists(spark, f"{store}/commits"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/commits")


def is_committed(spark: SparkSession, store: str, version: int) -> bool:
    return exists(spark, f"{store}/commits/version={version}/_SUCCESS")


def _write(rows: DataFrame, store: str, keys: list[str], version: int, base: bool, buckets: int) -> None:
    spark, place = rows.sparkSession, f"{store}/rows/version={version}"
    dealt = rows.withColumn("bucket", bucket_of(keys, buckets))
    # each task holds a share of the keys of a few buckets; writing again replaces an attempt that failed
    dealt.repartition("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(place)
    n = spark.read.schema(dealt.schema).parquet(place).count()
    one = spark.range(1, numPartitions=1).select(F.lit(base).alias("base"), F.lit(n).cast("long").alias("rows"))
    one.write.mode("overwrite").parquet(f"{store}/commits/version={version}")


def upsert(rows: DataFrame, store: str, keys: list[str], version: int, buckets: int = BUCKETS) -> None:
    """Commits rows (one for each key) as `version`; nothing happens where that version is committed already."""
    if not is_committed(rows.sparkSession, store, version):
        _write(rows, store, keys, version, False, buckets)


def _folders(spark: SparkSession, store: str) -> list[int]:
    """Versions to read: the newest base and all after it. One number per micro-batch since then."""
    done = commits(spark, store)
    base = F.coalesce(done.filter("base").select(F.max("version")).scalar(), F.lit(-1))
    return [r.version for r in done.filter(C("version") >= base).select("version").orderBy("version").collect()]


def latest(spark: SparkSession, store: str, keys: list[str], schema: str, buckets: list[int] | None = None) -> DataFrame:
    """Newest committed row of each key."""
    versions = _folders(spark, store)
    if not versions:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, version bigint, bucket int").option("basePath", f"{store}/rows").parquet(*[f"{store}/rows/version={v}" for v in versions])
    if buckets is not None:
        rows = rows.filter(C("bucket").isin(buckets))
    rest = [c for c in rows.columns if c not in (*keys, "version", "bucket")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r"))
    return newest.select(*keys, "r.*")


def look_up(spark: SparkSession, store: str, wanted: DataFrame, keys: list[str], schema: str, buckets: int = BUCKETS) -> DataFrame:
    """Newest rows of the wanted keys; only their buckets are read. At most `buckets` numbers come to the driver."""
    own = [r.b for r in wanted.select(bucket_of(keys, buckets).alias("b")).distinct().collect()]
    return latest(spark, store, keys, schema, own).join(wanted.select(*keys).distinct(), keys, "left_semi")


def compact(spark: SparkSession, store: str, keys: list[str], schema: str, version: int, buckets: int = BUCKETS) -> None:
    """Writes all keys as a base version, whose number must be new and higher than all before."""
    if not is_committed(spark, store, version):
        _write(latest(spark, store, keys, schema), store, keys, version, True, buckets)
