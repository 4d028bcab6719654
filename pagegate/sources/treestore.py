"""Append-only stores of records with many rows: timeline snapshots and gate verdicts.

A record is a head (target, generated_at, fields of its own) and rows. Its fingerprint is over the head's fields and the root of
the hash tree over its rows, without generated_at, so equal content has equal fingerprints; its id is over fingerprint and
generated_at; its digest is over the whole head.

    store/leaves/bucket=b../   rows, by the first two digits of their key's digest
    store/nodes/level=../      nodes of the hash trees
    store/records/             heads
    store/manifest/            id and attempt of each committed record, written last

A record counts once the manifest names it. Every save marks what it writes with an attempt of its own, so what a failed
one left is never read, and a repeated save finds the ids committed and writes nothing. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.functions.digest import sha256
from pagegate.operators import hashtree as H
from pagegate.session import cut_lineage
from pagegate.sources.versioned import exists

C = F.col
ID = "record_id"


def fingerprint(fields: list[str]) -> Column:
    return H.digest_of("target", *sorted(fields), "root")


def record_id() -> Column:
    return F.substring(sha256(F.concat_ws("|", "fingerprint", F.coalesce("generated_at", F.lit("")))), 1, 32)


def head_digest(fields: list[str]) -> Column:
    return H.digest_of(ID, "fingerprint", "target", "generated_at", *sorted(fields), "root")


def build(heads: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, their hung rows and the nodes of their trees, without writing. One record per target; a head without rows
    has a root over nothing."""
    fields = [c for c in heads.columns if c not in ("target", "generated_at")]
    leaves = cut_lineage(H.hung(rows, ["target"], key))
    nodes = cut_lineage(H.tree(leaves, ["target"]))
    roots = nodes.filter("level = 0").select("target", C("digest").alias("root"))
    made = heads.join(roots, "target", "left").withColumn("root", F.coalesce("root", sha256(F.lit(""))))
    made = made.withColumn("fingerprint", fingerprint(fields)).withColumn(ID, record_id()).withColumn("digest", head_digest(fields))
    return made, leaves, nodes


def committed(spark: SparkSession, store: str) -> DataFrame:
    schema = f"{ID} string, attempt string"
    return spark.read.schema(schema).parquet(f"{store}/manifest") if exists(spark, f"{store}/manifest") else spark.createDataFrame([], schema)


def save(heads: DataFrame, rows: DataFrame, key: list[str], store: str) -> int:
    """Keeps the records whose ids are not committed yet; their number."""
    spark, attempt = heads.sparkSession, F.lit(uuid.uuid4().hex)
    made, leaves, nodes = build(heads, rows, key)
    fresh = cut_lineage(made.join(committed(spark, store), ID, "left_anti").withColumn("attempt", attempt))
    n = fresh.count()
    if n:
        own = fresh.select("target", ID, "attempt")
        leaves.join(own, "target").withColumn("bucket", F.concat(F.lit("b"), F.substring("k", 1, 2))).write.mode("append").partitionBy("bucket").parquet(f"{store}/leaves")
        nodes.join(own, "target").write.mode("append").partitionBy("level").parquet(f"{store}/nodes")
        fresh.write.mode("append").parquet(f"{store}/records")
        fresh.select(ID, "attempt").write.mode("append").parquet(f"{store}/manifest")
    return n


def part(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A part of the store, committed rows only."""
    df = spark.read.parquet(f"{store}/{name}")
    return df.join(committed(spark, store).distinct(), [ID, "attempt"], "left_semi")


def latest_for(spark: SparkSession, store: str) -> DataFrame:
    """Newest record of each target (ties: the larger id)."""
    r = part(spark, store, "records")
    rest = [c for c in r.columns if c != "target"]
    return r.groupBy("target").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("generated_at", F.lit("")), C(ID))).alias("r")).select("target", "r.*")


def verify(spark: SparkSession, store: str, fields: list[str], key: list[str]) -> DataFrame:
    """record_id and issue: duplicate, missing, orphan, digest-mismatch, address-mismatch of heads; tree-mismatch where rows or nodes
    are not what the tree above them says."""
    issue = lambda df, kind: df.select(ID, F.lit(kind).alias("issue"))
    manifest, records = committed(spark, store), spark.read.parquet(f"{store}/records")
    pair = [ID, "attempt"]
    own = ["target", *pair]
    whole = records.join(manifest.distinct(), pair, "left_semi")
    leaves, nodes = part(spark, store, "leaves"), part(spark, store, "nodes")
    values = sorted(c for c in leaves.columns if c not in (*own, "n", "k", "d", "bucket"))
    again = H.tree(leaves.withColumn("k", H.digest_of(*key)).withColumn("d", H.digest_of(*values)), pair)
    stored = nodes.select(*pair, "level", "prefix", "digest")
    odd = again.select(*pair, "level", "prefix", C("digest").alias("now")).join(stored, [*pair, "level", "prefix"], "full_outer").filter(~C("now").eqNullSafe(C("digest")))
    roots = stored.filter("level = 0").select(*pair, C("digest").alias("top"))
    wrong_root = whole.join(roots, pair, "left").filter(F.coalesce("top", sha256(F.lit(""))) != C("root"))
    out = issue(manifest.groupBy(ID).count().filter("count > 1"), "duplicate")
    for df, kind in (
        (manifest.join(records, pair, "left_anti"), "missing"),
        (records.join(manifest, pair, "left_anti"), "orphan"),
        (whole.filter((C("digest") != head_digest(fields)) | (C("fingerprint") != fingerprint(fields))), "digest-mismatch"),
        (whole.filter(C(ID) != record_id()), "address-mismatch"),
        (odd.select(ID).unionByName(wrong_root.select(ID)).distinct(), "tree-mismatch"),
    ):
        out = out.unionByName(issue(df, kind))
    return out


def reproduces(spark: SparkSession, store: str, heads: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Whether the newest record of each target still comes out of the sources: (target, record_id, ok), and for those that do
    not, the rows behind it (target, k, change). `heads` and `rows` are built anew from the sources.

    Trees are compared from their roots down, and stored rows are read from the buckets of the branches that differ
    alone: at most 256 names reach the driver to choose the folders.
    """
    made, leaves, nodes = build(heads, rows, key)
    now = latest_for(spark, store).select("target", ID, C("fingerprint").alias("was"))
    told = now.join(made.select("target", "fingerprint"), "target", "left").select("target", ID, C("was").eqNullSafe(C("fingerprint")).alias("ok"))
    stored = part(spark, store, "nodes").join(now.select("target", ID), ["target", ID], "left_semi")
    mine = nodes.join(now.select("target"), "target", "left_semi")
    odd = cut_lineage(H.differing(stored, mine, ["target"]))
    buckets = [r.b for r in odd.select(F.concat(F.lit("b"), F.substring("prefix", 1, 2)).alias("b")).distinct().collect()]
    at = F.substring("k", 1, H.DIGITS).alias("prefix")
    near = lambda df: df.withColumn("prefix", at).join(odd, ["target", "prefix"], "left_semi")
    old = near(part(spark, store, "leaves").filter(C("bucket").isin(buckets)).join(now.select("target", ID), ["target", ID], "left_semi"))
    return told, H.changes(old, near(leaves), ["target"]).select("target", "k", "change")
