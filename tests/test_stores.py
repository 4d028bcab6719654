"""Versioned tables, stores with hash trees, baselines in force."""

import pytest
from pyspark.sql import functions as F

from pagegate.operators import hashtree
from pagegate.operators import history as T
from pagegate.sources import treestore, versioned
from pagegate.streaming import ingest

SCHEMA = "scan_id string, kind string, n bigint"
KEYS = ["scan_id", "kind"]


def _rows(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def _latest(spark, store):
    return sorted(map(tuple, versioned.latest(spark, store, KEYS, SCHEMA).collect()))


def test_upsert_resolves_keys_to_their_newest_version(spark, out):
    store = f"{out}/v"
    assert _latest(spark, store) == []
    versioned.upsert(_rows(spark, ("a", "x", 1), ("b", "x", 1)), store, KEYS, 0)
    versioned.upsert(_rows(spark, ("a", "x", 5)), store, KEYS, 1)
    versioned.upsert(_rows(spark, ("a", "x", 99), ("z", "x", 9)), store, KEYS, 1)  # the same micro-batch again
    assert _latest(spark, store) == [("a", "x", 5), ("b", "x", 1)]
    assert spark.read.parquet(f"{store}/rows/version=1").count() == 1  # no key that did not change
    versioned.compact(spark, store, KEYS, SCHEMA, 2)
    versioned.upsert(_rows(spark, ("b", "x", 7)), store, KEYS, 3)
    assert _latest(spark, store) == [("a", "x", 5), ("b", "x", 7)] and versioned._folders(spark, store) == [2, 3]


def test_a_write_that_fails_leaves_the_last_good_version(spark, out):
    store = f"{out}/v"
    versioned.upsert(_rows(spark, ("a", "x", 1)), store, KEYS, 0)
    bad = _rows(spark, ("a", "x", 2), ("b", "x", 2)).withColumn("n", F.when(F.col("scan_id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        versioned.upsert(bad, store, KEYS, 1)
    assert _latest(spark, store) == [("a", "x", 1)]
    _rows(spark, ("a", "x", 77)).withColumn("bucket", F.lit(1)).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/rows/version=1")  # half a version
    assert _latest(spark, store) == [("a", "x", 1)]
    versioned.upsert(_rows(spark, ("a", "x", 2)), store, KEYS, 1)
    assert _latest(spark, store) == [("a", "x", 2)]


def test_look_ups_read_the_buckets_of_their_keys(spark, out):
    store = f"{out}/v"
    versioned.upsert(spark.range(500).select(F.concat(F.lit("s"), "id").alias("scan_id"), F.lit("x").alias("kind"), F.col("id").alias("n")), store, KEYS, 0)
    got = versioned.look_up(spark, store, spark.createDataFrame([("s7", "x"), ("none", "x")], "scan_id string, kind string"), KEYS, SCHEMA)
    assert list(map(tuple, got.collect())) == [("s7", "x", 7)]
    scans = [line for line in got._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line and "bucket" in line]
    assert scans and all("bucket#" in line.split("PartitionFilters")[1] for line in scans)


def test_progress_writes_only_counts_that_changed(spark, out):
    schema = "scan_id string, kind string"
    for k, rows in enumerate(([("s1", "a")] * 3 + [("s2", "a")], [("s1", "a"), ("s3", "b")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
        ingest.keep_progress(spark.readStream.schema(schema).parquet(f"{out}/in"), f"{out}/v", f"{out}/cp").awaitTermination()
        assert versioned.commits(spark, f"{out}/v").filter(F.col("version") == k).first().rows == 2
    assert _latest(spark, f"{out}/v") == [("s1", "a", 4), ("s2", "a", 1), ("s3", "b", 1)]


POINTS = "target string, i int, v string"


def _snapshot(spark, change=None):
    rows = [(t, i, f"{t}{i}") for t in ("t1", "t2") for i in range(60)]
    df = spark.createDataFrame(rows, POINTS)
    df = df if change is None else df.withColumn("v", F.when(F.expr(change), "other").otherwise(F.col("v")))
    heads = df.groupBy("target").agg(F.count("*").alias("size")).withColumn("generated_at", F.lit("2024-01-01"))
    return heads, df


def test_saving_again_changes_nothing(spark, out):
    store = f"{out}/s"
    heads, rows = _snapshot(spark)
    assert [treestore.save(heads, rows, ["i"], store) for _ in range(2)] == [2, 0]
    assert treestore.part(spark, store, "leaves").count() == 120 and treestore.verify(spark, store, ["size"], ["i"]).isEmpty()
    # what an attempt without commit has left is not read, and is named by verify for its heads only
    made, leaves, _ = treestore.build(heads.withColumn("generated_at", F.lit("later")), rows, ["i"])
    made.withColumn("attempt", F.lit("lost")).write.mode("append").parquet(f"{store}/records")
    leaves.join(made.select("target", "record_id"), "target").withColumn("attempt", F.lit("lost")).withColumn("bucket", F.concat(F.lit("b"), F.substring("k", 1, 2))).write.mode("append").partitionBy("bucket").parquet(f"{store}/leaves")
    assert treestore.latest_for(spark, store).select("generated_at").distinct().collect()[0][0] == "2024-01-01"
    assert [r.issue for r in treestore.verify(spark, store, ["size"], ["i"]).collect()] == ["orphan"] * 2


def test_one_changed_row_is_found_and_only_its_bucket_is_read(spark, out):
    store = f"{out}/s"
    heads, rows = _snapshot(spark)
    treestore.save(heads, rows, ["i"], store)
    same, none = treestore.reproduces(spark, store, heads, rows, ["i"])
    assert {(r.target, r.ok) for r in same.collect()} == {("t1", True), ("t2", True)} and none.isEmpty()
    told, found = treestore.reproduces(spark, store, *_snapshot(spark, "target = 't2' AND i = 17"), ["i"])
    assert {(r.target, r.ok) for r in told.collect()} == {("t1", True), ("t2", False)}
    key = rows.filter("target = 't2' AND i = 17").select(hashtree.digest_of("i").alias("k")).first().k
    assert [tuple(r) for r in found.collect()] == [("t2", key, "changed")]
    scans = [line for line in found._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line and "bucket" in line]
    assert scans and all(f"b{key[:2]}" in line for line in scans)
    lost = rows.filter("NOT (target = 't1' AND i = 3)").unionByName(rows.filter("target = 't1' AND i = 4"))
    _, found = treestore.reproduces(spark, store, heads, lost, ["i"])
    assert sorted((r.target, r.change) for r in found.collect()) == [("t1", "changed"), ("t1", "lost")]


def test_trees_are_equal_exactly_when_their_rows_are(spark):
    rows = spark.createDataFrame([("g", 1, None), ("g", 2, ""), ("g", 2, "")], POINTS.replace("target", "g"))
    root = lambda df: hashtree.tree(hashtree.hung(df, ["g"], ["i"]), ["g"]).filter("level = 0").first().digest
    assert root(rows) == root(rows.orderBy(F.desc("i"))) != root(rows.distinct())
    assert root(rows) != root(rows.fillna("", ["v"]))
    assert hashtree.tree(hashtree.hung(rows.limit(0), ["g"], ["i"]), ["g"]).isEmpty()


def test_each_scan_meets_the_baseline_of_its_time(spark):
    chrono = spark.createDataFrame([("t", f"2024-01-0{n}", n, f"s{n}") for n in range(1, 7)] + [("u", "2024-01-01", 1, "x")], "target string, ts string, n long, scan_id string")
    pointers = spark.createDataFrame([("t", "s1", "2024-01-02"), ("t", "s4", "2024-01-04x"), ("t", "s2", "2024-01-04x"), ("t", "s4", "2024-01-04x")], "target string, scan_id string, set_at string")
    got = {r.n: r.baseline for r in T.baseline_in_force(chrono, pointers).collect()}
    assert got == {2: "s1", 3: "s1", 4: "s1", 5: "s4", 6: "s4"}
    spans = sorted((r.valid_from, r.valid_to or "", r.scan_id, r.position) for r in T.baseline_history(pointers.distinct()).collect())
    assert spans == [("2024-01-02", "2024-01-04x", "s1", 0), ("2024-01-04x", "", "s4", 2), ("2024-01-04x", "2024-01-04x", "s2", 1)]


def _parents(spark, links):
    return spark.createDataFrame([(str(a), None if b is None else str(b)) for a, b in links], "scan_id string, parent_scan_id string")


def test_ancestors_and_cycles(spark):
    chain = [(k, k - 1 if k else None) for k in range(70)]
    scans = _parents(spark, [*chain, ("a", "c"), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "d"), ("self", "self"), ("lone", "nowhere")])
    got = {(r.descendant, r.ancestor, r.distance) for r in T.ancestors(scans).collect()}
    assert got == {(str(k), str(j), k - j) for k in range(70) for j in range(k)}
    assert {(r.scan_id, r.on_cycle) for r in T.parent_cycles(scans).collect()} == {("a", True), ("b", True), ("c", True), ("d", False), ("e", False), ("self", True)}
    roots = {r.scan_id: (r.root, r.depth) for r in T.scan_roots(scans).collect()}
    assert roots["69"] == ("0", 69) and roots["lone"] == ("lone", 0) and "a" not in roots and len(roots) == 71
    assert T.ancestors(scans.limit(0)).isEmpty() and T.parent_cycles(scans.limit(0)).isEmpty()
