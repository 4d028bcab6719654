"""Readers, append-only tables and the audit of a copied store."""

import json

from pyspark.sql import functions as F

from pagegate.sources import readers, stores

SCAN = {
    "host": "x.y", "target": "https://x.y", "generated": "2024-01-01T00:00:00Z", "verdict": "NEEDS ATTENTION", "score": 80, "ready": False,
    "skipped": {"suites": ["seo"]},
    "suites": [{"key": "links", "name": "Links", "pass": 1, "warn": 0, "fail": 1, "manual": 0, "checks": [{"status": "pass", "name": "ok"}, {"status": "fail", "name": "bad", "ruleId": "LINK-001", "severity": "high", "deduction": 12, "target": "/p", "items": [{"page": "/p", "section": "s", "id": "i", "value": "404"}]}]}],
}


def test_lists(spark, tmp_path):
    (tmp_path / "old.csv").write_text("/a,/b\n\nhttps://other.z/c\t/d\n/e\n")
    got = [r.url for r in readers.old_urls(spark, str(tmp_path / "old.csv"), "https://x.y").collect()]
    assert got == ["https://x.y/a", "https://other.z/c", "https://x.y/e"]
    (tmp_path / "allow.txt").write_text("page:/gone\n\n")
    assert [r.identity_key for r in readers.allow_list(spark, str(tmp_path / "allow.txt")).collect()] == ["page:/gone"]
    (tmp_path / "ex.json").write_text(json.dumps([{"relatedIds": ["PAGE-001", "FORM-002"], "reason": "r", "approver": "a", "date": "d"}]))
    assert {r.id for r in readers.exceptions(spark, str(tmp_path / "ex.json")).collect()} == {"PAGE-001", "FORM-002"}


def test_scans_baselines_and_records(spark, tmp_path):
    (tmp_path / "scan.json").write_text(json.dumps(SCAN))
    scans = readers.scans(spark, str(tmp_path / "scan.json"))
    f = readers.scan_findings(scans).collect()
    assert len(f) == 1 and f[0].rule_id == "LINK-001" and f[0]["items"][0].value == "404"
    store = str(tmp_path / "base")
    stores.save_baseline(scans, store, "before launch")
    stores.save_baseline(scans, store, "before launch")
    assert readers.baseline(spark, store, "before-launch").count() == 1
    stores.record_scans(scans, str(tmp_path / "rec"))
    r = spark.read.parquet(str(tmp_path / "rec")).first()
    assert r.partial and r.skipped_suites == ["seo"]
    stores.record_scans(scans, str(tmp_path / "rec"))
    assert spark.read.parquet(str(tmp_path / "rec")).count() == 1


def test_labels(spark):
    assert stores.clean_label(" a  b/ü c ") == "a-b-c" and stores.clean_label("///") == "baseline"
    assert stores.clean_label("x" * 70 + "1") != stores.clean_label("x" * 70 + "2")


def test_ids_of_other_sites_and_other_sites_findings_stay(spark, tmp_path):
    ids = spark.createDataFrame([("a", "page", "page:/", "PAGE-001"), ("b", "page", "page:/", "PAGE-001"), ("a", "form", "page:/", "FORM-001")], "site string, type string, identity_key string, id string")
    for _ in range(2):
        stores.append_ids(ids, str(tmp_path / "ids"))
        stores.append_cases(ids, str(tmp_path / "cases"))
    assert spark.read.parquet(str(tmp_path / "ids")).count() == spark.read.json(str(tmp_path / "cases")).count() == 3
    stores.append_ids(ids.filter("site = 'a'").withColumn("id", F.lit("PAGE-009")), str(tmp_path / "ids"))
    assert spark.read.parquet(str(tmp_path / "ids")).count() == 3
    found = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], "site string, scan_id string, rule_id string")
    stores.write_findings(found, str(tmp_path / "f"))
    stores.write_findings(found.filter("site = 'a'").withColumn("rule_id", F.lit("z")), str(tmp_path / "f"))
    stores.write_findings(found.filter("site = 'a'").withColumn("scan_id", F.lit("2")), str(tmp_path / "f"))
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "f")).select("site", "rule_id").collect()) == [("a", "x"), ("a", "z"), ("b", "y")]


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "scan_id string, v int")
    for _ in range(2):
        stores.append_new(rows, str(tmp_path / "t"), "scan_id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_copy_audit(spark, tmp_path):
    folder = tmp_path / "copy"
    folder.mkdir()
    for name, text in (("a.json", "1"), ("b.json", "2"), ("c.json", "3")):
        (folder / name).write_text(text)
    manifest = readers.file_digests(spark, str(folder)).withColumn("sha256", F.when(F.col("rel") == "b.json", "0").otherwise(F.col("sha256"))).filter("rel <> 'c.json'")
    manifest = manifest.unionByName(manifest.limit(1).withColumn("rel", F.lit("lost.json"))).cache()
    got = {r.rel: r.issue for r in readers.store_copy_audit(readers.file_digests(spark, str(folder)), manifest).collect()}
    assert got == {"b.json": "corrupt", "c.json": "unexpected", "lost.json": "missing"}
