"""Readers of stored crawls and of the small lists people keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.functions.text import js_trim
from pagegate.functions.urls import abs_url
from pagegate.sources.stores import clean_label

C = F.col

CRAWL_SCHEMA = (
    "site string, scan_id string, url string, status int, body string, headers map<string,string>, content_type string, "
    "location string, error string, error_code string, ord long"
)
EXCEPTION_SCHEMA = "relatedIds array<string>, reason string, approver string, date string, evidence string"
CHECK_SCHEMA = (
    "array<struct<key:string,name:string,pass:int,warn:int,fail:int,manual:int,checks:array<struct<status:string,name:string,"
    "target:string,detail:string,ruleId:string,severity:string,deduction:int,items:array<struct<page:string,section:string,id:string,value:string>>>>>>"
)
SCAN_SCHEMA = (
    "host string, target string, generated string, verdict string, score int, ready boolean, "
    "quality struct<overall:int,suites:map<string,int>>, versions struct<engine:string,registry:string,report:string>, "
    "skipped struct<suites:array<string>>, suites " + CHECK_SCHEMA
)


def crawl(spark: SparkSession, path: str) -> DataFrame:
    """Stored page responses with lower-case header names. A failed fetch has status 0."""
    df = spark.read.schema(CRAWL_SCHEMA).parquet(path)
    return df.withColumn("headers", F.transform_keys("headers", lambda k, _: F.lower(k))).fillna({"status": 0, "body": ""})


def old_urls(spark: SparkSession, path: str, origin: str) -> DataFrame:
    """Old urls, one per line or `old,new` (comma or tab), resolved against the site's origin."""
    lines = spark.read.text(path).select(js_trim(C("value")).alias("line")).filter("line <> ''")
    first = js_trim(F.element_at(F.split("line", "[,\t]"), 1))
    return lines.select(abs_url(first, F.lit(origin + "/")).alias("url")).filter("url IS NOT NULL")


def allow_list(spark: SparkSession, path: str) -> DataFrame:
    """Identity keys whose removal was agreed, one per line."""
    return spark.read.text(path).select(js_trim(C("value")).alias("identity_key")).filter("identity_key <> ''")


def exceptions(spark: SparkSession, path: str) -> DataFrame:
    """Approved exceptions, one row per item they name."""
    e = spark.read.schema(EXCEPTION_SCHEMA).option("multiLine", True).json(path)
    return e.select(F.explode("relatedIds").alias("id"), "reason", "approver", "date", "evidence")


def scans(spark: SparkSession, *paths: str) -> DataFrame:
    """Scan results from JSON files or folders."""
    return spark.read.schema(SCAN_SCHEMA).option("multiLine", True).json(list(paths))


def baseline(spark: SparkSession, store: str, label: str) -> DataFrame:
    """Scan results saved under a label; the label is a partition, so nothing else is read."""
    return spark.read.parquet(store).filter(C("label") == clean_label(label))


def scan_findings(results: DataFrame) -> DataFrame:
    """Rows that did not pass, in canonical order, as the history tables keep them."""
    s = results.select("target", C("generated").alias("ts"), F.explode("suites").alias("s"))
    c = s.select("target", "ts", C("s.key").alias("suite"), F.posexplode("s.checks").alias("pos", "c")).filter("c.status <> 'pass'")
    return c.select(
        "target", "ts", "pos", C("c.ruleId").alias("rule_id"), "suite", C("c.status").alias("status"), C("c.severity").alias("severity"),
        F.coalesce("c.deduction", F.lit(0)).alias("deduction"), F.coalesce("c.target", F.lit("")).alias("page"), F.coalesce("c.items", F.array()).alias("items"),
    )


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of every file of a record store. Files are read one per row, as records are small."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return f.select(F.regexp_replace("path", "^.*/", "").alias("rel"), F.sha2("content", 256).alias("sha256"), C("length").alias("size"))


def store_copy_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, changed or unexpected against the manifest of a copy."""
    j = manifest.select("rel", C("sha256").alias("want")).join(files.select("rel", C("sha256").alias("have")), "rel", "full_outer")
    issue = F.when(C("have").isNull(), "missing").when(C("want").isNull(), "unexpected").when(C("want") != C("have"), "corrupt")
    return j.select("rel", issue.alias("issue")).filter("issue IS NOT NULL")
