"""On which pages each rule was answered, where it broke, and which pages it never reached.

Pages of a site are numbered once. What a check left unanswered is a bitmap of 32,768 pages a row, so that sets of pages are
intersected over the checks of a rule without a row for each page and rule. Bitmaps are made only where a check broke; everywhere
else a rule was answered on every page that it could read, and the counts of the site say how many these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegate import rules as R
from pagegate.functions.html import is_html
from pagegate.operators.page_ctx import KEYS
from pagegate.operators.prefix import rank_within
from pagegate.session import cut_lineage

C = F.col
SITE_CHECKS = ("robots-txt", "sitemap", "404-config", "https-enforce", "sec-exposure")  # asked once a site, not page by page
RESPONSE_CHECKS = ("page-status",)  # read any response; the others read HTML alone
REASONS = ("evaluated", "partial-error", "check-error", "no-evidence", "skipped-by-operator")  # the first that holds is a rule's
NOTHING = bytearray(4096)


def page_states(crawl: DataFrame, listed: DataFrame) -> DataFrame:
    """Every page that was fetched or listed, with its state: audited, errored, not-reached. A page fetched twice is one page,
    audited if one of its responses was. `listed(site, scan_id, url)`."""
    ok = F.coalesce((C("status") == 200) & is_html(C("body"), C("content_type")), F.lit(False))
    seen = crawl.groupBy(*KEYS, "url").agg(F.bool_or(ok).alias("html"), F.bool_or(F.coalesce(C("status") >= 100, F.lit(False))).alias("responded"))
    missed = listed.select(*KEYS, "url").distinct().join(seen, [*KEYS, "url"], "left_anti")
    fetched = seen.withColumn("state", F.when(C("html"), "audited").otherwise("errored"))
    return fetched.unionByName(missed.select("*", F.lit(False).alias("html"), F.lit(False).alias("responded"), F.lit("not-reached").alias("state")))


def numbered(states: DataFrame) -> DataFrame:
    """`page_states` with the bucket and bit under which bitmaps know a page."""
    n = rank_within(states, list(KEYS), ["url"], "n")
    return cut_lineage(n.select("*", F.bitmap_bucket_number("n").alias("bucket"), F.bitmap_bit_position("n").alias("bit")).drop("n"))


def _told(checks: DataFrame) -> DataFrame:
    return F.broadcast(checks.select("check_id", F.explode("rule_ids").alias("rule_id")))


def _page_rules(checks: DataFrame) -> DataFrame:
    """check_id, rule_id, reads of the checks that go page by page; some two hundred fixed rows."""
    rules = _told(checks.filter(~C("check_id").isin(*SITE_CHECKS)))
    return F.broadcast(rules.withColumn("reads", F.when(C("check_id").isin(*RESPONSE_CHECKS), "responded").otherwise("html")))


def unanswered(pages: DataFrame, failures: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Bitmaps of pages that no check of a rule answered, per rule and bucket in which a check of it broke: those where all broke
    and those that none could read. `failures(site, scan_id, check_id, url, ...)`; repeats count once. `checks(check_id, rule_ids)` are
    the registry's unless given."""
    rules = _page_rules(checks or R.checks_df(pages.sparkSession))
    attempted = F.when(C("check_id").isin(*RESPONSE_CHECKS), C("responded")).otherwise(C("html"))
    asked = failures.filter(~C("check_id").isin(*SITE_CHECKS)).select(*KEYS, "check_id", "url").distinct()
    place = [*KEYS, "bucket"]
    broke = cut_lineage(
        asked.join(pages, [*KEYS, "url"]).filter(attempted).groupBy(*place, "check_id").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    touched = broke.join(rules, "check_id").select(*place, "rule_id").distinct()
    asking = cut_lineage(touched.join(rules, "rule_id"))
    unread = pages.select(*place, "bit", F.explode(F.array(F.struct(F.lit("html").alias("reads"), C("html").alias("read")), F.struct(F.lit("responded").alias("reads"), C("responded").alias("read")))).alias("r"))
    closed = unread.select(*place, "bit", "r.*").filter("NOT read").groupBy(*place, "reads").agg(F.bitmap_construct_agg("bit").alias("bits"))
    one = [*place, "rule_id", "check_id"]
    sets = (
        asking.select(*one, F.lit(NOTHING).alias("bits"))
        .unionByName(asking.join(broke, [*place, "check_id"]).select(*one, "bits"))
        .unionByName(asking.join(closed, [*place, "reads"]).select(*one, "bits"))
    )
    by_check = sets.groupBy(*one).agg(F.bitmap_or_agg("bits").alias("bits"))
    return by_check.groupBy(*place, "rule_id").agg(F.bitmap_and_agg("bits").alias("bits"))


def _widest(checks: DataFrame) -> DataFrame:
    """What a rule can read at most: any response where one of its checks reads those."""
    return F.broadcast(_page_rules(checks).groupBy("rule_id").agg(F.max("reads").alias("reads")))


def rule_reach(pages: DataFrame, failures: DataFrame, coverage: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Per rule: evaluated, reason, and exact counts of pages answered, broken and never read. Counts of rules that are asked once
    a site are null. `pages` from `numbered`, `coverage` from `rows.verified`."""
    checks = checks or R.checks_df(pages.sparkSession)
    place = [*KEYS, "bucket"]
    reads = _widest(checks)
    sizes = cut_lineage(pages.groupBy(*place).agg(F.count("*").alias("all"), F.count_if("html").alias("html"), F.count_if("responded").alias("responded")))
    readable = F.when(C("reads") == "html", C("html")).otherwise(C("responded"))
    lost = (
        unanswered(pages, failures, checks).join(sizes, place).join(reads, "rule_id")
        .groupBy(*KEYS, "rule_id").agg(F.sum(F.bitmap_count("bits") - (C("all") - readable)).alias("lost"))
    )
    order = F.array(*map(F.lit, REASONS))
    rank = F.array_position(order, C("reason"))
    per_rule = coverage.join(_told(checks), "check_id").groupBy(*KEYS, "rule_id").agg(F.bool_or("verified").alias("evaluated"), F.element_at(order, F.min(rank).cast("int")).alias("reason"))
    site = sizes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("all", "html", "responded")])
    out = per_rule.join(reads, "rule_id", "left").join(site, list(KEYS), "left").join(lost, [*KEYS, "rule_id"], "left")
    paged = C("reads").isNotNull()
    gone = F.coalesce("lost", F.lit(0))
    return out.select(
        *KEYS, "rule_id", "evaluated", "reason", F.when(paged, readable - gone).alias("pages_evaluated"), F.when(paged, gone).alias("pages_errored"),
        F.when(paged, C("all") - readable).alias("pages_not_reached"),
    )


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def broken_pages(pages: DataFrame, failures: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """The pages behind `pages_errored`, one row per rule and page, read off the bitmaps."""
    checks = checks or R.checks_df(pages.sparkSession)
    place = [*KEYS, "bucket"]
    ends = pages.groupBy(*place).agg(F.max("bit").cast("int").alias("top"))
    bits = unanswered(pages, failures, checks).join(ends, place).join(_widest(checks), "rule_id")
    on = bits.select(*place, "rule_id", "reads", "bits", F.explode(F.sequence(F.lit(0), C("top"))).alias("bit")).filter(_is_set(C("bits"), C("bit"))).drop("bits")
    readable = F.when(C("reads") == "html", C("html")).otherwise(C("responded"))
    return on.withColumn("bit", C("bit").cast("long")).join(pages, [*place, "bit"]).filter(readable).select(*KEYS, "rule_id", "url")
