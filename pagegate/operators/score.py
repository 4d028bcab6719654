"""Quality score, launch readiness, lenses and scope.

Rows of one site fold into at most one row per rule before anything is summed, so scoring shuffles a
few hundred rows per site whatever the number of pages.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegate import rules as R
from pagegate.functions.text import round_half_up
from pagegate.operators.page_ctx import KEYS

C = F.col


def open_rules(rows: DataFrame, excluded: Iterable[str] = ()) -> DataFrame:
    """Rules that are open, each once per suite it shows in, less those taken out of scope."""
    rules = R.rules_df(rows.sparkSession).filter("NOT manual AND deduction > 0").select("rule_id", "deduction")
    return (
        rows.filter("status IN ('fail', 'warn') AND rule_id IS NOT NULL")
        .filter(~C("rule_id").isin(*excluded))
        .select(*KEYS, "suite", "rule_id")
        .distinct()
        .join(F.broadcast(rules), "rule_id")
    )


def suite_scores(
    rows: DataFrame,
    evaluated: DataFrame | None = None,
    excluded: Iterable[str] = (),
    weights: dict[str, int] | None = None,
    suites: tuple[str, ...] = R.AUDIT_SUITES,
) -> DataFrame:
    """Score per suite: open risk against total risk.

    `evaluated(site, scan_id, rule_id)` declares what was looked at; a rule neither declared nor open
    leaves the total. Rules in `excluded` leave both sides. A suite with no risk left scores null.
    """
    spark = rows.sparkSession
    sites = rows.select(*KEYS).distinct()
    registry = R.rules_df(spark).filter("NOT manual AND deduction > 0").filter(C("suite").isin(*suites))
    registry = registry.filter(~C("rule_id").isin(*excluded))
    opened = open_rules(rows, excluded)
    # what a site's rules weigh in total: a fixed table per site, never a product of two data tables
    packed = registry.groupBy("suite").agg(F.collect_list(F.struct("rule_id", "deduction")).alias("rs"))
    base = sites.select("*", F.explode(F.array(*[F.lit(s) for s in suites])).alias("suite"))
    risk = base.join(F.broadcast(packed), "suite", "left").select(*KEYS, "suite", F.inline_outer("rs"))
    seen = opened.select(*KEYS, "suite", "rule_id", C("deduction").alias("open_points"))
    if evaluated is not None:
        looked = evaluated.select(*KEYS, "rule_id").distinct().withColumn("looked", F.lit(True))
        risk = risk.join(looked, [*KEYS, "rule_id"], "left")
        counted = C("looked").isNotNull()
    else:
        counted = F.lit(True)
    joined = risk.join(seen, [*KEYS, "suite", "rule_id"], "full_outer")
    in_total = counted | C("open_points").isNotNull()
    agg = joined.groupBy(*KEYS, "suite").agg(
        F.coalesce(F.sum("open_points"), F.lit(0)).alias("open_risk"),
        F.coalesce(F.sum(F.when(in_total & C("deduction").isNotNull(), C("deduction"))), F.lit(0)).alias("total_risk"),
        F.count_if(C("deduction").isNotNull() & ~in_total).alias("not_evaluated"),
    )
    score = F.when(
        C("total_risk") > 0,
        F.greatest(round_half_up(F.lit(100.0) * (1 - C("open_risk") / C("total_risk"))), F.lit(0)),
    ).cast("int")
    w = F.broadcast(R.weights_df(spark, weights).select("suite", "weight"))
    return agg.join(w, "suite", "left").fillna(0, ["weight"]).withColumn("score", score)


def overall_score(scores: DataFrame) -> DataFrame:
    """Weighted mean over suites that have an opinion; null when none has."""
    has = C("score").isNotNull() & (C("weight") > 0)
    total = F.sum(F.when(has, C("score") * C("weight")))
    weight = F.sum(F.when(has, C("weight")))
    return scores.groupBy(*KEYS).agg(round_half_up(F.try_divide(total, weight)).cast("int").alias("overall"))


def deductions(rows: DataFrame) -> DataFrame:
    """What each open row costs, dearest first within its suite."""
    rules = F.broadcast(R.rules_df(rows.sparkSession).filter("deduction > 0").select("rule_id", "deduction"))
    return rows.filter("status IN ('fail', 'warn')").join(rules, "rule_id").orderBy(
        *KEYS, "suite", F.desc("deduction"), "name"
    )


def readiness(rows: DataFrame) -> DataFrame:
    """Launch readiness: any tier-1 row blocks; everything else open keeps it from being clean."""
    rules = F.broadcast(R.rules_df(rows.sparkSession).select("rule_id", "tier"))
    graded = rows.join(rules, "rule_id", "left").withColumn("is_open", C("status").isin("fail", "warn"))
    tier = lambda cond: F.count_if(C("is_open") & cond)
    t = graded.groupBy(*KEYS).agg(
        tier(F.coalesce(C("tier") == 1, F.lit(False))).alias("blockers"),
        tier(F.coalesce(C("tier") == 2, F.lit(False))).alias("majors"),
        tier(F.coalesce(C("tier") == 3, F.lit(False))).alias("polish"),
        tier(C("tier").isNull()).alias("untiered"),
    )
    outstanding = C("majors") + C("polish") + C("untiered")
    plural = lambda n: F.when(n > 1, "s").otherwise("")
    return t.select(
        "*",
        outstanding.alias("outstanding"),
        (C("blockers") == 0).alias("launch_ready"),
        ((C("blockers") == 0) & (outstanding == 0)).alias("clean"),
        F.when(C("blockers") > 0, "no").when(outstanding == 0, "ok").otherwise("part").alias("tone"),
        F.when(
            C("blockers") > 0,
            F.concat(F.lit("NOT LAUNCH-READY — "), C("blockers"), F.lit(" blocker"), plural(C("blockers"))),
        )
        .when(outstanding == 0, "LAUNCH-READY")
        .otherwise(
            F.concat(F.lit("NO LAUNCH BLOCKERS — "), outstanding, F.lit(" issue"), plural(outstanding), F.lit(" outstanding"))
        )
        .alias("verdict"),
    )


# The views findings can be looked at through.
LENSES = ("seo", "security", "stability", "interaction")


def lenses(occurrences: DataFrame) -> DataFrame:
    """Sub-score per lens over occurrences; one finding may count in several lenses.

    `occurrences(site, scan_id, rule_id, page)` holds one row per projected finding.
    """
    rules = F.broadcast(
        R.rules_df(occurrences.sparkSession).select("rule_id", "deduction", "inspector", "interaction")
    )
    keys = F.filter(
        F.array(
            F.when(C("inspector").isin(*LENSES[:3]), C("inspector")), F.when(C("interaction"), F.lit("interaction"))
        ),
        lambda k: k.isNotNull(),
    )
    seen = (
        occurrences.join(rules, "rule_id")
        .select(*KEYS, "page", "deduction", F.explode(keys).alias("lens"))
        .groupBy(*KEYS, "lens")
        .agg(F.sum("deduction").alias("points"), F.count("*").alias("findings"), F.count_distinct("page").alias("pages"))
    )
    every = occurrences.select(*KEYS).distinct().select("*", F.explode(F.array(*[F.lit(x) for x in LENSES])).alias("lens"))
    return every.join(seen, [*KEYS, "lens"], "left").select(
        *KEYS,
        "lens",
        F.greatest(F.lit(0), F.lit(100) - F.coalesce(C("points"), F.lit(0))).cast("int").alias("score"),
        F.coalesce(C("findings"), F.lit(0)).alias("findings"),
        F.coalesce(C("pages"), F.lit(0)).alias("pages"),
    )


def suites_fully_out(excluded: Iterable[str]) -> list[str]:
    """Suites of the audit none of whose rules is left in scope."""
    out = set(excluded)
    return [s for s in R.AUDIT_SUITES if all(r["rule_id"] in out for r in R.rule_rows() if r["suite"] == s)]


def scope_facts(rows: DataFrame, excluded: Iterable[str]) -> DataFrame:
    """What a narrowed scope hides: open rules out of scope, blockers among them, suites fully out."""
    excluded = list(excluded)
    tiers = F.broadcast(R.rules_df(rows.sparkSession).select("rule_id", "tier"))
    fired = C("status").isin("fail", "warn") & C("rule_id").isin(*excluded)
    per_rule = rows.groupBy(*KEYS, "rule_id").agg(F.bool_or(fired).alias("hidden")).join(tiers, "rule_id", "left")
    return per_rule.groupBy(*KEYS).agg(
        F.count_if("hidden").alias("open_hidden"),
        F.count_if(C("hidden") & (C("tier") == 1)).alias("blockers_hidden"),
        F.lit(len(suites_fully_out(excluded))).alias("suites_fully_out"),
    )


def worklist(rows: DataFrame) -> DataFrame:
    """Order of the work list: open first by tier and cost, then review, then passed by name."""
    rules = F.broadcast(R.rules_df(rows.sparkSession).select("rule_id", "tier", "deduction"))
    kind = F.when(C("status").isin("fail", "warn"), 0).when(C("status") == "manual", 1).otherwise(2)
    r = rows.join(rules, "rule_id", "left").withColumn("kind", kind)
    is_open = C("kind") == 0
    return r.orderBy(
        *KEYS, "kind",
        F.when(is_open, F.coalesce(C("tier"), F.lit(3))),
        F.when(is_open, -F.coalesce(C("deduction"), F.lit(0))),
        F.when(~is_open, C("name")),
    )
