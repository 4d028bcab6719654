"""Visual comparison of a reference page and its candidate, from element tables and pixel rows.

`element(site, page, viewport, vord, side, pos, sec, tag, head, text, href, aria, ialt, src, x, y,
font, size, color, bg_img)` in document order; `raster_row(site, page, viewport, side, y, rgb)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegate.functions.digest import djb2_base36
from pagegate.functions.text import round_half_up
from pagegate.operators.prefix import rank_within, running_max, running_sum, with_previous
from pagegate.session import cut_lineage

C = F.col
VIEW = ["site", "page", "viewport"]


def _first_text(*names: str) -> Column:
    """First non-empty of the named columns, lower case, 40 characters."""
    return F.substring(F.lower(F.coalesce(*[F.nullif(C(n), F.lit("")) for n in names], F.lit(""))), 1, 40)


def bucket() -> Column:
    return F.concat_ws("|", "sec", "tag", _first_text("text", "head", "src"))


def identity() -> Column:
    return _first_text("text", "aria", "ialt", "src", "href")


FACTS = ("pos", "sec", "tag", "text", "head", "href", "aria", "ialt", "src", "x", "y", "font", "size", "color", "bg_img")


def match_elements(elements: DataFrame) -> DataFrame:
    """One-to-one match inside (landmark, tag, text) buckets in document order.

    Taking the first unused candidate for each reference element in order pairs the n-th of a bucket
    with its n-th, so the match is an equal join on (bucket, n). Rows hold both sides `r` and `c`.
    """
    e = elements.withColumn("bucket", bucket()).withColumn("ident", identity())
    ranked = rank_within(e, [*VIEW, "side", "bucket"], ["pos"], "n")
    side = lambda s, name: ranked.filter(C("side") == s).select(
        *VIEW, "vord", "bucket", "n", F.struct(*FACTS, "ident").alias(name)
    )
    return side("ref", "r").join(side("cand", "c"), [*VIEW, "vord", "bucket", "n"], "full_outer").drop("bucket", "n")


def _phases(knotted: DataFrame, key: list[str]) -> DataFrame:
    """Adds to the n-th pairs the stretch `phase` (begin, own, end) they lie in, null outside of any.

    A stretch begins where both sides are of one landmark `own`. From there on elements of `own` wait, and it ends where as many
    as waited were taken: where the count of `own` on both sides, less one for each position, is back at what it was. This count
    falls by one at most, so the end is the next row at its level. Stretches may begin inside of others; those that count are
    found from the first one by doubling."""
    stuck = C("ref_sec") == C("cand_sec")
    rows = cut_lineage(running_sum(knotted.withColumn("is_stuck", F.coalesce(stuck, F.lit(False)).cast("long")), key, "n", "is_stuck", "begun"))
    owners = rows.filter("is_stuck = 1").select(*key, C("ref_sec").alias("own")).distinct()
    full = rows.filter("ref_sec IS NOT NULL AND cand_sec IS NOT NULL").join(owners, key)
    step = full.withColumn("step", (C("ref_sec") == C("own")).cast("long") + (C("cand_sec") == C("own")).cast("long") - 1)
    levels = running_sum(step, [*key, "own"], "n", "step", "level")
    marks = F.filter(
        F.array(
            F.struct(C("level").alias("level"), F.lit(False).alias("begins")),
            F.when(C("step") == 1, F.struct((C("level") - 1).alias("level"), F.lit(True).alias("begins"))),
        ),
        lambda m: m.isNotNull(),
    )
    events = rank_within(levels.select(*key, "own", "n", "begun", F.inline(marks)), [*key, "own", "level"], ["n"], "r")
    paired = with_previous(events, [*key, "own", "level"], "r", {"n": "end", "begun": "begun_at_end"}, -1)
    begins = cut_lineage(paired.filter("begins").select(*key, "own", C("n").alias("begin"), "end", C("begun").alias("at"), (C("begun_at_end") + 1).alias("to")))

    jump = cut_lineage(begins.filter("to IS NOT NULL").select(*key, "at", "to"))
    reached = begins.filter("at = 1").select(*key, "at")
    while not jump.isEmpty():
        onward = reached.join(jump, [*key, "at"]).select(*key, C("to").alias("at"))
        reached = cut_lineage(reached.unionByName(onward))
        hop = jump.select(*key, C("at").alias("to"), C("to").alias("then"))
        jump = cut_lineage(jump.join(hop, [*key, "to"]).select(*key, "at", C("then").alias("to")))
    counted = begins.join(reached, [*key, "at"]).select(*key, C("begin").alias("n"), F.struct("begin", "own", "end").alias("starts"))
    last = running_max(rows.join(counted, [*key, "n"], "left"), key, "n", "starts", "last")
    inside = C("last").isNotNull() & (C("last.end").isNull() | (C("n") <= C("last.end")))
    return last.withColumn("phase", F.when(inside, C("last"))).drop("last", "starts", "is_stuck", "begun")


def relocations(matched: DataFrame) -> DataFrame:
    """Missing elements that reappear in another landmark with the same tag and identity.

    In order, each missing element takes the first free extra of another landmark. All extras passed over so far are of one
    landmark, so the n-th missing meets the n-th extra but for stretches in which elements of one landmark wait. In such a
    stretch the missing of that landmark take the extras of others, and the missing of others take those that wait, each
    in order: equal joins on ordinals, whatever the size of a landmark. Elements without identity are not relocated."""
    key = [*VIEW, "tag", "ident"]

    def unmatched(el: str, other: str, pos: str, sec: str) -> DataFrame:
        alone = matched.filter(C(other).isNull() & (C(f"{el}.ident") != ""))
        rows = alone.select(*VIEW, f"{el}.tag", f"{el}.ident", C(f"{el}.pos").cast("long").alias(pos), C(f"{el}.sec").alias(sec))
        return rank_within(rows, key, [pos], "n")

    lost, extra = unmatched("r", "c", "ref_pos", "ref_sec"), unmatched("c", "r", "cand_pos", "cand_sec")
    met = cut_lineage(lost.join(extra, [*key, "n"], "full_outer"))
    out = [*key, "ref_pos", "cand_pos", C("cand_sec").alias("to_sec")]
    knots = met.filter("ref_sec = cand_sec").select(*key).distinct()
    plain = met.filter("ref_pos IS NOT NULL AND cand_pos IS NOT NULL")
    if knots.isEmpty():
        return plain.select(*out)
    told = cut_lineage(_phases(met.join(knots, key, "left_semi"), key))
    waiting = told.filter("phase IS NOT NULL").select("*", C("phase.begin").alias("begin"), C("phase.own").alias("own"))
    stretch = [*key, "begin", "turn"]
    takers = waiting.filter("ref_pos IS NOT NULL").select(*key, "begin", (C("ref_sec") == C("own")).alias("turn"), "n", "ref_pos")
    taken = waiting.filter("cand_pos IS NOT NULL").select(*key, "begin", (C("cand_sec") != C("own")).alias("turn"), "n", "cand_pos", "cand_sec")
    crossed = rank_within(takers, stretch, ["n"], "k").drop("n").join(rank_within(taken, stretch, ["n"], "k").drop("n"), [*stretch, "k"])
    direct = told.filter("phase IS NULL AND ref_pos IS NOT NULL AND cand_pos IS NOT NULL")
    return plain.join(knots, key, "left_anti").select(*out).unionByName(direct.select(*out)).unionByName(crossed.select(*out))


def deltas(matched: DataFrame, background: bool = True) -> DataFrame:
    """What differs, one row per kind and element: missing, extra, moved, restyled."""
    m = matched.withColumn("is_match", C("r").isNotNull() & C("c").isNotNull())
    moved = (F.abs(C("r.y") - C("c.y")) > 60) | (F.abs(C("r.x") - C("c.x")) > 60)
    font = (C("r.font") != "") & (C("c.font") != "") & (F.lower("r.font") != F.lower("c.font"))
    size = (C("r.size") > 0) & (C("c.size") > 0) & (F.abs(C("r.size") - C("c.size")) > 2)
    colour = ~C("r.color").eqNullSafe(C("c.color"))
    rb, cb = F.coalesce("r.bg_img", F.lit("")), F.coalesce("c.bg_img", F.lit(""))
    bg = (rb != cb) & F.lit(background)
    arrow = lambda label, a, b, unit="": F.concat(F.lit(label + " "), a, F.lit("→"), b, F.lit(unit))
    diffs = F.filter(
        F.array(
            F.when(font, arrow("font", C("r.font"), C("c.font"))),
            F.when(size, arrow("size", C("r.size"), C("c.size"), "px")),
            F.when(colour, arrow("color", C("r.color"), C("c.color"))),
            F.when(
                bg,
                F.when(cb == "", F.concat(F.lit("background removed ("), rb, F.lit(")")))
                .when(rb == "", F.concat(F.lit("background added ("), cb, F.lit(")")))
                .otherwise(arrow("background", rb, cb)),
            ),
        ),
        lambda d: d.isNotNull(),
    )
    row = lambda kind, el, detail, is_bg: F.struct(
        F.lit(kind).alias("kind"), el.alias("el"), detail.alias("detail"), is_bg.alias("is_bg")
    )
    none, no = F.lit("").cast("string"), F.lit(False)
    kinds = F.filter(
        F.array(
            F.when(C("c").isNull(), row("missing", C("r"), none, no)),
            F.when(C("r").isNull(), row("extra", C("c"), none, no)),
            F.when(C("is_match") & moved, row("moved", C("r"), none, no)),
            F.when(C("is_match") & (F.size(diffs) > 0), row("restyled", C("r"), F.array_join(diffs, "; "), F.coalesce(bg, no))),
        ),
        lambda k: k.isNotNull(),
    )
    flat = m.select(*VIEW, "vord", F.inline(kinds))
    moves = relocations(matched)
    as_ref = moves.select(*VIEW, F.lit("missing").alias("kind"), C("ref_pos").alias("pos"), "to_sec", F.lit(True).alias("reloc"))
    as_cand = moves.select(*VIEW, F.lit("extra").alias("kind"), C("cand_pos").alias("pos"), F.lit(None).cast("string").alias("to_sec"), F.lit(True).alias("reloc"))
    tagged = flat.withColumn("pos", C("el.pos").cast("long")).join(as_ref.unionByName(as_cand), [*VIEW, "kind", "pos"], "left")
    kept = tagged.filter("reloc IS NULL OR kind = 'missing'")
    return kept.select(
        *VIEW, "vord", F.when(C("reloc"), "moved").otherwise(C("kind")).alias("kind"), "el",
        F.when(C("reloc"), F.concat(C("el.sec"), F.lit("→"), C("to_sec"))).otherwise(C("detail")).alias("detail"), "is_bg",
    )


def structure_scores(matched: DataFrame) -> DataFrame:
    """Reference and candidate counts, matches, and the share of reference elements found again."""
    s = matched.groupBy(*VIEW, "vord").agg(
        F.count("r").alias("ref_count"), F.count("c").alias("cand_count"),
        F.count_if(C("r").isNotNull() & C("c").isNotNull()).alias("matched"),
    )
    share = F.when(C("ref_count") > 0, C("matched") / C("ref_count")).when(C("cand_count") > 0, 0.0).otherwise(1.0)
    return s.withColumn("struct_score", F.round(share * 100, 1))


def pixel_mismatch(rows: DataFrame) -> DataFrame:
    """Percent of reference pixels whose colour differs by more than 60 over the three channels."""
    side = lambda s, name: rows.filter(C("side") == s).select(*VIEW, "y", C("rgb").alias(name))
    j = side("ref", "a").join(side("cand", "b"), [*VIEW, "y"], "left")
    n = (F.size("a") / 3).cast("int")
    gap = lambda i, k: F.abs(F.get(C("a"), i * 3 + k) - F.get(C("b"), i * 3 + k))
    differs = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: gap(i, 0) + gap(i, 1) + gap(i, 2) > 60))
    return j.groupBy(*VIEW).agg(
        F.round(F.sum(F.when(C("b").isNotNull(), differs).otherwise(0)) / F.sum(n) * 100, 2).alias("pixel_pct")
    )


def viewport_scores(structure: DataFrame, pixels: DataFrame, redesign: bool = False) -> DataFrame:
    """Match per viewport: structure alone, or its mean with the pixels where they were compared."""
    p = pixels.select(*VIEW, F.lit(None).cast("double").alias("pixel_pct")) if redesign else pixels
    j = structure.join(p, VIEW, "left")
    vis = F.greatest(F.round(F.lit(100) - C("pixel_pct"), 1), F.lit(0.0))
    score = F.when(C("pixel_pct").isNull(), C("struct_score")).otherwise(F.round((C("struct_score") + vis) / 2, 1))
    return j.withColumn("match_score", score)


def _mean_tenths(score: str) -> Column:
    """Mean of one-decimal scores rounded to one decimal, from whole tenths so that order of adding
    never decides a tie."""
    tenths = F.sum(F.round(C(score) * 10).cast("long"))
    return round_half_up(tenths / F.count(score)) / 10


def page_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("site", "page").agg(_mean_tenths("match_score").alias("page_score"))


def overall_match(scores: DataFrame) -> DataFrame:
    return page_scores(scores).groupBy("site").agg(_mean_tenths("page_score").alias("overall"), F.count("*").alias("pairs"))


def fold_rows(
    scores: DataFrame, unmatched: DataFrame, drift: DataFrame, redesign: bool = False, match_min: float = 90, pixel_max: float = 8
) -> DataFrame:
    """The three rows of the visual suite. A redesign is not judged by pixels."""
    over = F.coalesce(C("match_score") < match_min, F.lit(False))
    if not redesign:
        over = over | F.coalesce(C("pixel_pct") > pixel_max, F.lit(False))
    hit = lambda df, rule: df.select("site", F.lit(rule).alias("rule_id"))
    hits = hit(scores.filter(over), "VIS-001").unionByName(hit(unmatched, "VIS-002")).unionByName(hit(drift, "VIS-003"))
    n = hits.groupBy("site", "rule_id").agg(F.count("*").alias("items"))
    every = scores.select("site").distinct().select("site", F.explode(F.array(*[F.lit(r) for r in ("VIS-001", "VIS-002", "VIS-003")])).alias("rule_id"))
    j = every.join(n, ["site", "rule_id"], "left").fillna(0)
    return j.withColumn("status", F.when(C("items") > 0, "warn").otherwise("pass"))


# Penalty of a finding per strictness profile and tier.
PROFILES = {
    "strict": {"MISSING": 1.0, "DEFECT": 0.6, "SPACING": 0.25, "IMPROVEMENT": 0.0},
    "balanced": {"MISSING": 1.0, "DEFECT": 0.4, "SPACING": 0.1, "IMPROVEMENT": 0.0},
    "lenient": {"MISSING": 0.8, "DEFECT": 0.25, "SPACING": 0.05, "IMPROVEMENT": 0.0},
}
TIERS = ("MISSING", "DEFECT", "SPACING", "IMPROVEMENT")


def grade_findings(deltas_: DataFrame, structure: DataFrame, unmatched: DataFrame, drift: DataFrame) -> DataFrame:
    """Graded findings of each page's first viewport, one per stable id."""
    first = structure.groupBy("site", "page").agg(F.min("vord").alias("vord"))
    d = deltas_.join(first, ["site", "page", "vord"])
    kind = (
        F.when(C("kind") == "missing", "missing-element")
        .when(C("kind") == "moved", "moved")
        .when(C("kind") == "extra", "extra")
        .when(C("is_bg"), "background")
        .otherwise("restyle")
    )
    name = lambda *cols: F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))
    ident = F.substring(F.lower(name(C("el.text"), C("el.aria"), C("el.ialt"), C("el.src"), C("el.href"), C("el.head"))), 1, 40)
    elems = d.select("site", "page", kind.alias("kind"), F.concat_ws("|", "el.sec", "el.tag", ident).alias("ekey"), F.lit(1.0).alias("weight"))
    counts = structure.join(first, ["site", "page", "vord"]).filter("ref_count > 0")
    # median of two middle values rounds half up; no page with elements counts as one element
    med = counts.groupBy("site").agg(round_half_up(F.median("ref_count")).cast("double").alias("median_ref"))
    lost = unmatched.join(med, "site", "left").select(
        "site", "page", F.lit("missing-page").alias("kind"), F.concat(F.lit("page|page|"), F.substring(F.lower("page"), 1, 40)).alias("ekey"),
        F.coalesce("median_ref", F.lit(1.0)).alias("weight"),
    )
    fonts = drift.select(
        "site", "page", F.lit("font-drift").alias("kind"), F.concat(F.lit("typography|font|"), F.substring(F.lower("family"), 1, 40)).alias("ekey"), F.lit(1.0).alias("weight")
    )
    every = elems.unionByName(lost).unionByName(fonts).dropDuplicates(["site", "page", "kind", "ekey"])
    tier = (
        F.when(C("kind").isin("missing-element", "missing-page"), "MISSING")
        .when(C("kind").isin("background", "restyle", "font-drift"), "DEFECT")
        .when(C("kind") == "moved", "SPACING")
        .otherwise("IMPROVEMENT")
    )
    return every.select(
        "site", "page", "kind", tier.alias("tier"), "weight",
        F.concat(F.substring("kind", 1, 4), F.lit("-"), djb2_base36(F.concat_ws("::", "page", "kind", "ekey"))).alias("id"),
    )


def fidelity(findings: DataFrame, structure: DataFrame, unmatched: DataFrame, profile: str = "balanced", ignored: DataFrame | None = None) -> DataFrame:
    """Fidelity score per site: penalties over the reference's elements. Ignored ids cost nothing."""
    p = PROFILES.get(profile, PROFILES["balanced"])
    # whole hundredths, so that no sum depends on the order of its terms
    penalty = F.create_map(*[F.lit(x) for t, v in p.items() for x in (t, round(v * 100))])[C("tier")]
    f = findings
    if ignored is not None:
        f = f.join(ignored.select("site", "id").distinct().withColumn("ign", F.lit(True)), ["site", "id"], "left")
    else:
        f = f.withColumn("ign", F.lit(None).cast("boolean"))
    f = f.withColumn("cost", F.when(C("ign"), 0).otherwise(penalty * C("weight").cast("long")))
    num = f.groupBy("site").agg(
        F.sum("cost").alias("numerator"), F.count("*").alias("findings"), F.count("ign").alias("ignored"),
        *[F.count_if(C("tier") == t).alias("n_" + t.lower()) for t in TIERS],
    )
    first = structure.groupBy("site", "page").agg(F.min_by("ref_count", "vord").alias("ref_count"))
    lost = unmatched.groupBy("site").agg(F.count("*").alias("lost"))
    den = first.groupBy("site").agg(
        F.sum("ref_count").alias("budget"), round_half_up(F.median(F.when(C("ref_count") > 0, C("ref_count")))).alias("median_ref")
    )
    j = den.join(lost, "site", "full_outer").join(num, "site", "left").fillna(0)
    total = C("budget") + C("lost") * F.when(C("median_ref") > 0, C("median_ref")).otherwise(1)
    t = j.withColumn("total", total.cast("long"))
    # half up: floor(x / total + 1/2) of the hundredths that are left
    half_up = F.expr("(2 * (100 * total - cast(numerator as long)) + total) div (2 * total)")
    score = F.when(C("total") > 0, F.least(F.greatest(half_up, F.lit(0)), F.lit(100))).cast("int")
    return t.select(
        "site", score.alias("score"), (C("numerator") / 100).alias("numerator"), C("total").alias("denominator"), "findings", "ignored",
        *["n_" + t.lower() for t in TIERS],
    )


def rerate_ledger(rates: DataFrame) -> DataFrame:
    """Before and after of every re-rating of a run, in order of time."""
    r = rank_within(rates, ["run"], ["at"], "n")
    return with_previous(r, ["run"], "n", {"score": "before"}).select("run", "n", "at", "profile", "before", C("score").alias("after"))


def explain_empty(side: DataFrame, pairs: DataFrame) -> DataFrame:
    """Why a comparison has no pairs. `side(run, side, status, error_code)` are the crawled pages."""
    def facts(name: str) -> DataFrame:
        return side.filter(C("side") == name).groupBy("run").agg(
            F.count_if(C("status") == 200).alias(f"{name}_ok"),
            F.bool_or(C("status").isin(401, 403)).alias(f"{name}_blocked"),
            F.bool_or(C("status") == 0).alias(f"{name}_silent"),
            F.bool_or(C("error_code").rlike("(?i)ENOTFOUND|EAI_AGAIN|ERR_NAME")).alias(f"{name}_dns"),
            F.bool_or(
                C("error_code").rlike("(?i)ETIMEDOUT|ETIMEOUT|EHOSTUNREACH|ENETUNREACH|ECONNRESET|UND_ERR_(CONNECT|HEADERS|BODY)_TIMEOUT|UND_ERR_SOCKET")
            ).alias(f"{name}_timeout"),
            F.bool_or(C("error_code").rlike("(?i)ECONNREFUSED")).alias(f"{name}_refused"),
            F.bool_or(C("error_code").rlike("(?i)CERT|TLS|SSL|EPROTO")).alias(f"{name}_tls"),
        )

    def cause(n: str) -> Column:
        return (
            F.when(C(f"{n}_blocked"), "blocked")
            .when(F.coalesce(C(f"{n}_silent"), F.lit(True)), F.when(C(f"{n}_dns"), "dns").when(C(f"{n}_timeout"), "timeout").when(C(f"{n}_refused"), "refused").when(C(f"{n}_tls"), "tls").otherwise("connection"))
            .otherwise("no-pages")
        )

    n = pairs.groupBy("run").agg(F.count("*").alias("pairs"))
    j = side.select("run").distinct().join(n, "run", "left").join(facts("ref"), "run", "left").join(facts("cand"), "run", "left").fillna(0)
    j = j.filter("pairs = 0")
    return j.select(
        "run",
        F.when(C("ref_ok") == 0, "reference-unreachable").when(C("cand_ok") == 0, "candidate-unreachable").otherwise("no-common-pages").alias("reason"),
        F.when(C("ref_ok") == 0, cause("ref")).when(C("cand_ok") == 0, cause("cand")).alias("cause"),
    )
