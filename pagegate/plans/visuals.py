"""Queries over visual comparison and captured page facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegate.functions.digest import djb2_base36
from pagegate.functions.grades import contrast_ratio, match_band
from pagegate.operators import rendered as N
from pagegate.operators import visual as V
from pagegate.plans import fixtures as X
from pagegate.session import cut_lineage

C = F.col
FONT_STATUS = "CASE page_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'loaded' WHEN 2 THEN 'loaded' ELSE 'unloaded' END"


def _matched(s, d, labelled=False):
    return cut_lineage(V.match_elements(X.elements(s, d, labelled)))


def _scores(s, d, redesign=False, m=None):
    m = m if m is not None else _matched(s, d)
    return V.viewport_scores(V.structure_scores(m), V.pixel_mismatch(X.raster_rows(s, d)), redesign)


def _drift(s, d):
    ref, cand = _used(s, d, 0), _used(s, d, 1)
    return N.font_drift(ref, cand)


def _graded(s, d):
    m = _matched(s, d)
    st = V.structure_scores(m)
    lost = X.lost_pages(s, d)
    g = V.grade_findings(V.deltas(m), st, lost, _drift(s, d).filter("cast(substr(page, 2) AS BIGINT) % 20 <> 0"))
    return g, st, lost


def _fonts(s, d):
    return X.pages(s, d).select(F.expr(X.SITE_SQL).alias("site"), X._expr(X.PATH_SQL).alias("page"), "page_id")


def _used(s, d, side):
    fam = F.array(F.lit("Inter"), F.expr(f"CASE WHEN page_id % 3 = {side} THEN 'Lora' ELSE 'Arial' END"), F.expr("concat('Face', page_id % 5)"))
    return _fonts(s, d).select("site", "page", F.explode(fam).alias("family"), F.lit(3).alias("n"))


def _font_tables(s, d):
    p = _fonts(s, d)
    faces = p.select(
        "site", "page", F.expr("concat('Face', page_id % 5)").alias("family"), F.expr(FONT_STATUS).alias("status"),
        F.expr("CASE page_id % 3 WHEN 0 THEN '400' WHEN 1 THEN '100 900' ELSE 'bold' END").alias("weight"),
        F.expr("CASE WHEN page_id % 7 = 0 THEN 'italic' ELSE 'normal' END").alias("style"), F.expr("CASE WHEN page_id % 2 = 0 THEN 'swap' ELSE 'auto' END").alias("display"),
    )
    samples = p.select(
        "site", "page", F.expr("concat('Face', page_id % 5)").alias("family"), F.expr("posexplode(array('normal', 'italic'))").alias("pos", "style"), "page_id"
    ).filter("pos = 0 OR page_id % 2 = 1").select(
        "site", "page", "family", "pos", "style", F.lit("p").alias("selector"), F.expr("CASE WHEN page_id % 3 = 0 THEN '700' ELSE '400' END").alias("weight")
    )
    preloads = p.filter("page_id % 6 = 1").select("site", "page", F.lit("Spare").alias("family"), F.expr("page_id % 12 = 1").alias("used_family"))
    return faces, _used(s, d, 0), samples, preloads


def _icons(s, d):
    m = X.marks(s, d).filter("tag = 'li'")
    return m.select(
        "site", "page", F.expr("concat('Icons', pos % 2)").alias("family"), F.expr("pos % 3 = 0").alias("loaded"), F.expr("pos % 4 = 1").alias("is_word"),
        F.lit("menu").alias("text"), F.expr("pos % 5 = 2").alias("pua"),
    )


def _engines(s, d):
    p = _fonts(s, d)
    e = p.select("site", "page", "page_id", F.explode(F.array(F.lit("firefox"), F.lit("webkit"))).alias("engine"))
    flags = e.select(
        "site", "page", "engine", F.expr("page_id % 10 <> 0 OR engine = 'firefox'").alias("available"), F.expr("page_id % 10 = 3").alias("abandoned"),
        F.expr("page_id % 10 NOT IN (4, 5)").alias("ok"), F.expr("CAST(page_id % 3 AS INT)").alias("errors"),
    )
    return flags, p.filter("page_id % 10 = 5").select("site", "page")


def _rerates(s, d):
    e = X.event_facts(s, d)
    return e.select(C("site").alias("run"), F.format_string("%012d", "event_id").alias("at"), F.lit("balanced").alias("profile"), F.floor("value").alias("score"))


def _empty_sides(s, d):
    """Comparisons that failed in different ways, one per site, from the pages of each site."""
    p = X.pages(s, d).select(F.expr(X.SITE_SQL).alias("run"), "page_id")
    k = p.groupBy("run").agg(F.min("page_id").alias("k"))
    j = p.join(k, "run").select("run", "k", F.explode(F.array(F.lit("ref"), F.lit("cand"))).alias("side"))
    status = F.expr("CASE WHEN side = 'ref' AND k % 7 = 1 THEN 403 WHEN side = 'ref' AND k % 7 IN (2, 3) THEN 0 WHEN side = 'cand' AND k % 7 = 4 THEN 0 WHEN side = 'ref' AND k % 7 = 6 THEN 404 ELSE 200 END")
    code = F.expr("CASE k % 7 WHEN 2 THEN 'ENOTFOUND' WHEN 3 THEN 'UND_ERR_CONNECT_TIMEOUT' WHEN 4 THEN 'ECONNREFUSED' END")
    return j.select("run", "side", status.alias("status"), code.alias("error_code")), k.filter("k % 7 = 0").select("run")


def queries():
    return {
        "element_match": lambda s, d: _matched(s, d).select("site", "page", "viewport", C("r.pos").alias("ref_pos"), C("c.pos").alias("cand_pos")),
        "element_deltas": lambda s, d: V.deltas(_matched(s, d)).groupBy("site", "page", "viewport", "kind", "is_bg").agg(F.count("*").alias("n")),
        "restyle_details": lambda s, d: V.deltas(_matched(s, d)).filter("kind = 'restyled'").select("site", "page", "viewport", C("el.pos").alias("pos"), "detail"),
        "relocated_elements": lambda s, d: V.relocations(_matched(s, d, True)).select("site", "page", "viewport", "tag", "ident", "ref_pos", "cand_pos", "to_sec"),
        "structure_score": lambda s, d: V.structure_scores(_matched(s, d)).drop("vord"),
        "pixel_mismatch": lambda s, d: V.pixel_mismatch(X.raster_rows(s, d)),
        "viewport_scores": lambda s, d: _scores(s, d).select("site", "page", "viewport", "match_score"),
        "redesign_scores": lambda s, d: _scores(s, d, True).select("site", "page", "viewport", "match_score"),
        "page_match": lambda s, d: V.page_scores(_scores(s, d)),
        "overall_match": lambda s, d: V.overall_match(_scores(s, d)).select("site", "overall", "pairs", match_band(C("overall")).alias("band")),
        "visual_fold": lambda s, d: V.fold_rows(_scores(s, d), X.lost_pages(s, d), _drift(s, d)),
        "graded_findings": lambda s, d: _graded(s, d)[0].select("site", "page", "kind", "tier", "weight"),
        "finding_ids": lambda s, d: X.marks(s, d).select("page", "pos", djb2_base36(F.concat_ws("::", "page", "tag", F.substring("txt", 1, 20))).alias("id")),
        "fidelity_grade": lambda s, d: (lambda g: V.fidelity(g[0], g[1], g[2]))(_graded(s, d)),
        "fidelity_strict": lambda s, d: (lambda g: V.fidelity(g[0], g[1], g[2], "strict"))(_graded(s, d)),
        "fidelity_ignored": lambda s, d: (lambda g: V.fidelity(g[0], g[1], g[2], "lenient", g[0].filter("kind = 'moved'").select("site", "id")))(_graded(s, d)),
        "rerate_ledger": lambda s, d: V.rerate_ledger(_rerates(s, d)),
        "explain_empty": lambda s, d: V.explain_empty(*_empty_sides(s, d)),
        "horizontal_overflow": lambda s, d: N.overflow(*X.boxes(s, d)),
        "too_wide": lambda s, d: N.too_wide(*X.boxes(s, d)),
        "touch_targets": lambda s, d: N.touch_targets(*X.boxes(s, d)),
        "contrast": lambda s, d: X.texts(s, d).select("site", "page", "pos", F.round(contrast_ratio(C("fg"), C("bg")), 4).alias("ratio")),
        "low_contrast": lambda s, d: N.low_contrast(X.texts(s, d)).select("site", "page", "selector"),
        "wcag_violations": lambda s, d: N.wcag_violations(
            X.event_facts(s, d).select("site", "page", C("event_type").alias("violation"), F.expr("CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'moderate' ELSE 'minor' END").alias("impact"), C("event_id").alias("ord"))
        ).groupBy("site", "page", "violation", "severity").agg(F.count("*").alias("n")),
        "console_network": lambda s, d: (lambda e: N.console_and_network(e.filter("event_type = 'error'"), e.filter("event_type = 'click'").withColumn("request", F.floor("value"))))(X.event_facts(s, d)),
        "page_weight": lambda s, d: N.page_weight(X.event_facts(s, d).withColumn("bytes", F.floor(C("value") * 10000))).select("site", "page", "requests", "bytes"),
        "web_vitals": lambda s, d: N.web_vitals(
            X.event_facts(s, d).filter("event_type IN ('view', 'click')").select(
                "site", "page", F.expr("CASE event_type WHEN 'view' THEN 'lcp' ELSE 'cls' END").alias("kind"),
                F.expr("CASE event_type WHEN 'view' THEN value * 200 ELSE value / 100 END").alias("value"), F.expr("event_id % 3 = 0").alias("recent_input"),
            )
        ),
        "font_findings": lambda s, d: N.font_findings(*_font_tables(s, d)),
        "font_samples": lambda s, d: N.sample_choice(_font_tables(s, d)[2]).select("site", "page", "family", "s.style"),
        "icon_findings": lambda s, d: N.icon_findings(_icons(s, d)),
        "font_drift": lambda s, d: _drift(s, d),
        "fonts_kept": lambda s, d: N.fonts_kept(_used(s, d, 0), _used(s, d, 1)),
        "engine_rows": lambda s, d: N.engine_rows(*_engines(s, d)),
        "blocking_overlays": lambda s, d: N.blocking_overlays(_fonts(s, d).select("site", "page", F.expr("page_id % 5 = 0").alias("still_blocking"), F.expr("CASE WHEN page_id % 2 = 0 THEN 'intercepts' ELSE 'paints' END").alias("reason"), F.expr("(page_id % 100) / 100").alias("cover"))),
        "consent_rows": lambda s, d: N.consent_rows(_fonts(s, d).select("site", "page")),
        "unverified_rules": _unverified,
        "swept_viewports": lambda s, d: N.swept_viewports(
            _fonts(s, d).select("site", "page", F.explode(F.array(F.lit("1920 · Desktop"), F.lit("390 · Phone"))).alias("viewport"), "page_id").withColumn("swept", F.expr("viewport = '1920 · Desktop' OR page_id % 50 <> 3"))
        ),
    }


SWEPT = "NOT (page_id % 4 = 1 AND viewport LIKE '1920%') AND NOT (page_id % 4 = 2 AND viewport LIKE '390%')"
MEASURE = "CASE WHEN page_id % 3 = 0 THEN 'A11Y-001' WHEN page_id % 3 = 1 THEN 'PERF-001' WHEN page_id % 5 = 2 THEN 'PERF-002' END"
NEEDED = ["1920 · Desktop", "390 · Phone"]


def _unverified(s, d):
    pages = _fonts(s, d).select("site", "page", "page_id").distinct()
    sweeps = pages.withColumn("viewport", F.explode(F.array(*map(F.lit, NEEDED)))).withColumn("swept", F.expr(SWEPT))
    return N.unverified_rules(pages, sweeps, pages.withColumn("rule_id", F.expr(MEASURE)).filter("rule_id IS NOT NULL"), NEEDED)


def _el_sql() -> str:
    ref = ", ".join(f"{v} AS {k}" for k, v in X.ELEMENT_COLUMNS.items())
    cand = ", ".join(f"{v} AS {k}" for k, v in X.CAND_COLUMNS.items())
    views = ", ".join(f"('{n}', {o}, {w}, {str(t).upper()})" for n, o, w, t in X.VIEWPORTS)
    return f"""WITH m AS MATERIALIZED ({X.marks_sql()}), vw AS (SELECT * FROM (VALUES {views}) t(viewport, vord, width, touch)),
e0 AS (SELECT site, page, 'ref' AS side, pos, tag, {ref} FROM m WHERE page_id % 20 <> 0 UNION ALL SELECT site, page, 'cand', pos, tag, {cand} FROM m WHERE pos % 7 <> 0 AND page_id % 20 <> 0),
e AS (SELECT e0.*, viewport, vord, lower(text)[1:40] AS ident, row_number() OVER (PARTITION BY site, page, viewport, side, sec, tag, lower(text)[1:40] ORDER BY pos) AS n FROM e0 CROSS JOIN vw),
mt AS MATERIALIZED (SELECT coalesce(a.site, b.site) AS site, coalesce(a.page, b.page) AS page, coalesce(a.viewport, b.viewport) AS viewport, coalesce(a.vord, b.vord) AS vord,
 a.pos AS rp, b.pos AS cp, coalesce(a.tag, b.tag) AS tag, coalesce(a.ident, b.ident) AS ident, coalesce(a.sec, b.sec) AS sec, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.font AS af, b.font AS bf, a.size AS asz, b.size AS bsz, a.color AS ac, b.color AS bc, a.bg_img AS ab, b.bg_img AS bb
 FROM (SELECT * FROM e WHERE side = 'ref') a FULL JOIN (SELECT * FROM e WHERE side = 'cand') b ON a.site = b.site AND a.page = b.page AND a.viewport = b.viewport AND a.sec = b.sec AND a.tag = b.tag AND a.ident = b.ident AND a.n = b.n),
lost AS (SELECT *, row_number() OVER (PARTITION BY site, page, viewport, tag, ident ORDER BY rp) AS k FROM mt WHERE cp IS NULL AND ident <> ''),
extra AS (SELECT *, row_number() OVER (PARTITION BY site, page, viewport, tag, ident ORDER BY cp) AS k FROM mt WHERE rp IS NULL AND ident <> ''),
rl AS (SELECT l.site, l.page, l.viewport, l.rp, x.cp FROM lost l JOIN extra x ON l.site = x.site AND l.page = x.page AND l.viewport = x.viewport AND l.tag = x.tag AND l.ident = x.ident AND l.k = x.k),
dl AS (SELECT mt.site, mt.page, mt.viewport, mt.vord, mt.sec, mt.tag, mt.ident, mt.rp AS pos, CASE WHEN rl.rp IS NULL THEN 'missing' ELSE 'moved' END AS kind, FALSE AS is_bg, '' AS detail FROM mt LEFT JOIN rl ON rl.site = mt.site AND rl.page = mt.page AND rl.viewport = mt.viewport AND rl.rp = mt.rp WHERE mt.cp IS NULL
 UNION ALL SELECT mt.site, mt.page, mt.viewport, mt.vord, mt.sec, mt.tag, mt.ident, mt.cp, 'extra', FALSE, '' FROM mt LEFT JOIN rl ON rl.site = mt.site AND rl.page = mt.page AND rl.viewport = mt.viewport AND rl.cp = mt.cp WHERE mt.rp IS NULL AND rl.cp IS NULL
 UNION ALL SELECT site, page, viewport, vord, sec, tag, ident, rp, 'moved', FALSE, '' FROM mt WHERE abs(ax - bx) > 60 OR abs(ay - by_) > 60
 UNION ALL SELECT site, page, viewport, vord, sec, tag, ident, rp, 'restyled', ab <> bb, concat_ws('; ', CASE WHEN lower(af) <> lower(bf) THEN concat('font ', af, '→', bf) END, CASE WHEN abs(asz - bsz) > 2 THEN concat('size ', asz, '→', bsz, 'px') END,
   CASE WHEN ac <> bc THEN concat('color ', ac, '→', bc) END, CASE WHEN ab <> bb THEN CASE WHEN bb = '' THEN concat('background removed (', ab, ')') WHEN ab = '' THEN concat('background added (', bb, ')') ELSE concat('background ', ab, '→', bb) END END)
  FROM mt WHERE rp IS NOT NULL AND cp IS NOT NULL AND (lower(af) <> lower(bf) OR abs(asz - bsz) > 2 OR ac <> bc OR ab <> bb)),
st AS (SELECT site, page, viewport, vord, count(rp) AS ref_count, count(cp) AS cand_count, count(*) FILTER (rp IS NOT NULL AND cp IS NOT NULL) AS matched FROM mt GROUP BY ALL),
ss AS (SELECT *, round(CASE WHEN ref_count > 0 THEN matched::DOUBLE / ref_count WHEN cand_count > 0 THEN 0 ELSE 1 END * 100, 1) AS struct_score FROM st),
px AS (SELECT {X.SITE_SQL} AS site, {X.PATH_SQL} AS page, '{X.VIEWPORTS[0][0]}' AS viewport, round(list_sum(list_transform(generate_series(0, 255), lambda i: CASE WHEN (page_id + i // 16 + i % 16) % 9 = 0 THEN 1 ELSE 0 END))::DOUBLE / 256 * 100, 2) AS pixel_pct FROM pages),
vs AS (SELECT ss.*, pixel_pct, CASE WHEN pixel_pct IS NULL THEN struct_score ELSE round((struct_score + greatest(round(100 - pixel_pct, 1), 0)) / 2, 1) END AS match_score FROM ss LEFT JOIN px USING (site, page, viewport)),
lp AS (SELECT {X.SITE_SQL} AS site, {X.PATH_SQL} AS page FROM pages WHERE page_id % 20 = 0),
dr AS (SELECT {X.SITE_SQL} AS site, {X.PATH_SQL} AS page, 'Lora' AS family, page_id FROM pages WHERE page_id % 3 = 0),
gr AS (SELECT DISTINCT site, page, CASE kind WHEN 'missing' THEN 'missing-element' WHEN 'restyled' THEN CASE WHEN is_bg THEN 'background' ELSE 'restyle' END ELSE kind END AS kind, concat_ws('|', sec, tag, ident) AS ekey, 1.0::DOUBLE AS weight FROM dl WHERE vord = 0
 UNION ALL SELECT lp.site, page, 'missing-page', page, coalesce(m, 1) FROM lp LEFT JOIN (SELECT site, floor(median(ref_count) + 0.5)::DOUBLE AS m FROM st WHERE vord = 0 GROUP BY site) q ON q.site = lp.site
 UNION ALL SELECT site, page, 'font-drift', 'lora', 1.0 FROM dr WHERE page_id % 20 <> 0),
gt AS (SELECT *, CASE WHEN kind IN ('missing-element', 'missing-page') THEN 'MISSING' WHEN kind IN ('background', 'restyle', 'font-drift') THEN 'DEFECT' WHEN kind = 'moved' THEN 'SPACING' ELSE 'IMPROVEMENT' END AS tier FROM gr)"""


def _relocated_sql() -> str:
    """The taking of free extras as it is told, one missing element after the other."""
    heads = {"ref": "0", "cand": "CASE WHEN pos % 13 = 1 THEN 1 ELSE 0 END"}
    sides = {"ref": (X.ELEMENT_COLUMNS, "TRUE"), "cand": (X.CAND_COLUMNS, "pos % 7 <> 0")}
    e = " UNION ALL ".join(
        f"SELECT site, page, '{name}' AS side, pos, tag, {cols['sec']} AS sec, {cols['text']} AS text, CASE WHEN tag = 'li' THEN concat('h', (pos + {heads[name]}) % 4) ELSE '' END AS head,"
        f" CASE WHEN tag = 'li' THEN 'item' ELSE '' END AS aria FROM m WHERE page_id % 20 <> 0 AND {where}"
        for name, (cols, where) in sides.items()
    )
    views = ", ".join(f"('{n}')" for n, _, _, _ in X.VIEWPORTS)
    first = lambda *names: f"lower(coalesce({', '.join(f'nullif({n}, {chr(39) * 2})' for n in names)}, ''))[1:40]"
    return f"""WITH RECURSIVE m AS MATERIALIZED ({X.marks_sql()}), e AS ({e}),
n AS MATERIALIZED (SELECT *, {first('text', 'aria')} AS ident, row_number() OVER (PARTITION BY site, page, side, sec, tag, {first('text', 'head')} ORDER BY pos) AS k, {first('text', 'head')} AS bkt FROM e),
alone AS MATERIALIZED (SELECT * FROM n a WHERE ident <> '' AND NOT EXISTS (SELECT 1 FROM n b WHERE b.side <> a.side AND b.site = a.site AND b.page = a.page AND b.sec = a.sec AND b.tag = a.tag AND b.bkt = a.bkt AND b.k = a.k)),
lost AS MATERIALIZED (SELECT site, page, tag, ident, pos, sec, row_number() OVER (PARTITION BY site, page, tag, ident ORDER BY pos) AS turn FROM alone WHERE side = 'ref'),
walk AS (SELECT site, page, tag, ident, 0::BIGINT AS turn, list({{'pos': pos, 'sec': sec}} ORDER BY pos) AS free, NULL::BIGINT AS ref_pos, NULL::BIGINT AS cand_pos, NULL::VARCHAR AS to_sec FROM alone WHERE side = 'cand' GROUP BY ALL
 UNION ALL SELECT site, page, tag, ident, turn, CASE WHEN hit IS NULL THEN free ELSE list_filter(free, lambda x: x.pos <> hit.pos) END, pos, hit.pos, hit.sec FROM (
  SELECT w.site, w.page, w.tag, w.ident, l.turn, w.free, l.pos, list_filter(w.free, lambda x: x.sec <> l.sec)[1] AS hit FROM walk w JOIN lost l ON l.site = w.site AND l.page = w.page AND l.tag = w.tag AND l.ident = w.ident AND l.turn = w.turn + 1))
SELECT site, page, viewport, tag, ident, ref_pos, cand_pos, to_sec FROM walk CROSS JOIN (VALUES {views}) v(viewport) WHERE cand_pos IS NOT NULL"""


def _fidelity(profile: str, ignore: str) -> str:
    p = V.PROFILES[profile]
    pen = "CASE tier " + " ".join(f"WHEN '{t}' THEN {round(v * 100)}::BIGINT" for t, v in p.items()) + " END"
    tiers = ", ".join(f"count(*) FILTER (tier = '{t}') AS n_{t.lower()}" for t in V.TIERS)
    return f""", nm AS (SELECT site, sum(CASE WHEN {ignore} THEN 0 ELSE {pen} * CAST(weight AS BIGINT) END)::BIGINT AS numerator, count(*) AS findings, count(*) FILTER ({ignore}) AS ignored, {tiers} FROM gt GROUP BY site),
dn AS (SELECT coalesce(a.site, b.site) AS site, CAST(coalesce(budget, 0) + coalesce(lost, 0) * CASE WHEN coalesce(md, 0) > 0 THEN md ELSE 1 END AS BIGINT) AS total FROM (SELECT site, sum(ref_count) AS budget, floor(median(ref_count) FILTER (ref_count > 0) + 0.5) AS md FROM st WHERE vord = 0 GROUP BY site) a
 FULL JOIN (SELECT site, count(*) AS lost FROM lp GROUP BY site) b ON a.site = b.site)
SELECT dn.site, CASE WHEN total > 0 THEN CAST(least(100, greatest(0, (2 * (100 * total - coalesce(numerator, 0)) + total) // (2 * total))) AS INTEGER) END AS score, coalesce(numerator, 0) / 100.0::DOUBLE AS numerator, total AS denominator,
 coalesce(findings, 0) AS findings, coalesce(ignored, 0) AS ignored, {', '.join(f'coalesce(n_{t.lower()}, 0) AS n_{t.lower()}' for t in V.TIERS)} FROM dn LEFT JOIN nm ON nm.site = dn.site"""


def oracles():
    e = _el_sql()
    box = ", ".join(f"{v} AS {k}" for k, v in X.BOX_COLUMNS.items())
    views = ", ".join(f"('{n}', {o}, {w}, {str(t).upper()})" for n, o, w, t in X.VIEWPORTS)
    b = f"""WITH m AS MATERIALIZED ({X.marks_sql()}), vw AS (SELECT * FROM (VALUES {views}) t(viewport, vord, width, touch)), bx AS (SELECT site, page, pos, {box}, viewport, width, touch FROM m CROSS JOIN vw),
dc AS (SELECT site, page, viewport, width, max(x + w) AS doc_width FROM bx GROUP BY ALL)"""
    top = lambda cond, order: f"(SELECT *, row_number() OVER (PARTITION BY site, page, viewport ORDER BY {order}) AS rn FROM bx WHERE {cond})"
    facts = X.FACT_SQL
    pg = f"(SELECT {X.SITE_SQL} AS site, {X.PATH_SQL} AS page, page_id FROM pages)"
    ch = lambda v: f"(CASE WHEN {v} / 255.0::DOUBLE <= 0.03928 THEN {v} / 255.0::DOUBLE / 12.92 ELSE pow(({v} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"
    lum = lambda k: f"({ch(f'((pos * {k}) % 256)')} * (0.2126::DOUBLE + 0.7152::DOUBLE + 0.0722::DOUBLE) + 0.05)"
    ratio = f"(greatest({lum(29)}, {lum(97)}) / least({lum(29)}, {lum(97)}))"
    large = "(font_size >= 24 OR (font_size >= 18.66 AND weight >= 700))"
    fam = "concat('Face', page_id % 5)"
    used = lambda k: f"(SELECT site, page, page_id, unnest(['Inter', CASE WHEN page_id % 3 = {k} THEN 'Lora' ELSE 'Arial' END, {fam}]) AS family FROM {pg})"
    ft = f"""WITH p AS (SELECT *, {fam} AS family, {FONT_STATUS} AS st, page_id % 3 AS w, page_id % 3 = 0 AS bold_wanted, page_id % 2 = 1 AS italic_wanted FROM {pg})
SELECT site, page, family, 'FONT-001' AS rule_id, NULL AS severity_override FROM p WHERE st = 'error'
UNION ALL SELECT site, page, family, 'FONT-002', NULL FROM p WHERE st = 'unloaded' UNION ALL SELECT site, page, 'Inter', 'FONT-002', NULL FROM p UNION ALL SELECT site, page, 'Lora', 'FONT-002', NULL FROM p WHERE page_id % 3 = 0
UNION ALL SELECT site, page, family, 'FONT-003', NULL FROM p WHERE st = 'loaded' AND bold_wanted AND w = 0
UNION ALL SELECT site, page, family, 'FONT-004', NULL FROM p WHERE st = 'loaded' AND page_id % 2 = 1
UNION ALL SELECT site, page, family, 'FONT-006', NULL FROM p WHERE st = 'loaded' AND italic_wanted AND page_id % 7 <> 0
UNION ALL SELECT site, page, 'Spare', 'FONT-005', NULL FROM p WHERE page_id % 6 = 1 AND page_id % 12 <> 1"""
    band = "CASE WHEN overall >= 95 THEN 'matches' WHEN overall >= 90 THEN 'very-close' WHEN overall >= 75 THEN 'visible-differences' ELSE 'rebuild' END"
    ps = "ps AS (SELECT site, page, floor(sum(CAST(round(match_score * 10) AS BIGINT))::DOUBLE / count(*) + 0.5) / 10 AS page_score FROM vs GROUP BY ALL)"
    return {
        "element_match": f"{e} SELECT site, page, viewport, rp AS ref_pos, cp AS cand_pos FROM mt",
        "relocated_elements": _relocated_sql(),
        "element_deltas": f"{e} SELECT site, page, viewport, kind, is_bg, count(*) AS n FROM dl GROUP BY ALL",
        "restyle_details": f"{e} SELECT site, page, viewport, pos, detail FROM dl WHERE kind = 'restyled'",
        "structure_score": f"{e} SELECT site, page, viewport, ref_count, cand_count, matched, struct_score FROM ss",
        "pixel_mismatch": f"{e} SELECT site, page, viewport, pixel_pct FROM px",
        "viewport_scores": f"{e} SELECT site, page, viewport, match_score FROM vs",
        "redesign_scores": f"{e} SELECT site, page, viewport, struct_score AS match_score FROM ss",
        "page_match": f"{e}, {ps} SELECT * FROM ps",
        "overall_match": f"{e}, {ps}, o AS (SELECT site, floor(sum(CAST(round(page_score * 10) AS BIGINT))::DOUBLE / count(*) + 0.5) / 10 AS overall, count(*) AS pairs FROM ps GROUP BY site) SELECT *, {band} AS band FROM o",
        "visual_fold": f"""{e}, h AS (SELECT site, 'VIS-001' AS rule_id FROM vs WHERE match_score < 90 OR coalesce(pixel_pct > 8, FALSE) UNION ALL SELECT site, 'VIS-002' FROM lp UNION ALL SELECT site, 'VIS-003' FROM dr)
SELECT s.site, s.rule_id, count(h.site) AS items, CASE WHEN count(h.site) > 0 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT DISTINCT vs.site, r.rule_id FROM vs CROSS JOIN (VALUES ('VIS-001'), ('VIS-002'), ('VIS-003')) r(rule_id)) s LEFT JOIN h ON h.site = s.site AND h.rule_id = s.rule_id GROUP BY s.site, s.rule_id""",
        "graded_findings": f"{e} SELECT site, page, kind, tier, weight FROM gt",
        "finding_ids": f"""WITH m AS ({X.marks_sql()}), t AS (SELECT page, pos, concat_ws('::', page, tag, substr(txt, 1, 20)) AS s FROM m),
h AS (SELECT page, pos, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: (a * 33 + b) % 4294967296) AS h FROM t)
SELECT page, pos, ltrim(array_to_string(list_transform([6, 5, 4, 3, 2, 1, 0], lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(pow(36, i) AS BIGINT)) % 36 AS INTEGER) + 1, 1)), ''), '0') AS id FROM h""",
        "fidelity_grade": f"{e}{_fidelity('balanced', 'FALSE')}",
        "fidelity_strict": f"{e}{_fidelity('strict', 'FALSE')}",
        "fidelity_ignored": f"{e}{_fidelity('lenient', "kind = 'moved'")}",
        "rerate_ledger": f'''WITH r AS (SELECT site AS run, printf('%012d', event_id) AS t, CAST(floor(value) AS BIGINT) AS score FROM ({facts}))
SELECT run, row_number() OVER w AS n, t AS "at", 'balanced' AS profile, lag(score) OVER w AS before, score AS after FROM r WINDOW w AS (PARTITION BY run ORDER BY t)''',
        "explain_empty": f"""WITH k AS (SELECT {X.SITE_SQL} AS run, min(page_id) % 7 AS k FROM pages GROUP BY 1)
SELECT run, CASE WHEN k IN (1, 2, 3, 6) THEN 'reference-unreachable' WHEN k = 4 THEN 'candidate-unreachable' ELSE 'no-common-pages' END AS reason, CASE k WHEN 1 THEN 'blocked' WHEN 2 THEN 'dns' WHEN 3 THEN 'timeout' WHEN 4 THEN 'refused' WHEN 6 THEN 'no-pages' END AS cause FROM k WHERE k <> 0""",
        "horizontal_overflow": f"""{b} SELECT site, page, viewport, 'RESP-002' AS rule_id, '' AS selector, concat(doc_width, 'px') AS value FROM dc WHERE doc_width > width + 2
UNION ALL SELECT t.site, t.page, t.viewport, 'RESP-003', selector, concat('+', x + w - t.width, 'px') FROM {top('x + w > width + 1 AND w <= width * 1.5 AND w > 4', 'x + w DESC, pos')} t JOIN dc ON dc.site = t.site AND dc.page = t.page AND dc.viewport = t.viewport AND doc_width > dc.width + 2""",
        "too_wide": f"{b} SELECT site, page, viewport, 'RESP-004' AS rule_id, selector, concat(w, 'px') AS value FROM {top('w > width + 1', 'pos')}",
        "touch_targets": f"""{b} SELECT site, page, viewport, 'RESP-005' AS rule_id, selector, concat(w, 'x', h) AS value FROM {top('touch AND interactive AND (w < 44 OR h < 44)', 'pos')}
UNION ALL SELECT site, page, viewport, 'RESP-006', selector, concat(font_size, 'px') FROM {top('touch AND is_field AND font_size < 16', 'pos')}""",
        "contrast": f"{b} SELECT site, page, pos, round({ratio}, 4) AS ratio FROM bx",
        "low_contrast": f"""{b}, t AS (SELECT site, page, selector, min(pos) AS pos FROM bx WHERE {ratio} < CASE WHEN {large} THEN 3.0 ELSE 4.5 END GROUP BY ALL)
SELECT site, page, selector FROM (SELECT *, row_number() OVER (PARTITION BY site, page ORDER BY pos) AS rn FROM t)""",
        "wcag_violations": f"""SELECT site, page, event_type AS violation, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY site, page ORDER BY event_id) AS rn FROM ({facts})) GROUP BY ALL""",
        "console_network": f"SELECT site, page, 'CON-001' AS rule_id, count(*) AS n FROM ({facts}) WHERE event_type = 'error' GROUP BY ALL UNION ALL SELECT site, page, 'CON-002', count(DISTINCT floor(value)) FROM ({facts}) WHERE event_type = 'click' GROUP BY site, page",
        "page_weight": f"SELECT site, page, count(*) AS requests, CAST(sum(CAST(floor(value * 10000) AS BIGINT)) AS BIGINT) AS bytes FROM ({facts}) GROUP BY ALL HAVING count(*) > 120 OR sum(floor(value * 10000)) > 4194304",
        "web_vitals": f"""WITH v AS (SELECT site, page, max(value * 200) FILTER (event_type = 'view') AS lcp, sum(value / 100) FILTER (event_type = 'click' AND event_id % 3 <> 0) AS s, bool_or(event_type = 'click') AS seen FROM ({facts}) WHERE event_type IN ('view', 'click') GROUP BY ALL),
c AS (SELECT *, CASE WHEN seen THEN coalesce(s, 0) END AS c FROM v)
SELECT site, page, lcp, round(c, 3) AS cls, CASE WHEN lcp IS NULL THEN 'unmeasured' WHEN lcp > 4000 THEN 'poor' WHEN lcp > 2500 THEN 'needs-improvement' ELSE 'good' END AS lcp_grade, CASE WHEN c IS NULL THEN 'unmeasured' WHEN round(c, 6) > 0.25 THEN 'poor' WHEN round(c, 6) > 0.1 THEN 'needs-improvement' ELSE 'good' END AS cls_grade FROM c""",
        "font_findings": ft,
        "font_samples": f"SELECT site, page, {fam} AS family, CASE WHEN page_id % 2 = 1 THEN 'italic' ELSE 'normal' END AS style FROM {pg}",
        "icon_findings": f"""WITH m AS ({X.marks_sql()}), i AS (SELECT * FROM m WHERE tag = 'li' AND pos % 3 <> 0)
SELECT site, page, 'ICON-001' AS rule_id, count(*) AS n FROM i GROUP BY site, page, pos % 2 UNION ALL SELECT site, page, 'ICON-002', count(*) FROM i WHERE pos % 4 = 1 GROUP BY site, page UNION ALL SELECT site, page, 'ICON-003', count(*) FROM i WHERE pos % 5 = 2 GROUP BY site, page""",
        "font_drift": f"SELECT site, page, 'Lora' AS family FROM {pg} WHERE page_id % 3 = 0",
        "fonts_kept": f"SELECT DISTINCT site, page, family FROM {used(0)} a WHERE family <> 'Arial' AND (family <> 'Lora' OR page_id % 3 = 1)",
        "engine_rows": f"""SELECT site, page, engine, CASE WHEN NOT av OR page_id % 10 = 3 THEN 'manual' WHEN page_id % 10 IN (4, 5) THEN 'fail' WHEN page_id % 3 > 0 THEN 'warn' ELSE 'pass' END AS status,
 CASE WHEN NOT av OR page_id % 10 = 3 THEN NULL WHEN page_id % 10 IN (4, 5) THEN CASE engine WHEN 'webkit' THEN 'XBR-002' ELSE 'XBR-001' END WHEN page_id % 3 > 0 THEN 'XBR-003' END AS rule_id,
 CASE WHEN NOT av THEN 'engine-missing' WHEN page_id % 10 = 3 THEN 'engine-abandoned' END AS reason, CASE WHEN av AND page_id % 10 IN (4, 5) THEN page_id % 10 = 5 END AS shared_with_primary
FROM (SELECT *, page_id % 10 <> 0 OR engine = 'firefox' AS av FROM (SELECT *, unnest(['firefox', 'webkit']) AS engine FROM {pg}))""",
        "blocking_overlays": f"SELECT site, page, 'CON-003' AS rule_id, concat(CASE WHEN page_id % 2 = 0 THEN 'blocks interaction across ' ELSE 'paints over ' END, page_id % 100, '% of the viewport') AS detail FROM {pg} WHERE page_id % 5 = 0",
        "consent_rows": f"SELECT site, count(*) AS clicks, count(DISTINCT page) AS pages FROM {pg} GROUP BY site",
        "unverified_rules": f"""WITH p AS (SELECT DISTINCT site, page, page_id FROM {pg}), s AS (SELECT site, viewport, bool_and({SWEPT}) AS whole FROM p, (SELECT unnest({NEEDED}) AS viewport) GROUP BY site, viewport)
SELECT DISTINCT p.site, r.rule_id, 'no page gave a measurement' AS reason FROM p, (SELECT unnest(['A11Y-001', 'PERF-001', 'PERF-002']) AS rule_id) r WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.site = p.site AND {MEASURE.replace("page_id", "q.page_id")} = r.rule_id)
UNION ALL SELECT site, unnest(['RESP-002', 'RESP-003', 'RESP-004', 'RESP-005', 'RESP-006']), 'no viewport was swept on every page' FROM s GROUP BY site HAVING NOT bool_or(whole)""",
        "swept_viewports": f"SELECT DISTINCT site, '1920 · Desktop' AS viewport FROM {pg} UNION ALL SELECT site, '390 · Phone' FROM {pg} GROUP BY site HAVING count(*) FILTER (page_id % 50 = 3) = 0",
    }
