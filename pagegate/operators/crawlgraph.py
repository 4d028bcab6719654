"""Links, sitemaps, redirects and sampling over stored crawls.

Tables: `crawl`, `sitemap_doc(site, scan_id, url, body)`, `sitemap_urls(site, scan_id, url)`,
`url_status(site, scan_id, url, code)`, `redirect(site, scan_id, url, code, location)`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegate.functions import html as H
from pagegate.functions.text import WS, js_trim
from pagegate.functions.urls import (
    ASSET_URL,
    abs_url,
    drop_fragment,
    family_depth,
    host_of,
    origin_of,
    page_family,
    path_of,
)
from pagegate.operators.page_ctx import KEYS, html_pages
from pagegate.session import cut_lineage

C, Q = F.col, H.Q


# ---- links and sitemaps --------------------------------------------------------------------


def page_links(crawl: DataFrame) -> DataFrame:
    """Same-host page links of every auditable page, each once per page."""
    raw = html_pages(crawl).select(
        *KEYS,
        "url",
        F.explode(
            F.array_distinct(H.find_all(C("body"), rf"(?i)<a\b[^>]*{WS}href{WS}*={WS}*{Q}([^\"'#?]+)[^\"']*{Q}", 1))
        ).alias("href"),
    )
    resolved = raw.select(*KEYS, "url", drop_fragment(abs_url(C("href"), C("url"))).alias("target"))
    kept = resolved.filter((host_of(C("target")) == C("site")) & ~C("target").rlike(ASSET_URL))
    return kept.dropDuplicates([*KEYS, "url", "target"])


def link_targets(crawl: DataFrame) -> DataFrame:
    """Distinct link targets of a site, told apart as internal or external."""
    hrefs = html_pages(crawl).select(
        *KEYS,
        "url",
        F.explode(
            F.array_distinct(H.find_all(C("body"), rf"(?i)<a\b[^>]*{WS}href{WS}*={WS}*{Q}([^\"']+){Q}", 1))
        ).alias("href"),
    ).filter(~js_trim(C("href")).rlike("(?i)^(mailto:|tel:|javascript:|#|data:)"))
    resolved = hrefs.select(
        *KEYS, abs_url(F.regexp_replace("href", "(?s)#.*$", ""), C("url")).alias("target")
    ).filter(C("target").isNotNull() & ~C("target").rlike(ASSET_URL))
    kind = F.when(host_of(C("target")) == C("site"), "internal").when(C("target").rlike("(?i)^https?:"), "external")
    return resolved.select(*KEYS, "target", kind.alias("kind")).filter("kind IS NOT NULL").distinct()


def image_sources(crawl: DataFrame) -> DataFrame:
    """Distinct image sources of a site with the first page (in crawl order) that shows each."""
    tags = html_pages(crawl).select(*KEYS, "url", "ord", F.explode(H.find_all(C("body"), r"(?i)<img\b[^>]*>")).alias("tag"))
    quoted = lambda name: H.first_match(C("tag"), rf"(?i){WS}{name}{WS}*={WS}*{Q}([^\"']+){Q}", 1)
    src = F.coalesce(quoted("src"), quoted("data-src"))
    found = tags.select(*KEYS, "url", "ord", src.alias("src")).filter(
        C("src").isNotNull() & ~C("src").rlike("(?i)^data:")
    ).select(*KEYS, "url", "ord", abs_url(C("src"), C("url")).alias("src"))
    return found.groupBy(*KEYS, "src").agg(F.min_by("url", F.struct("ord", "url")).alias("first_page"))


def sitemap_locations(sitemap_doc: DataFrame) -> DataFrame:
    """Locations of each sitemap document and whether the document is an index."""
    return sitemap_doc.select(
        *KEYS,
        C("url").alias("sitemap"),
        H.matches(C("body"), f"(?i)<sitemapindex[{WS[1:-1]}>]").alias("is_index"),
        F.explode(H.find_all(C("body"), f"(?i)<loc>{WS}*([^<{WS[1:-1]}]+){WS}*</loc>", 1)).alias("loc"),
    )


def sitemap_pages(sitemap_doc: DataFrame, roots: DataFrame) -> DataFrame:
    """Page urls of the root sitemaps and of the children one index level below, same host, once each.
    `roots(site, scan_id, sitemap)` names the sitemaps a site declares."""
    locs = sitemap_locations(sitemap_doc)
    top = locs.join(roots, [*KEYS, "sitemap"], "left_semi")
    children = top.filter("is_index").select(*KEYS, C("loc").alias("sitemap")).distinct()
    below = locs.join(children, [*KEYS, "sitemap"], "left_semi").filter("NOT is_index")
    pages = top.filter("NOT is_index").unionByName(below)
    return pages.filter(host_of(C("loc")) == C("site")).select(*KEYS, C("loc").alias("url")).distinct()


def known_urls(crawl: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Home, sitemap and linked urls of a site as one set."""
    home = crawl.groupBy(*KEYS).agg(F.min_by("url", "ord").alias("url")).select(
        *KEYS, F.concat(origin_of(C("url")), F.lit("/")).alias("url")
    )
    linked = page_links(crawl).select(*KEYS, C("target").alias("url"))
    return home.unionByName(sitemap_urls.select(*KEYS, "url")).unionByName(linked).distinct()


def sitemap_coverage(crawl: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Dead sitemap urls, and auditable pages no sitemap lists (the origin root is exempt)."""
    pages = crawl.select(*KEYS, "url", "status")
    dead = sitemap_urls.join(pages.filter("status >= 400"), [*KEYS, "url"]).select(
        *KEYS, "url", F.lit("SEO-023").alias("rule_id"), F.lit("dead").alias("value")
    )
    listed = sitemap_urls.select(*KEYS, drop_fragment(C("url")).alias("bare")).distinct()
    declared = sitemap_urls.select(*KEYS).distinct()
    orphans = (
        html_pages(crawl)
        .select(*KEYS, "url", drop_fragment(C("url")).alias("bare"))
        .filter(C("bare") != F.concat(origin_of(C("url")), F.lit("/")))
        .join(declared, list(KEYS), "left_semi")
        .join(listed, [*KEYS, "bare"], "left_anti")
        .select(*KEYS, "url", F.lit("SEO-024").alias("rule_id"), F.lit("orphan").alias("value"))
    )
    return dead.unionByName(orphans)


def link_audit(targets: DataFrame, url_status: DataFrame) -> DataFrame:
    """Broken links. An internal target must answer 2xx or 3xx; an external one only may not answer
    4xx or 5xx, because many hosts refuse a probe."""
    j = targets.join(url_status.select(*KEYS, C("url").alias("target"), "code"), [*KEYS, "target"], "left")
    internal = (C("kind") == "internal") & ~F.coalesce(C("code").between(200, 399), F.lit(False))
    external = (C("kind") == "external") & F.coalesce(C("code") >= 400, F.lit(False))
    return j.filter(internal | external).select(
        *KEYS, C("target").alias("url"), F.when(internal, "LINK-001").otherwise("LINK-002").alias("rule_id"),
        C("code").cast("string").alias("value"),
    )


def broken_images(images: DataFrame, url_status: DataFrame, strict: bool = False) -> DataFrame:
    """Images that do not load. The gate reports them without severity unless `strict`."""
    j = images.join(url_status.select(*KEYS, C("url").alias("src"), "code"), [*KEYS, "src"], "left")
    return j.filter(~F.coalesce(C("code").between(200, 399), F.lit(False))).select(
        *KEYS, "src", C("first_page").alias("url"), C("code").cast("string").alias("value"),
        F.lit("high" if strict else None).cast("string").alias("severity"),
    )


def redirect_preservation(old_urls: DataFrame, url_status: DataFrame, strict: bool = False) -> DataFrame:
    """Old urls with whether they still lead somewhere: a redirect, a page, or an honest 410."""
    j = old_urls.join(url_status.select(*KEYS, "url", "code"), [*KEYS, "url"], "left")
    good = F.coalesce(C("code").between(300, 399) | C("code").isin(200, 410), F.lit(False))
    return j.select(
        *KEYS, "url", "code", good.alias("good"),
        F.when(~good, F.lit("high" if strict else None)).cast("string").alias("severity"),
    )


def redirect_chains(starts: DataFrame, redirect: DataFrame) -> DataFrame:
    """Follows each start url through the redirect table; chains have a loop or more than one hop.

    Only rows that still move are joined again; finished ones are set aside, until none is left. A
    chain ends where no redirect leads on or where it meets a page of its own path.
    """
    step = redirect.filter(C("code").between(300, 399) & (C("location") != "")).select(
        *KEYS, C("url").alias("key"), abs_url(C("location"), C("url")).alias("nxt")
    ).filter(C("nxt").isNotNull())
    at = starts.select(
        *KEYS, "url", C("url").alias("cur"), F.lit(0).alias("hops"), F.array("url").alias("path"),
        F.lit(False).alias("loop"), F.lit(False).alias("done"),
    )
    step, ended = cut_lineage(step), []
    while True:
        j = at.withColumn("key", C("cur")).join(step, [*KEYS, "key"], "left")
        moved = C("nxt").isNotNull()
        again = moved & F.array_contains("path", C("nxt"))
        moves = cut_lineage(j.select(
            *KEYS, "url",
            F.coalesce("nxt", "cur").alias("cur"),
            (C("hops") + moved.cast("int")).alias("hops"),
            F.when(moved, F.concat("path", F.array("nxt"))).otherwise(C("path")).alias("path"),
            (C("loop") | again).alias("loop"),
            (~moved | again).alias("done"),
        ))
        ended.append(moves.filter("done"))
        at = moves.filter("not done")
        if at.isEmpty():
            break
    return reduce(DataFrame.unionByName, ended).filter("loop OR hops > 1").select(*KEYS, "url", "hops", "loop", C("cur").alias("final"))


def reachable(edges: DataFrame, homes: DataFrame, node: str = "url") -> DataFrame:
    """Pages reached from the home page by following stored links, with their distance.

    `node` names what a page is known by, its url or an id where several pages have one url; `edges` hold it as src and dst.
    Breadth-first: each round joins only the newest pages. Rounds are written to the checkpoint
    folder, so lost executors cost one round and the plan does not grow.
    """
    edges = cut_lineage(edges.select(*KEYS, C("src"), C("dst")).distinct())
    frontier = cut_lineage(homes.select(*KEYS, node, F.lit(0).alias("depth")).distinct())
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.select(*KEYS, C(node).alias("src")).join(edges, [*KEYS, "src"])
        new = step.select(*KEYS, C("dst").alias(node)).distinct().join(seen, [*KEYS, node], "left_anti")
        frontier = cut_lineage(new.select(*KEYS, node, F.lit(depth).alias("depth")))
        seen = seen.unionByName(frontier)
    return seen


# ---- sampling ------------------------------------------------------------------------------


def stratified_sample(urls: DataFrame, cap: int, homes: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The first `cap` pages per site when template families take turns, home first.

    Families go least sampled first (`seen(site, scan_id, family, n)`), then shallowest, then by
    name. The cap is the sample size asked for. Both ranks filter on `<= cap`, which Spark applies
    before the shuffle, so a family of any size sends at most `cap` rows per task.
    """
    others = urls.join(homes, [*KEYS, "url"], "left_anti").select(*KEYS, "url", page_family(C("url")).alias("family")).distinct()
    in_family = Window.partitionBy(*KEYS, "family").orderBy("url")
    turns = others.withColumn("turn", F.row_number().over(in_family)).filter(C("turn") <= cap)
    if seen is not None:
        turns = turns.join(seen, [*KEYS, "family"], "left").fillna(0, ["n"])
    else:
        turns = turns.withColumn("n", F.lit(0))
    order = Window.partitionBy(*KEYS).orderBy("turn", "n", family_depth(C("family")), "family")
    picked = turns.withColumn("position", F.row_number().over(order) + 1).filter(C("position") <= cap)
    first = homes.select(*KEYS, "url", F.lit("@0").alias("family"), F.lit(1).alias("position")).filter(F.lit(cap) >= 1)
    return first.unionByName(picked.select(*KEYS, "url", "family", "position"))


def page_cap(urls: DataFrame, cap: int, order: Column) -> DataFrame:
    """First `cap` urls of each site; `cap` is the page budget of a run."""
    w = Window.partitionBy(*KEYS).orderBy(order)
    return urls.withColumn("position", F.row_number().over(w)).filter(C("position") <= cap)


def pair_by_path(ref: DataFrame, cand: DataFrame, url_map: DataFrame | None = None) -> DataFrame:
    """Pages of two sites paired by path; `url_map(path, mapped)` overrides. Unmatched keep nulls.

    Both sides carry `pair` (which two sites belong together), `url` and are reduced to one row per
    path before the join.
    """
    a = ref.select("pair", C("url").alias("ref_url"), path_of(C("url")).alias("path"))
    b = cand.select("pair", C("url").alias("cand_url"), path_of(C("url")).alias("target"), "ord")
    b = b.groupBy("pair", "target").agg(F.max_by("cand_url", "ord").alias("cand_url"))
    if url_map is not None:
        a = a.join(url_map, ["path"], "left").withColumn("target", F.coalesce("mapped", "path")).drop("mapped")
    else:
        a = a.withColumn("target", C("path"))
    return a.join(b, ["pair", "target"], "left").drop("target")
