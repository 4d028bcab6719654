"""Operators against hand-worked answers, brute force and invariants."""

import random

from pyspark.sql import functions as F

from pagegate import rules as R
from pagegate.functions import digest, urls
from pagegate.functions.grades import contrast_ratio, verdict_line
from pagegate.functions.html import attr_map
from pagegate.operators import certify as K
from pagegate.operators import crawlgraph as G
from pagegate.operators import history as T
from pagegate.operators import inventory as I
from pagegate.operators import prefix
from pagegate.operators import score as S
from pagegate.operators import visual as V
from pagegate.operators.contract import copy_as, locator_strategies


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_url_resolution(spark):
    base = "https://Ex.com/a/b/page.html?q=1#f"
    want = {
        "/x": "https://ex.com/x", "y": "https://ex.com/a/b/y", "../y?z#w": "https://ex.com/a/y?z#w", "//cdn.com/k": "https://cdn.com/k", "?n=2": "https://ex.com/a/b/page.html?n=2",
        "#top": "https://ex.com/a/b/page.html?q=1#top", "": "https://ex.com/a/b/page.html?q=1", "http://o.org": "http://o.org/", "./a/./b/..": "https://ex.com/a/b/a/", "/für": "https://ex.com/f%C3%BCr", "mailto:a@b.c": "mailto:a@b.c",
        "/a b": "https://ex.com/a%20b",
    }
    df = spark.createDataFrame([(k, base) for k in want], "r string, b string")
    got = {r.r: r.u for r in df.select("r", urls.abs_url(F.col("r"), F.col("b")).alias("u")).collect()}
    assert got == want


def test_url_parts(spark):
    r = one(
        spark, p=urls.path_of(F.lit("https://a.b/x/y/?q")), root=urls.path_of(F.lit("http://a.b")), f=urls.page_family(F.lit("https://a.b/Blog/2024/x")), home=urls.page_family(F.lit("https://a.b/")),
        bad=urls.page_family(F.lit("nope")), n=urls.normalize_url(F.lit("https://A.b/x/?q#f")), base=urls.basename(F.lit("/i/Pic.PNG?v=1")), env=urls.detect_env(F.lit("www.qa2.shop.com")), live=urls.detect_env(F.lit("www.shop.com")),
    )
    assert tuple(r) == ("/x/y", "/", "blog@3", "@0", "zz-unparsable@9", "https://a.b/x", "pic.png", "staging", "live")


def test_uri_verdicts(spark):
    want = {
        "": (None, False), "#": (None, False), "#a": ("fragment", True), "x/y": ("relative", True), "https://a.b": ("https", True), "https://": ("https", False), "mailto:": ("mailto", False), "mailto:a@b.co,c@d": ("mailto", False),
        "mailto:a@b.co?subject=x": ("mailto", True), "tel:+1 (555) 123": ("tel", True), "tel:12": ("tel", False), "javascript:void( 0 )": ("javascript", False), "javascript:go()": ("javascript", True), "data:x": ("data", True), "foo:bar": ("foo", False),
    }
    df = spark.createDataFrame([(k,) for k in want], "u string").select("u", urls.validate_uri(F.col("u")).alias("v"), urls.is_dead_target(F.col("u")).alias("dead"))
    rows = df.collect()
    assert {r.u: (r.v.scheme, r.v.valid) for r in rows} == want
    assert {r.u for r in rows if r.dead} == {"", "#", "javascript:void( 0 )"}


def test_digests(spark):
    r = one(
        spark, id=digest.djb2_base36(F.lit("abc")), js=digest.canonical_json(b=digest.json_string(F.lit('q"\n')), a=digest.json_string(F.lit(None).cast("string"))), sha=digest.sha256(F.lit("abc")),
        ratio=F.round(contrast_ratio(F.array(F.lit(0), F.lit(0), F.lit(0)), F.array(F.lit(255), F.lit(255), F.lit(255))), 2), line=verdict_line(F.lit(96), F.lit(False)),
    )
    assert r.id == "3772q3" and r.js == '{"a":null,"b":"q\\"\\n"}' and r.sha.startswith("ba7816bf") and r.ratio == 21.0
    assert r.line.startswith("Matches the original")


def test_attributes_and_locators(spark):
    r = one(spark, m=attr_map(F.lit(" ID=a class='x y' disabled data-test=t1 href='/q' class=z hidden=1")))
    assert r.m == {"id": "a", "class": "z", "disabled": "", "data-test": "t1", "href": "/q", "hidden": "1"}
    at = F.create_map(F.lit("id"), F.lit("a"), F.lit("class"), F.lit("x y"), F.lit("name"), F.lit("n"))
    w = one(spark, w=locator_strategies(F.lit("a"), at), c=copy_as(F.lit("#a")))
    assert [(x.kind, x.value) for x in w.w] == [("id", "#a"), ("class-combo", "a.x.y"), ("attr", "a[name='n']")]
    assert w.c.playwright == 'page.locator("#a")'


def test_ranks_in_one_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("g"), F.format_string("%06d", F.col("id") * 7919 % 5003).alias("k"), F.col("id"))
    ranked = prefix.rank_within(df, ["g"], ["k"], "n")
    rows = ranked.collect()
    for g in ("hot", "cold"):
        ks = [r.k for r in sorted((r for r in rows if r.g == g), key=lambda r: r.n)]
        assert ks == sorted(ks) and [r.n for r in sorted((r for r in rows if r.g == g), key=lambda r: r.n)] == list(range(1, len(ks) + 1))
    summed = prefix.running_sum(prefix.running_max(ranked, ["g"], "n", "id", "top", block=64), ["g"], "n", "id", "total", block=64).collect()
    for g in ("hot", "cold"):
        top = total = 0
        for r in sorted((r for r in summed if r.g == g), key=lambda r: r.n):
            top, total = max(top, r.id), total + r.id
            assert (r.top, r.total) == (top, total)


def rows_df(spark, rows):
    return spark.createDataFrame([("s", "1", *r) for r in rows], "site string, scan_id string, suite string, rule_id string, status string, name string")


def test_score_invariants(spark):
    every = [(r["suite"], r["rule_id"], "fail", r["title"]) for r in R.rule_rows() if not r["manual"] and r["suite"] in R.AUDIT_SUITES]
    worst = rows_df(spark, every)
    best = rows_df(spark, [(s, i, "pass", n) for s, i, _, n in every])
    score = lambda df, **k: {r.suite: r.score for r in S.suite_scores(df, **k).collect()}
    assert set(score(worst).values()) == {0} and set(score(best).values()) == {100}
    assert S.overall_score(S.suite_scores(best)).first().overall == 100
    some = rows_df(spark, [("seo", "SEO-001", "fail", "a"), ("seo", "SEO-001", "fail", "b"), ("links", None, "manual", "x")])
    assert score(some)["seo"] == 95  # 10 of 194, counted once
    assert score(some, excluded=["SEO-003"])["seo"] <= score(some)["seo"]
    assert score(some, excluded=["SEO-001"])["seo"] == 100
    looked = spark.createDataFrame([("s", "1", "SEO-002")], "site string, scan_id string, rule_id string")
    judged = {r.suite: (r.score, r.total_risk) for r in S.suite_scores(some, looked).collect()}
    assert judged["seo"] == (17, 12) and judged["links"] == (None, 0)


def test_readiness_bands(spark):
    r = S.readiness(rows_df(spark, [("seo", "SEO-007", "fail", "a"), ("seo", "SEO-001", "fail", "b"), ("seo", None, "warn", "c")])).first()
    assert (r.blockers, r.majors, r.untiered, r.tone, r.verdict) == (1, 1, 1, "no", "NOT LAUNCH-READY — 1 blocker")
    assert S.readiness(rows_df(spark, [("seo", "SEO-007", "pass", "a")])).first().tone == "ok"


def test_minting_is_stable_and_does_not_truncate(spark):
    keys = [("s", "page", f"page:/p{i:04d}") for i in range(1100)]
    items = spark.createDataFrame(keys, "site string, type string, identity_key string")
    empty = spark.createDataFrame([], "site string, type string, identity_key string, id string")
    first = I.mint_ids(items, empty, ["site"]).cache()
    ids = {r.identity_key: r.id for r in first.collect()}
    assert ids["page:/p0000"] == "PAGE-001" and ids["page:/p1099"] == "PAGE-1100" and len(set(ids.values())) == 1100
    assert I.mint_ids(items, first, ["site"]).count() == 0
    more = items.unionByName(spark.createDataFrame([("s", "page", "page:/a")], items.schema))
    assert [r.id for r in I.mint_ids(more, first, ["site"]).collect()] == ["PAGE-1101"]


def test_migration_pair(spark):
    schema = "site string, scan_id string, url string, status int, body string, content_type string, ord long"
    page = lambda host, p, body, i: ("m", "1", f"https://{host}{p}", 200, body, "text/html", i)
    shell = '<html><body><header>h</header><nav>n</nav>{}<footer>f</footer></body></html>'
    home = shell.format('<h1>Home</h1><h2>!!</h2><img src="/i/hero.jpg"><form action="/newsletter"><input name="email"></form><div class="cookie-bar">c</div>')
    old = spark.createDataFrame([page("old.com", "/", home, 0), page("old.com", "/about/", shell.format("<h1>About</h1>"), 1), page("old.com", "/pricing", shell.format("<h1>Pricing</h1>"), 2)], schema)
    new = spark.createDataFrame([page("new.com", "/", shell.format('<h1>Home</h1><h2>!!</h2><img src="/i/hero.jpg">'), 0), page("new.com", "/about", shell.format("<h1>About</h1>"), 1)], schema)
    side = lambda c: I.inventory(c).withColumn("pair", F.col("site"))
    compared = K.compare(side(old), side(new)).cache()
    got = {r.identity_key: r.result for r in compared.collect()}
    assert got["page:/pricing"] == "missing" and got["page:/about"] == "present" and got["section:/#h2"] == "present"
    assert got["form:newsletter:/newsletter"] == "missing" and got["global:cookie-banner"] == "missing" and got["asset:image:hero.jpg"] == "present"
    items = K.certify_items(compared, K.completeness_findings(compared))
    c = K.certificate(items).first()
    assert c.verdict == "FAIL" and c.failed == 3  # the page, its form and the cookie banner
    capped = spark.createDataFrame([("m",)], "pair string")
    held = K.compare(side(old), side(new), capped=capped)
    assert K.certificate(K.certify_items(held, K.completeness_findings(held))).first().verdict == "PASS WITH MINOR ISSUES"
    assert K.illegal_moves(K.item_history(items)).count() == 0
    same = K.compare(side(old), side(old))
    assert K.certificate(K.certify_items(same, K.completeness_findings(same))).first().verdict == "PASS"


def _findings(spark, rows):
    df = spark.createDataFrame(rows, "target string, ts string, pos long, rule_id string, severity string, page string, value string")
    return df.select("*", F.lit("seo").alias("suite"), F.lit("warn").alias("status"), F.lit(1).alias("deduction"), F.array(F.struct("page", F.lit("m").alias("section"), F.lit("i").alias("id"), "value")).alias("items")).drop("value")


def test_same_scan_twice_is_unchanged(spark):
    rows = [("t", d, i, f"SEO-00{i}", "low", "/p", "x") for d in ("2024-01-01", "2024-01-02") for i in (1, 2, 3)]
    f = _findings(spark, rows)
    heads = f.select("target", "ts").distinct().select("*", F.lit(90).alias("overall"), *[F.lit("x").alias(c) for c in ("environment", "engine", "registry", "report", "verdict", "project")], F.lit(None).cast("string").alias("parent_scan_id"))
    rec = T.scan_records(heads, f)
    assert rec.select("fingerprint").distinct().count() == 1 and rec.select("scan_id").distinct().count() == 2
    chrono = T.chronology(rec)
    assert {r.change for r in T.adjacent_diff(chrono, f).collect()} == {"unchanged"}
    p = {r["index"]: r.classification for r in T.timeline(chrono, f).collect()}
    assert p == {0: None, 1: "unchanged"}
    assert T.scan_integrity(rec, rec.select("scan_id")).count() == 0


def test_policy(spark):
    diff = spark.createDataFrame(
        [("t", "created", "SEO-001", None, "high", False), ("t", "reopened", "SEO-002", None, "low", False), ("t", "modified", "SEO-003", "low", "critical", True), ("t", "created", "SEO-004", None, "low", False), ("u", "created", "SEO-004", None, "low", False)],
        "target string, change string, rule_id string, from_severity string, to_severity string, severity_changed boolean",
    )
    delta = spark.createDataFrame([("t", -12), ("u", 3), ("v", 0)], "target string, delta int")
    found = T.violations(diff, delta)
    assert sorted((r.effect, r.rule) for r in found.filter("target = 't'").collect()) == [("FAIL", "new-finding"), ("FAIL", "reopened"), ("FAIL", "score-drop"), ("FAIL", "severity-escalation"), ("WARN", "new-finding")]
    assert {r.target: r.verdict for r in T.gate_verdicts(delta, found).collect()} == {"t": "FAIL", "u": "WARN", "v": "PASS"}


def test_redirect_loops_and_long_chains(spark):
    hops = [("https://a.b/0", "/1"), ("https://a.b/1", "/2"), ("https://a.b/2", "/0"), ("https://a.b/s", "/end")] + [(f"https://a.b/c{i}", f"/c{i + 1}") for i in range(12)]
    r = spark.createDataFrame([("a.b", "1", u, 301, to) for u, to in hops], "site string, scan_id string, url string, code int, location string")
    got = {x.url: (x.hops, x.loop, x.final) for x in G.redirect_chains(r, r).collect()}
    assert got["https://a.b/0"] == (3, True, "https://a.b/0") and "https://a.b/s" not in got and got["https://a.b/c0"] == (12, False, "https://a.b/c12")


def test_stratified_sample_takes_turns(spark):
    urls_ = ["/"] + [f"/blog/post-{i}" for i in range(6)] + ["/about", "/contact", "/services/web"]
    u = spark.createDataFrame([("s", "1", "https://x.y" + p) for p in urls_], "site string, scan_id string, url string")
    home = u.filter("url = 'https://x.y/'")
    got = [r.url[11:] for r in G.stratified_sample(u, 5, home).orderBy("position").collect()]
    assert got == ["/", "/about", "/contact", "/blog/post-0", "/services/web"]
    assert G.stratified_sample(u, 100, home).count() == len(urls_)


def _brute_relocate(ref, cand):
    key = lambda e: (e[1], e[2], (e[3] or e[4] or "").lower()[:40])
    used, missing = set(), []
    for r in ref:
        hit = next((c for c in cand if c[0] not in used and key(c) == key(r)), None)
        if hit is None:
            missing.append(r)
        else:
            used.add(hit[0])
    extra, taken, out = [c for c in cand if c[0] not in used], set(), []
    for r in missing:
        ident = (r[3] or r[5] or "").lower()[:40]
        hit = next((c for c in extra if c[0] not in taken and c[2] == r[2] and (c[3] or c[5] or "").lower()[:40] == ident and c[1] != r[1]), None) if ident else None
        if hit is not None:
            taken.add(hit[0])
            out.append((r[0], hit[0], hit[1]))
    return sorted(out)


def test_relocation_equals_brute_force(spark):
    rnd = random.Random(7)
    sides = {"ref": [], "cand": []}
    for side in sides:
        for pos in range(120):
            sides[side].append((pos, rnd.choice(["nav", "main", "footer"]), rnd.choice(["a", "li"]), rnd.choice(["", "", "Home", "Shop", "x"]), rnd.choice(["", "h1", "h2"]), rnd.choice(["", "menu", "item"])))
    rows = [("s", "/p", "v", 0, side, p, sec, tag, head, text, aria) for side, es in sides.items() for p, sec, tag, text, head, aria in es]
    e = spark.createDataFrame(rows, "site string, page string, viewport string, vord int, side string, pos long, sec string, tag string, head string, text string, aria string")
    for c in ("href", "ialt", "src", "bg_img", "font", "color"):
        e = e.withColumn(c, F.lit(""))
    e = e.withColumn("x", F.lit(0)).withColumn("y", F.lit(0)).withColumn("size", F.lit(1))
    m = V.match_elements(e).cache()
    got = sorted((r.ref_pos, r.cand_pos, r.to_sec) for r in V.relocations(m).collect())
    assert got == _brute_relocate(sides["ref"], sides["cand"]) and got
    d = V.deltas(m).groupBy("kind").count().collect()
    n = {r.kind: r["count"] for r in d}
    both = m.filter("r IS NOT NULL AND c IS NOT NULL").count()
    assert n["missing"] + len(got) + both == 120 and n["extra"] + len(got) + both == 120


def _take_turns(lost, extra):
    """Each missing element, in order, takes the first free extra of another landmark."""
    free, out = list(extra), []
    for pos, sec in lost:
        hit = next((f for f in free if f[1] != sec), None)
        if hit is not None:
            free.remove(hit)
            out.append((pos, *hit))
    return out


def _alone(spark, rows):
    side = "struct<tag:string,ident:string,pos:long,sec:string>"
    return spark.createDataFrame(rows, f"site string, page string, viewport string, r {side}, c {side}")


def test_relocation_stretches_equal_turns_taken(spark):
    """Groups of every size, with two to four landmarks and one that outweighs the others, in which stretches follow, hold and cut
    each other and run to the end."""
    rnd = random.Random(11)
    rows, want = [], []
    for g in range(400):
        secs = ["nav", "main", "footer", "aside"][: rnd.randint(1, 4)] + ["nav"] * rnd.choice([0, 0, 2, 5])
        lost, extra = ([(p, rnd.choice(secs)) for p in range(rnd.choice([0, 1, 3, 8, 25]))] for _ in range(2))
        rows += [("s", f"/{g}", "v", ("a", "x", p, sec), None) for p, sec in lost] + [("s", f"/{g}", "v", None, ("a", "x", p, sec)) for p, sec in extra]
        want += [(f"/{g}", *hit) for hit in _take_turns(lost, extra)]
    rnd.shuffle(rows)
    found = V.relocations(_alone(spark, rows))
    assert sorted((r.page, r.ref_pos, r.cand_pos, r.to_sec) for r in found.collect()) == sorted(want) and len(want) > 500
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_relocation_without_rows_or_identity(spark):
    assert V.relocations(_alone(spark, [])).count() == 0
    assert V.relocations(_alone(spark, [("s", "/", "v", ("a", "", 1, "nav"), None), ("s", "/", "v", None, ("a", "", 1, "main"))])).count() == 0


def test_rule_reach_equals_sets_of_pages(spark):
    """Sites over the border of a bitmap, rules of several checks, repeated failures, failures on pages that a check cannot read
    or that nobody knows, and of checks that are asked once a site."""
    from pagegate.operators import reach as E
    from pagegate.operators import rows as W

    status = lambda i: 200 if i % 10 else 404
    n = {"big": 33_000, "small": 12}
    page = lambda site, i: f"https://{site}/{i:06d}"
    crawl = spark.createDataFrame([(k, "1", page(k, i), status(i), "<html></html>", "text/html") for k, m in n.items() for i in range(m)], "site string, scan_id string, url string, status int, body string, content_type string")
    listed = spark.createDataFrame([(k, "1", u) for k in n for u in (page(k, 1), page(k, 999_999), page(k, 999_999))], "site string, scan_id string, url string")
    known = [(c, rules.split()) for c, (_, rules) in R.CHECKS.items()]
    known = [(c, [*rules, *{"title": ["T", "S"], "schema": ["T", "M"], "page-status": ["M"], "robots-txt": ["S"]}.get(c, [])]) for c, rules in known]
    table = spark.createDataFrame(known, "check_id string, rule_ids array<string>")
    by_rule = {}
    for c, rules in known:
        for r in rules:
            by_rule.setdefault(r, []).append(c)
    rnd = random.Random(3)
    bad = [(k, "1", c, page(k, i), "x") for k, m in n.items() for c in ["title", "schema", "page-status", "robots-txt"] for i in (rnd.randrange(m) for _ in range(m // 3))]
    bad += bad[:50] + [("small", "1", "title", page("small", 999_999), "x"), ("gone", "1", "title", "https://gone/", "x")]
    failures = spark.createDataFrame(bad, "site string, scan_id string, check_id string, url string, error string")
    pages = E.numbered(E.page_states(crawl, listed))
    got = {(r.site, r.rule_id): r for r in E.rule_reach(pages, failures, W.verified(W.ledger(crawl, failures)), table).collect()}
    broke = {}
    for k, _, c, u, _ in bad:
        broke.setdefault((k, c), set()).add(u)
    lost = set()
    for k, m in n.items():
        html = {page(k, i) for i in range(m) if status(i) == 200}
        every = {page(k, i) for i in range(m)}
        for rule, checks in by_rule.items():
            asked = {c: every if c in E.RESPONSE_CHECKS else html for c in checks if c not in E.SITE_CHECKS}
            r = got[k, rule]
            if not asked:
                assert r.pages_evaluated is None and r.pages_errored is None
                continue
            read = set().union(*asked.values())
            answered = set().union(*(u - broke.get((k, c), set()) for c, u in asked.items()))
            assert (r.pages_evaluated, r.pages_errored, r.pages_not_reached) == (len(answered), len(read - answered), m + 1 - len(read)), (k, rule)
            lost |= {(k, rule, u) for u in read - answered}
    assert len(got) == 2 * len(by_rule) and len(lost) > 1000
    assert {(r.site, r.rule_id, r.url) for r in E.broken_pages(pages, failures, table).collect()} == lost
    none = E.numbered(E.page_states(crawl.limit(0), listed.limit(0)))
    assert E.broken_pages(none, failures).count() == 0 and E.rule_reach(none, failures, W.verified(W.ledger(crawl.limit(0)))).count() == 0


def test_pages_are_read_once_and_never_shuffled(spark):
    """Findings come from what one pass wrote: their plan reads no HTML, and the pass itself has no exchange."""
    from pagegate.operators import audit
    from pagegate.operators.findings import detect
    from pagegate.operators.page_ctx import page_ctx
    from pagegate.plans import fixtures

    crawl = fixtures.crawl(spark, "/root/testdata/sf0.001")
    plan = detect(page_ctx(crawl, "live"), [*audit.page_detectors(), audit.TELL])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    after = audit.page_findings(crawl)._jdf.queryExecution().optimizedPlan().toString()
    assert "pages.parquet" not in after and "html" not in after


def test_pages_and_sections_are_read_once_and_alone(spark):
    """page_children reads the pages one time, for pages and sections only."""
    from pagegate.plans import registry

    plan = registry.queries()["page_children"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "contentinfo" not in plan and "pages.parquet" not in plan


SIGNS = {
    "header": ("<HEADER>", "role='banner'"), "footer": ("<footer >", 'ROLE = "contentinfo"'), "nav": ("<nav>", "role='navigation'"),
    "mobile-nav": ('class="x hamburger"', "class='menu-toggle'", "class='navbar-toggle'", "class='nav-toggle'", "aria-label='Open Menu'"),
    "mega-menu": ("class='megamenu'", "class='mega-menu'"), "sticky-header": ("class='is-fixed'", "class='Sticky'"),
    "announcement-bar": ("class='topbar'", "class='promo-bar'", "class='notificationbar'", "class='utility-bar'", "class='announce'"),
    "cookie-banner": ("class='consent'", "id='onetrust-x'", "id='termly'", "id='osano'", "id='iubenda'", "id='Cookiebot'"),
    "newsletter-popup": ("class='newsletter' popup", "class='modal' newsletter"), "back-to-top": ("class='scrolltop'", "class='scroll-to-top'", "class='to-top'"),
    "a11y-widget": ("UserWay", "accessiBe", "acsb", "class='accessibility-widget'"), "language-switcher": ("class='lang-switch'", "rel='alternate' hreflang"),
    "mini-cart": ("class='minicart'", "class='cart-drawer'"), "analytics-ga4": ("gtag(", "G-ABCDEF1", "googletagmanager.com/gtag"),
    "tag-manager": ("GTM-ABCD", "googletagmanager.com/gtm"), "linkedin": ("_linkedin_partner_id", "snap.licdn.com"), "tiktok": ("ttq.", "analytics.tiktok.com"),
    "accordion": ("class='accordion'", "<DETAILS>"), "tabs": ("class='tab'", "class='tabs'", "role='tab'"), "modal": ("role='dialog'", "class='modal'"),
    "drawer": ("class='offcanvas'", "class='off-canvas'"), "pagination": ("rel='next'", "class='pager'"), "lazy-load": ("loading='lazy'", "data-lazy"),
    "infinite-scroll": ("data-infinite", "class='infinite'"),
}


def test_words_of_signs_lose_no_match(spark):
    """The words looked for before a pattern are in every spelling that the pattern knows."""
    kinds = {"global": I.GLOBALS, "behavior": I.BEHAVIORS}
    rows = [(f"https://a.example/{k}/{i}", t) for k, ts in SIGNS.items() for i, t in enumerate(ts)]
    crawl = spark.createDataFrame([("a.example", "s", u, n, 200, f"<html >{t}", "text/html") for n, (u, t) in enumerate(rows)], "site string, scan_id string, url string, ord long, status int, body string, content_type string")
    got = {(r.type, r.identity_key.split(":")[1], r.url) for r in I.inventory(crawl.withColumn("site", F.col("url")), tuple(kinds)).withColumnRenamed("site", "url").collect()}
    want = {
        (type_, k, u)
        for type_, signs in kinds.items()
        for k, p in signs.items()
        for u in [r.url for r in crawl.filter(F.col("body").rlike(p)).select("url").collect()]
    }
    assert got == want and {k for _, k, _ in want} >= set(SIGNS)
