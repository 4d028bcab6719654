"""Each rule fires on a page made for it and stays silent on a clean one."""

import pytest
from pyspark.sql import functions as F

from pagegate import rules as R
from pagegate.functions import html as H
from pagegate.functions import text as T
from pagegate.operators import detect_advisory as A
from pagegate.operators import detect_static as DS
from pagegate.operators.detect_advisory import ADVISORY
from pagegate.operators.detect_interaction import INTERACTION
from pagegate.operators.detect_more import INDEXING, SECURITY, STRUCTURE
from pagegate.operators.detect_static import STATIC
from pagegate.operators.findings import detect
from pagegate.operators.page_ctx import page_ctx

SCHEMA = "site string, scan_id string, url string, status int, body string, headers map<string,string>, content_type string, location string, error string, error_code string, ord long"
ALL = [*STATIC.values(), *SECURITY.values(), *INDEXING.values(), *STRUCTURE.values(), *INTERACTION.values(), *ADVISORY.values()]
SAFE = {
    "content-security-policy": "default-src self", "x-frame-options": "DENY", "referrer-policy": "no-referrer", "permissions-policy": "x",
    "x-content-type-options": "nosniff", "strict-transport-security": "max-age=1", "content-encoding": "br",
}
WORDS = "The cat sat on the mat and had a good day. " * 12
CLEAN = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>A title of good length</title>'
    '<meta name="viewport" content="w"><meta name="description" content="' + "d" * 80 + '"><link rel="canonical" href="/p">'
    '<link rel="icon" href="/f.ico"><link rel="manifest" href="/m"><link rel="apple-touch-icon" href="/t"><meta name="theme-color" content="x">'
    '<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="/i.png">'
    '<meta name="twitter:card" content="s"><script type="application/ld+json">{"@context":"https://schema.org","@type":"WebPage"}</script>'
    '<script async src="https://www.googletagmanager.com/gtag/js?id=G-ABCDEF1"></script></head><body><header>h</header><nav><a href="/x">Go to x</a></nav>'
    f'<main><h1>One</h1><h2>Two</h2><p>{WORDS}</p><img src="/a.webp" alt="a" width="1" height="1" loading="lazy"></main>'
    '<footer><a href="/privacy">Privacy</a> <a href="/terms">Terms</a> cookie</footer></body></html>'
)


def run(spark, cases):
    """cases: name -> (body, overrides). Returns name -> {rule: (value, [item ids])}."""
    rows = []
    for i, (name, (body, over)) in enumerate(cases.items()):
        base = dict(site="x.example.com", scan_id="s", url=f"https://x.example.com/{name}", status=200, body=body, headers=SAFE, content_type="text/html", location=None, error=None, error_code=None, ord=i)
        base.update(over)
        rows.append(tuple(base.values()))
    got = detect(page_ctx(spark.createDataFrame(rows, SCHEMA)), ALL).collect()
    out = {name: {} for name in cases}
    for r in got:
        out[r.url.rsplit("/", 1)[1]].setdefault(r.rule_id, []).append((r.value, [i.id for i in (r["items"] or [])], [i.section for i in (r["items"] or [])]))
    return out


def in_main(html):
    return CLEAN.replace("</main>", html + "</main>")


CASES = {
    "FUNC-001": ("", {"status": 503}), "FUNC-002": ("", {"status": 404}), "FUNC-003": ("", {"status": 301, "location": "/to"}),
    "RESP-001": (CLEAN.replace('name="viewport"', 'name="vp"'), {}), "SEO-001": (CLEAN.replace("A title of good length", ""), {}),
    "SEO-002": (CLEAN.replace("A title of good length", "a\U0001f600b"), {}), "SEO-003": (CLEAN.replace('name="description"', 'name="d"'), {}),
    "SEO-004": (CLEAN.replace("d" * 80, "short"), {}), "SEO-005": (CLEAN.replace('rel="canonical"', 'rel="c"'), {}),
    "SEO-006": (CLEAN.replace('href="/p"', 'href="https://staging.example.com/"'), {}), "SEO-007": (CLEAN, {"headers": {**SAFE, "x-robots-tag": "NoIndex"}}),
    "SEO-030": (in_main("see https://dev.example.com/x"), {}), "A11Y-003": (CLEAN.replace("h1", "h2"), {}), "A11Y-004": (in_main("<h1>again</h1>"), {}),
    "A11Y-005": (in_main("<h4>deep</h4>"), {}), "A11Y-006": (in_main('<img src="b.png" width="1">'), {}), "A11Y-007": (in_main('<img alt="" width="1">'), {}),
    "A11Y-008": (in_main('<img src="b.png" alt="b">'), {}), "PERF-003": (in_main('<img src="b.webp" alt="b" width="1">' * 4), {}),
    "PERF-004": (CLEAN.replace("/a.webp", "/a.jpg").replace("</main>", '<img src="b.png" alt="b" width="1" loading="lazy">' * 4 + "</main>"), {}),
    "SEO-011": (CLEAN.replace("og:image", "og:img"), {}), "SEO-012": (CLEAN.replace("twitter:card", "x"), {}), "SEO-014": (CLEAN.replace('rel="icon"', 'rel="i"').replace("apple-touch-icon", "touch"), {}),
    "SEO-016": (CLEAN.replace("ld+json", "x"), {}), "SEO-017": (CLEAN.replace('"@type":', '"@type"'), {}), "SEO-018": (CLEAN.replace('"@type"', '"type"'), {}),
    "SEO-019": (CLEAN.replace("https://schema.org", "https://example.org"), {}), "FUNC-004": (in_main("<p>Lorem ipsum</p>"), {}), "FUNC-006": (in_main("<pre> &nbsp;</pre>"), {}),
    "FUNC-007": (in_main("<table><tr></tr></table>"), {}), "SEC-009": (in_main('<img src="http://cdn.example.org/a.webp" alt="a" width="1">'), {}), "SEC-010": (CLEAN, {"headers": {"content-encoding": "gzip"}}),
    "PERF-007": (CLEAN, {"headers": {k: v for k, v in SAFE.items() if k != "content-encoding"}}), "SEO-025": (CLEAN.replace("googletagmanager.com/gtag", "x").replace("G-ABCDEF1", ""), {}),
    "FUNC-005": (CLEAN.replace("<header>", "<div>"), {}), "A11Y-009": (CLEAN.replace(' lang="en"', ""), {}), "PERF-005": (CLEAN.replace("</head>", '<link rel="stylesheet" href="/a.css">' * 4 + "</head>"), {}),
    "LINK-005": (in_main('<a href="#Gone">to gone</a>'), {}), "SEO-027": (CLEAN.replace("manifest", "m").replace("theme-color", "t"), {}), "SEO-028": (CLEAN.replace("cookie", ""), {}),
    "SEC-011": (CLEAN, {"headers": {k: v for k, v in SAFE.items() if k != "content-security-policy"}}), "SEC-016": (CLEAN, {"headers": {**SAFE, "set-cookie": "a=1; HttpOnly; SameSite=Lax"}}),
    "SEC-017": (CLEAN, {"headers": {**SAFE, "set-cookie": "a=1; Secure; SameSite=Lax"}}), "SEC-018": (CLEAN, {"headers": {**SAFE, "set-cookie": "a=1; Secure; HttpOnly\nb=2; Secure; HttpOnly; SameSite=None"}}),
    "SEC-023": (in_main("<script>eval('x')</script>"), {}), "SEC-024": (in_main('<input type="password" autocomplete="x">'), {"url": "http://x.example.com/SEC-024"}),
    "SEC-025": (in_main('<form method="get"><input type="password" autocomplete="x"></form>'), {}), "SEO-031": (CLEAN.replace("</head>", '<link rel="alternate" hreflang="xx-toolong1" href="/x"></head>'), {}),
    "SEO-035": (CLEAN.replace("</head>", '<meta name="robots" content="noindex"></head>'), {}), "SEO-036": (CLEAN.replace("</head>", '<meta name="robots" content="noindex"></head>'), {"headers": {**SAFE, "x-robots-tag": "all"}}),
    "SEO-037": (CLEAN.replace(WORDS, "few words"), {}), "SEO-038": (CLEAN.replace(WORDS, "incomprehensibility internationalization " * 40), {}), "DOM-003": (in_main('<i id="a"></i><i id=\'a\'></i>'), {}),
    "DOM-004": (in_main("<i></i>" * 1500), {}), "FORM-002": (in_main('<input name="e-mail">'), {}), "LINK-010": (in_main('<a href="mailto:a@b">write</a>'), {}),
    "LINK-006": (in_main('<a href=" ">x</a>'), {}), "LINK-007": (in_main('<a href="#">x</a>'), {}), "LINK-008": (in_main('<a href="javascript:;">x</a>'), {}), "LINK-009": (in_main("<a class='k m'>x</a>"), {}),
    "DOM-010": (in_main("<form></form><button type=submit>x</button>"), {}), "DOM-011": (in_main('<button onclick="">x</button>'), {}), "DOM-012": (in_main('<a href="/q"><button>x</button></a>'), {}),
    "DOM-013": (in_main('<button disabled onclick="go()">x</button>'), {}), "BP-001": (CLEAN.replace("<!DOCTYPE html>", ""), {}), "BP-002": (CLEAN.replace('<meta charset="utf-8">', ""), {}),
    "BP-003": (in_main("<center>x</center>"), {}), "BP-004": (in_main('<a href="/q" target=_blank>Open q</a>'), {}), "BP-005": (in_main('<a href="/q"><b>Read</b> more</a>'), {}),
    "BP-006": (CLEAN.replace("</head>", '<meta name="generator" content="G 1"></head>'), {}), "BP-007": (in_main('<i onclick="x()"></i>'), {}), "BP-008": (CLEAN.replace("<!DOCTYPE html>", "<!DOCTYPE html SYSTEM>"), {}),
    "FUNC-008": (in_main("<p>Hi {{ name }}</p>"), {}), "FUNC-009": (in_main("<p>in the the end</p>"), {}), "COPY-001": (in_main("<p>As an AI language model</p>"), {}), "COPY-002": (in_main("<p>[INSERT NAME]</p>"), {}),
    "COPY-003": (in_main("<p>let us delve into it</p>"), {}), "COPY-004": ("<html><body>" + "".join(f"<p>{'word ' * 40}n{i}</p>" for i in range(9)) + "</body></html>", {}),
}


@pytest.fixture(scope="module")
def results(spark):
    return run(spark, {"clean": (CLEAN, {}), **CASES})


def test_clean_page_is_silent(results):
    assert results["clean"] == {}


@pytest.mark.parametrize("rule", list(CASES))
def test_rule_fires(results, rule):
    assert rule in results[rule], results[rule].keys()


def test_every_static_rule_has_a_case():
    pages = {r["rule_id"] for r in R.rule_rows() if r["method"] == "static"}
    other = {"SEO-008", "SEO-009", "SEO-010", "SEO-026", "FORM-001", "SEC-012", "SEC-013", "SEC-014", "SEC-015"}
    assert pages - set(CASES) <= other


def test_utf16_title_length(results):
    assert results["SEO-002"]["SEO-002"][0][0] == "4"


def test_items_are_located(results):
    assert results["A11Y-006"]["A11Y-006"][0][1:] == (["b.png"], ["“Two” (main)"])
    assert results["LINK-009"]["LINK-009"][0][1] == ["a.k"]


def test_staging_inverts_indexability(spark):
    got = run(spark, {"a": (CLEAN, {"site": "staging.example.com"}), "b": (CLEAN, {"site": "staging.example.com", "headers": {**SAFE, "x-robots-tag": "noindex"}})})
    assert set(got["a"]) == {"SEO-008", "SEO-026"} and set(got["b"]) == {"SEO-026", "SEO-035"}


def test_all_dead_links_and_nesting(spark):
    got = run(spark, {"many": (in_main('<a href="">x</a>' * 40), {}), "deep": (in_main('<a href="/1"><a href="/2"></a></a><a href="/3">z</a>'), {})})
    assert len(got["many"]["LINK-006"]) == 40
    assert [v[0] for v in got["deep"]["DOM-012"]] == ["a>a"]


def test_hostile_pages_do_not_fail(spark):
    bodies = {"empty": "", "text": "just text", "cut": '<html><head><title>x</title><body><div class="co', "broken": "<div><span><p>open <img src=<form><<>", "huge": "<html><body>" + '<div class="x">z</div>' * 20000 + "</body></html>"}
    got = run(spark, {k: (v, {}) for k, v in bodies.items()})
    assert "DOM-004" in got["huge"]


def test_registry_facts():
    rows = R.rule_rows()
    assert len(rows) == 142 and len({r["rule_id"] for r in rows}) == 142
    risk = {}
    for r in rows:
        risk[r["suite"]] = risk.get(r["suite"], 0) + r["deduction"]
    assert (risk["seo"], risk["security"], risk["a11y"], risk["functional"]) == (194, 235, 76, 102)
    assert sum(w for _, _, w in R.SUITES) == 100
    known = {r["rule_id"] for r in rows}
    assert all(x in known for _, (_, ids) in R.CHECKS.items() for x in ids.split())


def test_space_is_the_same_class(spark):
    """the form of the white space class made for speed takes the same characters of the whole plane."""
    chars = [(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame(chars, "c string")
    assert df.filter(F.col("c").rlike(f"^{T.WS}$") != F.col("c").rlike(f"^{T.SPACE}$")).count() == 0
    assert df.filter(F.col("c").rlike(f"^{T.SPACE}$")).count() == 25


MATCHES = (
    "As an AI language MODEL", "I'm sorry, but I can't", "I'm SORRY but as an AI", "as of my last knowledge update", "As of my last training",
    "I cannot browse the Internet", "Certainly! Here's", "x\nsure,\u00a0here is", "here's the Rewritten version", "Here is a revised version",
    "[insert NAME]", "[Your mail]", "[company]", "[TODO: x]", "a TK b", "TODO: x", "FIXME it", "aXXXXXb", "Delve INTO", "In today's digital world",
    "It's worth noting", "its important to note", "unlock the Power", "unlock the potential", "elevate your", "navigate the complex",
    "navigate the ever-", "a Testament to", "in the realm of", "Seamlessly integrated", "ROBUST framework", "robust solution",
    "{{ name }}", "{% if %}", "${x}", "a\ufffdb", "caf\u00c3\u00a9", "\u00c2\u00a0", "\u00e2\u20ac", "&AMP;lt;", "a\x01b",
    "The the end", "an an", "xthe the", "the thee", "of OF, is\u00a0is", "a an and and", "teh accomodate ab a", "adn't wich", "",
)


def test_signs_lose_no_match(spark):
    """a text that its signs leave out has no match, and every pattern has a text here that is found."""
    df = spark.createDataFrame([(m,) for m in MATCHES], "t string").select("t", F.lower("t").alias("low"))
    t, low = F.col("t"), F.col("low")
    tests = {p: low.contains(s) for p, s in A.COPY_SIGNS.items()}
    tests |= {p: T.holds_any(low, A.ARTIFACT_SIGNS[n]) for n, p in A.ARTIFACTS if n in A.ARTIFACT_SIGNS}
    rows = df.select(F.array(*[t.rlike(p) for p in tests]).alias("found"), F.array(*tests.values()).alias("may")).collect()
    assert all(may or not found for r in rows for found, may in zip(r["found"], r["may"], strict=True))
    assert all(any(r["found"][i] for r in rows) for i in range(len(tests)))
    prose = df.select(T.collapse_ws(t).alias("t"))
    got = prose.select((F.size(A.doubled_words(F.col("t"))) > 0).alias("doubled"), F.col("t").rlike(A.DOUBLED).alias("may")).collect()
    assert all(r.doubled == r.may for r in got) and sum(r.doubled for r in got) >= 4
    words = H.find_all(low, "[a-z][a-z']*[a-z]|[a-z]")
    listed = F.array_intersect(words, F.array(*[F.lit(w) for w in A.MISSPELLINGS]))
    assert df.filter(A.misspelled_words(low) != listed).count() == 0 and min(map(len, A.MISSPELLINGS)) > 2


def test_hidden_blocks_go_in_their_order(spark):
    pages = [
        "<p>a</p><SCRIPT>x</script><style>y</style><!-- c -->b", "<pre><script></pre></script>z</pre>", "<code>a</code>b<template>c</template>d",
        "<style><script></style>k</script>m", "<!-- <pre> -->v</pre>w", "<prefix>a</prefix><scripted>b", "", "<template>open",
    ]
    df = spark.createDataFrame([(p,) for p in pages], "h string")
    plain = F.col("h")
    for tag in H.HIDDEN_BLOCKS:
        plain = F.regexp_replace(plain, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    assert df.filter(H.hidden_removed(F.col("h")) != F.regexp_replace(plain, "(?s)<!--.*?-->", " ")).count() == 0


def test_audit_rules_lose_no_match_to_their_signs(spark):
    """what is looked for beforehand is in every match, and prose, words and regions are those of the plain steps."""
    copy = ["Lorem IPSUM", "lipsum", "Your Text here", "sample text", "DUMMY content", "placeholder copy", "TODO", "fixme", "TBD x", "Insert name here", "coming soon...x", "clean"]
    df = spark.createDataFrame([(c,) for c in copy], "t string")
    t = F.col("t")
    tests = [(t.rlike(p), T.holds_any(F.lower(t), s)) for (p, _), s in zip(DS.PLACEHOLDER_SIGNS, DS.PLACEHOLDER_HOLDS, strict=True)]
    rows = df.select(F.array(*[a for a, _ in tests]).alias("found"), F.array(*[b for _, b in tests]).alias("may")).collect()
    assert all(may or not found for r in rows for found, may in zip(r["found"], r["may"], strict=True))
    assert all(any(r["found"][i] for r in rows) for i in range(len(tests)))
    track = ["gtag(", "googletagmanager.com/gtag", "G-ABCDEF1", "googletagmanager.com/gtm", "GTM-ABCD", "connect.facebook.net", "fbq(", "snap.licdn.com", "_linkedin_partner_id"]
    tdf = spark.createDataFrame([(c,) for c in track], "t string")
    for (p, _), s in zip(DS.TRACKERS, DS.TRACKER_HOLDS, strict=True):
        assert tdf.filter(t.rlike(p) & ~T.holds_any(t, s)).count() == 0 and tdf.filter(t.rlike(p)).count() >= 2
    prose = ["", "one", "a b c", "The cat sat on the mat. " * 12, "\u00fcber alle Berge"]
    pdf = spark.createDataFrame([(p.strip(),) for p in prose], "t string").select("t", T.reading(t).alias("r"))
    assert pdf.filter(F.col("r.words") != F.size(T.word_list(t))).count() == 0
    assert pdf.filter(~F.col("r.ease").eqNullSafe(T.flesch_reading_ease(t))).count() == 0
    pages = [
        "<NAV>a", "<nav>a</nav>b", "<main><article>x", "<main><article>x</ARTICLE>y", "<header><h2>T</h2>", "<headerx>", "<aside></aside><section>", "", "<footer\n>z</main>",
    ]
    rdf = spark.createDataFrame([(p,) for p in pages], "t string")
    assert [r[0] for r in rdf.select(H.region_at(t)).collect()] == ["nav", None, "article", "main", "header", None, "section", None, "footer"]


def test_prose_and_ids_of_odd_markup(spark):
    """quoted blocks leave the prose in any case, and ids and names are read after any white space."""
    body = '<html><main>a <PRE>no</pre> b <textarea>no</TEXTAREA> c <prefix>d</prefix></main><a href="#One">1</a><a href="#two">2</a><a href="#three">3</a><i\u00a0ID="one" NAME = "Two" data-id="three"></i></html>'
    row = (("x.example.com", "s", "https://x.example.com/p", 200, body, {}, "text/html", None, None, None, 0),)
    ctx = page_ctx(spark.createDataFrame(row, SCHEMA))
    assert ctx.select("prose").head()[0] == "a b c d"
    dead = detect(ctx, [STATIC["anchor-target"]]).collect()
    assert [(r.rule_id, [i.id for i in r["items"]]) for r in dead] == [("LINK-005", ['href="#three"'])]
