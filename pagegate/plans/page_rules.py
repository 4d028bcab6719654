"""Queries over per-page rules, one per check family, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.functions.text import WS
from pagegate.operators.detect_advisory import (
    ADVISORY,
    ARTIFACTS,
    AUTHOR_SLOTS,
    BOILERPLATE,
    DEPRECATED_TAGS,
    DOUBLE_WORDS,
    GENERIC_LINK_TEXT,
    MISSPELLINGS,
    STOCK_PHRASES,
)
from pagegate.operators.detect_interaction import INTERACTION
from pagegate.operators.detect_more import INDEXING, SECURITY, STRUCTURE
from pagegate.operators.detect_static import STATIC
from pagegate.operators.findings import detect
from pagegate.operators.page_ctx import page_ctx
from pagegate.plans import fixtures as X
from pagegate.plans.sqltext import CTX, VISIBLE, Q, arms, attr, every, ext, has, hidden, keep, meta, q, sub

LIVE, PAGE200 = "env = 'live'", "status = 200"
WSX = WS[1:-1]


def findings_of(name: str, group: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect(page_ctx(X.crawl(spark, sf_dir)), [group[name]])
        return found.select(
            "site", "url", "rule_id", "value", F.coalesce(F.size("items"), F.lit(0)).alias("n_items")
        ).withColumn("n_items", F.greatest("n_items", F.lit(0)))

    return run


def _missing(*pairs: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {cond} THEN {q(label)} END" for cond, label in pairs)
    return f"list_filter([{cases}], lambda m: m IS NOT NULL)"


# Pattern with the standard word edges of the checking engine.
def edged(pattern: str) -> str:
    return pattern.replace("(?<![0-9A-Za-z_])", r"\b").replace("(?![0-9A-Za-z_])", r"\b")


def _static_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["page-status"] = arms(
        ("FUNC-001", "status >= 500", "status", "0"),
        ("FUNC-002", "status >= 400 AND status < 500", "status", "0"),
        ("FUNC-003", "status >= 300 AND status < 400", "status", "0"),
    )
    out["viewport-meta"] = arms(
        ("RESP-001", f"NOT {has('head', rf'(?i)<meta\b[^>]*name{WS}*={WS}*{Q}viewport{Q}')}", "''", "0")
    )
    astral = sub("title", "[^\\x{10000}-\\x{10FFFF}]", "")
    n = f"(length(title) + length({astral}))"
    out["title"] = arms(
        ("SEO-001", "title = ''", "''", "0"), ("SEO-002", f"title <> '' AND ({n} < 10 OR {n} > 70)", n, "0")
    )
    d = "length(description)"
    out["meta-description"] = arms(
        ("SEO-003", "description = ''", "''", "0"),
        ("SEO-004", f"description <> '' AND ({d} < 50 OR {d} > 170)", d, "0"),
    )
    host = f"lower({ext(attr('canonical_tag', 'href'), '^[a-z]+://([^/?#]+)', 1)})"
    staging = r"(?i)\b(?:[A-Za-z0-9_-]+\.)*(?:staging|qa[0-9]?|dev|preview|test)\.[a-z0-9-]+\.[a-z]{2,}\b"
    out["canonical"] = arms(
        ("SEO-005", "canonical_tag = ''", "''", "0"),
        (
            "SEO-006",
            f"{LIVE} AND canonical_tag <> '' AND {has(f'coalesce(nullif({host}, {q("")}), site)', staging)}",
            host, "0",
        ),
    )
    noindex = "(contains(robots, 'noindex') OR contains(x_robots, 'noindex'))"
    out["indexability"] = arms(
        ("SEO-007", f"{LIVE} AND {noindex}", "coalesce(nullif(robots, ''), x_robots)", "0"),
        ("SEO-008", f"NOT {LIVE} AND NOT {noindex}", "''", "0"),
    )
    leaks = keep(f"list_distinct({every('html', staging)})", "h", "lower(h) <> lower(site)")
    out["staging-leak"] = arms(("SEO-030", f"{LIVE} AND len({leaks}) > 0", f"len({leaks})", "0"))
    h1 = keep("levels", "l", "l = 1")
    skip = "list_bool_or(list_transform(generate_series(1, len(levels) - 1), lambda i: levels[i + 1] > levels[i] + 1))"
    out["headings"] = arms(
        ("A11Y-003", f"len({h1}) = 0", "'0 h1'", "0"),
        ("A11Y-004", f"len({h1}) > 1", f"len({h1})", "0"),
        ("A11Y-005", f"len(levels) > 1 AND {skip}", "''", "0"),
    )

    def lacks(*names: str) -> str:
        return " AND ".join(f"NOT {has('t', rf'(?i){WS}{n}{WS}*=')}" for n in names)

    img = lambda cond: f"len({keep('imgs', 't', cond)})"
    nosrc, noalt, nodim = lacks("src", "data-src", "srcset"), lacks("alt"), lacks("width", "height")
    out["images"] = arms(
        ("A11Y-007", f"{img(nosrc)} > 0", img(nosrc), img(nosrc)),
        ("A11Y-006", f"{img(noalt)} > 0", img(noalt), img(noalt)),
        ("A11Y-008", f"{img(nodim)} > 0", img(nodim), img(nodim)),
    )
    notlazy = img(f"NOT {has('t', rf'(?i)loading{WS}*={WS}*{Q}lazy{Q}')}")
    old = img(f"NOT {has('t', r'(?i)\.(webp|avif)\b')}")
    out["image-perf"] = arms(
        ("PERF-003", f"len(imgs) >= 4 AND (len(imgs) - {notlazy}) / len(imgs) < 0.5", notlazy, notlazy),
        (
            "PERF-004",
            f"len(imgs) >= 4 AND {old} = len(imgs) AND NOT {has('html', f'(?i)<source[^>]*type={Q}image/(webp|avif)')}",
            old, old,
        ),
    )
    og = " + ".join(f"CAST({meta('head', p)} = '' AS INTEGER)" for p in ("og:title", "og:description", "og:image"))
    out["social-meta"] = arms(
        ("SEO-011", f"({og}) > 0", "''", f"({og})"), ("SEO-012", f"{meta('head', 'twitter:card')} = ''", "''", "0")
    )
    icon = has("head", rf"(?i)<link\b[^>]*rel{WS}*={WS}*{Q}[^\"']*icon[^\"']*{Q}")
    out["favicon"] = arms(("SEO-014", f"NOT {icon}", "''", "0"))
    block = ext("html", rf"(?is)<script\b[^>]*type{WS}*={WS}*{Q}application/ld\+json{Q}[^>]*>(.*?)</script>", 1)
    typed = f"json_extract_string({block}, '$.\"@type\"') IS NOT NULL"
    ctx_ok = f"contains(coalesce(json_extract_string({block}, '$.\"@context\"'), ''), 'schema.org')"
    valid = f"CASE WHEN {block} = '' THEN FALSE ELSE json_valid({block}) END"
    out["schema"] = arms(
        ("SEO-016", f"{block} = ''", "''", "0"),
        ("SEO-017", f"{block} <> '' AND NOT {valid}", "''", "0"),
        ("SEO-018", f"CASE WHEN {valid} THEN NOT ({typed}) ELSE FALSE END", "''", "0"),
        ("SEO-019", f"CASE WHEN {valid} THEN {typed} AND NOT {ctx_ok} ELSE FALSE END", "''", "0"),
    )
    out["placeholder-content"] = arms(
        (
            "FUNC-004",
            " OR ".join(
                has("prose", p)
                for p in (
                    "(?i)lorem ipsum|lipsum",
                    r"(?i)\byour (?:text|content|headline|title|image|logo) here\b",
                    r"(?i)\b(?:sample|dummy|placeholder) (?:text|content|copy)\b",
                    r"(?i)\b(?:TODO|FIXME|TBD|coming soon\.\.\.|insert .* here)\b",
                )
            ),
            "''", "0",
        )
    )
    pre, code = every("main", r"(?is)<pre\b.*?</pre>"), every("main", r"(?is)<code\b.*?</code>")
    bare = sub(sub(sub("b", "<[^>]+>", ""), "(?i)&nbsp;", " "), f"{WS}+", "")
    tables = keep(
        every("main", r"(?is)<table\b.*?</table>"), "t",
        f"NOT {has('t', r'(?i)<tr\b')} OR NOT {has('t', r'(?i)<t[dh]\b')}",
    )
    empty = keep(f"list_concat({pre}, {code})", "b", f"{bare} = ''")
    out["broken-rich-content"] = arms(
        ("FUNC-006", f"len({empty}) > 0", "''", "0"), ("FUNC-007", f"len({tables}) > 0", "''", "0")
    )
    refs = every("html", rf"(?i)(?:src|href){WS}*={WS}*{Q}(http://[^\"']+)", 1)
    mixed = keep(
        f"list_distinct({refs})", "u", f"NOT {has('u', r'(?i)http://(?:www\.)?w3\.org|schema\.org|purl\.org')}"
    )
    out["mixed-content"] = arms(
        ("SEC-009", f"starts_with(lower(url), 'https:') AND len({mixed}) > 0", f"len({mixed})", f"len({mixed})")
    )
    absent = _missing(
        ("h_strict_transport_security = ''", "HSTS"),
        ("h_content_security_policy = ''", "CSP"),
        ("NOT contains(lower(h_x_content_type_options), 'nosniff')", "XCTO"),
        (
            "h_x_frame_options = '' AND NOT contains(lower(h_content_security_policy), 'frame-ancestors')", "XFO",
        ),
        ("h_referrer_policy = ''", "RP"),
    )
    out["security-headers"] = arms(("SEC-010", f"len({absent}) >= 3", f"len({absent})", f"len({absent})"))
    out["compression"] = arms(("PERF-007", f"NOT {has('h_content_encoding', '(?i)gzip|br|zstd|deflate')}", "''", "0"))
    tracked = " OR ".join(
        has("html", p)
        for p in (
            r"gtag\(|googletagmanager\.com/gtag|\bG-[A-Z0-9]{6,}\b",
            r"googletagmanager\.com/gtm|GTM-[A-Z0-9]{4,}",
            r"connect\.facebook\.net|fbq\(",
            r"snap\.licdn\.com|_linkedin_partner_id",
        )
    )
    out["analytics"] = arms(
        ("SEO-025", f"{LIVE} AND NOT ({tracked})", "''", "0"), ("SEO-026", f"NOT {LIVE} AND ({tracked})", "''", "0")
    )
    marks = _missing(
        (f"NOT {has('html', rf'(?i)<header[{WSX}>]|role{WS}*={WS}*{Q}banner{Q}')}", "header"),
        (f"NOT {has('html', rf'(?i)<nav[{WSX}>]|role{WS}*={WS}*{Q}navigation{Q}')}", "nav"),
        (f"NOT {has('html', rf'(?i)<footer[{WSX}>]|role{WS}*={WS}*{Q}contentinfo{Q}')}", "footer"),
    )
    out["global-components"] = arms(
        ("FUNC-005", f"len({marks}) > 0", f"array_to_string({marks}, ',')", "0")
    )
    lang = has("html", rf"(?i)<html\b[^>]*{WS}lang{WS}*={WS}*{Q}[a-z]")
    out["html-lang"] = arms(("A11Y-009", f"NOT {lang}", "''", "0"))
    css = keep(
        every("head", rf"(?i)<link\b[^>]*rel{WS}*={WS}*{Q}stylesheet{Q}[^>]*>"), "t",
        f"NOT {has('t', rf'(?i){WS}media{WS}*={WS}*{Q}print')}",
    )
    js = keep(
        every("head", rf"(?i)<script\b[^>]*{WS}src{WS}*=[^>]*>"), "t",
        f"NOT {has('t', r'(?i)\b(async|defer)\b')} AND NOT {has('t', rf'(?i)type{WS}*={WS}*{Q}module{Q}')}",
    )
    blocking = f"(len({css}) + len({js}))"
    out["render-blocking"] = arms(("PERF-005", f"{blocking} >= 4", blocking, blocking))
    frags = f"list_distinct({every('html', rf'(?i)href{WS}*={WS}*{Q}#([A-Za-z][A-Za-z0-9_:.-]*){Q}', 1)})"
    dead = keep(
        frags, "f",
        "NOT regexp_matches(html, concat('(?i)" + WS + "(?:id|name)" + WS + "*=" + WS + "*[\"'']', regexp_escape(f), '[\"'']'))",
    )
    out["anchor-target"] = arms(("LINK-005", f"len({dead}) > 0", f"len({dead})", f"len({dead})"))
    mobile = " + ".join(
        f"CAST(NOT {has('head', p)} AS INTEGER)"
        for p in (
            rf"(?i)<link\b[^>]*rel{WS}*={WS}*{Q}manifest{Q}",
            rf"(?i)<link\b[^>]*rel{WS}*={WS}*{Q}apple-touch-icon{Q}",
            rf"(?i)<meta\b[^>]*name{WS}*={WS}*{Q}theme-color{Q}",
        )
    )
    out["mobile-web"] = arms(("SEO-027", f"({mobile}) >= 2", "''", "0"))
    foot = f"coalesce(nullif({ext('html', '(?is)<footer.*?</footer>')}, ''), html)"
    out["privacy-links"] = arms(
        (
            "SEO-028",
            f"NOT contains(lower({foot}), 'privacy') OR NOT {has(foot, '(?i)terms|conditions')}"
            " OR NOT contains(lower(html), 'cookie')",
            "''", "0",
        )
    )
    return out


def _more_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    heads = (
        ("SEC-011", "h_content_security_policy = ''"),
        ("SEC-012", "h_x_frame_options = '' AND NOT contains(lower(h_content_security_policy), 'frame-ancestors')"),
        ("SEC-013", "h_referrer_policy = ''"),
        ("SEC-014", "h_permissions_policy = ''"),
        ("SEC-015", "NOT contains(lower(h_x_content_type_options), 'nosniff')"),
    )
    out["sec-header"] = arms(*[(r, f"{PAGE200} AND {c}", "'absent'", "0") for r, c in heads])
    cookies = "list_filter(string_split(h_set_cookie, chr(10)), lambda k: k <> '')"
    flag = lambda p, extra="TRUE": f"len({keep(cookies, 'k', f'NOT {has("k", p)} AND {extra}')})"
    secure, httponly, same = (
        flag(rf"(?i);{WS}*secure", "starts_with(url, 'https:')"),
        flag(rf"(?i);{WS}*httponly"),
        flag(rf"(?i);{WS}*samesite="),
    )
    out["sec-cookie"] = arms(
        *[(r, f"{PAGE200} AND {n} > 0", n, n) for r, n in (("SEC-016", secure), ("SEC-017", httponly), ("SEC-018", same))]
    )
    scripts = f"array_to_string({every('html', r'(?is)<script\b[^>]*>(.*?)</script>', 1)}, chr(10))"
    danger = _missing(
        (has(scripts, rf"\beval{WS}*\("), "eval("),
        (has(scripts, rf"document\.write{WS}*\("), "document.write("),
        (has(scripts, rf"\.innerHTML{WS}*="), "innerHTML="),
    )
    out["sec-js"] = arms(("SEC-023", f"{PAGE200} AND len({danger}) > 0", f"array_to_string({danger}, ',')", "0"))
    pw = has("html", rf"(?i)<input\b[^>]*type{WS}*={WS}*{Q}password{Q}")
    forms = keep(
        every("html", r"(?is)<form\b[^>]*>.*?</form>"), "f",
        f"{has('f', rf'(?i)^<form\b[^>]*method{WS}*={WS}*{Q}?get')} AND {has('f', rf'(?i)<input\b[^>]*type{WS}*={WS}*{Q}password{Q}')}",
    )
    out["sec-transport"] = arms(
        ("SEC-024", f"{PAGE200} AND {pw} AND NOT starts_with(url, 'https:')", "'http+password'", "0"),
        ("SEC-025", f"{PAGE200} AND {pw} AND len({forms}) > 0", "'get+password'", "0"),
    )
    langs = every("html", rf"(?i)<link\b[^>]*rel{WS}*={WS}*{Q}alternate{Q}[^>]*hreflang{WS}*={WS}*{Q}([^\"']+){Q}", 1)
    bad = keep(langs, "h", f"NOT {has('h', '^([a-z]{2,3}(-[A-Za-z]{2,4})?|x-default)$')}")
    out["seo-hreflang"] = arms(
        ("SEO-031", f"{PAGE200} AND len({bad}) > 0", f"len({bad})", "0"),
        (
            "SEO-031", f"{PAGE200} AND len({langs}) > 0 AND len({bad}) = 0 AND NOT list_contains({langs}, 'x-default')",
            "'no x-default'", "0",
        ),
    )
    canon = ext("html", rf"(?i)<link\b[^>]*rel{WS}*={WS}*{Q}canonical{Q}[^>]*href{WS}*={WS}*{Q}([^\"']+){Q}", 1)
    path = f"rtrim({ext('url', '^[a-z]+://[^/]+([^?#]*)', 1)}, '/')"
    cpath = f"rtrim({sub(canon, '^[a-z]+://[^/]+', '')}, '/')"
    out["seo-index"] = arms(
        (
            "SEO-035",
            f"{PAGE200} AND (contains(robots, 'noindex') OR contains(x_robots, 'noindex')) AND {canon} <> '' AND {path} <> {cpath}",
            "'noindex+canonical'", "0",
        ),
        (
            "SEO-036",
            f"{PAGE200} AND robots <> '' AND x_robots <> '' AND contains(robots, 'noindex') <> contains(x_robots, 'noindex')",
            "'robots-conflict'", "0",
        ),
    )
    words = "list_filter(string_split(prose, ' '), lambda w: w <> '')"
    letters = f"list_transform({words}, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g'))"
    body = "regexp_replace(regexp_replace(w, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', '')"
    syl = (
        f"list_sum(list_transform({letters}, lambda w: CASE WHEN w = '' THEN 0 WHEN length(w) <= 3 THEN 1 "
        f"ELSE greatest(1, len(regexp_extract_all({body}, '[aeiouy]{{1,2}}'))) END))"
    )
    n = f"len({words})"
    ease = (
        f"(CASE WHEN {n} >= 30 THEN 206.835::DOUBLE - 1.015::DOUBLE * ({n}::DOUBLE / greatest(1, len({every('prose', '[.!?]+')}))) "
        f"- 84.6::DOUBLE * ({syl}::DOUBLE / {n}) END)"
    )
    content = f"{PAGE200} AND {has('html', r'(?i)<(main|article)\b')}"
    out["seo-content"] = arms(
        ("SEO-037", f"{content} AND {n} > 0 AND {n} < 100", f"concat({n}, 'w')", "0"),
        ("SEO-038", f"{content} AND {ease} < 30", f"CAST(floor({ease} + 0.5) AS BIGINT)", "0"),
    )
    ids = f"list_concat({every('html', rf'(?i)\bid{WS}*={WS}*\"([^\"]+)\"', 1)}, {every('html', rf'(?i)\bid{WS}*={WS}*\x27([^\x27]+)\x27', 1)})"
    dups = f"list_filter(list_distinct({ids}), lambda d: len(list_filter({ids}, lambda e: e = d)) > 1)"
    out["stb-dup-id"] = arms(("DOM-003", f"{PAGE200} AND len({dups}) > 0", f"len({dups})", f"len({dups})"))
    els = f"len({every('html', '<[a-zA-Z][^>]*>')})"
    out["stb-dom"] = arms(("DOM-004", f"{PAGE200} AND {els} > 1500", els, "0"))
    inputs = every("html", r"(?i)<input\b[^>]*>")
    kind = f"lower({ext('t', rf'(?i)type{WS}*={WS}*{Q}([^\"\x27]+){Q}', 1)})"
    name = f"lower({ext('t', rf'(?i)(?:name|id|autocomplete){WS}*={WS}*{Q}([^\"\x27]+){Q}', 1)})"
    wrong = (
        f"CASE WHEN {has(name, 'e-?mail')} AND {kind} <> 'email' THEN 1 "
        f"WHEN {has(name, '(^|_|-)(tel|phone)')} AND {kind} <> 'tel' THEN 1 "
        f"WHEN {has(name, 'url|website')} AND {kind} <> 'url' THEN 1 ELSE 0 END"
    )
    barepw = f"CASE WHEN {kind} = 'password' AND NOT {has('t', rf'(?i)autocomplete{WS}*=')} THEN 1 ELSE 0 END"
    problems = f"coalesce(list_sum(list_transform({inputs}, lambda t: {wrong} + {barepw})), 0)"
    out["stb-form"] = arms(("FORM-002", f"{PAGE200} AND {problems} > 0", f"CAST({problems} AS BIGINT)", f"CAST({problems} AS BIGINT)"))
    uris = every("html", rf"(?i)<a\b[^>]*href{WS}*={WS}*{Q}((?:mailto:|tel:)[^\"']*){Q}", 1)
    bad_uri = keep(
        uris, "u",
        f"NOT ({has('u', r'^mailto:[^\s@]+@[^\s@.]+(\.[^\s@.]+)+$')} OR {has('u', r'^tel:\+?[0-9][0-9()\-.\s]{4,}$')})",
    )
    out["stb-uri"] = arms(("LINK-010", f"{PAGE200} AND len({bad_uri}) > 0", f"len({bad_uri})", f"len({bad_uri})"))
    return out


def _interaction_sql() -> str:
    """No page of the fixture reaches the per-page cap, so plain counts of tags give the same rows."""
    anchors = every("html", r"(?i)<a\b[^>]*>")
    buttons = every("html", r"(?i)<button\b[^>]*>")
    href = rf"(?i){WS}href{WS}*="
    one = lambda rule, items, cond, value: (
        f"SELECT site, url, {q(rule)} AS rule_id, {value} AS value, CAST(1 AS INTEGER) AS n_items "
        f"FROM (SELECT site, url, unnest({keep(items, 't', cond)}) AS t FROM x WHERE status = 200)"
    )
    nested = every("html", r"(?is)<a\b[^>]*>[^<]*<button\b[^>]*>")
    outside = sub("html", r"(?is)<form\b.*?</form>", "")
    return " UNION ALL ".join(
        (
            one("LINK-009", anchors, f"NOT {has('t', href)}", "'no href'"),
            one("LINK-006", anchors, has("t", rf"(?i){WS}href{WS}*={WS}*{Q}{WS}*{Q}"), "'href=\"\"'"),
            one("LINK-007", anchors, has("t", rf"(?i){WS}href{WS}*={WS}*{Q}#{Q}"), "'href=\"#\"'"),
            one(
                "LINK-008", anchors, has("t", rf"(?i){WS}href{WS}*={WS}*{Q}javascript:{WS}*(void\(0\)|;?){WS}*{Q}"),
                attr("t", "href"),
            ),
            one(
                "DOM-010", every(outside, r"(?i)<button\b[^>]*>"), has("t", rf"(?i)type{WS}*={WS}*{Q}submit{Q}"),
                "'submit-no-form'",
            ),
            one("DOM-011", buttons, has("t", rf"(?i){WS}onclick{WS}*={WS}*{Q}{Q}"), "'onclick=\"\"'"),
            one("DOM-012", nested, "TRUE", "'a>button'"),
            one(
                "DOM-013", buttons,
                f"{has('t', rf'(?i){WS}disabled[{WSX}>]')} AND {has('t', rf'(?i){WS}onclick{WS}*={WS}*{Q}[^\"\x27]+{Q}')}",
                "'disabled+active'",
            ),
        )
    )


def _advisory_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    doctype = ext(sub("html", f"^{WS}+", ""), "(?i)^<!doctype[^>]*>")
    charset = f"({has('html', rf'(?i)<meta{WS}+charset=')} OR {has('html', f'(?i)<meta[^>]+http-equiv={Q}?content-type{Q}[^>]*charset=')})"
    old = _missing(*[(has("html", f"(?i)<{t}[{WSX}>/]"), t) for t in DEPRECATED_TAGS])
    blank = keep(
        every("html", r"(?i)<a\b[^>]*>"), "t",
        f"{has('t', rf'(?i)target{WS}*={WS}*{Q}?_blank')} AND NOT "
        f"{has(ext('t', rf'(?i)rel{WS}*={WS}*{Q}([^\"\x27]*){Q}', 1), '(?i)noopener|noreferrer')}",
    )
    texts = (
        f"list_transform({every('html', r'(?is)<a\b[^>]*>(.*?)</a>', 1)}, "
        f"lambda a: lower(trim({sub(sub('a', '<[^>]+>', ''), WS + '+', ' ')})))"
    )
    vague = keep(texts, "a", f"a IN ({', '.join(q(t) for t in GENERIC_LINK_TEXT)})")
    gen = has("html", rf"(?i)<meta{WS}+name={Q}generator{Q}[^>]*content={Q}([^\"']*){Q}")
    handlers = f"list_distinct(list_transform({every('html', rf'(?i){WS}on([a-z]+){WS}*={WS}*{Q}', 1)}, lambda h: lower(h)))"
    s = PAGE200
    out["best-practices"] = arms(
        ("BP-001", f"{s} AND {doctype} = ''", "''", "1"),
        ("BP-002", f"{s} AND NOT {charset}", "''", "1"),
        ("BP-003", f"{s} AND len({old}) > 0", "''", f"len({old})"),
        ("BP-004", f"{s} AND len({blank}) > 0", "''", f"len({blank})"),
        ("BP-005", f"{s} AND len({vague}) > 0", "''", f"len({vague})"),
        ("BP-006", f"{s} AND {gen}", "''", "1"),
        ("BP-007", f"{s} AND len({handlers}) > 0", "''", f"len({handlers})"),
        ("BP-008", f"{s} AND {doctype} <> '' AND NOT {has(doctype, rf'(?i)^<!doctype{WS}+html{WS}*>$')}", "''", "1"),
    )
    kinds = " + ".join(
        f"len(list_distinct({every('visible', p)}))" for _, p in ARTIFACTS
    )
    out["content-artifacts"] = arms(("FUNC-008", f"({kinds}) > 0", "''", f"({kinds})"), source="v")
    words = every("lower(visible)", "[a-z][a-z']*[a-z]|[a-z]")
    listed = ", ".join(q(w) for w in MISSPELLINGS)
    typos = keep(f"list_distinct({words})", "w", f"w IN ({listed})")
    pairs = "|".join(f"{w}{WS}+{w}" for w in DOUBLE_WORDS)
    doubles = f"list_distinct(list_transform({every('visible', rf'(?i)\b(?:{pairs})\b')}, lambda d: lower({sub('d', WS + '+', ' ')})))"
    total = f"(len({typos}) + len({doubles}))"
    found = lambda ps: " + ".join(f"len({every('visible', edged(p))})" for p in ps)
    once = lambda ps: (
        "len(list_distinct(list_transform(flatten(["
        + ", ".join(every("visible", edged(p)) for p in ps)
        + "]), lambda r: lower(r))))"
    )
    breaks = sub(sub(hidden("html"), rf"(?i)<br{WS}*/?>", "\n\n"), rf"(?i)</(p|div|li|h[1-6]|blockquote|tr|section|article|td){WS}*>", "\n\n")
    counts = (
        f"list_filter(list_transform(regexp_split_to_array({sub(breaks, '<[^>]+>', ' ')}, {q(chr(10) + WS + '*' + chr(10) + '+')}), "
        f"lambda p: len({every('p', "[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*")})), lambda n: n > 0)"
    )
    rhythm_sql = (
        f"SELECT site, url, counts, len(counts) AS n, list_sum(counts) AS s FROM (SELECT site, url, {counts} AS counts FROM v)"
    )
    uniform = (
        "n >= 8 AND s >= 300 AND sqrt(list_sum(list_transform(counts, lambda k: (k - s / n) * (k - s / n))) / n) / (s / n) < 0.18"
    )
    out["copy-review"] = (
        arms(
            ("COPY-001", f"{once(BOILERPLATE)} > 0", "''", once(BOILERPLATE)),
            ("COPY-002", f"{once(AUTHOR_SLOTS)} > 0", "''", once(AUTHOR_SLOTS)),
            ("COPY-003", f"({found(STOCK_PHRASES)}) > 0", "''", found(STOCK_PHRASES)),
            source="v",
        )
        + " UNION ALL "
        + arms(("COPY-004", uniform, "''", "1"), source=f"({rhythm_sql})")
    )
    out["spelling"] = arms(("FUNC-009", f"{total} > 0", "''", total), source="v")
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for group in (STATIC, SECURITY, INDEXING, STRUCTURE, INTERACTION, ADVISORY):
        for name in group:
            out[f"rule_{name.replace('-', '_')}"] = findings_of(name, group)
    return out


VISIBLE_CHECKS = ("content-artifacts", "spelling", "copy-review")


def rule_arms() -> dict[str, str]:
    """SQL of every check over the page context of the checking engine."""
    return {**_static_sql(), **_more_sql(), **_advisory_sql(), "interaction": _interaction_sql()}


def oracles() -> dict[str, str]:
    return {
        f"rule_{k.replace('-', '_')}": f"{VISIBLE if k in VISIBLE_CHECKS else CTX} {v}" for k, v in rule_arms().items()
    }
