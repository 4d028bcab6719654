"""Small builders for the SQL the checking engine runs. They only assemble text."""

from __future__ import annotations

from pagegate.functions.text import WS
from pagegate.plans.fixtures import crawl_sql

Q = "[\"']"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def ext(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({expr}, {q(pattern)}, {group})"


def every(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {q(pattern)}, {group})"


def sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def collapse(expr: str) -> str:
    return f"trim({sub(expr, WS + '+', ' ')})"


def strip(expr: str) -> str:
    e = sub(expr, "(?is)<script.*?</script>", " ")
    e = sub(e, "(?is)<style.*?</style>", " ")
    return collapse(sub(e, "<[^>]+>", " "))


def hidden(expr: str) -> str:
    for tag in ("script", "style", "pre", "code", "template"):
        expr = sub(expr, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return sub(expr, "(?s)<!--.*?-->", " ")


def visible(expr: str) -> str:
    return collapse(sub(hidden(expr), "<[^>]+>", " "))


def no_code(expr: str) -> str:
    for tag in ("pre", "code", "textarea"):
        expr = sub(expr, f"(?is)<{tag}.*?</{tag}>", " ")
    return expr


def attr(expr: str, name: str) -> str:
    return ext(expr, rf"(?i){WS}{name}{WS}*={WS}*{Q}([^\"']*){Q}", 1)


def meta(expr: str, name: str) -> str:
    tag = ext(expr, rf"(?i)<meta\b[^>]*(?:name|property){WS}*={WS}*{Q}{name}{Q}[^>]*>")
    return attr(tag, "content")


def keep(items: str, var: str, cond: str) -> str:
    return f"list_filter({items}, lambda {var}: {cond})"


# The page context in the checking engine: table `x`.
CTX_FROM = f"""
WITH c AS (@CRAWL@),
x0 AS (
  SELECT *,
    coalesce(nullif({ext('html', '(?is)<head.*?</head>')}, ''), substr(html, 1, 8000)) AS head,
    coalesce(nullif({ext('html', '(?is)<main.*?</main>')}, ''),
             nullif({ext('html', '(?is)<article.*?</article>')}, ''), html) AS main,
    {strip(ext('html', '(?is)<title[^>]*>(.*?)</title>', 1))} AS title,
    {every('html', '(?i)<img\\b[^>]*>')} AS imgs,
    list_transform({every('html', '(?i)<h([1-6])\\b', 1)}, lambda l: CAST(l AS INTEGER)) AS levels
  FROM c),
x AS (
  SELECT *,
    {strip(no_code('main'))} AS prose,
    {meta('head', 'description')} AS description,
    lower({meta('head', 'robots')}) AS robots,
    lower(h_x_robots_tag) AS x_robots,
    {ext('head', rf'(?i)<link\b[^>]*rel{WS}*={WS}*{Q}canonical{Q}[^>]*>')} AS canonical_tag
  FROM x0)
"""
CTX = CTX_FROM.replace("@CRAWL@", crawl_sql())
LIVE_CTX = CTX_FROM.replace("@CRAWL@", f"SELECT * REPLACE ('live' AS env) FROM ({crawl_sql()})")
VISIBLE_STEP = f""", v AS (SELECT *, {visible('html')} AS visible FROM x WHERE status = 200)"""
VISIBLE = CTX + VISIBLE_STEP


def arms(*rows: tuple[str, str, str, str], source: str = "x") -> str:
    """UNION ALL of rule arms: (rule id, condition, value, number of items)."""
    return " UNION ALL ".join(
        f"SELECT site, url, {q(rule)} AS rule_id, CAST({value} AS VARCHAR) AS value, "
        f"CAST({n} AS INTEGER) AS n_items FROM {source} WHERE {cond}"
        for rule, cond, value, n in rows
    )
