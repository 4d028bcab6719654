"""Column functions over raw HTML.

Detection is pattern based on purpose: broken markup must give the same answer as it does when a
reader applies the same patterns by hand, so no parser repairs the text first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegate.functions.text import WS, collapse_ws, holds_any, let

Q = "[\"']"

# Landmark tags a page location is named after.
LANDMARKS = ("footer", "header", "nav", "main", "article", "aside", "section")

# Blocks that never hold visible copy.
HIDDEN_BLOCKS = ("script", "style", "pre", "code", "template")


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def find_where(c: Column, lower: Column, signs: tuple[str, ...], pattern: str, group: int = 0) -> Column:
    """All matches of a pattern in a text that holds one of the signs in lower case; without them there are none."""
    return F.when(holds_any(lower, signs), find_all(c, pattern, group)).otherwise(F.array().cast("array<string>"))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match or null; a match of the empty string is kept as the empty string."""
    hit = F.regexp_extract(c, pattern, group)
    return F.when((hit != "") | matches(c, pattern), hit)


def first_block(html: Column, tag: str, otherwise: Column) -> Column:
    """First block of a tag, looked for once; what `otherwise` gives where there is none."""
    return let(
        F.regexp_extract(html, f"(?is)<{tag}.*?</{tag}>", 0), lambda b: F.when(b != "", b).otherwise(otherwise)
    )


def head_slice(html: Column) -> Column:
    return first_block(html, "head", F.substring(html, 1, 8000))


def main_slice(html: Column) -> Column:
    return first_block(html, "main", first_block(html, "article", html))


def strip_tags(c: Column) -> Column:
    c = F.regexp_replace(c, "(?is)<script.*?</script>", " ")
    c = F.regexp_replace(c, "(?is)<style.*?</style>", " ")
    return collapse_ws(F.regexp_replace(c, "<[^>]+>", " "))


# Blocks that quote text rather than say it.
QUOTING = ("pre", "code", "textarea")


def without_code(c: Column) -> Column:
    for tag in QUOTING:
        c = F.regexp_replace(c, f"(?is)<{tag}.*?</{tag}>", " ")
    return c


def _blocks_removed(c: Column, tags) -> Column:
    for tag in tags:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return c


def hidden_removed(c: Column) -> Column:
    """A page less its blocks without visible copy, in their order. Most pages hold scripts and styles alone."""
    rare = HIDDEN_BLOCKS[2:]
    c = let(
        _blocks_removed(c, HIDDEN_BLOCKS[:2]),
        lambda t: F.when(t.rlike(rf"(?i)<(?:{'|'.join(rare)})\b"), _blocks_removed(t, rare)).otherwise(t),
    )
    return F.regexp_replace(c, "(?s)<!--.*?-->", " ")


def visible_prose(shown: Column) -> Column:
    """Visible copy of what `hidden_removed` leaves of a page."""
    return collapse_ws(F.regexp_replace(shown, "<[^>]+>", " "))


def paragraph_texts(shown: Column) -> Column:
    """What `hidden_removed` leaves, split at block ends and line breaks. White space at the ends and empty texts
    stay in: what is read of it are word counts."""
    c = F.regexp_replace(shown, rf"(?i)<br{WS}*/?>", "\n\n")
    c = F.regexp_replace(c, rf"(?i)</(p|div|li|h[1-6]|blockquote|tr|section|article|td){WS}*>", "\n\n")
    return F.split(F.regexp_replace(c, "<[^>]+>", " "), f"\n{WS}*\n+")


def text_paragraphs(text: Column) -> Column:
    """The same split for text that is prose already."""
    parts = F.transform(
        F.split(text, f"\n{WS}*\n+"),
        lambda p: F.regexp_replace(F.regexp_replace(p, "[ \t]+", " "), f"^{WS}+|{WS}+$", ""),
    )
    return F.filter(parts, lambda p: p != "")


def attr(tag: Column, name: str) -> Column:
    """Quoted attribute value of a tag, or null when the tag has none."""
    return first_match(tag, rf"(?i){WS}{name}{WS}*={WS}*{Q}([^\"']*){Q}", 1)


def meta_content(head: Column, name: str) -> Column:
    """`content` of the first meta tag named (or with the property) `name`."""
    escaped = name.replace(".", r"\.")
    tag = F.regexp_extract(head, rf"(?i)<meta\b[^>]*(?:name|property){WS}*={WS}*{Q}{escaped}{Q}[^>]*>", 0)
    return attr(tag, "content")


def meta_description(head: Column) -> Column:
    """Trimmed description, null when absent or empty."""
    text = F.regexp_replace(meta_content(head, "description"), f"^{WS}+|{WS}+$", "")
    return F.when(text != "", text)


def title_of(html: Column) -> Column:
    return F.coalesce(strip_tags(first_match(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def first_doctype(html: Column) -> Column:
    return first_match(html, f"(?i)^{WS}*(<!doctype[^>]*>)", 1)


def is_html(body: Column, content_type: Column) -> Column:
    return matches(content_type, "(?i)text/html") | matches(body, rf"(?i)<html[{WS[1:-1]}>]")


def meta_tag_present(head: Column, name: str) -> Column:
    return matches(head, rf"(?i)<meta\b[^>]*name{WS}*={WS}*{Q}{name}{Q}")


def header(name: str) -> Column:
    """Response header by lower-case name, empty text when absent."""
    return F.coalesce(F.try_element_at(F.col("headers"), F.lit(name)), F.lit(""))


def tag_chunks(html: Column, tag: str) -> Column:
    """Array of (tag text, text before it) for every `<tag ...>`, in document order."""
    return let(
        F.split(html, rf"(?i)(?=<{tag}\b)"),
        lambda parts: F.filter(
            F.transform(
                parts,
                lambda part, i: F.struct(
                    F.regexp_extract(part, rf"(?i)^<{tag}\b[^>]*>", 0).alias("tag"),
                    F.array_join(F.slice(parts, 1, i), "").alias("before"),
                ),
            ),
            lambda p: p["tag"] != "",
        ),
    )


def _last_start(before: Column, lower: Column, sign: str, pattern: str) -> Column:
    """Start of the last match of `pattern`, or -1. A text without the sign in lower case has no match."""
    start = F.length(F.regexp_extract(F.concat(F.lit("."), before), rf"(?is)^(.+){pattern}", 1)) - 1
    return F.when(lower.contains(sign), start).otherwise(F.lit(-1))


def region_at(before: Column) -> Column:
    """Innermost landmark opened and not yet closed in the text before a position."""
    found = lambda low: F.array(
        *[
            F.struct(
                _last_start(before, low, f"<{t}", rf"<{t}\b").alias("pos"),
                F.lit(-i).alias("order"),
                _last_start(before, low, f"</{t}>", f"</{t}>").alias("closed"),
                F.lit(t).alias("name"),
            )
            for i, t in enumerate(LANDMARKS)
        ]
    )
    open_ones = F.filter(let(F.lower(before), found), lambda r: (r["pos"] >= 0) & (r["pos"] > r["closed"]))
    return F.array_max(open_ones)["name"]


def heading_at(before: Column) -> Column:
    """Text of the nearest h1-h4 before a position, cut at 60 characters."""
    inner = find_all(before, r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]>", 1)
    text = F.substring(strip_tags(F.try_element_at(inner, F.lit(-1))), 1, 60)
    return F.when(text != "", text)


def section_at(before: Column) -> Column:
    """Readable page location: heading, landmark, or both."""

    def label(at: Column) -> Column:
        inside = F.coalesce(F.concat(F.lit(" ("), at["region"], F.lit(")")), F.lit(""))
        return F.when(
            at["heading"].isNotNull(), F.concat(F.lit("“"), at["heading"], F.lit("”"), inside)
        ).otherwise(F.coalesce(at["region"], F.lit("—")))

    return let(F.struct(heading_at(before).alias("heading"), region_at(before).alias("region")), label)


def image_source(tag: Column) -> Column:
    src, data_src = attr(tag, "src"), attr(tag, "data-src")
    return F.coalesce(F.when(src != "", src), F.when(data_src != "", data_src), F.lit(""))


def image_id(tag: Column) -> Column:
    """Short image identity: file name, else alt text, else the tag itself."""
    srcset = F.element_at(F.split(F.coalesce(attr(tag, "srcset"), F.lit("")), "[ ,]"), 1)
    source = F.when(image_source(tag) != "", image_source(tag)).otherwise(srcset)
    path = F.regexp_replace(source, "[?#].*$", "")
    file = F.element_at(F.split(path, "/"), -1)
    alt = attr(tag, "alt")
    return (
        F.when(source != "", F.substring(F.when(file != "", file).otherwise(source), 1, 80))
        .when(alt != "", F.concat(F.lit('[alt="'), F.substring(alt, 1, 40), F.lit('"]')))
        .otherwise(F.substring(tag, 1, 60))
    )


# Attribute pair as written in a tag (name, then one of three value forms).
ATTR_PAIR = "([a-zA-Z_:][-a-zA-Z0-9_:.]*)" + f"{WS}*={WS}*" + "(\"[^\"]*\"|'[^']*'|[^\t\n\x0b\x0c\r >\"']+)"


def attr_map(tag_body: Column) -> Column:
    """All attributes of a tag body as a map; a later duplicate wins, bare disabled/hidden count as empty."""
    pairs = F.zip_with(
        find_all(tag_body, ATTR_PAIR, 1),
        find_all(tag_body, ATTR_PAIR, 2),
        lambda n, v: F.struct(F.lower(n).alias("k"), F.regexp_replace(v, "^[\"']|[\"']$", "").alias("v")),
    )
    bare = F.transform(
        F.array_distinct(
            F.transform(find_all(tag_body, rf"(?i)(?:^|{WS})(disabled|hidden)(?={WS}|$|/)", 1), F.lower)
        ),
        lambda b: F.struct(b.alias("k"), F.lit("").alias("v")),
    )
    # bare ones first: a written value of the same attribute comes later and wins
    return let(
        F.concat(bare, pairs),
        lambda all_: F.map_from_entries(
            F.filter(
                all_,
                lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["k"] == p["k"]),
            )
        ),
    )
