"""Inventory of a site: pages, sections, shared components, assets, forms, behaviours; stable ids.

An item is (site, scan_id, type, identity_key, meta map). The first page that shows an item, in
crawl order, is kept with a partial minimum, so no list of pages is ever gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegate.functions import html as H
from pagegate.functions.text import WS, collapse_ws, let, slug
from pagegate.functions.urls import basename, path_of
from pagegate.operators.page_ctx import KEYS, html_pages
from pagegate.operators.prefix import rank_within

C, Q = F.col, H.Q

# Item types in the order ids are minted, with their id prefix.
PREFIX = {
    "page": "PAGE", "section": "SECTION", "component": "COMP", "global": "GLOBAL", "asset": "ASSET",
    "form": "FORM", "behavior": "BEHAVIOR",
}


def _class(words: str) -> str:
    return rf"class{WS}*={WS}*{Q}[^\"']*(?:{words})[^\"']*{Q}"


def _role(name: str) -> str:
    return rf"role{WS}*={WS}*{Q}{name}{Q}"


# Asset roles and where their source stands.
ASSETS = (
    ("image", rf"(?i)<img\b[^>]*?{WS}src{WS}*={WS}*{Q}([^\"']+){Q}"),
    ("image", rf"(?i)<img\b[^>]*?{WS}data-src{WS}*={WS}*{Q}([^\"']+){Q}"),
    ("bg-image", rf"(?i)url\({WS}*{Q}?([^\"')]+\.(?:png|jpe?g|webp|avif|gif|svg)){Q}?{WS}*\)"),
    ("svg-file", rf"(?i){WS}src{WS}*={WS}*{Q}([^\"']+\.svg){Q}"),
    ("favicon", rf"(?i)<link\b[^>]*rel{WS}*={WS}*{Q}[^\"']*icon[^\"']*{Q}[^>]*href{WS}*={WS}*{Q}([^\"']+){Q}"),
    ("app-icon", rf"(?i)<link\b[^>]*rel{WS}*={WS}*{Q}apple-touch-icon{Q}[^>]*href{WS}*={WS}*{Q}([^\"']+){Q}"),
    ("manifest", rf"(?i)<link\b[^>]*rel{WS}*={WS}*{Q}manifest{Q}[^>]*href{WS}*={WS}*{Q}([^\"']+){Q}"),
    ("font", rf"(?i){Q}([^\"']+\.(?:woff2?|ttf|otf|eot)){Q}"),
    ("video", rf"(?i)<(?:video|source)\b[^>]*{WS}src{WS}*={WS}*{Q}([^\"']+\.(?:mp4|webm|ogg)){Q}"),
    ("document", rf"(?i)<a\b[^>]*{WS}href{WS}*={WS}*{Q}([^\"']+\.(?:pdf|docx?|xlsx?|pptx?|zip|csv))(?:[\"'?#])"),
    ("og-image", rf"(?i)<meta\b[^>]*property{WS}*={WS}*{Q}og:image{Q}[^>]*content{WS}*={WS}*{Q}([^\"']+){Q}"),
)

# Signs of components every page shares. Patterns without (?i) are case sensitive.
GLOBALS = {
    "header": rf"(?i)<header[{WS[1:-1]}>]|" + _role("banner"),
    "footer": rf"(?i)<footer[{WS[1:-1]}>]|" + _role("contentinfo"),
    "nav": rf"(?i)<nav[{WS[1:-1]}>]|" + _role("navigation"),
    "mobile-nav": "(?i)" + _class("hamburger|menu-toggle|mobile-menu|navbar-toggle|nav-toggle")
    + rf"|aria-label{WS}*={WS}*{Q}[^\"']*menu[^\"']*{Q}",
    "mega-menu": "(?i)" + _class("mega-?menu"),
    "sticky-header": "(?i)" + _class("sticky|fixed-header|header--fixed|is-sticky|is-fixed"),
    "announcement-bar": "(?i)" + _class("announce|announcement|top-?bar|promo-?bar|notification-?bar|utility-?bar"),
    "cookie-banner": "(?i)" + _class("cookie|consent")
    + rf"|id{WS}*={WS}*{Q}[^\"']*(?:cookie|onetrust|cookiebot|termly|osano|iubenda)[^\"']*{Q}",
    "newsletter-popup": "(?is)" + _class("newsletter") + ".{0,400}(?:popup|modal)|" + _class("popup|modal") + ".{0,400}newsletter",
    "chat-widget": r"(?i)intercom|drift\.com|tawk\.to|crisp\.chat|zendesk|livechat|hubspot-messages|tidio|widget\.freshworks",
    "whatsapp": r"(?i)wa\.me/|api\.whatsapp\.com",
    "messenger": r"(?i)m\.me/|facebook\.com/messages|fb-customerchat",
    "phone-button": rf"(?i)href{WS}*={WS}*{Q}tel:",
    "email-button": rf"(?i)href{WS}*={WS}*{Q}mailto:",
    "back-to-top": "(?i)" + _class("back-to-top|scroll-to-top|scrolltop|to-top"),
    "a11y-widget": "(?i)userway|accessibe|acsb|" + _class("accessibility-widget"),
    "language-switcher": "(?i)" + _class("lang-switch|language-select|lang-selector")
    + rf"|rel{WS}*={WS}*{Q}alternate{Q}[^>]*hreflang",
    "theme-toggle": "(?i)" + _class("theme-toggle|dark-mode|color-scheme-toggle"),
    "search-overlay": "(?i)" + _class("search-overlay|search-modal"),
    "account-menu": "(?i)" + _class("my-account|account-menu"),
    "mini-cart": "(?i)" + _class("mini-?cart|cart-drawer"),
    "wishlist": "(?i)" + _class("wishlist"),
    "currency-selector": "(?i)" + _class("currency"),
    "analytics-ga4": r"gtag\(|googletagmanager\.com/gtag|\bG-[A-Z0-9]{6,}\b",
    "tag-manager": r"googletagmanager\.com/gtm|GTM-[A-Z0-9]{4,}",
    "facebook-pixel": r"connect\.facebook\.net|fbq\(",
    "linkedin": r"snap\.licdn\.com|_linkedin_partner_id",
    "tiktok": r"analytics\.tiktok\.com|ttq\.",
}

# Signs of behaviours.
BEHAVIORS = {
    "sticky-header": GLOBALS["sticky-header"],
    "accordion": "(?i)" + _class("accordion") + rf"|<details[{WS[1:-1]}>]",
    "tabs": "(?i)" + _class(r"\btabs?\b") + "|" + _role("tab"),
    "carousel": "(?i)" + _class("carousel|slider|swiper|slick|splide|glide|flickity"),
    "modal": "(?i)" + _class("modal") + "|" + _role("dialog"),
    "drawer": "(?i)" + _class("drawer|offcanvas|off-canvas"),
    "search-overlay": GLOBALS["search-overlay"],
    "video-playback": rf"(?i)<video[{WS[1:-1]}>]|youtube\.com/embed|player\.vimeo\.com",
    "dropdown": "(?i)" + _class("dropdown"),
    "mega-menu": GLOBALS["mega-menu"],
    "infinite-scroll": "(?i)" + _class("infinite") + "|data-infinite",
    "pagination": "(?i)" + _class("pagination|pager") + rf"|rel{WS}*={WS}*{Q}next{Q}",
    "lazy-load": rf"(?i)loading{WS}*={WS}*{Q}lazy{Q}|data-lazy",
    "back-to-top": GLOBALS["back-to-top"],
    "cookie-banner": GLOBALS["cookie-banner"],
    "theme-switch": GLOBALS["theme-toggle"],
    "language-switch": GLOBALS["language-switcher"],
}

# Words in lower case of which each match of a sign has at least one. A search for a word costs far less than a pattern.
WORDS = {
    "header": "<header banner", "footer": "<footer contentinfo", "nav": "<nav navigation",
    "mobile-nav": "hamburger menu navbar-toggle nav-toggle", "mega-menu": "mega", "sticky-header": "sticky fixed",
    "announcement-bar": "announce top promo notification utility", "cookie-banner": "cookie consent onetrust termly osano iubenda",
    "newsletter-popup": "newsletter", "chat-widget": "intercom drift.com tawk.to crisp.chat zendesk livechat hubspot-messages tidio widget.freshworks",
    "whatsapp": "wa.me/ api.whatsapp.com", "messenger": "m.me/ facebook.com/messages fb-customerchat", "phone-button": "tel:",
    "email-button": "mailto:", "back-to-top": "to-top scrolltop", "a11y-widget": "userway accessibe acsb accessibility-widget",
    "language-switcher": "lang-switch language-select lang-selector hreflang", "theme-toggle": "theme-toggle dark-mode color-scheme-toggle",
    "search-overlay": "search-overlay search-modal", "account-menu": "my-account account-menu", "mini-cart": "mini cart-drawer",
    "wishlist": "wishlist", "currency-selector": "currency", "analytics-ga4": "gtag( googletagmanager.com/gtag g-",
    "tag-manager": "googletagmanager.com/gtm gtm-", "facebook-pixel": "connect.facebook.net fbq(",
    "linkedin": "snap.licdn.com _linkedin_partner_id", "tiktok": "analytics.tiktok.com ttq.",
    "accordion": "accordion <details", "tabs": "tab", "carousel": "carousel slider swiper slick splide glide flickity",
    "modal": "modal dialog", "drawer": "drawer offcanvas off-canvas", "video-playback": "<video youtube.com/embed player.vimeo.com",
    "dropdown": "dropdown", "infinite-scroll": "infinite", "pagination": "pagination pager next", "lazy-load": "lazy",
    "theme-switch": "theme-toggle dark-mode color-scheme-toggle", "language-switch": "lang-switch language-select lang-selector hreflang",
}
ASSET_WORDS = (
    "<img", "data-src", "url(", ".svg", "icon", "apple-touch-icon", "manifest", ".woff .ttf .otf .eot", ".mp4 .webm .ogg",
    ".pdf .doc .xls .ppt .zip .csv", "og:image",
)


def _may_hold(words: str) -> Column:
    """Whether the page, in lower case, has one of the words."""
    some = [C("low").contains(w) for w in words.split()]
    return reduce(lambda a, b: a | b, some)


def _meta(**entries) -> Column:
    parts = []
    for k, v in entries.items():
        parts += [F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string")]
    return F.create_map(*parts)


ROW = "array<struct<type:string,identity_key:string,pos:int,meta:map<string,string>>>"


def _row(type_: str, key: Column, pos: Column, meta: Column) -> Column:
    return F.struct(
        F.lit(type_).alias("type"), key.alias("identity_key"), pos.cast("int").alias("pos"), meta.alias("meta")
    )


def _page() -> Column:
    path = path_of(C("url"))
    return F.array(
        _row("page", F.concat(F.lit("page:"), path), F.lit(0), _meta(url=C("url"), path=path, status=C("status")))
    )


def _sections() -> Column:
    """Headings h1 to h3. A heading without letters or digits is named by its place among the page's."""
    tag = r"(?is)<h([1-3])\b[^>]*>(.*?)</h\1>"
    heads = F.zip_with(
        H.find_all(C("body"), tag, 1),
        H.find_all(C("body"), tag, 2),
        lambda lv, t: F.struct(
            lv.alias("level"), F.substring(collapse_ws(F.regexp_replace(t, "<[^>]+>", " ")), 1, 60).alias("text")
        ),
    )

    def named(h: Column, i: Column) -> Column:
        name = F.when(slug(h["text"]) != "", slug(h["text"])).otherwise(F.concat(F.lit("h"), i + 1))
        return _row(
            "section", F.concat(F.lit("section:"), C("path"), F.lit("#"), name), i,
            _meta(url=C("url"), path=C("path"), heading=h["text"], level=h["level"]),
        )

    return F.transform(F.filter(heads, lambda h: h["text"] != ""), named)


def _asset_role(n: int, role: str, pattern: str, words: str) -> Column:
    def asset(src: Column, i: Column) -> Column:
        file = basename(src)
        return _row(
            "asset", F.concat(F.lit(f"asset:{role}:"), file), F.lit(n * 100000) + i,
            _meta(role=role, filename=file, src=F.substring(src, 1, 160), firstPage=C("url")),
        )

    found = F.when(_may_hold(words), H.find_all(C("body"), pattern, 1)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(found, asset), lambda a: a["meta"]["filename"] != "")


def _assets() -> Column:
    return F.flatten(F.array(*[_asset_role(n, *asset, words) for n, (asset, words) in enumerate(zip(ASSETS, ASSET_WORDS, strict=True))]))


def _signals(signals: dict[str, str], type_: str) -> Column:
    found = F.array(
        *[
            F.when(_may_hold(WORDS[k]) & H.matches(C("body"), p), _row(type_, F.lit(f"{type_}:{k}"), F.lit(0), _meta(key=k, firstPage=C("url"))))
            for k, p in signals.items()
        ]
    )
    return F.filter(found, lambda k: k.isNotNull())


def form_kind(form: Column, text: Column, fields: Column) -> Column:
    """What a form is for, from its markup; the first sign that fits decides."""
    password = form.rlike(rf"(?i)type{WS}*={WS}*{Q}password{Q}")
    return (
        F.when(password & text.rlike("register|signup|sign-up|create.account"), "registration")
        .when(password, "login")
        .when(text.rlike("checkout|payment|billing|card-number"), "checkout")
        .when(text.rlike("booking|appointment|reserve|schedule"), "booking")
        .when(text.rlike("quote|estimate"), "quote")
        .when(text.rlike("newsletter|subscribe") | ((fields <= 2) & text.rlike("email")), "newsletter")
        .when(form.rlike(rf"(?i)type{WS}*={WS}*{Q}search{Q}|role{WS}*={WS}*{Q}search{Q}|name{WS}*={WS}*{Q}[qs]{Q}"), "search")
        .when(text.rlike("message|comment|enquir|inquir|contact"), "contact")
        .otherwise("form")
    )


def _forms() -> Column:
    def facts(form: Column) -> Column:
        return F.struct(
            form.alias("form"),
            F.regexp_extract(form, rf"(?i){WS}action{WS}*={WS}*{Q}([^\"']*){Q}", 1).alias("action"),
            F.regexp_count(form, F.lit(r"(?i)<(input|select|textarea)\b[^>]*>")).alias("fields"),
        )

    def form_row(f: Column, i: Column) -> Column:
        kind = form_kind(f["form"], F.lower(F.concat(f["form"], F.lit(" "), f["action"])), f["fields"])
        shared = (f["action"] != "") & ~f["action"].rlike(rf"(?i)^{WS}*(javascript:|#|void)")
        place = F.when(shared, path_of(f["action"])).otherwise(F.concat(C("path"), F.lit("#"), i))
        return let(
            kind,
            lambda k: _row(
                "form",
                F.when(k == "search", "form:search").otherwise(F.concat(F.lit("form:"), k, F.lit(":"), place)),
                i,
                _meta(
                    formType=k, action=f["action"], fieldCount=f["fields"],
                    hasValidation=f["form"].rlike(rf"(?i)\brequired\b|{WS}pattern{WS}*="), page=C("url"),
                ),
            ),
        )

    return F.transform(F.transform(H.find_all(C("body"), r"(?is)<form\b.*?</form>"), facts), form_row)


PROVIDERS = {
    "page": _page,
    "section": _sections,
    "global": lambda: _signals(GLOBALS, "global"),
    "asset": _assets,
    "form": _forms,
    "behavior": lambda: _signals(BEHAVIORS, "behavior"),
}
_BUILT: dict[tuple, Column] = {}


def _provider(type_: str) -> Column:
    key = (id(SparkContext._gateway), type_)
    if key not in _BUILT:
        _BUILT[key] = PROVIDERS[type_]().cast(ROW)
    return _BUILT[key]


def inventory(crawl: DataFrame, types: tuple[str, ...] = tuple(PROVIDERS)) -> DataFrame:
    """Every item of every site, from one reading of the pages and one shuffle.

    The first page that shows an item, in crawl order, is kept; sections carry their page as parent.
    """
    pages = html_pages(crawl).select(*KEYS, "url", "ord", "status", "body", F.lower("body").alias("low"), path_of(C("url")).alias("path"))
    shown = pages.select(*KEYS, "url", "ord", F.inline(F.concat(*[_provider(t) for t in types])))
    first = shown.groupBy(*KEYS, "type", "identity_key").agg(
        F.min_by(F.struct("meta", "url"), F.struct("ord", "pos")).alias("m")
    )
    parent = F.when(C("type") == "section", F.concat(F.lit("page:"), C("m.meta")["path"]))
    return first.select(
        *KEYS, "type", "identity_key", C("m.url").alias("page"), C("m.meta").alias("meta"), parent.alias("parent")
    )


def inventory_counts(items: DataFrame) -> DataFrame:
    """Items per type and, with a null type, in total."""
    return items.rollup(*KEYS, "type").agg(F.count("*").alias("items"), F.grouping_id().alias("level")).filter("level <= 1").drop("level")


def page_children(items: DataFrame) -> DataFrame:
    """Page to section edges, one row each, so a page's children are never one array."""
    sections = items.filter("type = 'section'").select(*KEYS, C("parent").alias("page_key"), C("identity_key").alias("child"))
    pages = items.filter("type = 'page'").select(*KEYS, C("identity_key").alias("page_key"))
    return sections.join(pages, [*KEYS, "page_key"])


# What may not be lost in a migration.
CONTENT_ROLES = ("image", "document", "video", "og-image", "logo")
CORE_GLOBALS = ("header", "footer", "nav", "cookie-banner")


def is_blocking(type_: Column, meta: Column) -> Column:
    return (
        type_.isin("page", "form")
        | ((type_ == "asset") & meta["role"].isin(*CONTENT_ROLES))
        | ((type_ == "global") & meta["key"].isin(*CORE_GLOBALS))
    )


def mint_ids(items: DataFrame, ledger: DataFrame, scope: list[str]) -> DataFrame:
    """Stable ids: a known identity keeps its id, new ones continue each prefix in key order.

    `ledger` holds (scope, type, identity_key, id). Ranks come from ordered blocks, so one site may
    hold most of the new items. Returns the ledger rows to append.
    """
    keys = items.select(*scope, "type", "identity_key").distinct()
    fresh = keys.join(ledger.select(*scope, "identity_key"), [*scope, "identity_key"], "left_anti")
    top = ledger.groupBy(*scope, "type").agg(
        F.max(F.regexp_extract("id", "-([0-9]+)$", 1).cast("long")).alias("top")
    )
    ranked = rank_within(fresh, [*scope, "type"], ["identity_key"], "rank")
    names = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])
    number = C("rank") + F.coalesce(C("top"), F.lit(0))
    return ranked.join(top, [*scope, "type"], "left").select(
        *scope, "type", "identity_key", F.format_string("%s-%03d", names[C("type")], number).alias("id")
    )
