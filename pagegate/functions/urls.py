"""Column functions over URLs, written as rules rather than a parser call per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegate.functions.html import first_match, matches
from pagegate.functions.text import WS, js_trim, let

# Host names that look like a staging or preview site.
STAGING_HOST = r"(?i)\b(?:[A-Za-z0-9_-]+\.)*(?:staging|qa[0-9]?|dev|preview|test)\.[a-z0-9-]+\.[a-z]{2,}\b"
STAGING_SITE = r"(?i)(^|\.)(staging|qa[0-9]?|dev|preview|test|uat)\."

# File endings that are never a page.
ASSET_URL = r"(?i)\.(png|jpe?g|gif|webp|svg|pdf|zip|mp4|mp3|css|js|ico|woff2?|ttf)(\?|$)"

# Characters a URL path keeps as written, with the form `url_encode` gives them.
PATH_KEEPS = "!$&'()*+,/:;=@[]|\\^~%"


def origin_of(url: Column) -> Column:
    return F.lower(first_match(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"))


def host_of(url: Column) -> Column:
    """Authority with its port, lower case; null when the text is not an absolute URL."""
    return F.lower(first_match(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))


def raw_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_of(url: Column) -> Column:
    """Path without trailing slashes, '/' for the root; text that is no URL stays as it is."""
    path = let(
        percent_path(raw_path(url)),
        lambda p: F.coalesce(F.nullif(F.regexp_replace(p, "/+$", ""), F.lit("")), F.lit("/")),
    )
    return F.when(host_of(url).isNull(), url).otherwise(path)


def percent_path(path: Column) -> Column:
    """Percent-encodes what a URL path may not carry (spaces, quotes, non-ASCII)."""

    def encode(p: Column) -> Column:
        enc = F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))
        for ch in PATH_KEEPS:
            enc = F.replace(enc, F.lit("%%%02X" % ord(ch)), F.lit(ch))
        return F.when(p.rlike(r"[^!#-;=?-_a-z|~]"), enc).otherwise(p)

    return let(path, encode)


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def _without_dots(path: Column) -> Column:
    """Resolves `.` and `..` segments of an absolute path."""

    def resolve(p: Column) -> Column:
        kept = F.aggregate(
            F.split(F.substring(p, 2, 1 << 30), "/"),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(s))),
        )
        closed = F.when(p.rlike(r"/\.\.?$"), "/").otherwise("")
        joined = F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), closed), "^/+$", "/")
        return F.when(p.rlike(r"/\.\.?(/|$)"), joined).otherwise(p)

    return let(path, resolve)


def abs_url(ref: Column, base: Column) -> Column:
    """`ref` resolved against the page it stands on; null when it cannot be one.

    The three parts (origin, path, query and fragment) are chosen by the form of the reference and
    put together once.
    """

    def resolve(r: Column) -> Column:
        base_path = raw_path(base)
        own_path = F.when(base_path == "", "/").otherwise(base_path)
        folder = F.when(base_path == "", "/").otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
        web = r.rlike("(?i)^https?://[^/?#]+")
        with_host = r.startswith("//")
        bare = (r == "") | r.startswith("#")
        origin = (
            F.when(web, origin_of(r))
            .when(with_host, F.lower(F.concat(F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:", 0), F.regexp_extract(r, "^//[^/?#]*", 0))))
            .otherwise(origin_of(base))
        )
        path = (
            F.when(web, F.regexp_replace(raw_path(r), "^$", "/"))
            .when(with_host, F.regexp_replace(F.regexp_extract(r, "^//[^/?#]*([^?#]*)", 1), "^$", "/"))
            .when(bare | r.startswith("?"), own_path)
            .when(r.startswith("/"), F.regexp_extract(r, "^[^?#]*", 0))
            .otherwise(F.concat(folder, F.regexp_extract(r, "^[^?#]*", 0)))
        )
        kept_query = F.when(bare, F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)).otherwise("")
        rest = F.concat(kept_query, F.regexp_replace(r, "(?s)^[^?#]*", ""))
        other_scheme = r.rlike("(?i)^[a-z][a-z0-9+.-]*:") & ~web
        return (
            F.when(other_scheme, F.when(~r.rlike("(?i)^https?:"), r))
            .otherwise(F.concat(origin, percent_path(_without_dots(path)), rest))
        )

    return let(js_trim(ref), resolve)


def resolved_host(ref: Column, base: Column) -> Column:
    """Host a reference leads to; relative references stay on the page's host."""
    return F.coalesce(
        host_of(js_trim(ref)), F.lower(first_match(js_trim(ref), "^//([^/?#]+)", 1)), host_of(base)
    )


def normalize_url(url: Column) -> Column:
    """Origin and path without trailing slash; other text is only trimmed."""
    full = F.concat(origin_of(url), percent_path(raw_path(url)))
    return (
        F.when(url.isNull() | (url == ""), F.lit(""))
        .when(origin_of(url).isNull(), js_trim(url))
        .otherwise(F.regexp_replace(full, "/+$", ""))
    )


def same_host(url: Column, host: Column) -> Column:
    return F.coalesce(host_of(url) == F.lower(host), F.lit(False))


def same_path(a: Column, b: Column) -> Column:
    return path_of(a) == path_of(abs_url(b, a))


def is_staging_host(host: Column) -> Column:
    return matches(host, STAGING_HOST)


def detect_env(host: Column) -> Column:
    return F.when(matches(host, STAGING_SITE), F.lit("staging")).otherwise(F.lit("live"))


def page_family(url: Column) -> Column:
    """Template family: first path segment and depth. The home page is `@0`."""
    segs = F.filter(F.split(F.regexp_replace(percent_path(raw_path(url)), "/+$", ""), "/"), lambda s: s != "")
    return (
        F.when(host_of(url).isNull(), F.lit("zz-unparsable@9"))
        .when(F.size(segs) == 0, F.lit("@0"))
        .otherwise(F.concat(F.lower(F.try_element_at(segs, F.lit(1))), F.lit("@"), F.size(segs).cast("string")))
    )


def family_depth(family: Column) -> Column:
    return F.regexp_extract(family, "@([0-9]+)$", 1).cast("int")


def basename(ref: Column) -> Column:
    """Lower-case file name of a reference, cut at 80 characters; the text itself when it names no file."""
    path = F.regexp_replace(F.regexp_replace(ref, "(?s)[?#].*$", ""), "(?i)^[a-z][a-z0-9+.-]*://[^/]*", "")
    file = percent_path(F.element_at(F.split(path, "/"), -1))
    return F.substring(F.lower(F.when(file != "", file).otherwise(ref)), 1, 80)


# ---- per-scheme validity -------------------------------------------------------------------

# Address and number forms.
EMAIL = "^[^@" + WS[1:-1] + "]+@[^@." + WS[1:-1] + r"]+(\.[^@." + WS[1:-1] + "]+)+$"
PHONE = r"^\+?[0-9][0-9()\-." + WS[1:-1] + "]{4,}$"
JS_NOOP = rf"(?i)^javascript:{WS}*(void{WS}*\({WS}*0{WS}*\)|;?){WS}*$"


def uri_scheme(uri: Column) -> Column:
    return F.lower(first_match(js_trim(uri), "(?i)^([a-z][a-z0-9+.-]*):", 1))


def _uri_verdict(name, valid: bool, level: str, reason) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(name).cast("string").alias("scheme"),
        F.lit(valid).alias("valid"),
        F.lit(level).alias("level"),
        as_col(reason).alias("reason"),
    )


def validate_uri(uri: Column) -> Column:
    """Struct (scheme, valid, level, reason) for one link target."""
    ok = lambda name, reason: _uri_verdict(name, True, "ok", reason)
    bad = lambda name, reason: _uri_verdict(name, False, "invalid", reason)

    def check(u: Column) -> Column:
        raw, scheme, after = u["raw"], u["scheme"], u["after"]
        address = F.element_at(F.split(after, r"\?"), 1)
        bad_mail = F.filter(F.transform(F.split(address, ","), js_trim), lambda a: ~a.rlike(EMAIL))
        well_formed = raw.rlike(f"(?i)^(https?|ftp)://[^/?#{WS[1:-1]}]+[^{WS[1:-1]}]*$|^blob:")
        number = F.when(address == "", "(empty)").otherwise(address)
        return (
            F.when(raw == "", bad(None, "empty URI"))
            .when(raw == "#", bad(None, 'fragment-only "#" (no target)'))
            .when(scheme.isNull() & raw.startswith("#"), ok("fragment", "in-page anchor"))
            .when(scheme.isNull(), ok("relative", "relative URL"))
            .when(scheme.isin("http", "https", "ftp", "blob") & well_formed, ok(scheme, "well-formed"))
            .when(
                scheme.isin("http", "https", "ftp", "blob"),
                bad(scheme, F.concat(F.lit("malformed "), scheme, F.lit(" URL"))),
            )
            .when((scheme == "mailto") & (address == ""), bad(scheme, "mailto with no address"))
            .when(
                (scheme == "mailto") & (F.size(bad_mail) > 0),
                bad(scheme, F.concat(F.lit("invalid email: "), F.try_element_at(bad_mail, F.lit(1)))),
            )
            .when(scheme == "mailto", ok(scheme, "valid mailto"))
            .when(scheme.isin("tel", "sms") & address.rlike(PHONE), ok(scheme, F.concat(F.lit("valid "), scheme)))
            .when(scheme.isin("tel", "sms"), bad(scheme, F.concat(F.lit("invalid phone number: "), number)))
            .when(
                (scheme == "javascript") & raw.rlike(JS_NOOP), bad(scheme, "javascript: no-op (dead control)")
            )
            .when(
                scheme == "javascript",
                _uri_verdict(scheme, True, "warning", "javascript: URI — inline handler, prefer real handler"),
            )
            .when(scheme == "data", _uri_verdict(scheme, True, "informational", "data: URI (inline payload)"))
            .otherwise(bad(scheme, F.concat(F.lit("unsupported scheme: "), scheme)))
        )

    raw = F.coalesce(js_trim(uri), F.lit(""))
    parts = F.struct(
        raw.alias("raw"),
        uri_scheme(raw).alias("scheme"),
        F.regexp_replace(raw, "(?i)^[a-z][a-z0-9+.-]*:", "").alias("after"),
    )
    return let(parts, check)


def is_dead_target(uri: Column) -> Column:
    """Empty, a bare `#`, or a javascript no-op: nothing a click could reach."""
    raw = js_trim(uri)
    return (raw == "") | (raw == "#") | raw.rlike(JS_NOOP)
