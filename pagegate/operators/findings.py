"""Findings from detectors.

A detector is a function `env-aware context -> [Hit, ...]`. All chosen detectors become one array
expression per page that `inline` flattens, so the HTML is read once however many rules run and no
shuffle happens before findings exist.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegate.functions.text import let

ITEM = "struct<id:string,section:string,value:string>"
ITEMS = f"array<{ITEM}>"


class Hit(NamedTuple):
    rule_id: str | Column
    section: str
    when: Column
    detail: str | Column = ""
    value: str | Column = ""
    items: Column | None = None


class Listed(NamedTuple):
    """A finding of pages on which something is listed. The list is made once, however often the finding reads it."""

    rule_id: str
    section: str
    when: Column
    listed: Column
    detail: Callable[[Column], Column]
    value: Callable[[Column], Column] | None = None
    items: bool = True


class Detector(NamedTuple):
    check_id: str
    hits: Callable[[], Iterable[Hit | Listed]]
    many: Callable[[], Column] | None = None  # array of findings for rules that fire repeatedly


FINDING_STRUCT = f"struct<rule_id:string,check_id:string,section:string,detail:string,value:string,items:{ITEMS}>"


def as_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def item(id_: Column | str, section: Column | str, value: Column | str) -> Column:
    return F.struct(
        as_col(id_).cast("string").alias("id"),
        as_col(section).cast("string").alias("section"),
        as_col(value).cast("string").alias("value"),
    )


def text(*parts) -> Column:
    return F.concat(*[as_col(p).cast("string") for p in parts])


def _finding(check_id: str, hit: Hit | Listed) -> Column:
    if isinstance(hit, Listed):
        return let(
            F.when(hit.when, hit.listed),
            lambda x: _finding(
                check_id,
                Hit(
                    hit.rule_id, hit.section, F.size(x) > 0, hit.detail(x), hit.value(x) if hit.value else "",
                    x if hit.items else None,
                ),
            ),
        )
    row = F.struct(
        as_col(hit.rule_id).alias("rule_id"),
        F.lit(check_id).alias("check_id"),
        F.lit(hit.section).alias("section"),
        as_col(hit.detail).cast("string").alias("detail"),
        as_col(hit.value).cast("string").alias("value"),
        (hit.items if hit.items is not None else F.lit(None)).cast(ITEMS).alias("items"),
    )
    return F.when(hit.when, row)


_BUILT: dict[tuple, Column] = {}


def _built(d: Detector) -> Column:
    """The detector's findings as one array column. Columns are unresolved expressions, so one built
    for a session's JVM serves every query of it; building them anew is most of a query's planning."""
    key = (id(SparkContext._gateway), d)
    if key not in _BUILT:
        if d.many is not None:
            _BUILT[key] = d.many().cast(f"array<{FINDING_STRUCT}>")
        else:
            _BUILT[key] = F.array(*[_finding(d.check_id, h) for h in d.hits()])
    return _BUILT[key]


def detect(ctx: DataFrame, detectors: Iterable[Detector], keep: Iterable[str] = ()) -> DataFrame:
    """Runs the chosen detectors over a page context in one pass."""
    groups = [_built(d) for d in detectors]
    every = F.concat(*groups) if len(groups) > 1 else groups[0]
    found = F.filter(every, lambda f: f.isNotNull())
    return ctx.select("site", "scan_id", "url", "ord", *keep, F.inline(found))


def site_finding(
    df: DataFrame, rule_id: str, check_id: str, section: str, url: Column, detail: Column | str, value: Column | str = ""
) -> DataFrame:
    """Rows of a site-level rule in the shape every finding has."""
    return df.select(
        "site",
        "scan_id",
        url.alias("url"),
        F.lit(0).alias("ord"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(check_id).alias("check_id"),
        F.lit(section).alias("section"),
        as_col(detail).cast("string").alias("detail"),
        as_col(value).cast("string").alias("value"),
        F.lit(None).cast(ITEMS).alias("items"),
    )


FINDING_COLUMNS = (
    "site", "scan_id", "url", "ord", "rule_id", "check_id", "section", "detail", "value", "items"
)
