"""Ranks, bands and colour arithmetic used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity_rank(sev: Column) -> Column:
    """4 for critical down to 1 for low; 0 for anything else."""
    return F.when(sev == "critical", 4).when(sev == "high", 3).when(sev == "medium", 2).when(sev == "low", 1).otherwise(0)


def status_rank(status: Column) -> Column:
    return F.when(status == "fail", 2).when(status == "warn", 1).when(status == "pass", 0)


def severity_to_status(sev: Column) -> Column:
    return F.when(sev.isin("critical", "high"), "fail").otherwise("warn")


def _channel(v: Column) -> Column:
    s = v / F.lit(255.0)
    return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def luminance(rgb: Column) -> Column:
    return (
        F.lit(0.2126) * _channel(rgb[0]) + F.lit(0.7152) * _channel(rgb[1]) + F.lit(0.0722) * _channel(rgb[2])
    )


def contrast_ratio(fg: Column, bg: Column) -> Column:
    """WCAG contrast of two RGB arrays."""
    a, b = luminance(fg) + 0.05, luminance(bg) + 0.05
    return F.greatest(a, b) / F.least(a, b)


def match_band(score: Column) -> Column:
    """Band of a visual match score: 95, 90 and 75 are the cuts."""
    return F.when(score >= 95, "matches").when(score >= 90, "very-close").when(score >= 75, "visible-differences").otherwise("rebuild")


# The sentence shown for each band, for a like-for-like run and for a redesign.
BAND_TEXT = {
    False: {
        "matches": "Matches the original — no visible differences worth raising.",
        "very-close": "Very close to the original — minor differences, worth a quick look.",
        "visible-differences": "Mostly matches, but there are visible differences a visitor would notice.",
        "rebuild": "Noticeably different from the original — needs rebuild work before sign-off.",
    },
    True: {
        "matches": "Content and structure carried over intact — the redesign kept what the old site had. (Looks are expected to differ and are not scored.)",
        "very-close": "Structure carried over well — a few elements differ from the old site; confirm each was dropped on purpose.",
        "visible-differences": "A fair amount of the old site’s structure is not accounted for — check the missing list below for content that should have survived the redesign.",
        "rebuild": "Much of the old site’s content is missing from the rebuild. On a redesign the styling is expected to change — this is about what is no longer there.",
    },
}


def verdict_line(score: Column, redesign: Column) -> Column:
    band = match_band(score)
    out = F.lit(None).cast("string")
    for mode, texts in BAND_TEXT.items():
        for name, text in texts.items():
            out = F.when((redesign == F.lit(mode)) & (band == name), F.lit(text)).otherwise(out)
    return out
