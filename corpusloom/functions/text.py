"""Scalar building blocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole language codes that mean another one.
LANGUAGE_ALIASES = {
    "en-us": "en", "en-gb": "en", "eng": "en",
    "zh-tw": "zh", "zh-hk": "zh", "zh-hans": "zh", "zh-hant": "zh", "cht": "zh", "chs": "zh",
    "ja-jp": "ja", "jpn": "ja",
}


def collapsed(c: Column) -> Column:
    """Runs of white space (Unicode) as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


#: White space of all scripts and the separators U+001C to U+001F, in a pattern that begins with (?U).
BLANK = r"[\s\x1c-\x1f]"


def stripped(c: Column) -> Column:
    """Without white space (Unicode) at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"(?U)^{BLANK}+|{BLANK}+$", "")


def fit_title(c: Column) -> Column:
    """Whether a title may be stored: not empty, no control characters; null is none."""
    return F.coalesce((c != "") & ~c.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def title_rank(c: Column) -> Column:
    """0 for titles that say something, 1 for bare time stamps (ten digits or more), 2 for none: the smallest is kept."""
    t = stripped(c)
    return F.when(t == "", 2).when(t.rlike(r"^[0-9]{10,}$"), 1).otherwise(0)


def preview(content: Column, width: int = 200) -> Column:
    """The first `width` characters of the flattened start of a text, with an ellipsis if cut."""
    flat = collapsed(F.substring(content, 1, 4 * width))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("…"))).otherwise(flat)


def contains(c: Column, text: str) -> Column:
    """Case-insensitive containment; no wildcard has a meaning. Null contains nothing."""
    return F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))


def occurrences(c: Column, text: Column | str) -> Column:
    """Non-overlapping occurrences of a non-empty text."""
    t = F.lit(text) if isinstance(text, str) else text
    return F.coalesce(((F.length(c) - F.length(F.replace(c, t, F.lit("")))) / F.length(t)).cast("long"), F.lit(0).cast("long"))


def language(c: Column) -> Column:
    """Normalised code: trimmed, lower case, aliases mapped, blank and null as und; unknown codes stay whole."""
    base = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.when(base == "", "und")
    for k, v in LANGUAGE_ALIASES.items():
        out = out.when(base == k, v)
    return out.otherwise(base)


def language_of(code: str) -> str:
    """language() of a code that the driver holds."""
    base = code.strip().lower()
    return LANGUAGE_ALIASES.get(base, base or "und")


def window(content: Column, term: str, width: int = 480, before: int = 60) -> Column:
    """`width` characters of a text from `before` ahead of the first match; null without a match."""
    at = F.instr(F.lower(content), term.lower())
    return F.when(at > 0, F.substring(content, F.greatest(F.lit(1), at - before), F.lit(width)))


def marked(content: Column, term: str, side: int = 30) -> Column:
    """The first match in <mark> with `side` characters around it and ellipses where cut; null without a match."""
    at, n = F.instr(F.lower(content), term.lower()), len(term)
    start = F.greatest(F.lit(1), at - side)
    left = F.substring(content, start, at - start)
    right = F.substring(content, at + n, F.lit(side))
    cut = F.length(content) > at + n - 1 + side
    out = F.concat(F.when(start > 1, "…").otherwise(""), left, F.lit("<mark>"), F.substring(content, at, F.lit(n)), F.lit("</mark>"), right, F.when(cut, "…").otherwise(""))
    return F.when(at > 0, out)


def summary(content: Column, least: int = 8, most: int = 100) -> Column:
    """The first sentence of at least `least` characters, cut at `most` with an ellipsis; null if there is none."""
    parts = F.transform(F.split(content, "[.!?。！？\\n]+"), lambda x: F.trim(x))
    first = F.try_element_at(F.filter(parts, lambda x: F.length(x) >= least), F.lit(1))
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most), F.lit("…"))).otherwise(first)


def mentions(content: Column) -> Column:
    """Distinct trimmed titles in [[ ]], in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(r"\[\[([^\[\]\n]+)\]\]"), 1), lambda x: F.trim(x)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', "_")), r"\s+", "_")


def tsv_cell(c: Column) -> Column:
    """Tabs and line ends as blanks, so that a value stays in its cell."""
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))


def day_at(ts: Column, minutes: int) -> Column:
    """Local day of a UTC time at an offset in minutes."""
    return F.to_date(ts + F.make_interval(mins=F.lit(minutes)))


def interval_text(minutes: Column) -> Column:
    """Minutes below a day as minutes, else whole days by half-even rounding."""
    return F.when(minutes < 1440, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.bround(minutes / 1440, 0).cast("long").cast("string"), F.lit(" d")))
