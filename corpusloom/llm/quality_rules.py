"""Quality rules as a short-circuit cascade.

Each rule is a boolean Column that says "reject". On a sample, one small job per rule measures its cost (seconds) and
its selectivity (share rejected); rules then run in falling order of rejections per second inside one CASE, so a row
that a cheap, selective rule rejects never pays for the dear ones. Order changes speed only: the verdict is the OR of
all rules. DataFrame functions only, no shuffle; work per row depends on that row's text alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, table, words_of

#: The class of symbol characters.
SYMBOLS = "[#*$%&|<>]"
SAMPLE_SHARE, SAMPLE_ROWS = 0.05, 400


@dataclass(frozen=True)
class Rule:
    name: str
    reject: Column


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _without(text: Column, pattern: str) -> Column:
    """Code points of text that are not in the character class."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _lines(text: str) -> Column:
    return F.filter(F.split(_text(text), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def n_dup_lines(text: str) -> Column:
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_lines(text: str) -> Column:
    return F.size(_lines(text)).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that the text holds twice or more, the first included.

    Windows stand as 64-bit hashes. Where all differ there is nothing to cover; else they are sorted with their
    places, equal neighbours mark repeats, and their places are joined.
    """

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda i, j: s[i]["g"] == s[j]["g"]
        again = F.filter(
            F.sequence(F.lit(0), last),
            lambda j: F.when(j > 0, same(j, j - 1)).otherwise(False) | F.when(j < last, same(j, j + 1)).otherwise(False),
        )
        places = F.transform(again, lambda j: F.sequence(s[j]["i"], s[j]["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places))).cast("long")

    def counted(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("g"), i.alias("i")))
        differ = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(differ, F.lit(0).cast("long")).otherwise(let(F.sort_array(placed), covered))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(at, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(hashes, counted))

    return let(words, windows)


def measures(text: str = "text", words: Column | None = None) -> dict[str, Column]:
    """The base measures by name; `words` is the text's array of words where a column holds it already."""
    w, t = words_of(F.col(text)) if words is None else words, _text(text)
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(t) - _without(t, SYMBOLS),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(w),
    }


def base_rules(text: str = "text", known: dict[str, Column] | None = None) -> list[Rule]:
    m = known or measures(text)
    return [Rule("few_words", m["n_words"] < 50), Rule("repeats", 100 * m["n_repeat_words"] > 50 * m["n_words"])]


def further_rules(text: str = "text", known: dict[str, Column] | None = None) -> list[Rule]:
    """The method's own rules; none of them rejects an empty text. `known`: measures, or the columns that hold them."""
    m, t = known or measures(text), _text(text)
    n = m["n_words"]
    lettered = F.regexp_count(t, F.lit("\\p{L}[^\\x20\\x09-\\x0D]*"))  # from a word's first letter to its end
    capitals = F.length(t) - _without(t, "[A-Z]+")
    return [
        Rule("symbols", 10 * m["n_symbols"] > n),
        Rule("word_length", (m["word_chars"] > 15 * n) | (m["word_chars"] < 2 * n)),
        Rule("capitals", 2 * capitals > m["word_chars"]),
        Rule("letters", 10 * lettered < 7 * n),
        Rule("dup_lines", 10 * m["n_dup_lines"] > 5 * n_lines(text)),
        Rule("cut_lines", 10 * F.regexp_count(t, F.lit("(\\.\\.\\.|…)[ \\t\\r]*(\\n|$)")) > 5 * F.greatest(n_lines(text), F.lit(1))),
    ]


def plan(df: DataFrame, rules: list[Rule], share: float = SAMPLE_SHARE, rows: int = SAMPLE_ROWS, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> list[dict]:
    """Rules with cost (seconds on the sample) and selectivity, best rejection per cost first; ties by name.

    The sample only sets the order. `prepare` adds to it the columns that rules read besides the text. An empty sample
    leaves selectivity 0 everywhere and orders by name.
    """
    drawn = df.sample(share, 7).limit(rows).cache()
    sample = prepare(drawn).cache()
    try:
        found = sample.count()
        out = []
        for r in rules:
            began = time.perf_counter()
            hit = sample.agg(F.avg(F.coalesce(r.reject, F.lit(False)).cast("double"))).first()[0] if found else 0.0
            cost = time.perf_counter() - began if found else 1.0
            out.append({"rule": r, "cost": cost, "selectivity": hit or 0.0})
    finally:
        sample.unpersist()
        drawn.unpersist()
    return sorted(out, key=lambda x: (-x["selectivity"] / x["cost"], x["rule"].name))


def cascade(ordered: list[Rule]) -> Column:
    """True where no rule rejects; CASE takes the rules in the order given and stops at the first that rejects.

    A rule that gives null does not reject.
    """
    case = F.when(F.lit(False), False)
    for r in ordered:
        case = case.when(r.reject, False)
    return case.otherwise(True)


def _free_name(df: DataFrame) -> str:
    """A column name longer than any of df's, for the array of words."""
    return "_words".ljust(max([6, *(len(c) + 1 for c in df.columns)]), "_")


def judge(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, name: str = "kept") -> DataFrame:
    """df plus kept boolean (`name`) by the ordered cascade (all rules, base rules among them).

    Null and empty texts have no words and fail few_words. One output row per input row; a column of that name is
    replaced. The text is split into words once a row, in a column of a name of its own.
    """
    own = _free_name(df)
    add = lambda d: d.withColumn(own, words_of(F.col(text)))
    known = measures(text, F.col(own))
    rules = rules or base_rules(text, known) + further_rules(text, known)
    ordered = [x["rule"] for x in plan(df.select(text), rules, prepare=add)]
    return add(df).withColumn(name, cascade(ordered)).drop(own)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus n_words, the four base measures, base_failed and kept. Null text counts as empty.

    Columns of these names are replaced; one output row per input row. The further rules read the measures from their
    columns.
    """
    own = _free_name(df)
    known = measures(text, F.col(own))
    add = lambda d: d.withColumn(own, words_of(F.col(text))).withColumns(known).drop(own)
    ordered = [x["rule"] for x in plan(df.select(text), further_rules(text, {k: F.col(k) for k in known}), prepare=add)]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = add(df).withColumn("base_failed", failed)
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(ordered)))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT *, len(w) AS n, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w),
pos AS (SELECT doc_id, unnest(g) AS gram, unnest(range(1, n - 1)) AS i FROM g WHERE n >= 3),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM pos) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS c FROM rep, range(3) r(j) GROUP BY doc_id),
s AS (SELECT g.doc_id, t, w, l, CAST(n AS BIGINT) AS n_words,
   CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words FROM g LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
    OR 2 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > word_chars
    OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 7 * n_words
    OR 10 * n_dup_lines > 5 * len(l)
    OR 10 * len(regexp_extract_all(t, '(\.\.\.|…)[ \t\r]*(\n|$)')) > 5 * greatest(len(l), 1)) AS kept
FROM b
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return measure(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*cols)
