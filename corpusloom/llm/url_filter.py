"""URL filtering with mined association rules and a fixed list of host and path rules.

Labelled URLs become baskets of tokens (host parts, path parts, query names) plus the item `label=block` for bad ones.
Spark's FP-growth mines frequent combinations; rules whose consequent is that item are kept when confidence and
support are high enough and no shorter kept rule is at least as confident. The rules, at most `max_rules` of them, form
an inverted index token -> rule ids held as one literal; a URL fires a rule when all the rule's tokens are found. No
shuffle at scoring time.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Fixed rules of the query: (verdict, host and path prefix).
HOST_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
BLOCK = "label=block"
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS, MAX_RULES, MIN_ROWS = 0.001, 0.8, 3, 5000, 20


def _rest(url: Column) -> Column:
    """What follows the first ://, null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: h:<host suffix>, p:<path part without its digits' values>, q:<query name>."""
    parts = F.split(host_of(url), "\\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".")),
    )
    names = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    path = F.transform(names, lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([^=&#]+)"), 1)
    return F.array_distinct(F.concat(hosts, path, F.transform(query, lambda x: F.concat(F.lit("q:"), x))))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               max_rules: int = MAX_RULES, min_rows: int = MIN_ROWS) -> list[dict]:
    """Rules {tokens, confidence, support, n} from (url, blocked boolean); null urls and null labels take no part.

    min_rows is the least count of blocked URLs behind a rule: with few rows it takes the place of min_support, so that
    chance does not make rules. Rules are pruned on Spark before the at most max_rules best ones come to the driver.
    """
    known = labelled.where("url IS NOT NULL AND blocked IS NOT NULL")
    total = known.count()
    if total == 0:
        return []
    baskets = known.select(
        F.when(F.col("blocked"), F.concat(tokens_of(F.col("url")), F.array(F.lit(BLOCK)))).otherwise(tokens_of(F.col("url"))).alias("items")
    )
    support = min(1.0, max(min_support, min_rows / total))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", BLOCK)).where(F.size("antecedent") <= MAX_TOKENS)
    rules = rules.select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    single = F.transform("tokens", lambda t: F.array(t))
    without = F.transform("tokens", lambda t: F.array_remove("tokens", t))  # with MAX_TOKENS = 3 these are all proper parts
    parts = rules.where(F.size("tokens") > 1).select("tokens", "confidence", F.explode(F.array_distinct(F.concat(single, without))).alias("part"))
    known = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"))
    needless = parts.join(known, "part").where("c >= confidence").select("tokens").distinct()
    best = rules.join(needless, "tokens", "left_anti").orderBy(F.desc("confidence"), F.size("tokens"), F.desc("support"), "tokens").limit(max_rules)
    kept = [{"tokens": list(r.tokens), "confidence": r.confidence, "support": r.support, "n": len(r.tokens)} for r in best.collect()]
    return sorted(kept, key=lambda r: (r["n"], -r["confidence"], r["tokens"]))


def fires(tokens: Column, rules: list[dict]) -> Column:
    """True where some rule has all its tokens among `tokens`; inverted index lookup, then a count per rule."""
    if not rules:
        return F.lit(False)
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for t in r["tokens"]:
            index.setdefault(t, []).append(i)
    postings = F.from_json(F.lit(json.dumps(index)), "map<string,array<int>>")
    needs = F.from_json(F.lit(json.dumps([r["n"] for r in rules])), "array<int>")
    hits = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(postings, t), F.array().cast("array<int>"))))
    return let(hits, lambda h: F.exists(F.array_distinct(h), lambda r: F.size(F.filter(h, lambda x: x == r)) == needs[r]))


def host_rule(url: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest fitting rule (ties: first in text order), null if none fits."""
    host, path = host_of(url), path_of(url)
    cases = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        fit = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        cases.append(F.when(fit, F.struct(F.lit(-len(rule)).alias("k"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_min(F.array_compact(F.array(*cases)))


def judge_urls(pages: DataFrame, mined: list[dict], rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, one row per input row.

    Null urls and urls without :// have empty host and path, fit no rule and are allowed. Repeated rows stay.
    """
    url = F.col("url")
    out = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                       host_rule(url, rules or HOST_RULES).alias("_r"), fires(tokens_of(url), mined).alias("_f"))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("_f"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked): the last number in a page's path is its document; bad quality or toxic means blocked."""
    number = F.regexp_extract(path_of(F.col("url")), "([0-9]{1,18})[^0-9/]*/?$", 1)
    doc_id = F.when(number != "", number).cast("long")
    keyed = pages.where("url IS NOT NULL").select("url", doc_id.alias("doc_id")).where("doc_id IS NOT NULL")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return keyed.join(labels.select("doc_id", bad.alias("blocked")), "doc_id").select("url", "blocked")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, mine_rules(labelled_urls(pages, table(spark, sf_dir, "labels"))))
