"""URL filters by association rules: FP-growth over URL tokens of labelled pages, pruned, matched by inverted index.

A page that a stated list rule fits gets that rule's verdict; the others are blocked if a mined rule matches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.llm.frames import column, fresh
from incidentlens.plans.materialize import materialize

BLOCK = "label=block"
MIN_SUPPORT, MIN_CONFIDENCE = 0.001, 0.5
LEAST_PAGES = 8  # a rule rests on at least so many labelled pages, however few there are
LIST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://`` or for a null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def list_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = LIST_RULES) -> Column:
    """The longest list rule (host and path) that fits, as a struct of ``rule`` and ``verdict``; else null.

    Equal lengths: the longer host wins, then the first by text.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a url: scheme, host labels and host ends, path pieces, query names, fragment; digits as 0."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_path(url)
    labels = F.split(host, r"\.")
    tagged = lambda tag, values: F.transform(values, lambda x: F.concat(F.lit(tag + "="), x))
    zero = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    query = F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&")
    all_ = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
                F.concat(F.lit("end="), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))),
        tagged("host", labels), tagged("path", F.split(zero(path), r"[/.]")),
        tagged("query", F.transform(query, lambda x: F.regexp_extract(x, r"^([^=]*)", 1))),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment="))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(all_, lambda x: ~F.endswith(x, F.lit("=")) | (x == F.lit("fragment="))))


def _rarest(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``rule_id, token``: the token of each rule that ``counts`` (``token, n``) has least often."""
    order = Window.partitionBy("rule_id").orderBy(F.coalesce("n", F.lit(0)), "token")
    posted = rules.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token", "left")
    return posted.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("rule_id", "token")


def token_classes(baskets: DataFrame, least: int) -> DataFrame:
    """``token, stands, pages, hits``: tokens of at least ``least`` blocked pages (``hits``), each with the token that stands for it.

    Tokens that the same pages have (told by their number and two sums of page hashes) are one class, for which its
    first token by text stands: rules with one or another of them, or with several, would say the same.
    """
    posted = baskets.select("page", "blocked", F.explode("items").alias("token"))
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "page").cast("decimal(38,0)"))
    seen = posted.groupBy("token").agg(F.count(F.lit(1)).alias("pages"), F.count_if("blocked").alias("hits"),
                                       wide(1).alias("_a"), wide(2).alias("_b")).where(F.col("hits") >= least)
    same = seen.groupBy("pages", "hits", "_a", "_b").agg(F.min("token").alias("stands"))
    return seen.join(same, ["pages", "hits", "_a", "_b"]).select("token", "stands", "pages", "hits")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from ``url, blocked`` rows: ``rule_id, tokens, confidence, support``.

    One token stands for all tokens that the same labelled pages have, and a token whose pages are all blocked is a rule by
    itself and takes part in no larger one, so what many urls share as a whole (a directory tree, a template) is
    mined as one token. Of the others FP-growth finds all combinations; their number still doubles with each further
    token of a chain of directories in which every level has pages of both kinds of its own.
    A rule is kept if no rule with fewer of its tokens has at least its confidence. Without rows, or without
    blocked ones, there are no rules.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id bigint, tokens array<string>, confidence double, support double")
    baskets = materialize(labelled.select(F.monotonically_increasing_id().alias("page"), F.coalesce("blocked", F.lit(False)).alias("blocked"),
                                          url_tokens(F.col("url")).alias("items")))
    n, blocked = baskets.agg(F.count(F.lit(1)), F.count_if("blocked")).first()
    if not blocked:
        return empty
    share = min(1.0, max(min_support, LEAST_PAGES / n))
    least = math.ceil(share * n - 1e-9)
    classes = materialize(token_classes(baskets, least))
    sure = F.col("hits") == F.col("pages")
    single = classes.where((F.col("token") == F.col("stands")) & sure).select(
        F.array("token").alias("tokens"), F.lit(1.0).alias("confidence"), (F.col("hits") / n).alias("support"))
    # Baskets of the standing tokens, with the mark of blocked pages; pages with none of them still count.
    standing = classes.where((F.col("token") == F.col("stands")) & ~sure).select("token")
    kept = baskets.select("page", F.explode("items").alias("token")).join(standing, "token").groupBy("page").agg(
        F.collect_list("token").alias("items"))
    mark = F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    marked = materialize(baskets.select("page", "blocked").join(kept, "page", "left").select(
        F.concat(F.coalesce("items", F.array().cast("array<string>")), mark).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(marked)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BLOCK))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").unionByName(single)
    rules = materialize(rules.where(F.col("confidence") >= min_confidence).withColumn("rule_id", F.xxhash64("tokens")))
    # A smaller rule meets larger ones at the one of its tokens that the fewest rules have, not in all pairs.
    one = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    counts = one.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    small = _rarest(rules, counts).join(rules, "rule_id").select(F.col("tokens").alias("fewer"), F.col("confidence").alias("c"), "token")
    worse = one.join(small, "token").where(
        (F.size("fewer") < F.size("tokens")) & (F.col("c") >= F.col("confidence"))
        & (F.size(F.array_except("fewer", "tokens")) == 0)).select("rule_id").distinct()
    return rules.join(worse, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct ``url`` that a mined rule matches: the rule with the highest confidence, then support.

    The index maps the token of a rule that the fewest urls have to the rule; a url meets the rules of its tokens there,
    and the rest of a rule's tokens are then looked for among the url's.
    """
    tokens = urls.select("url").distinct().withColumn("items", url_tokens(F.col("url")))
    posted = tokens.select("url", "items", F.explode("items").alias("token"))
    used = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = posted.select("token").join(used, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = _rarest(rules, counts).join(rules, "rule_id")
    met = posted.join(index, "token").where(F.size(F.array_except("tokens", "items")) == 0)
    best = F.max(F.struct("confidence", "support", "rule_id"))
    return met.groupBy("url").agg(best.alias("best")).select("url", F.col("best.rule_id").alias("mined_rule"),
                                                           F.col("best.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url",
                label_id: str = "doc_id", rules: Sequence[tuple[str, str, str]] = LIST_RULES,
                min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """All columns of ``pages`` and ``host, path, rule, verdict, mined_rule, confidence``.

    Labels belong to the page with the same id; a page is labelled blocked if any of its labels has quality 0 or
    toxic 1. Null urls and urls without ``://`` have an empty host and path and fit no list rule; pages with
    null or repeated ids are judged by their urls alike; without labels no rule is mined and what no list rule
    fits is allowed. A column that has one of the new names keeps it and the new one gets a leading ``_``.
    """
    named = fresh(pages, "host", "path", "rule", "verdict", "mined_rule", "confidence")
    host, path, rule, verdict, mined, confidence = named
    key, found = fresh(pages, "url_key", "url_rule")
    marks = labels.groupBy(column(label_id).alias("id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("blocked"))
    labelled = pages.select(column(page_col).alias("id"), column(url_col).alias("url")).join(marks, "id").select("url", "blocked")
    mined_rules = materialize(mine(labelled, min_support, min_confidence))
    hits = match(pages.select(column(url_col).alias("url")).where("url is not null"), mined_rules).select(
        F.col("url").alias(key), F.col("mined_rule").alias(mined), F.col("confidence").alias(confidence))
    h, p = host_path(column(url_col))
    out = pages.withColumn(host, h).withColumn(path, p)
    out = out.withColumn(found, list_rule(F.col(host), F.col(path), rules))
    out = out.join(hits, column(url_col) == F.col(key), "left")
    by_method = F.when(F.col(mined).isNotNull(), "block").otherwise("allow")
    out = out.withColumn(rule, F.col(found)["rule"]).withColumn(verdict, F.coalesce(F.col(found)["verdict"], by_method))
    return out.select(*[column(c) for c in pages.columns], *named)
