"""URL filters: list rules first, then association rules over URL tokens, with DataFrame functions only.

Pages with a label are baskets of URL tokens and their label; Spark's FP-growth finds the frequent sets among all of
them. Rules from tokens to the label `bad` that have the confidence asked for, and more of it than every shorter rule
within them, stay. A URL's tokens look the rules up in an inverted index, and a rule applies when it is found by as many
classes as it has.

Tokens that stand on the same labelled pages are one class: rules with one or another of them have the same support and
confidence, and a rule with two of them is no better than the one with either, so that nothing is lost and a long path counts
as one item where it always comes as a whole. A set must stand on LEAST pages, however few are labelled. Where a page has over
WIDE frequent classes, FP-growth would list all sets of them, and sets are grown class by class instead, over all pages: only
from sets that stand on fewer pages than each set within them and are not bad throughout, as no other has more confidence than
every shorter rule within it. The rules are the same.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, reused

#: Fixed list: (verdict, host, path).
LIST = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE, LEAST, WIDE = 0.001, 0.6, 20, 24
BAD = "=bad"
#: Rules that are sent to all tasks rather than shuffled to them.
FEW = 1 << 18


def host_path(url: str = "url") -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(text, pattern, 2)


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: labels of the host, its last two together, parts of the path with digits as 0, and keys of the query."""
    labels = F.split(host, r"\.")
    steps = F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/")
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    named = lambda kind, a: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(named("h:", labels), named("p:", steps), named("q:", query)))


def listed(host: Column, path: Column, rules=LIST) -> tuple[Column, Column]:
    """The longest rule of the list that fits, and its verdict; null where none does."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    pick = lambda value: F.coalesce(*(F.when(fits(h, p), F.lit(value(v, h, p))) for v, h, p in order))
    return pick(lambda v, h, p: h + p), pick(lambda v, h, p: v)


def classes(bags: DataFrame, least: int) -> DataFrame:
    """(token, class) for the tokens of (page, bag) that stand on enough pages; a class is named by its first token."""
    each = bags.select("page", F.explode("bag").alias("token"))
    mark = F.xxhash64("page").cast("decimal(38,0)")
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(mark).alias("a"), F.sum(F.xxhash64(F.lit(7), "page").cast("decimal(38,0)")).alias("b")).where(F.col("n") >= least)
    return seen.join(seen.groupBy("n", "a", "b").agg(F.min("token").alias("class")), ["n", "a", "b"]).select("token", "class")


def grown(each: DataFrame, enough: int) -> DataFrame:
    """(items, n, b): the sets of classes that stand on enough bad pages and may be a better rule than those within them, with their pages and bad ones, for (page, bad, class)."""
    count = lambda rows: cut(rows.groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("b")).where(F.col("b") >= enough))
    rows = each.select("page", "bad", F.array("class").alias("items"))
    level = count(rows)
    found, more = level, None
    while True:
        open_ = level.where("b < n").select("items", "n")
        rows = cut(rows.join(open_.select("items"), "items", "left_semi"))
        if rows.isEmpty():
            return found
        more = rows.select("page", F.element_at("items", 1).alias("class")) if more is None else more
        wider = count(rows.join(more, "page").where(F.col("class") > F.element_at("items", -1)).select("page", "bad", F.array_append("items", F.col("class")).alias("items")))
        less = wider.select("items", "n", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("less")).join(open_.select(F.col("items").alias("less"), F.col("n").alias("of")), "less")
        whole = less.groupBy("items").agg(F.count("*").alias("k"), F.min("of").alias("of"), F.min("n").alias("n")).where((F.col("k") == F.size("items")) & (F.col("of") > F.col("n")))
        level = cut(wider.join(whole.select("items"), "items", "left_semi"))
        rows = rows.join(more, "page").where(F.col("class") > F.element_at("items", -1)).select("page", "bad", F.array_append("items", F.col("class")).alias("items")).join(level.select("items"), "items", "left_semi")
        found = found.unionByName(level)


def mined(bags: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(mined, token, class, size, confidence): the inverted index of the rules from classes to BAD, for (page, bag, bad)."""
    n = bags.count()
    enough = max(least, math.ceil(support * n - 1e-9))
    of = reused(classes(bags, enough))
    items = bags.select("page", "bad", F.explode("bag").alias("token")).join(of, "token").groupBy("page", "bad").agg(F.collect_set("class").alias("items"))
    items = reused(items)
    total, most = items.agg(F.count("*"), F.coalesce(F.max(F.size("items")), F.lit(0))).first()
    if total < enough:
        return bags.sparkSession.createDataFrame([], "mined string, token string, class string, size int, confidence double")
    if most <= WIDE:
        baskets = reused(items.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
        found = FPGrowth(itemsCol="items", minSupport=(enough - 0.5) / total, minConfidence=confidence).fit(baskets).associationRules
        rules = found.where(F.element_at("consequent", 1) == BAD).select(F.array_sort("antecedent").alias("items"), "confidence")
    else:
        found = grown(items.select("page", "bad", F.explode("items").alias("class")), enough)
        rules = found.select("items", (F.col("b") / F.col("n")).alias("confidence")).where(F.col("confidence") >= confidence)
    short = rules.select(F.col("items").alias("less"), F.col("confidence").alias("also"))
    keyed = rules.withColumn("class", F.explode("items"))
    wider = keyed.join(short.withColumn("class", F.explode("less")), "class")
    pruned = wider.where((F.size("less") < F.size("items")) & (F.col("also") >= F.col("confidence")) & (F.size(F.array_except("less", "items")) == 0))
    kept = rules.join(pruned.select("items").distinct(), "items", "left_anti")
    index = kept.select(F.concat_ws(" ", "items").alias("mined"), F.explode("items").alias("class"), F.size("items").alias("size"), "confidence")
    return index.join(of, "class").select("mined", "token", "class", "size", "confidence")


def judge(pages: DataFrame, labels: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """page_id, url, host, path, rule, verdict, mined (the association rule that blocked) of every page.

    Null url, or one without ://: host and path empty, which no rule fits. Repeated pages are all returned. A page is
    labelled if labels has its page_id as doc_id; several labels count as bad if one is. Without labels, or without
    pages, nothing is mined and pages that no rule of the list fits are allowed. Other columns are not read.
    """
    host, path = host_path()
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = listed(F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("listed", verdict)
    bag = tokens(F.col("host"), F.col("path"), F.col("url"))
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"))
    bags = reused(rows.join(marks, "page_id").select(F.xxhash64("page_id", "url", F.monotonically_increasing_id()).alias("page"), bag.alias("bag"), (F.col("quality") == 0).alias("bad")))
    index = reused(mined(bags, support=support, confidence=confidence, least=least))
    index = F.broadcast(index) if index.count() <= FEW else index
    open_ = F.col("listed").isNull() & (F.col("host") != "")  # others, null urls among them, need no look-up
    urls = rows.where(open_).select("url", bag.alias("bag")).distinct()
    hits = urls.select("url", F.explode("bag").alias("token")).join(index, "token").groupBy("url", "mined").agg(F.count_distinct("class").alias("n"), F.min("size").alias("size"), F.min("confidence").alias("confidence"))
    best = hits.where("n = size").groupBy("url").agg(F.min(F.struct(-F.col("confidence"), F.col("size"), F.col("mined"))).getField("mined").alias("mined"))
    out = rows.where(open_).join(best, "url", "left").unionByName(rows.where(~open_).withColumn("mined", F.lit(None).cast("string")))
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("listed", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")
