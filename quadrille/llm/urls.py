"""URL filters: given host and path rules, and rules mined from labelled pages."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import written

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: An itemset counts if this share of the labelled pages, and so many of them, are bad and have it; a rule from this confidence on.
SUPPORT, PAGES, CONFIDENCE = 0.002, 10, 0.6
#: A rule is dropped unless its confidence beats that of every shorter rule within it by so much.
GAIN = 0.02


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, and segments of the path, numbers as one token."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    return F.array_distinct(F.concat(labels, parts))


def _bit(number: Column) -> Column:
    """A bit for an item; the 64 most frequent items have one of their own."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (number % 64).cast("int"))


def contained(sets: DataFrame, bags: DataFrame) -> DataFrame:
    """Each bag with each set that it holds. sets: set, set_bits, anchor and more; bags: items, bits and more.

    A set is looked up by its rarest item alone. Bits of all items pass over nearly all bags that lack another one.
    """
    met = bags.withColumn("anchor", F.explode(F.array_distinct("items"))).join(sets, "anchor").filter(F.col("bits").bitwiseAND(F.col("set_bits")) == F.col("set_bits"))
    return met.filter(F.forall("set", lambda x: F.array_contains("items", x)))


def _looked_up(sets: DataFrame) -> DataFrame:
    """Adds set_bits and anchor to sets of item numbers; rarer items have larger numbers."""
    return sets.withColumn("set_bits", F.aggregate("set", F.lit(0).cast("long"), lambda b, x: b.bitwiseOR(_bit(x)))).withColumn("anchor", F.array_max("set"))


def rules_of(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Association rules (items, size, confidence) whose consequent is a bad label. items: an array of (number, members).

    A rule fires where each of its items is met by one of the item's members, tokens that the same labelled pages have.

    pages: page_id, url. labels: doc_id, quality (0: bad; of repeated rows of one id the least counts); a page has the label of the
    same id. All labelled pages and all their tokens count. Itemsets come from Spark's FP-growth over the bad pages, and the
    confidence of each from all labelled pages. A rule goes if a shorter one within it is as confident but for GAIN.

    Two things keep FP-growth from making all subsets of tokens that go together, without a change to the rules. Tokens that the same
    labelled pages have are one item; a rule with two of them would not beat that with one. Tokens whose own rule no longer rule
    can beat by GAIN are no items. Null urls, ids and qualities take no
    part. Without labels, or bad ones, there are no rules. Other columns are not read.
    """
    bad = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = pages.filter("url is not null").join(bad, F.col("page_id") == F.col("doc_id")).select(
        tokens(host_of(F.col("url")), path_of(F.col("url"))).alias("items"), (F.col("quality") == 0).cast("long").alias("bad")
    )
    seen = seen.groupBy(F.array_sort("items").alias("items")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    seen = written(seen.withColumn("basket", F.xxhash64("items")), "url-baskets")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    need = max(PAGES, math.ceil(support * total["n"]))

    each = seen.select("basket", "n", "bad", F.explode("items").alias("token"))
    same = [F.bit_xor(F.xxhash64("basket", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    alike = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), *same).filter(F.col("bad") >= need)
    alike = alike.groupBy("n", "bad", "h0", "h1").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members"))
    # One task numbers the items: no more than tokens a page over support.
    number = (F.row_number().over(Window.orderBy(F.desc("n"), "item")) - 1).alias("number")
    share = F.col("bad") / F.col("n")
    items = written(alike.select(number, "item", "members", share.alias("confidence"), ((share < confidence) | (share + GAIN < 1)).alias("open")), "url-items")
    single = items.select(F.array("number").alias("set"), "confidence")
    own = items.filter("open").select(F.col("item").alias("token"), "number")
    bags = each.join(own, "token").groupBy("basket").agg(F.first("n").alias("n"), F.first("bad").alias("bad"), F.collect_list("number").alias("items"), F.bit_or(_bit(F.col("number"))).alias("bits"))
    bags = written(bags.drop("basket"), "url-kept")
    n_rows = bags.agg(F.coalesce(F.sum("bad"), F.lit(0))).first()[0]
    if n_rows < need:
        sets = single
    else:
        rows = bags.filter("bad > 0").select("items", F.explode(F.sequence(F.lit(1).cast("long"), "bad"))).select("items")
        found = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / n_rows).fit(rows).freqItemsets.filter(F.size("items") > 1)
        found = written(_looked_up(found.select(F.array_sort("items").alias("set"), F.col("freq").alias("of"))), "url-sets")
        counted = contained(found, bags).groupBy("set", "of").agg(F.sum("n").alias("all"))
        sets = single.unionAll(counted.select("set", F.col("of") / F.col("all")))
    rules = written(_looked_up(sets.filter(F.col("confidence") >= confidence)), "url-found")
    # Shorter rules within a rule, as sure as it but for GAIN.
    short = rules.withColumnRenamed("confidence", "s_confidence")
    long = rules.select(F.col("set").alias("items"), F.col("set_bits").alias("bits"), "confidence")
    covered = contained(short, long).filter((F.size("set") < F.size("items")) & (F.col("s_confidence") + GAIN >= F.col("confidence"))).select("items").distinct()
    best = rules.join(covered, rules["set"] == covered["items"], "left_anti").select("set", "confidence", F.explode("set").alias("number"))
    named = best.join(items.select("number", "members"), "number").groupBy("set", "confidence").agg(F.array_sort(F.collect_list(F.struct("number", "members"))).alias("items"))
    return named.select("items", F.size("items").alias("size"), "confidence")


def mined(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """The rules of rules_of() written out as (rule_id, antecedent, size, confidence): one for each choice of a member of each item.

    Their number is the product of the items' members, so this is for reading rules; matching goes by items.
    """
    choices = F.aggregate("items", F.array(F.array().cast("array<string>")), lambda a, m: F.flatten(F.transform(a, lambda x: F.transform(m["members"], lambda t: F.concat(x, F.array(t))))))
    out = rules_of(pages, labels, support, confidence).select(F.explode(choices).alias("antecedent"), "size", "confidence").withColumn("antecedent", F.array_sort("antecedent"))
    return out.select(F.sha2(F.concat_ws(" ", "antecedent"), 256).alias("rule_id"), "antecedent", "size", "confidence")


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), by length of host and path together; null if none fits."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    return reduce(lambda a, b: F.coalesce(a, b), fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def judged(pages: DataFrame, found: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_fired) for every row of pages. found: rules as of rules_of().

    Mined rules are matched by an inverted index from a rule's rarest item to the rule; the URL's other items then
    decide. n_fired counts a rule once for each choice of members that the URL has. Only tokens of rules leave a page's row, and they are
    looked up by distinct URL, so one URL that a third of all pages share is looked up once.

    A null URL, or one without ://, has an empty host and path and no tokens: it is allowed unless a rule fits. A null
    page_id, repeated rows and an empty table give rows like any other.
    """
    url = F.col("url")
    sets = _looked_up(found.select(F.transform("items", lambda x: x["number"]).alias("set")))
    index = found.select(F.explode("items").alias("item")).select(F.explode("item.members").alias("token"), "item.number").distinct()
    urls = pages.select("url").filter("url is not null").distinct()
    met = urls.select("url", F.explode(tokens(host_of(url), path_of(url))).alias("token")).join(index, "token")
    bags = met.groupBy("url").agg(F.collect_list("number").alias("items"), F.bit_or(_bit(F.col("number"))).alias("bits"))
    choices = F.aggregate("set", F.lit(1.0), lambda p, x: p * F.size(F.filter("items", lambda y: y == x)))
    fired = contained(sets, bags).groupBy(F.col("url").alias("u")).agg(F.least(F.sum(choices), F.lit(2**31 - 1)).cast("int").alias("n_fired"))
    host, path = host_of(url), path_of(url)
    given = rule_column(host, path, rules)
    # Null urls, which may be many, are no key of a join.
    joined = pages.filter("url is not null").join(fired, F.col("url") == F.col("u"), "left").select("page_id", "url", "n_fired")
    return joined.unionAll(pages.filter("url is null").select("page_id", "url", F.lit(None).cast("int"))).select(
        "page_id", host.alias("host"), path.alias("path"), given["rule"].alias("rule"),
        F.coalesce(given["verdict"], F.when(F.col("n_fired") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("n_fired", F.lit(0)).alias("n_fired"),
    )


def filtered(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """Rules mined from the labelled pages, then every page judged."""
    return judged(pages.select("page_id", "url"), written(rules_of(pages.select("page_id", "url"), labels), "url-rules"), rules)
