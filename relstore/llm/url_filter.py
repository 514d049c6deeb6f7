"""URL filtering: given rules first, association rules mined by FP-growth for the rest (DataFrame functions only).

1. A URL is split into host and path; the longest given rule that fits decides.
2. What has a verdict already is labelled data: Spark's FP-growth mines the combinations of URL tokens that
   imply a verdict. Rules are pruned by support and confidence, and a rule goes if one with fewer of its tokens is as confident.
3. Mined rules match by an inverted index from each rule's rarest token: a URL looks up only its own tokens. URLs are collapsed to
   their distinct token sets before that, so that a host with a third of all rows is looked up once for each of its sets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read

#: (verdict, host, path): a rule fits its host and all subdomains, where the path begins with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A mined combination holds for this share of the labelled rows, and its verdict for this share of those.
SUPPORT, CONFIDENCE = 0.01, 0.8
#: Tokens that a mined rule may have.
TOKENS = 3
#: FP-growth finds combinations of any size: where a URL has more frequent tokens than this, those of up to TOKENS are counted instead.
MINED_TOKENS = 14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of a short list of rules that fits, else nulls; ties by the rule's text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, segments of the path, keys of the query. Runs of digits count as one sign."""
    signs = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    marked = lambda mark, c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                marked("scheme:", F.array(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), "^([a-z]+)://", 1))),
                marked("host:", F.split(signs(host), r"\.")),
                marked("path:", F.split(signs(path), "/")),
                marked("query:", F.transform(keys, signs)),
            )
        )
    )


def mine_rules(labelled: DataFrame, ws: Workspace, tokens: str = "tokens", label: str = "label", support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = TOKENS) -> DataFrame:
    """tokens, key, label, confidence, support. An empty table of labels gives no rules.

    Whole token sets are mined, but for tokens below the support, which no rule can have. However many rows there are, a URL
    with k frequent tokens adds to less than k**4 combinations, and each kept one needs `support` of the rows: there are fewer
    than k**4 / support rules.
    """
    spark = labelled.sparkSession
    schema = "tokens array<string>, key string, label string, confidence double, support double"
    whole = ws.table(labelled.select(F.array_union(tokens, F.array(F.concat(F.lit("label:"), F.col(label)))).alias("items")), "whole")
    rows = whole.count()
    if not rows:
        return spark.createDataFrame([], schema)
    least = math.ceil(support * rows)
    # Fewer than (tokens a URL) / support of them, whatever the input.
    frequent = sorted(r[0] for r in whole.select(F.explode("items").alias("token")).groupBy("token").count().filter(F.col("count") >= least).collect())
    held = F.array(*map(F.lit, frequent)).cast("array<string>")
    baskets = ws.table(whole.select(F.array_sort(F.array_intersect("items", held)).alias("items")), "baskets")
    verdict = F.element_at("consequent", 1)
    if baskets.agg(F.max(F.size("items"))).first()[0] <= MINED_TOKENS + 1:
        rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    else:
        rules = _counted_rules(baskets, rows, least, confidence, most)
    found = rules.filter(verdict.startswith("label:") & (F.size("antecedent") <= most) & (F.col("lift") > 1.0))
    found = ws.table(
        found.select(F.array_sort("antecedent").alias("tokens"), F.substring(verdict, 7, 1000).alias("label"), "confidence", "support"),
        "rules",
    )
    general = found.select(F.col("tokens").alias("g"), F.col("label").alias("label"), F.col("confidence").alias("gc"))
    # Each rule has at most 2**TOKENS parts, so that its more general rules are found by equality.
    parts = found.withColumn("part", F.explode(_subsets(F.col("tokens"), most)))
    beaten = parts.join(general, (parts["part"] == general["g"]) & (parts["label"] == general["label"]) & (general["gc"] >= parts["confidence"])).select(parts["tokens"], parts["label"]).distinct()
    kept = found.join(beaten, ["tokens", "label"], "left_anti")
    # The key of the index: the rarest token.
    single = baskets.select(F.explode("items").alias("token")).groupBy("token").count()
    each = kept.withColumn("token", F.explode("tokens")).join(single, "token")
    keys = each.groupBy("tokens", "label").agg(F.min_by("token", F.struct("count", "token")).alias("key"))
    return ws.table(kept.join(keys, ["tokens", "label"]).select("tokens", "key", "label", "confidence", "support"), "index")


def _counted_rules(baskets: DataFrame, rows: int, least: int, confidence: float, most: int) -> DataFrame:
    """The rules for labels that FP-growth finds, with up to `most` tokens, by counting the combinations of distinct baskets."""
    is_label = lambda x: x.startswith("label:")
    sets = baskets.groupBy("items").agg(F.count(F.lit(1)).alias("n"))
    sets = sets.select("n", F.filter("items", is_label).getItem(0).alias("label"), F.filter("items", lambda x: ~is_label(x)).alias("rest"))
    level, levels = sets.withColumn("antecedent", F.array().cast("array<string>")), []
    for _ in range(most):
        level = level.select("n", "label", "rest", "antecedent", F.posexplode("rest").alias("i", "token"))
        level = level.select("n", "label", F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest"), F.array_append("antecedent", F.col("token")).alias("antecedent"))
        levels.append(level.select("antecedent", "label", "n"))
    both = reduce(DataFrame.unionAll, levels).groupBy("antecedent", "label").agg(F.sum("n").alias("n"))
    per = both.groupBy("antecedent").agg(F.sum("n").alias("of")).filter(F.col("of") >= least)
    shares = sets.filter("label is not null").groupBy("label").agg((F.sum("n") / rows).alias("share"))
    # One row a label.
    joined = both.filter(F.col("label").isNotNull() & (F.col("n") >= least)).join(per, "antecedent").join(F.broadcast(shares), "label")
    sure = F.col("n") / F.col("of")
    return joined.filter(sure >= confidence).select("antecedent", F.array("label").alias("consequent"), sure.alias("confidence"), (sure / F.col("share")).alias("lift"), (F.col("n") / rows).alias("support"))


def _subsets(tokens: Column, most: int) -> Column:
    """Proper, non-empty subsets of up to `most` tokens, each in order."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(tokens)) - 2).cast("int"))
    return F.when(
        F.size(tokens) > 1,
        F.transform(masks, lambda m: F.filter(tokens, lambda x, i: (F.floor(m / F.pow(F.lit(2), i)) % 2) == 1)),
    ).otherwise(F.array().cast("array<array<string>>"))


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, default: str = "allow", **mining) -> DataFrame:
    """pages with host, path, rule, verdict and pattern (the mined rule's tokens).

    labels: url, label; by default the URLs that a given rule decides. Verdict: the given rule's, else that of the mined rule with the
    highest confidence (then support, more tokens, order of tokens), else `default`. A URL that is null or has no '://' has an
    empty host and path and no rule. Rows with the same URL have the same verdict. Columns of the input with names of results
    are replaced. An empty table gives an empty result.
    """
    ws = Workspace(pages.sparkSession, "url-filter")
    own = ("host", "path", "rule", "verdict", "pattern")
    u = F.col(url)
    rows = pages.drop(*own)
    host, path = host_of(u), path_of(u)
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)

    def with_tokens(df: DataFrame) -> DataFrame:
        return df.withColumn("host", host).withColumn("path", path).withColumn("__tokens", tokens_of(u, F.col("host"), F.col("path")))

    rows = with_tokens(rows).withColumn("rule", rule).withColumn("__given", verdict)
    if labels is None:
        labelled = rows.filter(F.col("__given").isNotNull()).select(F.col("__tokens").alias("tokens"), F.col("__given").alias("label"))
    else:
        labelled = with_tokens(labels.filter("label is not null").withColumnRenamed("url", url)).select(F.col("__tokens").alias("tokens"), F.col("label").cast("string"))
    index = mine_rules(labelled, ws, **mining)
    sets = rows.filter(F.col("__given").isNull()).groupBy("__tokens").agg(F.count(F.lit(1)).alias("n"))
    looked = sets.select("__tokens", F.explode("__tokens").alias("key")).join(index, "key").filter(F.size(F.array_except("tokens", "__tokens")) == 0)
    order = F.struct((-F.col("confidence")).alias("a"), (-F.col("support")).alias("b"), (-F.size("tokens")).alias("c"), F.col("tokens").alias("d"), F.col("label").alias("e"))
    best = looked.groupBy("__tokens").agg(F.min(order).alias("__best")).select(F.col("__tokens").alias("__set"), F.col("__best.d").alias("pattern"), F.col("__best.e").alias("__mined"))
    # Rows that a given rule decides need no lookup, and would all have the same empty key.
    decided = rows.filter(F.col("__given").isNotNull()).withColumn("pattern", F.lit(None).cast("array<string>")).withColumn("verdict", F.col("__given"))
    found = rows.filter(F.col("__given").isNull()).join(best.hint("merge"), F.col("__tokens") == F.col("__set"), "left").withColumn("verdict", F.coalesce("__mined", F.lit(default)))
    return decided.unionByName(found.drop("__mined", "__set")).drop("__given", "__tokens")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern")
