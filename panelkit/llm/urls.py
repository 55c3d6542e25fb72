"""URL filter: fixed host rules, then association rules that FP-growth mines from what those label.

A url becomes a set of tokens: host labels, path segments with digits folded,
query keys.  Pages that a fixed rule decides are the labelled transactions (their
tokens and their verdict); FP-growth finds token sets that imply a verdict with
``MIN_SUPPORT`` and ``MIN_CONFIDENCE`` or more, and a set is pruned when a part of
it implies a verdict at least as surely.  Matching uses an inverted index: every
rule stands under its rarest token, a page looks up its tokens and keeps the rules
that it holds whole.  The surest rule decides (then the better supported, then
block); a page without any is allowed.

DataFrame functions and Spark's FP-growth only.  The index has at most some rules
for each of the 1 / ``MIN_SUPPORT`` frequent tokens; it is broadcast only if it
counts ``BROADCAST_RULES`` rows or fewer.  A host with a third of all pages costs
no skew: rows are dealt by row, and token counts combine before their shuffle.

Edge cases: a null url, or one without ``://``, has an empty host and path, no
tokens and the verdict allow; rows that share an id are judged each by its url;
without labelled pages there are no mined rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import cut

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    mark = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    folded = F.regexp_replace(path, "[0-9]+", "0")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(mark("host ", F.split(host, r"\.")), mark("path ", F.split(folded, "/")), mark("query ", keys)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (need: tokens, verdict, confidence, support, under: the token to look up) from (tokens, verdict)."""
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit("label "), "verdict")).alias("items"))
    model = FPGrowth(minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    said = F.element_at("consequent", 1)
    rules = (model.associationRules.where(said.startswith("label ") & ~F.exists("antecedent", lambda x: x.startswith("label ")))
             .select(F.array_sort("antecedent").alias("need"), F.substring_index(said, " ", -1).alias("verdict"), "confidence", "support"))
    often = model.freqItemsets.where("size(items) = 1").select(F.element_at("items", 1).alias("token"), "freq")
    under = (rules.select("need", F.explode("need").alias("token")).join(often, "token")
             .groupBy("need").agg(F.min_by("token", F.struct("freq", "token")).alias("under")))
    rules = cut(rules.join(under, "need"))
    part = rules.select(F.col("under").alias("token"), F.col("need").alias("part"), F.col("confidence").alias("surely"))
    weaker = (rules.where("size(need) > 1").select("need", "verdict", "confidence", F.explode("need").alias("token")).join(part, "token")
              .where((F.size("part") < F.size("need")) & (F.col("surely") >= F.col("confidence")) & (F.size(F.array_except("part", "need")) == 0))
              .select("need").distinct())
    return rules.join(weaker, "need", "left_anti")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, n_matched of every row of ``pages``."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = cut(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"),
                           tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
               .withColumn("rid", F.monotonically_increasing_id()))
    mined = cut(mine(rows.where("fixed is not null").select("tokens", F.col("fixed").alias("verdict"))))
    index = F.broadcast(mined) if mined.count() <= BROADCAST_RULES else mined
    asked = rows.where("fixed is null").select("rid", "tokens", F.explode("tokens").alias("under"))
    best = F.struct("confidence", "support", "verdict", "need")  # block is greater than allow
    found = (asked.join(index, "under").where(F.size(F.array_except("need", "tokens")) == 0)
             .groupBy("rid").agg(F.max(best).alias("best"), F.count("*").alias("n")))
    return (rows.join(found, "rid", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("fixed", "best.verdict", F.lit("allow")).alias("verdict"),
                    F.coalesce("n", F.lit(0)).alias("n_matched")))
