"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found by pattern, leftmost and without overlap in each kind:
``assign`` (a value of 6 or more characters given to a password, secret, token
or key name), ``access`` (AKIA keys of 20 or more) and ``hex`` (runs of 24 or
more).  Every value, and every other run of 24 or more letters, digits, ``_`` or
``-`` that holds a digit and letters of either case, is a candidate: its hash is
counted over the corpus by distinct owners and, for each owner, by distinct
repositories.  A value looks live if it has at most ``MAX_OWNERS`` owners, in however
many repositories of theirs it stands, or if one owner has ``OWN_SHARE`` tenths or more
of its repositories (a key that leaked out of its owner's into a few others'); other
values are widely copied examples.  Both are counts of owners or shares, so neither the
size of an owner nor that of the corpus changes a verdict.  Other runs that look live
and touch no base span are added as spans of kind ``owned``.

For documents the owner is ``source`` and a repository is a document of an owner.
Distinct (hash, owner, repository) are dealt by all three, then counted by (hash, owner)
and by hash, each combined before its shuffle, so that a value in a third of all rows
sends a row a task to its counters.

Edge cases: null text counts as empty; null owners count as one owner, null ids as one
repository of their owner; rows that share an id are judged each by its own text; an empty
table gives no rows; texts without spans give empty lists
and the digest of the empty text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import cut, text_of

MAX_OWNERS = 2
OWN_SHARE = 9  # tenths
KINDS = ("assign", "access", "hex", "owned")  # in the order of the report
_ASSIGN = r"""(?=[apstAPST])((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A failing access or hex match holds no other one, so the least length may stand in the pattern; runs start where no
# character of theirs stands before, and are taken whole (possessive), so that no run is read twice.
_PATTERNS = ((_ASSIGN, 2, 6), (r"AKIA[A-Z0-9]{16,}", 0, 20), (r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
             (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+", 0, 24))
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, kind: int) -> Column:
    """The matches of one kind that are long enough, as (start, kind, end, value) in code points."""
    pattern, group, least = _PATTERNS[kind]
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.array_append(acc["out"], span))
                        .otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_SPAN)
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _looks_mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """One row a document, written out: rid, doc_id, key (text hash), owner, base and other spans."""
    text = text_of()
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), F.col(owner).cast("string").alias("owner"),
                       *(_spans(text, k).alias(f"s{k}") for k in range(4)))
    base = F.array_sort(F.concat("s0", "s1", "s2"))
    rows = rows.select("doc_id", "key", "owner", base.alias("base"), F.col("s3"))
    apart = F.filter("s3", lambda x: _looks_mixed(x["value"]) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return cut(rows.select("doc_id", "key", "owner", "base", apart.alias("other"))
               .withColumn("rid", F.monotonically_increasing_id()))


def judged(found: DataFrame) -> DataFrame:
    """(rid, spans): all spans of each row that has any, with ``live``; those of kind owned only where live."""
    spans = (found.where("size(base) + size(other) > 0")
             .select("rid", "doc_id", "owner", F.explode(F.concat("base", "other")).alias("s"))
             .withColumn("hash", F.sha2(F.col("s.value"), 256)))
    held = spans.select("hash", "owner", "doc_id").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    holders = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.max("n").alias("most"))
    live = (F.col("owners") <= MAX_OWNERS) | (F.col("most") * 10 >= F.col("repositories") * OWN_SHARE)
    span = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), live.alias("live"))
    return (spans.join(holders, "hash").where((F.col("s.kind") < 3) | live)
            .groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("spans")))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, ``spans`` with the added ones, n_owned, n_live, n_example."""
    found = scan(docs)
    rows = found.select("rid", "doc_id", "base").join(judged(found), "rid", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>"))
    count = lambda test: F.size(F.filter(spans, test)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k).alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *map(of_kind, range(4)),
                       F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(spans).alias("spans"),
                       count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_example"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with every span replaced by its kind in angle brackets; other texts stay as they are."""
    found = scan(docs)
    spans = (found.select("rid", "doc_id", "key").join(judged(found), "rid").drop("rid")
             .dropDuplicates(["doc_id", "key"]).withColumnRenamed("doc_id", "id"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("of"), text_of().alias("text"))
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    text = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    joined = (rows.join(spans, F.col("of").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("key")), "left")
              .select("row", F.when(F.col("spans").isNotNull(), text).alias("new")))
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out["text"] = F.coalesce("new", out["text"])
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return joined.select(*(out[c].alias(c) for c in docs.columns))
