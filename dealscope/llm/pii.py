"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base spans (e-mail, IP, card, phone) come from fixed patterns. They are the
seeds. Lexical patterns are the word before a value, the word after it, and both together; patterns and values form
a weighted bipartite graph together with identifier-like candidates that no
base pattern accepts. Scores go back and forth for ``ROUNDS`` rounds: a
pattern's confidence for a kind is the mean score of the distinct values that it
stands at, a value's score is the best confidence of a pattern with at least
``MIN_SUPPORT`` supporting values and ``MIN_CONFIDENCE``. Values that reach
``MIN_CONFIDENCE`` are reported wherever they occur as candidates.

A text is cut into matches and the gaps between them, which become rows; running sums of their lengths within a document
give the offsets, so the time is linear in the number of matches. Regular expressions are written with possessive quantifiers, which match the
same text as the plain patterns but need neither recursion nor quadratic time.

Defined results: null and empty texts have no spans; overlapping matches of one
kind follow leftmost order; spans found by the method never overlap base spans; ties between kinds go to the one that sorts last;
repeated rows are reported row by row; a null doc_id is kept; an empty table gives no rows; very long texts are searched whole; extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop, stored, table

ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE = 3, 5, 0.8
_LOCAL = r"A-Za-z0-9._%+-"
#: kind -> pattern, and what a text must hold to be searched at all
KINDS = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", "[0-9]\\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "[0-9][\\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]"),
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: runs of any length; possessive ones start where a run starts, so that a long run is read once
_CANDIDATE = r"(?<![A-Za-z0-9@.+-])(?:[(+]?[0-9][0-9() .-]{5,}[0-9](?![0-9A-Za-z])|(?<![_%])[A-Za-z0-9._%+-]++(?:@|\[at\]|\(at\)|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]++)++|[A-Z]{2}[0-9]{2}[A-Z0-9]{8,}+(?![0-9A-Za-z]))"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(f"^{_BYTE}[.]{_BYTE}[.]{_BYTE}[.]{_BYTE}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _matches(kind: str, rank: int, pattern: str, has: Column) -> Column:
    """All matches in order, with the length of the gap before and the ends of the gaps on either side."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    after = F.slice(gaps, F.lit(2), F.size(found))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), after.alias("after"))
    row = lambda x, i: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("skip"), x["hit"].alias("hit"), F.substring(x["gap"], -64, 64).alias("before"), F.substring(x["after"], 1, 64).alias("after"))
    return F.when(has, F.transform(pairs, row)).otherwise(F.from_json(F.lit("[]"), "array<struct<rank:int,kind:string,i:int,skip:int,hit:string,before:string,after:string>>"))


def _word(c: Column) -> Column:
    """Lower case, with digits made alike; empty without a letter."""
    return F.when(c.rlike("[A-Za-z]"), F.regexp_replace(F.lower(c), "[0-9]+", "9")).otherwise("")


def span_rows(documents: DataFrame) -> DataFrame:
    """One row per valid base match and per candidate beside them (base false): uid, doc_id, rank, kind, start, end, hit, left, right; documents without any have one row of nulls."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid"))
    text = F.col("text")
    every = [_matches(kind, i, pattern, text.contains(need) if len(need) == 1 else text.rlike(need)) for i, (kind, (pattern, need)) in enumerate(KINDS.items())]
    every.append(_matches("other", len(KINDS), _CANDIDATE, text.rlike("[0-9]{2}|@|[(\\[ ]at[)\\] ]")))
    rows = docs.select("uid", "doc_id", F.explode_outer(F.concat(*every)).alias("m")).select("uid", "doc_id", "m.*").repartition("uid")
    own = Window.partitionBy("uid", "rank").orderBy("i")
    size = F.length("hit")
    left = F.substring(F.concat(F.coalesce(F.lag("hit").over(own), F.lit("")), "before"), -64, 64)
    rows = rows.withColumns({"end": F.sum(F.col("skip") + size).over(own).cast("int"), "left": _word(F.regexp_extract(left, r"(\S{1,30})\s*$", 1)), "right": _word(F.regexp_extract("after", r"^\s*(\S{1,30})", 1))})
    valid = F.col("rank").isNull() | (F.col("kind") == "other")
    for kind in KINDS:
        valid = valid | ((F.col("kind") == kind) & _valid(kind, F.col("hit")))
    rows = rows.withColumn("start", F.col("end") - size).withColumn("ok", F.col("rank").isNull() | (F.when(F.col("rank").isNotNull(), valid)))
    base = F.col("ok") & (F.col("kind") != "other")
    near = Window.partitionBy("uid").orderBy("start")
    before = F.max(F.when(base, F.col("end"))).over(near.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(base, F.col("start"))).over(near.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("free", ~F.coalesce(before > F.col("start"), F.lit(False)) & ~F.coalesce(after < F.col("end"), F.lit(False)))
    keep = base | (F.col("kind") == "other") & F.col("free")
    # a document without spans keeps one row
    last = F.row_number().over(Window.partitionBy("uid").orderBy(F.when(keep, 0).otherwise(1), "start", "rank"))
    rows = rows.withColumn("one", last).where(F.coalesce(keep, F.lit(False)) | (F.col("one") == 1))
    kept = F.coalesce(keep, F.lit(False))
    return rows.select("uid", "doc_id", *(F.when(kept, F.col(c)).alias(c) for c in ("rank", "kind", "start", "end", "hit", "left", "right")), F.when(kept, base).alias("base"))


def discover(spans: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(value, kind, score) of the candidates that confident patterns stand at."""
    beside = F.array(F.when(F.col("left") != "", F.concat(F.lit("before "), "left")), F.when(F.col("right") != "", F.concat(F.lit("after "), "right")), F.when((F.col("left") != "") & (F.col("right") != ""), F.concat_ws(" ", F.lit("between"), "left", "right")))
    edges = spans.where("hit is not null").select(F.explode(beside).alias("pattern"), F.col("hit").alias("value"), F.when(F.col("base"), F.col("kind")).alias("kind"))
    edges = stored(edges.where("pattern is not null").distinct())
    size = edges.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= min_support)
    known = edges.where("kind is not null").select("pattern", "kind", F.lit(1.0).alias("score"))
    unknown = edges.where("kind is null").select("pattern", "value")
    scored = None
    for _ in range(rounds):
        gathered = known if scored is None else known.union(unknown.join(scored, "value").select("pattern", "kind", "score"))
        patterns = gathered.groupBy("pattern", "kind").agg(F.sum("score").alias("support")).where(F.col("support") >= min_support).join(size, "pattern")
        confident = patterns.select("pattern", "kind", (F.col("support") / F.col("size")).alias("confidence")).where(F.col("confidence") >= min_confidence)
        new = stored(unknown.join(confident, "pattern").groupBy("value").agg(F.max(F.struct(F.col("confidence").alias("score"), "kind")).alias("s")).select("value", "s.kind", "s.score"))
        if scored is not None:
            drop(scored)
        scored = new
    drop(edges)
    return scored


def find_pii(documents: DataFrame) -> DataFrame:
    """Per document row: doc_id, base and found spans as sorted arrays of (rank, kind, start, end, hit)."""
    spans = stored(span_rows(documents))
    values = discover(spans).select(F.col("value").alias("hit"), F.col("kind").alias("as"))
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    found = spans.where("not base").join(values, "hit").select("uid", "doc_id", rank[F.col("as")].alias("rank"), F.col("as").alias("kind"), "start", "end", "hit", F.lit(False).alias("base"))
    rows = spans.where("base is null or base").select("uid", "doc_id", "rank", "kind", "start", "end", "hit", "base").union(found)
    # candidates alone leave no row of nulls, so their documents get one
    rows = rows.union(spans.where("not base").select("uid", "doc_id").distinct().select("uid", "doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("kind", "string"), ("start", "int"), ("end", "int"), ("hit", "string"), ("base", "boolean")))))
    span = F.struct("rank", "kind", "start", "end", "hit")
    return rows.groupBy("uid", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(F.when(~F.col("base"), span))).alias("found")).drop("uid")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", functools.partial(lambda k, s: s["kind"] == k, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return got.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_found"))
