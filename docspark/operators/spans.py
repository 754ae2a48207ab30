"""Spans: rows (or array elements) with entity_type, start, end, score, recognizer; end is exclusive, offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: classes of identifiers that fail their checksum, and the rule that failed
INVALID_RULES = {
    "AU_TFN_INVALID": "TFN mod-11 checksum failed",
    "AU_MEDICARE_INVALID": "Medicare mod-10 checksum failed",
    "AU_MEDICARE_MALFORMED": "Medicare first digit outside 2-6 (structurally impossible)",
    "AU_ABN_INVALID": "ABN mod-89 checksum failed",
    "AU_ACN_INVALID": "ACN complement checksum failed",
    "CREDIT_CARD_INVALID": "Luhn checksum failed",
}
ROUTING = "AU_BSB"
SPAN = "struct<entity_type:string,start:int,end:int,score:double,recognizer:string>"


def is_invalid(kind: Column) -> Column:
    return kind.isin(*INVALID_RULES)


def merge_overlaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row per island of overlapping spans within ``keys``: its extent, and type and score of its best member.

    Touching spans do not overlap. A routing code may name an island only if it covers all of it; any valid type goes
    before any invalid class, then the score decides, then the earlier start, the longer span, the type. One shuffle by
    keys, with a running maximum; the island's aggregate reuses its partitioning. Adds ``members``.
    """
    order = Window.partitionBy(*keys).orderBy("start", F.col("end").desc())
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    island = F.sum("opened").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn("opened", opened).withColumn("island", island)
    whole = Window.partitionBy(*keys, "island")
    marked = marked.withColumn("lo", F.min("start").over(whole)).withColumn("hi", F.max("end").over(whole))
    names_it = (F.col("entity_type") != ROUTING) | ((F.col("start") == F.col("lo")) & (F.col("end") == F.col("hi")))
    rank = F.struct(names_it.cast("int"), (~is_invalid(F.col("entity_type"))).cast("int"), F.col("score"), -F.col("start"), F.col("end"), F.col("entity_type"))
    out = marked.groupBy(*keys, "island").agg(F.max_by(F.struct("entity_type", "score"), rank).alias("best"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("members"))
    return out.select(*keys, "best.entity_type", "start", "end", "best.score", "members")


def merge_array(spans: Column) -> Column:
    """merge_overlaps for an array within one row: no shuffle."""
    s = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(F.when(a["entity_type"] < b["entity_type"], -1).when(a["entity_type"] > b["entity_type"], 1).otherwise(0)))
    empty = F.array().cast(f"array<array<{SPAN}>>")
    step = lambda acc, x: F.when(
        x["start"] < acc["reach"],
        F.struct(F.greatest(acc["reach"], x["end"]).alias("reach"), F.concat(F.slice(acc["islands"], 1, F.size(acc["islands"]) - 1), F.array(F.array_append(F.element_at(acc["islands"], -1), x))).alias("islands")),
    ).otherwise(F.struct(x["end"].alias("reach"), F.array_append(acc["islands"], F.array(x)).alias("islands")))
    islands = F.aggregate(s, F.struct(F.lit(-1).alias("reach"), empty.alias("islands")), step, lambda acc: acc["islands"])

    def label(members: Column) -> Column:
        lo, hi = F.array_min(F.transform(members, lambda m: m["start"])), F.array_max(F.transform(members, lambda m: m["end"]))
        ranked = F.transform(
            members,
            lambda m: F.struct(((m["entity_type"] != ROUTING) | ((m["start"] == lo) & (m["end"] == hi))).cast("int").alias("a"), (~is_invalid(m["entity_type"])).cast("int").alias("b"), m["score"].alias("c"), (-m["start"]).alias("d"), m["end"].alias("e"), m["entity_type"].alias("t")),
        )
        best = F.array_max(ranked)
        return F.struct(best["t"].alias("entity_type"), lo.alias("start"), hi.alias("end"), best["c"].alias("score"))

    return F.transform(islands, label)


def resolve_greedy(spans: Column) -> Column:
    """Array for reading: highest score first, then longest, then earliest; what overlaps a kept span goes; by start."""
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct((-x["score"]).alias("a"), (x["start"] - x["end"]).alias("b"), x["start"].alias("c"), x["entity_type"].alias("d"), x.alias("x"))))
    kept = F.aggregate(ranked, F.array().cast(f"array<{SPAN}>"), lambda acc, r: F.when(F.forall(acc, lambda k: (r["x"]["end"] <= k["start"]) | (r["x"]["start"] >= k["end"])), F.array_append(acc, r["x"])).otherwise(acc))
    return F.array_sort(kept, lambda a, b: a["start"] - b["start"])


def drop_covered(candidates: DataFrame, by: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that no span of ``by`` covers, the same extent included: an anti-join on keys with a range condition."""
    a, b = candidates.alias("a"), by.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("b.start") <= F.col("a.start"), F.col("a.end") <= F.col("b.end")]
    return a.join(b, on, "left_anti")


def drop_contained(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates not strictly inside another; of equal extents all stay. Containment is transitive, so order is no matter."""
    a, b = candidates.alias("a"), candidates.select(*keys, "start", "end").distinct().alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("b.start") <= F.col("a.start"), F.col("a.end") <= F.col("b.end"), (F.col("a.start") != F.col("b.start")) | (F.col("a.end") != F.col("b.end"))]
    return a.join(b, on, "left_anti")


def drop_repeats(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans without those inside another of their class that scores higher, or as high and begins earlier or is longer.

    Equal rows become one, spans of score 0 go. Being inside and going before are transitive, so it is enough to look at
    all spans: an anti-join on keys and class.
    """
    own = spans.where("score > 0").distinct()
    # of equal extent, class and score one recognizer's row stays
    alike = [*keys, "entity_type", "start", "end", "score"]
    own = own.groupBy(*alike).agg(*[F.min(c).alias(c) for c in spans.columns if c not in alike]).select(*spans.columns)
    a, b = own.alias("a"), own.select(*alike).alias("b")
    before = lambda x: F.struct((-F.col(f"{x}.score")).alias("s"), F.col(f"{x}.start").alias("p"), (-F.col(f"{x}.end")).alias("e"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "entity_type"]] + [F.col("b.start") <= F.col("a.start"), F.col("a.end") <= F.col("b.end"), before("b") < before("a")]
    return a.join(b, on, "left_anti")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Pairs with a common code point, with ``lo``, ``hi`` and ``shared``: the part in common.

    An equi-join on keys with the overlap as a condition; columns of the right side are prefixed ``r_``.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = [F.col(k) == F.col(f"r_{k}") for k in keys] + [F.greatest("start", "r_start") < F.least("end", "r_end")]
    lo, hi = F.greatest("start", "r_start"), F.least("end", "r_end")
    return left.join(r, on, how).withColumn("lo", lo).withColumn("hi", hi).withColumn("shared", F.coalesce(hi - lo, F.lit(0)))


def overlaps_binned(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int = 4096) -> DataFrame:
    """``overlaps`` for keys with very many spans: both sides go to the bins they touch, pairs meet in their first common bin."""
    touch = lambda df, s, e: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / bin_size))))
    r = touch(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), "r_start", "r_end").withColumnRenamed("bin", "r_bin")
    on = [F.col(k) == F.col(f"r_{k}") for k in keys] + [F.col("bin") == F.col("r_bin"), F.greatest("start", "r_start") < F.least("end", "r_end")]
    met = touch(left, "start", "end").join(r, on).where(F.col("bin") == F.floor(F.greatest("start", "r_start") / bin_size))
    lo, hi = F.greatest("start", "r_start"), F.least("end", "r_end")
    return met.drop("bin", "r_bin").withColumn("lo", lo).withColumn("hi", hi).withColumn("shared", hi - lo)


def coalesce_adjacent(text: Column, spans: Column, gap: int = 4) -> Column:
    """Neighbouring ADDRESS or PERSON fragments of an array joined, each tested against what is joined before it.

    Up to ``gap`` characters of blanks and commas may lie between; between a single-word PERSON and the next also
    ``and`` or ``&``. The joined span has the later end and the higher score.
    """
    s = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        between = F.substring(text, last["end"] + 1, F.greatest(x["start"] - last["end"], F.lit(0)))
        close = (x["start"] - last["end"] <= gap) & between.rlike(r"^[,\s]*$")
        single = ~F.substring(text, last["start"] + 1, last["end"] - last["start"]).rlike(r"\s")
        joint = (x["entity_type"] == "PERSON") & single & between.rlike(r"(?i)^\s*(?:and|&)\s*$")
        same = last.isNotNull() & (last["entity_type"] == x["entity_type"]) & x["entity_type"].isin("ADDRESS", "PERSON") & (close | joint)
        joined = F.struct(last["entity_type"].alias("entity_type"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.greatest(last["score"], x["score"]).alias("score"), last["recognizer"].alias("recognizer"))
        return F.when(F.coalesce(same, F.lit(False)), F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), joined)).otherwise(F.array_append(acc, x))

    return F.aggregate(s, F.array().cast(f"array<{SPAN}>"), step)


def extend_honorific(text: Column, start: Column) -> Column:
    """Start moved left over a title and white space that end just before it."""
    # fixed values: the titles
    title = F.regexp_extract(F.substring(text, F.greatest(F.lit(1), start - 11), F.least(start, F.lit(12))), r"(?:^|\W)((?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+)$", 1)
    return start - F.length(title)


def corporate_licence_before(text: Column, start: Column) -> Column:
    """A financial or credit licence label ends just before the start: such a number is no driver licence."""
    before = F.substring(text, F.greatest(F.lit(1), start - 59), F.least(start, F.lit(60)))
    return before.rlike(r"(?is)\b(?:afsl|acl|(?:financial\s+services|credit)\s+licen[cs]e)\s*(?:no\.?|number|#)?\s*:?\s*$")


def text_windows(text: Column, size: int = 3000, stride: int = 2700, separator: str = "␞") -> Column:
    """Array of struct(start, text): overlapping windows within the parts between separators; blank ones are left out."""
    parts = F.split(text, separator)
    placed = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p) + len(separator)).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), p.alias("text"))).alias("out")),
        lambda acc: acc["out"],
    )
    count = lambda p: F.greatest(F.lit(0), F.ceil((F.length(p) - size) / F.lit(stride))).cast("int")
    cut = lambda x: F.transform(F.sequence(F.lit(0), count(x["text"])), lambda i: F.struct((x["start"] + i * stride).alias("start"), F.substring(x["text"], i * stride + 1, F.lit(size)).alias("text")))
    return F.filter(F.flatten(F.transform(placed, cut)), lambda w: w["text"].rlike(r"\S"))
