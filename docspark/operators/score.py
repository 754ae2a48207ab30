"""Scoring against ground truth: verdicts, pivots, the leak gate, OCR error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import normalize, squash_confusable

VERDICTS = ("stripped", "partial", "leaked", "kept", "over-stripped")
# fixed values: tiers of evidence in reporting order
EVIDENCE = ("likely", "context", "all")
#: Up to so many spans of a key are taken one by one; with more, an entity looks its own up. Results are equal.
FEW = 32


def verdicts(truth: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """truth (keys, type, start, end, strip_expected, critical) with covered and verdict.

    Covered is how many of its characters the plan's spans (disjoint) cover; an entity that none of them touches counts
    with its whole length, as the queries' SQL has it. What should go is stripped, partial or leaked; what should stay
    is kept or over-stripped. The plan comes as arrays per key, so truth rows pass a single join and equal ones stay
    apart; a task sorts each side once. No span touches a row whose key is null.

    Where a key has more than FEW spans, their starts and ends come in order, and an entity finds its own part of them by
    halving: a span covers of it what lies after its start less what lies after its end, so sums over either suffice.
    Few spans, and those with a bound that is null (it sets no limit, but two do not meet), are taken one by one.
    """
    start, end = F.col("start"), F.col("end")
    p = plan.groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("__p"))
    many, plain = F.size("__p") > FEW, F.filter("__p", lambda x: x["start"] < x["end"])
    p = p.select(*keys, F.when(many, F.filter("__p", lambda x: x["start"].isNull() | x["end"].isNull())).otherwise(F.col("__p")).alias("__p"), *[F.when(many, F.sort_array(F.transform(plain, lambda x: x[c].cast("long")))).alias(f"__{c}s") for c in ("start", "end")])  # noqa: B023
    powers = F.transform(F.sequence(F.length(F.bin(F.size("__starts").cast("long"))), F.lit(1), F.lit(-1)), lambda i: F.pow(F.lit(2), i - 1).cast("int"))
    p = p.withColumn("__halves", F.when(F.col("__starts").isNotNull(), powers))
    lo, hi = F.coalesce("start", F.get("__starts", F.lit(0))).cast("long"), F.coalesce("end", F.get("__ends", F.size("__ends") - 1)).cast("long")
    before = lambda a, x: F.aggregate("__halves", F.lit(0), lambda n, w: F.when(F.get(a, n + w - 1) < x, n + w).otherwise(n))
    within = lambda a, n: F.aggregate(F.slice(a, n["i"] + 1, n["j"] - n["i"]), n["i"] * (hi - lo), lambda k, x: k + hi - x)
    after = lambda a: F.get(F.transform(F.array(F.struct(before(a, lo).alias("i"), before(a, hi).alias("j"))), lambda n: within(a, n)), 0)
    ordered = F.when(F.col("__starts").isNotNull() & (lo < hi), after("__starts") - after("__ends")).otherwise(F.lit(0).cast("long"))
    shared = lambda x: F.greatest(F.coalesce(F.least("end", x["end"]) - F.greatest("start", x["start"]), F.lit(0)), F.lit(0))
    touched = F.aggregate("__p", ordered, lambda n, x: n + shared(x), lambda n: F.when(n > 0, n))
    covered = F.coalesce(touched, end - start, F.lit(0)).cast("long")
    out = truth.join(p, keys, "left").select(*truth.columns, covered.alias("covered"))
    return out.withColumn("verdict", verdict(F.col("strip_expected"), F.col("covered"), F.col("end") - F.col("start")))


def verdict(expected: Column, covered: Column, length: Column) -> Column:
    return F.when(expected, F.when(covered >= length, "stripped").when(covered > 0, "partial").otherwise("leaked")).otherwise(F.when(covered > 0, "over-stripped").otherwise("kept"))


def cell_verdicts(truth: DataFrame, output: DataFrame, keys: list[str]) -> DataFrame:
    """truth (keys, value, strip_expected, ...) by whether its value survives in the output cell's text, normalized; an empty value never does."""
    met = truth.join(output.select(*keys, F.col("value").alias("__out")), keys, "left")
    n = normalize(F.col("value"))
    survives = F.coalesce((n != "") & F.contains(normalize(F.col("__out")), n), F.lit(False))
    return met.withColumn("verdict", F.when(F.col("strip_expected"), F.when(survives, "leaked").otherwise("stripped")).otherwise(F.when(survives, "kept").otherwise("over-stripped"))).drop("__out")


def logged(truth: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Injected invalid identifiers that a finding of their type overlaps: a semi-join."""
    return _matching(truth, findings, keys, "left_semi", "type", "entity_type")


def noise(findings: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that no injected identifier of their type overlaps: an anti-join."""
    return _matching(findings, truth, keys, "left_anti", "entity_type", "type")


def _matching(a: DataFrame, b: DataFrame, keys: list[str], how: str, kind_a: str, kind_b: str) -> DataFrame:
    x, y = a.alias("x"), b.alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys] + [F.col(f"x.{kind_a}") == F.col(f"y.{kind_b}"), F.greatest("x.start", "y.start") < F.least("x.end", "y.end")]
    return x.join(y, on, how)


def verdict_pivot(scored: DataFrame) -> DataFrame:
    """type, a count per verdict, n, recall (stripped of those to strip)."""
    out = scored.groupBy("type").pivot("verdict", list(VERDICTS)).count().na.fill(0)
    n = out["stripped"] + out["partial"] + out["leaked"]
    return out.withColumn("n", sum((out[v] for v in VERDICTS), F.lit(0))).withColumn("recall", F.when(n > 0, out["stripped"] / n))


def survival(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(type, stripped, leaked, fuzzy, n, recall) of entities to strip, (type, kept, over_stripped, n) of those to keep.

    Split by each entity's own expectation, as a type may be on both sides. ``fuzzy`` counts leaks that only a fuzzy
    match found. scored holds type, verdict, match and strip_expected.
    """
    is_ = lambda v: F.col("verdict") == v
    go = scored.where("strip_expected").groupBy("type").agg(F.count_if(is_("stripped")).alias("stripped"), F.count_if(is_("leaked")).alias("leaked"), F.count_if(is_("leaked") & (F.col("match") == "fuzzy")).alias("fuzzy"))
    go = go.withColumn("n", F.col("stripped") + F.col("leaked")).withColumn("recall", F.when(F.col("n") > 0, F.col("stripped") / F.col("n")).otherwise(0.0))
    stay = scored.where("NOT strip_expected").groupBy("type").agg(F.count_if(is_("kept")).alias("kept"), F.count_if(is_("over-stripped")).alias("over_stripped"))
    return go, stay.withColumn("n", F.col("kept") + F.col("over_stripped"))


def rendered_truth(renders: DataFrame, truth: DataFrame) -> DataFrame:
    """Entities of each rendered file: renders (file, source, ...) with the truth rows of its source file."""
    own = truth.withColumnRenamed("file", "source")
    return renders.join(own, "source")


def strip_types(scored: DataFrame) -> DataFrame:
    """Types of which nothing was expected to stay."""
    return scored.groupBy("type").agg(F.bool_or(F.col("verdict").isin("kept", "over-stripped")).alias("k")).where(~F.col("k")).select("type")


def evidence_breakdown(scored: DataFrame, was_logged: Column) -> DataFrame:
    """evidence, logged, total, in the order of EVIDENCE."""
    place = F.array_position(F.array(*[F.lit(e) for e in EVIDENCE]), F.col("evidence"))
    return scored.where("evidence IS NOT NULL").groupBy("evidence").agg(F.count_if(was_logged).alias("logged"), F.count("*").alias("total")).orderBy(place)


def critical_failures(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("critical") & F.col("verdict").isin("leaked", "partial"))


def gate(scored: DataFrame) -> DataFrame:
    """One row: critical entities, failures, passed (no failure)."""
    bad = F.col("critical") & F.col("verdict").isin("leaked", "partial")
    return scored.agg(F.count_if("critical").alias("critical"), F.count_if(bad).alias("failures")).withColumn("passed", F.col("failures") == 0)


def find_value(value: Column, text: Column) -> Column:
    """``exact``: the normalized value is in the text; ``fuzzy``: its confusable form of 4 signs or more is; else null.

    Values of 8 signs or more may differ further: see align.substring_distance.
    """
    v, s = normalize(value), squash_confusable(value)
    return F.when((v != "") & F.contains(normalize(text), v), "exact").when((F.length(s) >= 4) & F.contains(squash_confusable(text), s), "fuzzy")


def error_rates(cells: DataFrame, by: list[str]) -> DataFrame:
    """cer and wer per group: sums of errors over sums of characters and words, not means of ratios."""
    return cells.groupBy(*by).agg((F.sum("char_errors") / F.nullif(F.sum("chars"), F.lit(0))).alias("cer"), (F.sum("word_errors") / F.nullif(F.sum("words"), F.lit(0))).alias("wer"))


def error_matrix(cells: DataFrame, rows: list[str], column: str, values: list | None = None) -> DataFrame:
    """Character error rate by ``rows`` and the values of ``column``."""
    return cells.groupBy(*rows).pivot(column, values).agg(F.sum("char_errors") / F.nullif(F.sum("chars"), F.lit(0)))


def merge_counters(cells: DataFrame, counters: str, by: list[str] | None = None, top: int | None = 20) -> DataFrame:
    """key, n: map counters of all cells added up; the ``top`` greatest, ties by key."""
    out = cells.select(*(by or []), F.explode(counters).alias("key", "v")).groupBy(*(by or []), "key").agg(F.sum("v").alias("n"))
    return out if top is None else out.orderBy(F.col("n").desc(), "key").limit(top)


def confidence_bin(conf: Column) -> Column:
    """0 to 9 for confidences of 0 to 100."""
    return F.least(F.greatest(F.floor(conf / 10), F.lit(0)), F.lit(9)).cast("int")


def confidence_histogram(words: DataFrame, by: list[str]) -> DataFrame:
    """bin, correct, wrong, and the mean confidence of either, from words (conf, ok)."""
    return words.groupBy(*by, confidence_bin(F.col("conf")).alias("bin")).agg(F.count_if("ok").alias("correct"), F.count_if(~F.col("ok")).alias("wrong"))


def confidence_means(cells: DataFrame, by: list[str]) -> DataFrame:
    """Means from partial sums (conf_sum_ok, conf_n_ok, conf_sum_bad, conf_n_bad)."""
    return cells.groupBy(*by).agg((F.sum("conf_sum_ok") / F.nullif(F.sum("conf_n_ok"), F.lit(0))).alias("mean_ok"), (F.sum("conf_sum_bad") / F.nullif(F.sum("conf_n_bad"), F.lit(0))).alias("mean_bad"))


def resegmentation(words: DataFrame, page: list[str]) -> DataFrame:
    """Distinct lines per page, and visual lines that were split over more than one."""
    per = words.groupBy(*page, "visual").agg(F.count_distinct("line").alias("k"))
    lines = words.groupBy(*page).agg(F.count_distinct("line").alias("lines"))
    return lines.join(per.groupBy(*page).agg(F.count_if(F.col("k") > 1).alias("fragmented")), page)


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a sweep without a result yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def aligned_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Rows as padded text with two blanks between columns; widths come from one aggregate that is joined back as one row."""
    widths = rows.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(f"__{c}") for c in columns])
    padded = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), F.greatest(F.coalesce(F.col(f"__{c}"), F.lit(0)), F.lit(len(c))), F.lit(" ")) for c in columns]
    return rows.join(F.broadcast(widths)).select(*order, F.regexp_replace(F.concat_ws("  ", *padded), r"\s+$", "").alias("line"))
