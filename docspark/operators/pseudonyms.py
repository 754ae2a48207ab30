"""Pseudonyms: placeholders numbered per class in first-seen order, kept in a map relation, reversible.

The map is ``pmap(scope, prefix, norm_value, placeholder, n, surface)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import collapse, normalize
from docspark.storage import stored

# fixed values: prefix of each class; other classes go by their own name
PREFIXES = {
    "PERSON": "PERSON",
    "EMAIL_ADDRESS": "EMAIL",
    "PHONE_NUMBER": "PHONE",
    "AU_TFN": "TFN",
    "AU_MEDICARE": "MEDICARE",
    "AU_ABN": "ABN",
    "AU_ACN": "ACN",
    "AU_TFN_INVALID": "TFN_INVALID",
    "AU_MEDICARE_INVALID": "MEDICARE_INVALID",
    "AU_MEDICARE_MALFORMED": "MEDICARE_MALFORMED",
    "AU_ABN_INVALID": "ABN_INVALID",
    "AU_ACN_INVALID": "ACN_INVALID",
    "CREDIT_CARD_INVALID": "CARD_INVALID",
    "AU_BSB": "BSB",
    "AU_BANK_ACCOUNT": "ACCOUNT",
    "AU_PAYID": "PAYID",
    "CREDIT_CARD": "CARD",
    "ADDRESS": "ADDRESS",
    "DATE_OF_BIRTH": "DOB",
    "ORGANIZATION": "ORG",
}
TOKEN = r"[A-Z][A-Z_]*_[0-9]+"
PMAP = "scope string, prefix string, norm_value string, placeholder string, n long, surface string"


def prefix_of(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), kind), kind)


def allocate(mentions: DataFrame, order: list[str], pmap: DataFrame | None = None) -> DataFrame:
    """The map for mentions (scope, entity_type, value, and the columns of ``order``), extending ``pmap`` if given.

    A value (normalized) keeps its placeholder; new ones go on from the class's highest number, in the order of their
    first mention. Mentions shrink to one row per distinct value before numbering, with a map-side aggregate. The values
    are dealt by ranges of (scope, prefix, first mention) and numbered within their range; counts of the ranges, one
    small row each, carry the numbers on, so a class of any size spreads over tasks. A null scope is the empty one.
    """
    first = F.struct(*order)
    own = mentions.select(F.coalesce("scope", F.lit("")).alias("scope"), prefix_of(F.col("entity_type")).alias("prefix"), normalize(F.col("value")).alias("norm_value"), first.alias("first"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("surface"))
    new = own.groupBy("scope", "prefix", "norm_value").agg(F.min(F.struct("first", "surface")).alias("x"))
    if pmap is not None:
        new = new.join(pmap, ["scope", "prefix", "norm_value"], "left_anti")
        base = pmap.groupBy("scope", "prefix").agg(F.max("n").alias("base"))
        new = new.join(base, ["scope", "prefix"], "left")
    else:
        new = new.withColumn("base", F.lit(0).cast("long"))
    keys = ["scope", "prefix"]
    new = stored(new.repartitionByRange(*keys, "x.first", "norm_value").withColumn("chunk", F.spark_partition_id()), "values")
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = new.groupBy(*keys, "chunk").agg(F.count("*").alias("k")).select(*keys, "chunk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy(*keys, "chunk").orderBy("x.first", "norm_value")
    n = F.coalesce("base", F.lit(0)) + F.col("earlier") + F.row_number().over(within)
    new = new.join(counts, [*keys, "chunk"]).withColumn("n", n.cast("long")).select("scope", "prefix", "norm_value", F.concat_ws("_", "prefix", F.col("n").cast("string")).alias("placeholder"), "n", F.col("x.surface").alias("surface"))
    return new if pmap is None else pmap.unionByName(new)


def splice(text: Column, parts: Column) -> Column:
    """Text with array<struct(start, end, placeholder)>, disjoint and in order, put in: one pass over the gaps."""
    run = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, p: F.struct(p["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, p["start"] - acc["at"]), p["placeholder"])).alias("out")),
    )
    return F.concat(F.array_join(run["out"], ""), F.substring(text, run["at"] + 1, F.length(text) - run["at"]))


def forms_of(text: Column, parts: Column) -> Column:
    """For each token of the spliced text in order: what it stood for where that is not the map's surface, else null.

    parts as in ``splice``, with the value found and the map's surface. Tokens that were in the text before stand for themselves.
    """
    tokens = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    run = F.aggregate(
        F.coalesce(parts, F.array().cast("array<struct<start:int,end:int,placeholder:string,value:string,surface:string>>")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, p: F.struct(p["end"].alias("at"), F.concat(acc["out"], tokens(F.substring(text, acc["at"] + 1, p["start"] - acc["at"])), F.array(F.when(p["value"] != p["surface"], p["value"]))).alias("out")),
    )
    return F.concat(run["out"], tokens(F.substring(text, run["at"] + 1, F.length(text) - run["at"])))


def rehydrate(texts: DataFrame, pmap: DataFrame, text: str = "text", forms: str | None = None) -> DataFrame:
    """texts (scope, ...) with every placeholder of its scope's map replaced by its first-seen surface; unknown ones stay.

    A placeholder may touch other letters. Where the array column ``forms`` (see forms_of) has a form for a token, that goes in.
    Tokens are looked up in an equi-join, so the map may be of any size; a text's tokens meet again by its own key.
    """
    keyed = texts.withColumn("__k", F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b")))
    tokens = keyed.select("scope", "__k", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))).alias("placeholder")).distinct()
    found = tokens.join(pmap.select("scope", "placeholder", "surface"), ["scope", "placeholder"]).groupBy("scope", "__k").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "surface"))).alias("__m"))
    met = keyed.join(found, ["scope", "__k"], "left")
    words, gaps = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(F.col(text), TOKEN, -1)
    own = F.coalesce(forms, F.array().cast("array<string>")) if forms else F.array().cast("array<string>")
    surfaces = F.zip_with(words, own, lambda w, f: F.coalesce(f, F.try_element_at(F.col("__m"), w), w))
    filled = F.zip_with(gaps, surfaces, lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    return met.withColumn(text, F.when(F.col("__m").isNull(), F.col(text)).otherwise(F.array_join(filled, ""))).drop("__k", "__m")


def pmap_from_json(docs: DataFrame, scope: str = "scope", body: str = "json") -> DataFrame:
    """Rows holding a stored map as JSON (counters, forward: prefix to value to placeholder, reverse) to the relation."""
    kind = "struct<counters:map<string,bigint>,forward:map<string,map<string,string>>,reverse:map<string,string>>"
    own = docs.select(F.col(scope).alias("scope"), F.from_json(body, kind).alias("m"))
    rows = own.select("scope", "m.reverse", F.explode("m.forward").alias("prefix", "values")).select("scope", "reverse", "prefix", F.explode("values").alias("norm_value", "placeholder"))
    return rows.select("scope", "prefix", "norm_value", "placeholder", F.regexp_extract("placeholder", "([0-9]+)$", 1).cast("long").alias("n"), F.try_element_at("reverse", F.col("placeholder")).alias("surface"))


def pmap_to_json(pmap: DataFrame) -> DataFrame:
    """(scope, json): one stored map per scope."""
    by_prefix = pmap.groupBy("scope", "prefix").agg(F.max("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("norm_value", "placeholder")))).alias("values"), F.collect_list(F.struct("placeholder", "surface")).alias("back"))
    out = by_prefix.groupBy("scope").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prefix", "n")))).alias("counters"), F.map_from_entries(F.collect_list(F.struct("prefix", "values"))).alias("forward"), F.map_from_entries(F.array_sort(F.flatten(F.collect_list("back")))).alias("reverse"))
    return out.select("scope", F.to_json(F.struct("counters", "forward", "reverse")).alias("json"))


__all__ = ["PMAP", "PREFIXES", "TOKEN", "allocate", "collapse", "forms_of", "pmap_from_json", "pmap_to_json", "prefix_of", "rehydrate", "splice"]
