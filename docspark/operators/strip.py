"""Detection and stripping of whole documents, table cells and page words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import let
from docspark.operators import pseudonyms
from docspark.operators.recognize import THRESHOLD, TIERS, Recognizer, invalid_findings, recognize, registry
from docspark.operators.spans import INVALID_RULES, merge_array, resolve_greedy

# fixed values: classes replaced by default
DEFAULT_STRIP = (
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "AU_TFN", "AU_MEDICARE", "AU_ABN", "AU_ACN", "AU_BSB", "AU_BANK_ACCOUNT",
    "AU_PAYID", "AU_DRIVERS_LICENCE", "PASSPORT", "CREDIT_CARD", "ADDRESS", "DATE_OF_BIRTH", "IBAN_CODE",
)

# fixed values: legal-form markers of private entities, and institutions that are kept in any case
MARKERS = r"(?i)\b(?:pty|trust(?:ees?)?|atf|super(?:annuation)?\s+fund|smsf)\b"
INSTITUTIONS = (
    r"(?i)\b(?:anz|nab|cba|commonwealth\s+bank|westpac|st\.?\s*george|bankwest|bendigo|suncorp|macquarie|"
    r"bank\s+of\s+queensland|boq|ing|amp|afg|advantedge|connective|qbe|cgu|iag|allianz|aami|insurance\s+australia|"
    r"australia\s+and\s+new\s+zealand\s+banking|new\s+zealand\s+banking\s+group|visa|mastercard|american\s+express)\b"
)


def is_private_entity(name: Column) -> Column:
    """A legal-form marker and no institution of the keep-list, which goes before."""
    return name.rlike(MARKERS) & ~name.rlike(INSTITUTIONS)


@dataclass(frozen=True)
class Options:
    """threshold; classes to strip; organizations too; tier of invalid findings; whether those are masked; more recognizers."""

    threshold: float = THRESHOLD
    strip: tuple[str, ...] = DEFAULT_STRIP
    strip_orgs: bool = False
    invalid: str = "likely"
    mask_invalid: bool = False
    extra: tuple[Recognizer, ...] = ()

    def __post_init__(self) -> None:
        if self.invalid not in TIERS:
            raise ValueError(f"invalid {self.invalid!r}, expected one of {TIERS}")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie between 0 and 1")

    @property
    def classes(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.strip, *["ORGANIZATION"] * self.strip_orgs, *(INVALID_RULES if self.mask_invalid else ())]))


def in_plan(text: Column, span: Column, options: Options) -> Column:
    """Whether a span is replaced; decided before overlaps are merged, so that a kept class never hides one that goes."""
    listed = span["entity_type"].isin(*options.classes)
    if "ORGANIZATION" in options.classes:
        return listed
    return listed | ((span["entity_type"] == "ORGANIZATION") & is_private_entity(F.substring(text, span["start"] + 1, span["end"] - span["start"])))


def analyze(docs: DataFrame, options: Options = Options(), text: str = "text", given: str | None = None) -> DataFrame:
    """docs with ``spans`` (all that is found) and ``view`` (overlaps resolved greedily, for reading).

    ``given`` names an array<span> column of spans from elsewhere, such as a named-entity model; they join the rest.
    """
    spans = recognize(text, registry(options.invalid, options.extra), options.threshold)
    if given:
        spans = F.concat(spans, F.filter(F.col(given), lambda s: s["score"] >= options.threshold))
    return docs.withColumn("spans", spans).withColumn("view", resolve_greedy(F.col("spans")))


def detect(docs: DataFrame, options: Options = Options(), text: str = "text", given: str | None = None) -> DataFrame:
    """docs with ``plan`` (disjoint spans to replace) and ``invalid`` (findings); all within the row, no shuffle."""
    spans = recognize(text, registry(options.invalid, options.extra), options.threshold)
    if given:
        spans = F.concat(spans, F.filter(F.col(given), lambda s: s["score"] >= options.threshold))
    both = lambda s: F.struct(merge_array(F.filter(s, lambda x: in_plan(F.col(text), x, options))).alias("plan"), invalid_findings(F.col(text), s).alias("invalid"))
    return docs.withColumn("__d", let(spans, both)).withColumn("plan", F.col("__d.plan")).withColumn("invalid", F.col("__d.invalid")).drop("__d")


def strip(docs: DataFrame, options: Options = Options(), doc_id: str = "doc_id", text: str = "text", scope: Column | None = None, pmap: DataFrame | None = None, given: str | None = None, order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(docs with ``stripped``, ``plan`` and ``invalid``; the map), a row for each row of docs, in no order.

    One scope (the default) numbers the whole set alike, in the order of ``order`` (default: the id) and then of
    position; ``scope`` splits it, for instance by document. Ids may be null or repeated: what is found goes back to its
    rows by id, order and text (a 128-bit hash). A null text stays null, with an empty plan. Detection runs once: what it
    found, not the texts, is kept (in memory, else on disk; recomputed where an executor is lost). Placeholders come back
    by equi-joins and texts are spliced in their rows.
    """
    keys = [f"__{i}" for i, _ in enumerate(dict.fromkeys((*(order or (doc_id,)), doc_id)))]
    named_keys = dict(zip(keys, dict.fromkeys((*(order or (doc_id,)), doc_id)), strict=True))
    said = [F.col(c) for c in (text, given) if c]
    own = docs.withColumns({k: F.col(c) for k, c in named_keys.items()} | {"__a": F.xxhash64(*said), "__b": F.xxhash64(F.lit(1), *said), "__s": F.coalesce(scope if scope is not None else F.lit("all"), F.lit(""))})
    row = ["__s", *keys, "__a", "__b"]
    found = detect(own, options, text, given)
    cut = F.transform("plan", lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]).alias("value")))
    slim = found.select(*row, cut.alias("plan"), "invalid").dropDuplicates(row).persist(StorageLevel.MEMORY_AND_DISK)
    mentions = slim.select(F.col("__s").alias("scope"), *row, F.explode("plan").alias("s")).select("scope", *row, "s.*")
    made = pseudonyms.allocate(mentions, [*(keys if order else keys[:1]), "start"], pmap)
    named = mentions.withColumn("prefix", pseudonyms.prefix_of(F.col("entity_type"))).withColumn("norm_value", pseudonyms.normalize(F.col("value"))).join(made, ["scope", "prefix", "norm_value"])
    places = named.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("__p"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        theirs = right.withColumnsRenamed({c: f"{c}_" for c in row})
        return left.join(theirs, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in row], "left").drop(*[f"{c}_" for c in row])

    out = beside(beside(own, slim), places)
    return out.withColumn("stripped", F.when(F.col("__p").isNull(), F.col(text)).otherwise(pseudonyms.splice(F.col(text), F.col("__p")))).drop(*row, "__p"), made


def cells(rows: DataFrame, row: str, columns: list[str] | None = None) -> DataFrame:
    """Long form (row, col, col_name, value) of string columns; blank columns are kept out by strip_cells."""
    names = [c for c in rows.columns if c != row]
    if unknown := [c for c in columns or [] if c not in names]:
        raise ValueError(f"no such columns: {unknown}; there are {names}")
    chosen = columns or names
    entries = F.array(*[F.struct(F.lit(names.index(c)).alias("col"), F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value")) for c in chosen])
    return rows.select(F.col(row).alias("row"), F.explode(entries).alias("x")).select("row", "x.*")


def strip_cells(rows: DataFrame, row: str, options: Options = Options(), columns: list[str] | None = None, pmap: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the chosen columns stripped, the map, findings by row and column).

    Every cell is a text of its own, so that no span or context reaches over a cell's end. Numbers follow the columns
    from left to right, each from top to bottom. The header is not data and is never scanned. ``row`` must be unique.
    """
    long = cells(rows, row, columns).where(F.trim("value") != "").withColumn("cell", F.concat_ws(":", "row", "col"))
    out, made = strip(long, options, "cell", "value", pmap=pmap, order=("col", "row"))
    back = out.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col_name", "stripped"))).alias("__m"))
    chosen = columns or [c for c in rows.columns if c != row]
    met = rows.join(back.withColumnRenamed("row", "__r"), F.col(row).eqNullSafe(F.col("__r")), "left")
    done = met.select(*[F.coalesce(F.try_element_at("__m", F.lit(c)), F.col(c)).alias(c) if c in chosen else F.col(c) for c in rows.columns])
    findings = out.select("row", "col", F.explode("invalid").alias("f")).select("row", "col", "f.*")
    return done, made, findings


def strip_words(words: DataFrame, page: list[str], options: Options = Options(), pmap: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, map) of recognized page words (page columns, line, word_idx, text, box): what to paint over, and its label.

    Words are laid out as text, one line per line; spans map back to the boxes of the words that they touch, one box
    per line of a span, reaching no further than the middle of the gap to the neighbouring words.
    """
    from docspark.operators.layout import linearize, span_boxes

    placed, texts = linearize(words, page)
    keyed = texts.withColumn("__id", F.concat_ws("/", *page))
    out, made = strip(keyed, options, "__id", "text", pmap=pmap, order=tuple(page))
    spans = out.select(*page, F.posexplode("plan").alias("span", "s"), F.col("text")).select(*page, "span", F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))
    labelled = spans.withColumn("prefix", pseudonyms.prefix_of(F.col("entity_type"))).withColumn("norm_value", pseudonyms.normalize(F.col("value"))).join(made.drop("scope"), ["prefix", "norm_value"])
    boxes = span_boxes(labelled.select(*page, "span", "start", "end"), placed, page)
    segments = boxes.join(labelled.select(*page, "span", F.col("placeholder").alias("label")), [*page, "span"])
    return segments.groupBy(*page, "span", "label").agg(F.array_sort(F.collect_list("box")).alias("boxes")), made
