"""Mixing sources to target weights: golden-ratio slots, ranked per source, joined with equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import running_total, stored, table

WEIGHTS, SHARE, CAP, BLOCK = (3, 1, 2), 1.5, 2.0, 4096
#: Documents, and slots of the schedule, that are ordered together in one task.
CHUNK = 50_000
GOLDEN = 0.6180339887498949
CELLS = 1024


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of the id's MD5: the same order in every run and engine; a null id goes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sid, source, source_size, target and the source's interval [low, high) of the unit line.

    Sources in code point order, null last, weigh ``weights``, repeating. ``share`` of all words is dealt by weight;
    a target stops at ``cap`` times its source's size and the excess is dealt again by weight. The level at which this
    ends is found in one pass over the sources ordered by cap/weight: the even share of those left, the first (and so the
    largest) that is within the cap of the source at hand.

    The windows order one row per source in one task; documents are never ordered here.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    sources = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    sources = sources.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level)
    sources = sources.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).over(every))
    target = F.round(F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most"))), 6)
    sources = sources.select("sid", "source", "source_size", target.alias("target"))
    up_to = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.greatest(F.sum("target").over(every), F.lit(1e-9))
    high = F.sum("target").over(up_to) / whole
    return sources.select("*", (high - F.col("target") / whole).alias("low"), high.alias("high"))


def slot_schedule(sources: DataFrame, block_words: int = BLOCK) -> DataFrame:
    """slot, sid, block, words: which block of which source each slot of the mix reads, and how many of its words.

    Slot t stands at the fractional part of t times the golden ratio and belongs to the source whose cumulative
    interval holds that point, so every stretch of the schedule is near the target weights. Its rank among the slots
    of its source names the block: the source's blocks in order, then again from the first. Slots beyond a source's
    target are left out and the last one is cut to fit; where discrepancy left a source short, slots at the end of
    the schedule complete it. Intervals are met by an equi-join on CELLS cells of the unit line.
    """
    b = F.lit(block_words)
    s = sources.where(F.col("source_size") > 0).withColumn("quota", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / b))
    rest = F.col("quota") % F.col("source_size")
    s = s.withColumn("needed", F.floor(F.col("quota") / F.col("source_size")) * F.col("blocks") + F.ceil(rest / b))
    last_cell = F.lit(CELLS - 1).cast("long")
    cells = s.select("sid", "low", "high", F.explode(F.sequence(F.least(F.floor(F.col("low") * CELLS), last_cell), F.least(F.floor(F.col("high") * CELLS), last_cell))).alias("cell"))
    n = s.agg(F.ceil(F.sum("quota") / b)).first()[0] or 0
    spark = sources.sparkSession
    points = spark.range(0, int(n), 1, max(1, min(2000, int(n) // CHUNK + 1))).select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    slots = points.join(cells, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    slots = slots.select("sid", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"), F.lit(1).alias("one"))
    ranked = running_total(slots, ["sid"], "chunk", ["slot"], "one", "k", "__n").select("slot", "sid", "k")
    dealt = slots.groupBy("sid").agg(F.count("*").alias("dealt"))
    short = s.join(dealt, "sid", "left").withColumn("dealt", F.coalesce("dealt", F.lit(0))).where(F.col("dealt") < F.col("needed"))
    more = short.select("sid", F.explode(F.sequence(F.col("dealt"), F.col("needed") - 1)).alias("k")).select((F.lit(n) + F.col("k")).alias("slot"), "sid", "k")
    out = ranked.unionByName(more).join(s, "sid").where(F.col("k") < F.col("needed"))
    block = F.col("k") % F.col("blocks")
    start = F.floor(F.col("k") / F.col("blocks")) * F.col("source_size") + block * b
    words = F.least(b.cast("long"), F.col("source_size") - block * b, F.col("quota") - start)
    return out.select("slot", "sid", block.alias("block"), words.cast("long").alias("words")).where(F.col("words") > 0)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, slots, pieces): the targets, the schedule, and where each document's words lie in the blocks.

    A source's documents, in the order of a hash of their id, laid end to end are its stream of words, cut into blocks
    of block_words. pieces has a row for each document and block that it touches (block null where a document has no
    words): doc_id, source, sid, chunk, rn (chunk and rn name the row within its source), size, block, start (word in
    the block), length, first (word of the document), and the columns named in keep. Reading slots in order, each with its block's pieces cut to the
    slot's words, gives the mix.

    Null texts have size 0; a null source is a source of its own, the last; rows of one doc_id are separate documents;
    columns other than the three named and those in keep are not read. An empty table gives empty results; if no document has words all
    targets are 0.
    """
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *keep)
    sizes = stored(sizes.withColumn("h", shuffle_key(F.col("doc_id"))), "sizes")
    chunks = sizes.count() // CHUNK + 1
    sources = stored(source_targets(sizes, weights, share, cap), "sources")
    a, b = sizes.alias("a"), sources.select("sid", "source").alias("b")
    placed = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.sid")
    placed = placed.withColumn("chunk", F.floor(F.col("h") / F.lit(2.0**60) * F.lit(chunks)))
    placed = running_total(placed, ["sid"], "chunk", ["h", "doc_id", "size"], "size", "o", "rn")
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("o") / block_words), F.floor((F.col("o") + F.col("size") - 1) / block_words)))
    pieces = placed.withColumn("block", F.explode_outer(touched))
    first = F.greatest(F.col("block") * block_words - F.col("o"), F.lit(0).cast("long"))
    start = F.col("o") + F.col("first") - F.col("block") * block_words
    pieces = pieces.withColumn("first", first).withColumn("start", start).withColumn("length", F.least(F.col("size") - F.col("first"), F.lit(block_words) - F.col("start")))
    return sources, slot_schedule(sources, block_words), pieces.select("doc_id", "source", "sid", "chunk", "rn", "size", "block", "start", "length", "first", *keep)


def taken_words(sources: DataFrame, slots: DataFrame, pieces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, opens and the columns named in keep: what the slots take of each document.

    taken counts words, repeats included; opens counts how often a slot takes the document's first word.
    """
    used = slots.groupBy("sid", "block").agg(F.collect_list("words").alias("words"))  # at most one per pass over the source
    met = pieces.join(used, ["sid", "block"], "left")
    cut = lambda w: F.greatest(F.least(w - F.col("start"), F.col("length")), F.lit(0).cast("long"))
    met = met.withColumn("got", F.aggregate(F.coalesce("words", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda acc, w: acc + cut(w)))
    opens = F.when(F.col("first") == 0, F.size(F.filter(F.coalesce("words", F.array().cast("array<bigint>")), lambda w: w > F.col("start")))).otherwise(0)
    docs = met.groupBy("sid", "chunk", "rn", "doc_id", "size", *keep).agg(F.sum("got").alias("taken"), F.sum(opens).alias("opens"))
    return docs.join(sources.select("sid", "source", "source_size", "target"), "sid").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("opens", F.lit(0)).cast("long").alias("opens"), *keep)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taken_words(*mix_sources(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
z AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM {docs}),
g AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM z GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((sid - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS most FROM g),
v AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv
      FROM w WINDOW b AS (ORDER BY most / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, round(least(most, coalesce((SELECT max(lv) FROM v WHERE lv * w <= most) * w, most)), 6) AS target FROM v),
o AS (SELECT z.*, t.sid, t.source_size, t.target, round(t.target)::BIGINT AS q,
      coalesce(sum(size) OVER (PARTITION BY t.sid ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o
      FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
"""

SQL = f"""WITH {MIX_SQL.format(docs="documents")}
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (q // source_size) * size + greatest(0, least(size, q % source_size - o)) END::BIGINT AS taken
FROM o"""
