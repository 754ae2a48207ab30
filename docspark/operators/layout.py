"""Page layout: words to lines and text, spans to boxes, lines to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import geometry as g
from docspark.operators.grouped import fold_groups


def linearize(words: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """(words with char_start and char_end, one text per page).

    A blank between the words of a line, a newline between lines; offsets are running sums in (line, word_idx) order.
    """
    order = Window.partitionBy(*page).orderBy("line", "word_idx")
    end = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    placed = words.withColumn("char_end", end.cast("int")).withColumn("char_start", (F.col("char_end") - F.length("text")).cast("int"))
    by_line = words.groupBy(*page, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ").alias("t"))
    texts = by_line.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return placed, texts


def span_boxes(spans: DataFrame, placed: DataFrame, page: list[str]) -> DataFrame:
    """A box per span and line: the touched words and their regions, cut at the middle of the gap to neighbours."""
    has_region = "region" in placed.columns
    region = F.col("region") if has_region else F.lit(None).cast("struct<left:int,top:int,width:int,height:int>")
    w = placed.select(*[F.col(p).alias(f"w_{p}") for p in page], "line", "word_idx", "box", "char_start", "char_end", region.alias("region"))
    on = [F.col(p) == F.col(f"w_{p}") for p in page]
    touch = (F.greatest("start", "char_start") < F.least("end", "char_end"))
    hits = spans.join(w, on).where(touch)
    keys = [*page, "span", "line"]
    around = F.coalesce("region", "box")
    left, top = F.least(F.min("box.left"), F.min(around["left"])), F.least(F.min("box.top"), F.min(around["top"]))
    right, bottom = F.greatest(F.max(g.right(F.col("box"))), F.max(g.right(around))), F.greatest(F.max(g.bottom(F.col("box"))), F.max(g.bottom(around)))
    runs = hits.groupBy(*keys).agg(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"), F.min("box.left").alias("wl"), F.max(g.right(F.col("box"))).alias("wr"), F.min("word_idx").alias("first"), F.max("word_idx").alias("last"))
    others = w.select(*[f"w_{p}" for p in page], F.col("line").alias("o_line"), F.col("word_idx").alias("o_idx"), F.col("box").alias("o"))
    near = runs.join(others, [*on, F.col("line") == F.col("o_line"), (F.col("o_idx") < F.col("first")) | (F.col("o_idx") > F.col("last"))], "left")
    lo = F.max(F.when(F.col("o_idx") < F.col("first"), g.right(F.col("o"))))
    hi = F.min(F.when(F.col("o_idx") > F.col("last"), F.col("o.left")))
    out = near.groupBy(*keys, "l", "t", "r", "b", "wl", "wr").agg(lo.alias("lo"), hi.alias("hi"))
    cut_l = F.least(F.col("wl"), F.greatest(F.col("l"), F.coalesce(F.floor((F.col("lo") + F.col("wl")) / 2), F.col("l"))))
    cut_r = F.greatest(F.col("wr"), F.least(F.col("r"), F.coalesce(F.floor((F.col("hi") + F.col("wr")) / 2), F.col("r"))))
    return out.select(*keys, g.box(cut_l, F.col("t"), cut_r - cut_l, F.col("b") - F.col("t")).alias("box"))


def word_boxes(line_text: str = "text", line_box: str = "box"):
    """array<struct(word_idx, text, box)>: words of a line with boxes in proportion to their characters, rounded half to even."""
    from docspark.functions.text import matches

    n = F.greatest(F.length(line_text), F.lit(1))
    scale = F.col(f"{line_box}.width") / n
    return F.transform(
        matches(F.col(line_text), r"\S+"),
        lambda m, i: F.struct(i.alias("word_idx"), m["value"].alias("text"), g.box(F.col(f"{line_box}.left") + F.bround(m["start"] * scale), F.col(f"{line_box}.top"), F.greatest(F.bround((m["end"] - m["start"]) * scale), F.lit(1)), F.col(f"{line_box}.height")).alias("box")),
    )


def fragment_words(words: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Word boxes from OCR fragments of the same line: the union of the fragments whose characters a word shares.

    Both sides hold text in order (idx); blanks do not count. Where the two spell different lengths in all, words keep
    a null box for the caller's proportional fallback.
    """
    def placed(df: DataFrame) -> DataFrame:
        n = F.length(F.regexp_replace("text", r"\s", ""))
        w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("hi", F.sum(n).over(w)).withColumn("lo", F.col("hi") - n).withColumn("all", F.sum(n).over(Window.partitionBy(*keys)))

    a, b = placed(words), placed(fragments).select(*[F.col(k).alias(f"f_{k}") for k in keys], F.col("lo").alias("f_lo"), F.col("hi").alias("f_hi"), F.col("all").alias("f_all"), F.col("box").alias("f_box"))
    on = [F.col(k) == F.col(f"f_{k}") for k in keys] + [F.col("all") == F.col("f_all"), F.greatest("lo", "f_lo") < F.least("hi", "f_hi")]
    return a.join(b, on, "left").groupBy(*keys, "idx", "text").agg(F.when(F.count("f_box") > 0, g.union_of(F.col("f_box"))).alias("box"))


def assign_blocks(lines: DataFrame, blocks: DataFrame, page: list[str]) -> DataFrame:
    """lines (page, line, box, text) with block_id: the first block, in order, that holds its centre, else the one of
    largest common area, else a block of its own, numbered after the page's detected ones by line.

    A page's blocks come as one array beside its lines, in the sort that also numbers: no join, and a task sorts once.
    """
    own = blocks.select(*page, F.struct("block_order", "block_id", F.col("box").alias("b")).alias("__b"))
    whole = Window.partitionBy(*page).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = lines.withColumn("__line", F.lit(True)).unionByName(own, allowMissingColumns=True)
    met = both.withColumn("__all", F.collect_list("__b").over(whole)).where("__line")

    def fit(x: Column) -> Column:
        inside, area = F.coalesce(g.centre_inside(F.col("box"), x["b"]), F.lit(False)), g.overlap_area(F.col("box"), x["b"])
        return F.when(inside | (area > 0), F.struct((~inside).alias("a"), F.when(inside, 0).otherwise(-area).alias("s"), x["block_order"].alias("o"), x["block_id"].alias("block_id")))

    best = F.array_min(F.transform("__all", fit))["block_id"]
    met = met.select(*lines.columns, F.size("__all").alias("__n"), best.alias("__id"))
    extra = F.sum(F.col("__id").isNull().cast("int")).over(so_far)
    return met.select(*lines.columns, F.coalesce("__id", F.col("__n") + extra - 1).cast("int").alias("block_id"), F.col("__id").isNull().alias("synthetic"))


def reading_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """blocks with ``rank``: by order_index, those without last, then by index."""
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy(F.col("order_index").asc_nulls_last(), "index")) - 1)


def visual_rows(regions: DataFrame, page: list[str], mode: str = "halfway") -> DataFrame:
    """regions (page, idx, left, top, width, height) with ``row``: bands by vertical centre, each page in its own group.

    By centre from the top, then from the left, a region joins the last row, and no earlier one, if that row's centre
    lies within half the greater height and, in mode ``halfway``, the region overlaps none of its members in x by over
    0.3 of the narrower width; the row's centre then moves halfway. In mode ``mean`` the centre is the running mean and
    overlap does not count. Else it opens a row. Sequential, so a fold per page; a page is bounded.
    """
    names = regions.columns

    def band(key: tuple, own: list[dict]) -> list[tuple]:
        rows: list[dict] = []
        for r in sorted(own, key=lambda r: (r["top"] + r["height"] / 2, r["left"])):
            c, right, q = r["top"] + r["height"] / 2, r["left"] + r["width"], rows[-1] if rows else None
            near = q and abs(c - q["c"]) < 0.5 * max(r["height"], q["h"], 1)
            if near and (mode == "mean" or not any(min(right, m["left"] + m["width"]) - max(r["left"], m["left"]) > 0.3 * min(r["width"], m["width"]) for m in q["members"])):
                q["members"].append(r)
                q["c"] += (c - q["c"]) / (2 if mode == "halfway" else len(q["members"]))
                q["h"] = max(q["h"], r["height"])
            else:
                rows.append({"c": c, "h": r["height"], "members": [r]})
        return [(*[m[n] for n in names], k) for k, q in enumerate(rows) for m in q["members"]]

    return fold_groups(regions, page, ["top", "left"], band, ", ".join(f"`{n}` {t}" for n, t in regions.dtypes) + ", row int")


def line_gaps(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (y, size, text, ord) with ``prefix``: as many newlines as line heights lie between, three at most."""
    gap = F.abs(F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("ord"))) / F.col("size")
    n = F.least(F.lit(3), F.bround(F.coalesce(gap, F.lit(0.0))).cast("int"))
    return lines.withColumn("prefix", F.repeat(F.lit("\n"), n))


def gap_sessions(points: DataFrame, keys: list[str], x: str, most: float) -> DataFrame:
    """points with ``cluster``: a new one where the step to the next x, in order, exceeds ``most``."""
    order = Window.partitionBy(*keys).orderBy(x)
    new = F.coalesce((F.col(x) - F.lag(x).over(order) > most).cast("int"), F.lit(0))
    return points.withColumn("__n", new).withColumn("cluster", F.sum("__n").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("__n")


def page_columns(rects: DataFrame, page: list[str], most: float, share: float = 0.1) -> DataFrame:
    """(page, cluster, left, weight): text columns of a page from the left edges of its rectangles (x0, x1, height).

    A cluster's weight is the sum of heights, less those of rectangles that straddle its left edge; clusters of enough
    weight remain, and a page without any is one column from 0.
    """
    c = gap_sessions(rects, page, "x0", most).groupBy(*page, "cluster").agg(F.min("x0").alias("left"), F.sum("height").alias("gain"))
    r = rects.select(*[F.col(p).alias(f"r_{p}") for p in page], "x0", "x1", F.col("height").alias("h"))
    crossing = [F.col(p) == F.col(f"r_{p}") for p in page] + [F.col("x0") < F.col("left"), F.col("x1") > F.col("left")]
    w = c.join(r, crossing, "left").groupBy(*page, "cluster", "left", "gain").agg((F.col("gain") - F.coalesce(F.sum("h"), F.lit(0))).alias("weight"))
    best = F.max("weight").over(Window.partitionBy(*page))
    kept = w.where("weight > 0").withColumn("best", best).where(F.col("weight") >= share * F.col("best")).select(*page, "cluster", "left", "weight")
    bare = rects.select(*page).distinct().join(kept, page, "left_anti").select(*page, F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("left"), F.lit(0).alias("weight"))
    return kept.unionByName(bare.select(*page, "cluster", F.col("left").cast(dict(kept.dtypes)["left"]), F.col("weight").cast(dict(kept.dtypes)["weight"])))


def column_of(blocks: DataFrame, columns: DataFrame, page: list[str]) -> DataFrame:
    """blocks (x0) with the column that holds x0, from its left edge to the next; those left of all columns are dropped."""
    nxt = F.lead("left").over(Window.partitionBy(*page).orderBy("left"))
    c = columns.withColumn("until", nxt).select(*[F.col(p).alias(f"c_{p}") for p in page], "cluster", "left", "until")
    on = [F.col(p) == F.col(f"c_{p}") for p in page] + [F.col("x0") >= F.col("left"), F.col("until").isNull() | (F.col("x0") < F.col("until"))]
    return blocks.join(c, on).drop(*[f"c_{p}" for p in page], "left", "until")


def page_summary(lines: DataFrame, page: list[str]) -> DataFrame:
    """One text per page: blocks by reading order, each with its kind and lines."""
    by_block = lines.groupBy(*page, "rank", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("t"))
    block = F.concat(F.format_string("[%d] %s", F.col("rank"), F.col("kind")), F.array_join(F.transform("t", lambda x: F.concat(F.lit("\n  "), x)), ""))
    return by_block.withColumn("b", block).groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), "\n").alias("summary"))


