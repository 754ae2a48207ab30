"""Pages: JSON of recognized pages, parsed PDF spans, page filters and transforms, boxes to paint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import geometry as g
from docspark.operators.tree import font_key
from docspark.sources.plugins import PAGES, per_row

BOX = "struct<left:int,top:int,width:int,height:int>"
FRAME = "struct<width:int,height:int,page:int,dpi:int,source:string,backend:string,tier:string>"


def _page_type(box: str) -> str:
    block = f"struct<id:int,kind:string,origin:string,box:{box},reading_order:int,page_id:int,conf:double>"
    line = f"struct<text:string,box:{box},block_id:int,conf:double,words:array<struct<text:string,box:{box},region_box:{box}>>>"
    return f"struct<frame:{FRAME},blocks:array<{block}>,lines:array<{line}>>"


#: A recognized page as one value.
PAGE = _page_type(BOX)


def _with_boxes(page: Column, box: Callable[[Column], Column]) -> Column:
    block = lambda b: F.struct(b["id"].alias("id"), b["kind"].alias("kind"), b["origin"].alias("origin"), box(b["box"]).alias("box"), b["reading_order"].alias("reading_order"), b["page_id"].alias("page_id"), b["conf"].alias("conf"))
    word = lambda w: F.struct(w["text"].alias("text"), box(w["box"]).alias("box"), box(w["region_box"]).alias("region_box"))
    line = lambda x: F.struct(x["text"].alias("text"), box(x["box"]).alias("box"), x["block_id"].alias("block_id"), x["conf"].alias("conf"), F.transform(x["words"], word).alias("words"))
    return F.struct(page["frame"].alias("frame"), F.transform(page["blocks"], block).alias("blocks"), F.transform(page["lines"], line).alias("lines"))


def page_to_json(page: Column) -> Column:
    """A PAGE as JSON: boxes are lists of four numbers, absent values null. A null page is null."""
    flat = lambda b: F.when(b.isNotNull(), F.array(b["left"], b["top"], b["width"], b["height"]))
    return F.when(page.isNotNull(), F.to_json(_with_boxes(page, flat), {"ignoreNullFields": "false"}))


def page_from_json(text: Column) -> Column:
    """The PAGE that page_to_json wrote; null for null or broken text."""
    own = F.from_json(text, _page_type("array<int>"))
    box = lambda b: F.when(b.isNotNull(), g.box(b[0], b[1], b[2], b[3]))
    return F.when(own["frame"].isNotNull(), _with_boxes(own, box)).cast(PAGE)


# --- PDF seams -------------------------------------------------------------------------------------------------------

PDF_SPANS = "page int, block int, line int, i int, size double, flags int, color int, text string, x0 double, y0 double, x1 double, y1 double"


def parse_spans(files: DataFrame, parser: Callable[[bytes], Iterator[tuple]], coloured: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Text spans of PDF bytes by a pluggable parser, which gives rows of PDF_SPANS in reading order, with ``sz`` and error.

    ``coloured`` is the colour of plain text: with it, spans of another colour have header fonts of their own.
    """
    out = per_row(files, "content", lambda content: parser(content) if content is not None else iter(()), PDF_SPANS, keep or ["path"])
    return out.withColumn("sz", font_key(F.col("size"), F.col("flags"), None if coloured is None else F.col("color") != coloured))


def page_counts(files: DataFrame, counter: Callable[[bytes], int], keep: list[str] | None = None) -> DataFrame:
    """(kept columns, pages, error) of PDF bytes by a pluggable counter; null bytes have no pages."""
    return per_row(files, "content", lambda content: iter([(0 if content is None else counter(content),)]), "pages int", keep or ["path"])


def select_pages(pages: DataFrame, wanted: set[int] | None = None, page: str = "page_no") -> DataFrame:
    """Pages of the given numbers (from 1); None is all, an empty set none."""
    return pages if wanted is None else pages.where(F.col(page).isin(sorted(wanted)))


def transform_pages(pages: DataFrame, transform: Callable[[int, bytes], bytes], wanted: set[int] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(kept columns, page_no, image, error): every wanted page's image as ``transform(page_no, image)`` makes it."""
    own = select_pages(pages, wanted).withColumn("__p", F.struct("page_no", "image"))
    return per_row(own, "__p", lambda p: iter([(p["page_no"], transform(p["page_no"], bytes(p["image"])))]), PAGES, keep or ["path"])


def progress(done: DataFrame, counts: DataFrame, doc: str = "path") -> DataFrame:
    """(doc, done, pages): distinct pages of each document that a result table holds, of all it has."""
    own = done.groupBy(doc).agg(F.count_distinct("page_no").alias("done"))
    return counts.select(doc, "pages").join(own, doc, "left").select(doc, F.coalesce("done", F.lit(0)).alias("done"), "pages")


# --- painting --------------------------------------------------------------------------------------------------------

def is_degenerate(box: Column, width: Column, height: Column, margin: int = 2) -> Column:
    """Grown by the margin and cut to the page, nothing is left of the box: it would paint nothing."""
    grown = g.grow(box, margin, width, height)
    return box.isNull() | F.coalesce((grown["width"] <= 0) | (grown["height"] <= 0), F.lit(True))


def paintable(boxes: DataFrame, page: list[str], margin: int = 2) -> tuple[DataFrame, DataFrame]:
    """(boxes that paint something, a row per page and label of those that do not, with their number).

    boxes hold box, label, width and height of the page. What is not painted may still be read: look at the second table.
    """
    own = boxes.withColumn("__d", is_degenerate(F.col("box"), F.col("width"), F.col("height"), margin))
    lost = own.where("__d").groupBy(*page, "label").agg(F.count("*").alias("skipped"))
    return own.where(~F.col("__d")).drop("__d"), lost


def background(pixels: DataFrame, page: list[str]) -> DataFrame:
    """(page, colour): the most common colour among border pixels (x, y, colour, and the page's width and height).

    Ties go to the smaller colour. Counted map-side, so an image of any size shrinks to its colours first.
    """
    border = pixels.where((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1))
    counts = border.groupBy(*page, "colour").agg(F.count("*").alias("n"))
    return counts.groupBy(*page).agg(F.min_by("colour", F.struct(-F.col("n"), F.col("colour"))).alias("colour"))
