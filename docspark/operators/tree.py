"""Header trees from font statistics, breadcrumbs, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import collapse, let, sanitize_glyphs
from docspark.operators.grouped import fold_groups


def font_key(size: Column, flags: Column, coloured: Column | None = None) -> Column:
    """Hundredths of the size, three more for bold (bit 4 of flags), one more for a coloured header."""
    bold = F.when(flags.bitwiseAND(F.lit(16)) != 0, 3).otherwise(0)
    return F.round(size * 100).cast("int") + bold + (F.when(coloured, 1).otherwise(0) if coloured is not None else 0)


def main_font(spans: DataFrame, doc: list[str]) -> DataFrame:
    """The font key (sz) with most characters of each document; ties go to the smaller key."""
    weights = spans.groupBy(*doc, "sz").agg(F.sum(F.length("text")).alias("chars"))
    return weights.groupBy(*doc).agg(F.max_by("sz", F.struct("chars", -F.col("sz"))).alias("main"))


def header_levels(spans: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, sz, level): fonts above the main one, the largest first at level 0."""
    sizes = spans.select(*doc, "sz").distinct().join(main_font(spans, doc), doc).where(F.col("sz") > F.col("main"))
    return sizes.select(*doc, "sz", (F.dense_rank().over(Window.partitionBy(*doc).orderBy(F.col("sz").desc())) - 1).alias("level"))


def mark_headers(spans: DataFrame, levels: DataFrame, doc: list[str], line: list[str]) -> DataFrame:
    """spans (sz, text, i: index in its line) with ``level`` where a span is part of a header, else null.

    A header span is not blank, its font has a level and is that of the line's last span, and it does not begin with a
    dash unless it stands within the line.
    """
    last = F.last("sz").over(Window.partitionBy(*doc, *line).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = spans.withColumn("last_sz", last).join(levels.withColumnRenamed("level", "__l"), [*doc, "sz"], "left")
    ok = F.col("text").rlike(r"\S") & (F.col("sz") == F.col("last_sz")) & (~F.col("text").startswith("-") | (F.col("i") > 0))
    return own.withColumn("level", F.when(ok, F.col("__l"))).drop("__l", "last_sz")


def build_tree(pieces: DataFrame, doc: list[str]) -> DataFrame:
    """tree_nodes from pieces (doc, ord, level or null, text, page, x, y) in reading order.

    A header closes all open headers of its level or deeper and becomes a child of the one left open; headers of equal
    level in a row, with no text between, be it blank, are one. Other text belongs to the header open at the time. Then
    header white space is collapsed, texts are trimmed, and a leaf without text passes its header on to its right sibling. Sequential, so a fold per document; node 0 is the root with level -1.
    """
    keys = ", ".join(f"{c} {dict(pieces.dtypes)[c]}" for c in doc)
    schema = f"{keys}, node_id int, parent_id int, level int, header string, text string, page int, x double, y double, ordinal int"

    def fold(key: tuple, pieces: list[dict]) -> list[tuple]:
        nodes = [{"id": 0, "parent": None, "level": -1, "header": "", "text": "", "page": 0, "x": 0.0, "y": 0.0}]
        open_ = [0]
        for r in pieces:
            if r["level"] is None:
                nodes[open_[-1]]["text"] += r["text"] or ""
                continue
            level, top = r["level"], nodes[open_[-1]]
            if top["level"] == level and top["text"] == "":
                top["header"] += " " + r["text"]
                continue
            while nodes[open_[-1]]["level"] >= level:
                open_.pop()
            nodes.append({"id": len(nodes), "parent": open_[-1], "level": level, "header": r["text"], "text": "", "page": r["page"], "x": r["x"], "y": r["y"]})
            open_.append(len(nodes) - 1)
        for n in nodes:
            n["header"], n["text"] = " ".join(n["header"].split()), n["text"].strip()
        children: dict = {}
        for n in nodes:
            children.setdefault(n["parent"], []).append(n)
        gone = set()
        for own in children.values():
            for a, b in zip(own, own[1:], strict=False):
                if a["id"] not in children and not a["text"].strip() and a["parent"] is not None:
                    b["header"] = f"{a['header']} {b['header']}".strip()
                    b["page"], b["x"], b["y"] = a["page"], a["x"], a["y"]
                    gone.add(a["id"])
        place: dict = {}
        rows = []
        for n in nodes:
            if n["id"] not in gone:
                place[n["parent"]] = place.get(n["parent"], -1) + 1
                rows.append((*key, n["id"], n["parent"], n["level"], n["header"], n["text"], int(n["page"]), float(n["x"]), float(n["y"]), place[n["parent"]]))
        return rows

    return fold_groups(pieces, doc, ["ord"], fold, schema)


def tree_paths(nodes: DataFrame, doc: list[str], most: int = 64) -> DataFrame:
    """nodes with ``path`` (ids from the root, joined by /) and ``crumbs`` (headers of level 0 and more, from the top).

    One equi-join per level of the deepest tree, on (doc, parent); trees deeper than ``most`` are an error.
    """
    at = nodes.where(F.col("parent_id").isNull()).withColumn("path", F.col("node_id").cast("string")).withColumn("crumbs", F.array().cast("array<string>"))
    done, rest = at, nodes.where(F.col("parent_id").isNotNull())
    for _ in range(most):
        up = at.select(*doc, F.col("node_id").alias("parent_id"), F.col("path").alias("__p"), F.col("crumbs").alias("__c"))
        at = rest.join(up, [*doc, "parent_id"]).select(*nodes.columns, F.concat_ws("/", "__p", F.col("node_id").cast("string")).alias("path"), F.when(F.col("level") >= 0, F.array_append("__c", F.col("header"))).otherwise(F.col("__c")).alias("crumbs"))
        if at.isEmpty():
            return done
        done = done.unionByName(at)
    raise ValueError(f"a tree is deeper than {most} levels")


def tree_markdown(nodes: DataFrame, doc: list[str]) -> DataFrame:
    """One Markdown text per document: headers with # by depth, texts below, in id order; a blank root is left out."""
    head = F.when(F.col("level") >= 0, F.concat(F.repeat(F.lit("#"), F.col("level") + 1), F.lit(" "), F.col("header"), F.lit("\n"))).otherwise("")
    body = F.concat(head, F.when(F.col("text").rlike(r"\S"), F.concat("text", F.lit("\n"))).otherwise(""))
    return nodes.groupBy(*doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", body.alias("b")))), lambda x: x["b"]), "").alias("markdown"))


def table_markdown(header: Column, rows: Column) -> Column:
    """Markdown of a table given as array<string> and array<array<string>>."""
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r, lambda c: F.coalesce(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit(""))), "|"), F.lit("|"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(header, lambda _: F.lit("---")), "|"), F.lit("|"))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")


def chunks(texts: DataFrame, text: str = "text", size: int = 8000, overlap: int = 2000, token: str = r"\s*\S+") -> DataFrame:
    """texts with split, pos, len, chunk: windows of ``size`` tokens, ``overlap`` of them shared with the one before.

    pos is the true offset in the text, also where chunks repeat. A token is a match of ``token``; with the default the
    chunks cover the text but for blanks at its end. Blank texts have no chunk.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    own = texts.withColumn("__t", F.regexp_extract_all(text, F.lit(token), F.lit(0))).where(F.size("__t") > 0)
    count = F.greatest(F.lit(0), F.ceil((F.size("__t") - size) / F.lit(step))).cast("int")
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, t: s + F.length(t))
    # lengths of the steps, so that an offset adds up steps and not tokens; only finished chunks are exploded
    own = own.withColumn("__s", F.transform(F.sequence(F.lit(0), count), lambda i: length(F.slice("__t", i * step + 1, step))))
    before = lambda i: F.aggregate(F.slice("__s", 1, i), F.lit(0), lambda s, n: s + n)
    cut = lambda i: let(F.slice("__t", i * step + 1, size), lambda c: F.struct(i.alias("split"), before(i).alias("pos"), length(c).alias("len"), F.array_join(c, "").alias("chunk")))
    return own.withColumn("__c", F.explode(F.transform(F.sequence(F.lit(0), count), cut))).select(*texts.columns, "__c.*")


def node_chunks(paths: DataFrame, doc: list[str], size: int = 8000, overlap: int = 2000) -> DataFrame:
    """Chunks to embed: id path#split, the text after its breadcrumbs. Inner nodes without text are left out; leaves stay by their header."""
    inner = paths.select(*doc, F.col("parent_id").alias("node_id")).where("node_id IS NOT NULL").distinct().withColumn("inner", F.lit(True))
    own = paths.join(inner, [*doc, "node_id"], "left").where(F.col("inner").isNull() | F.col("text").rlike(r"\S")).drop("inner")
    own = own.withColumn("body", F.concat("header", F.lit("\n"), "text"))
    out = chunks(own, "body", size, overlap)
    return out.select(*doc, F.concat_ws("#", "path", F.col("split").cast("string")).alias("id"), "path", "split", "pos", "len", F.concat(F.array_join("crumbs", " > "), F.lit("\n"), "chunk").alias("text"), "crumbs", "page", "x", "y")


def clean_spans(spans: DataFrame, header: Column, footer: Column) -> DataFrame:
    """Spans within the page band, glyphs made plain."""
    return spans.where((F.col("y0") >= header) & (F.col("y1") <= footer)).withColumn("text", sanitize_glyphs(F.col("text")))


def outside_tables(blocks: DataFrame, tables: DataFrame, page: list[str]) -> DataFrame:
    """Blocks (x0, y0, x1, y1) that no table of their page fully contains."""
    a, b = blocks.alias("a"), tables.alias("b")
    on = [F.col(f"a.{p}") == F.col(f"b.{p}") for p in page] + [F.col("b.x0") <= F.col("a.x0"), F.col("b.y0") <= F.col("a.y0"), F.col("a.x1") <= F.col("b.x1"), F.col("a.y1") <= F.col("b.y1")]
    return a.join(b, on, "left_anti")


def page_order(blocks: DataFrame, doc: list[str]) -> DataFrame:
    """blocks (page, cluster, y, x) with ``ord``: page, column, from the top, from the left."""
    return blocks.withColumn("ord", F.row_number().over(Window.partitionBy(*doc).orderBy("page", "cluster", "y", "x")))


__all__ = ["build_tree", "chunks", "clean_spans", "collapse", "font_key", "header_levels", "main_font", "mark_headers", "node_chunks", "outside_tables", "page_order", "table_markdown", "tree_markdown", "tree_paths"]
