"""Seams for models that are not part of this library: page renderers, OCR, named entities. One bad row never ends a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OCR_WORDS = "line int, word_idx int, text string, left int, top int, width int, height int, conf double"
PAGES = "page_no int, image binary"
ENTITIES = "entity_type string, start int, `end` int, score double, recognizer string"
_OCR: dict[str, Callable[[bytes, str], list[tuple]]] = {}


def register_ocr(name: str, engine: Callable[[bytes, str], list[tuple]]) -> None:
    """engine(image, language) returns rows of OCR_WORDS."""
    _OCR[name] = engine


def per_row(df: DataFrame, column: str, call: Callable[[bytes], Iterator[tuple]], schema: str, keep: list[str]) -> DataFrame:
    """A table function: rows of ``call(value)`` beside the kept columns and ``error`` (null, or why the value failed).

    Rows before a failure are kept. One value is in memory at a time.
    """
    types = dict(df.dtypes)
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def arrays(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            for row in range(batch.num_rows):
                done, error, columns = [], None, []
                try:
                    for x in call(values[row].as_py()):
                        done.append(x)
                except Exception as e:  # a row's failure is data
                    error = f"{type(e).__name__}: {e}"
                try:
                    columns = arrays(done) if done else []
                except Exception as e:  # so are values of a wrong type
                    done, error = [], f"{type(e).__name__}: {e}"
                parts = [(len(done), columns, None)] if done else []
                if error is not None:
                    parts.append((1, [pa.nulls(1, f.type) for f in fields], error))
                for n, own, why in parts:
                    head = [batch.column(k).take(pa.array([row] * n)) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*head, *own, pa.array([why] * n, pa.string())], names=[*keep, *fields.names, "error"])

    own = df.select(*[F.col(k) for k in keep], F.col(column).alias("__value"))
    return own.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + f", {schema}, error string")


def render_pages(files: DataFrame, renderer: Callable[[bytes, int], Iterator[bytes]], dpi: int = 300, keep: list[str] | None = None) -> DataFrame:
    """Pages (from 1) of PDF bytes, in order, by a pluggable renderer."""
    return per_row(files, "content", lambda content: ((i, page) for i, page in enumerate(renderer(content, dpi), 1)), PAGES, keep or ["path"])


def ocr(pages: DataFrame, engine: str, language: str = "en", keep: list[str] | None = None) -> DataFrame:
    """Words of page images by a registered engine."""
    if engine not in _OCR:
        raise ValueError(f"no OCR engine {engine!r}; there are {sorted(_OCR)}")
    call = _OCR[engine]
    return per_row(pages, "image", lambda image: iter(call(image, language)), OCR_WORDS, keep or ["path", "page_no"])


def named_entities(docs: DataFrame, model: Callable[[str], list[tuple[str, str, float]]], doc_id: str = "doc_id", text: str = "text", name: str = "ner") -> DataFrame:
    """(doc_id, spans of ENTITIES): every occurrence, without regard to case, of each (label, surface, score) a model names.

    Guesses at identifiers should go through checksum.post_validate afterwards.
    """

    def call(value: str | None) -> Iterator[tuple]:
        lower = (value or "").lower()
        seen = set()
        for label, surface, score in model(value or "") if value else ():
            at = lower.find(surface.lower()) if surface else -1
            while at >= 0:
                if (key := (label, at, at + len(surface))) not in seen:
                    seen.add(key)
                    yield (*key, float(score), name)
                at = lower.find(surface.lower(), at + max(1, len(surface)))

    return per_row(docs, text, call, ENTITIES, [doc_id])
