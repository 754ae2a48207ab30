"""Entities that a model proposes: passes over windows, checks of what is proposed, one list of spans per row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.checksum import post_validate
from docspark.functions.text import let
from docspark.operators.spans import SPAN, coalesce_adjacent, corporate_licence_before, extend_honorific, text_windows

# fixed values: labels of each pass with their description and class
LABELS = {
    "person": ("Full or partial name of a person", "PERSON"),
    "organization": ("Name of a company, bank, merchant or other organization", "ORGANIZATION"),
    "address": ("Street or postal address, full or partial", "ADDRESS"),
    "email": ("Email address", "EMAIL_ADDRESS"),
    "phone number": ("Phone number in any format", "PHONE_NUMBER"),
    "date of birth": ("A person's date of birth", "DATE_OF_BIRTH"),
    "bank account number": ("Bank account number, 5-10 digits in Australian format, sometimes preceded by a 6-digit BSB code", "AU_BANK_ACCOUNT"),
    "tax file number": ("Australian tax file number (TFN), 8 or 9 digits", "AU_TFN"),
    "medicare number": ("Australian Medicare card number, 10 or 11 digits", "AU_MEDICARE"),
    "driver licence number": ("Driver licence number", "AU_DRIVERS_LICENCE"),
    "passport number": ("Passport number", "PASSPORT"),
}
ADDRESS_WHOLE = {"address": ("Residential or postal address or any part of one, e.g. '5 Jeremy Avenue, Richardland QLD 5537' or a suburb-state-postcode line like 'NEWTOWN NSW 2042'", "ADDRESS")}
ADDRESS_PARTS = {
    "street address": ("Street line of an address, including unit, flat or suite numbers, e.g. 'Flat 66 7 Maddox Alleyway' or 'Suite 8 12 George Street'", "ADDRESS"),
    "suburb state postcode": ("Locality line of an Australian address: suburb, state abbreviation and 4-digit postcode, e.g. 'NEWTOWN NSW 2042'", "ADDRESS"),
}
ADDRESS_THRESHOLD = 0.3

#: A model: (texts, label to description, threshold) to a list of (label, surface, score) for each text.
Model = Callable[[list[str], dict[str, str], float], list[list[tuple[str, str, float]]]]
Pass = tuple[dict[str, tuple[str, str]], float]
GUESS = "struct<entity_type:string,surface:string,start:int,end:int,score:double,place:int>"


def passes(threshold: float = 0.4) -> list[Pass]:
    """The general pass, then addresses alone, whole and in parts, which other labels would crowd out."""
    return [(LABELS, threshold), (ADDRESS_WHOLE, ADDRESS_THRESHOLD), (ADDRESS_PARTS, ADDRESS_THRESHOLD)]


def propose(docs: DataFrame, model: Model, runs: list[Pass], text: str = "text", batch: int = 8) -> DataFrame:
    """docs with ``guesses``: every place, without regard to case, of each surface that a pass names within a window.

    A person of two words is also looked for in reversed order. Windows of many rows go to the model together; no
    shuffle. ``model`` may be a factory (attribute ``factory`` true), called once per task. Null and blank texts have an
    empty list.
    """
    names = list(docs.columns)
    own = docs.withColumn("__w", F.coalesce(text_windows(F.col(text)), F.array().cast("array<struct<start:int,text:string>>")))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", guesses array<{GUESS}>"
    kind = pa.list_(pa.struct([("entity_type", pa.string()), ("surface", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("place", pa.int32())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = model() if getattr(model, "factory", False) else model
        for b in batches:
            windows = [(row, w["start"], w["text"]) for row, ws in enumerate(b.column(len(names)).to_pylist()) for w in ws]
            found: list[list[tuple]] = [[] for _ in range(b.num_rows)]
            for labels, threshold in runs:
                for i in range(0, len(windows), batch):
                    part = windows[i : i + batch]
                    named = call([w[2] for w in part], {k: d for k, (d, _) in labels.items()}, threshold)
                    for (row, at, body), guesses in zip(part, named, strict=True):
                        for label, surface, score in guesses:
                            entity = labels[label][1]
                            words = surface.split()
                            forms = [surface, " ".join(reversed(words))] if entity == "PERSON" and len(words) == 2 else [surface]
                            for form in filter(None, forms):
                                for m in re.finditer(re.escape(form), body, re.IGNORECASE):
                                    found[row].append((entity, surface, at + m.start(), at + m.end(), float(score), len(found[row])))
            lists = [[dict(zip(("entity_type", "surface", "start", "end", "score", "place"), g, strict=True)) for g in f] for f in found]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(lists, kind)], names=[*names, "guesses"])

    return own.mapInArrow(read, schema)


def accept(text: Column, guesses: Column, threshold: float = 0.4, wanted: list[str] | None = None, demote: bool = True, name: str = "ner") -> Column:
    """array<SPAN> of what stands of the guesses, in order of place.

    Identifiers are checked first and may become their invalid class (left out unless ``demote``); only then does the
    choice of ``wanted`` classes apply. Persons take in a title before them, a licence number after a corporate licence
    label goes, addresses score at least the threshold. Of equal extent and class the first guess stays; fragments of
    addresses and persons are joined.
    """

    def check(x: Column) -> Column:
        emit = post_validate(x["entity_type"], x["surface"])
        return F.struct(
            F.when(emit == "PERSON", extend_honorific(text, x["start"])).otherwise(x["start"]).cast("int").alias("start"), x["end"].alias("end"), emit.alias("entity_type"), x["place"].alias("place"),
            F.when(emit == "ADDRESS", F.greatest(x["score"], F.lit(threshold))).otherwise(x["score"]).alias("score"), (emit == x["entity_type"]).alias("same"),
            ((emit == "AU_DRIVERS_LICENCE") & corporate_licence_before(text, x["start"])).alias("corporate"),
        )

    def stands(x: Column) -> Column:
        ok = x["entity_type"].isNotNull() & ~F.coalesce(x["corporate"], F.lit(False))
        ok = ok if demote else ok & x["same"]
        return ok & x["entity_type"].isin(*wanted) if wanted is not None else ok

    def first_of_each(s: Column) -> Column:
        same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["entity_type"] == b["entity_type"])
        return F.filter(s, lambda x, i: ~F.coalesce(same(F.get(s, i - 1), x), F.lit(False)))

    kept = let(F.array_sort(F.filter(F.transform(guesses, check), stands)), first_of_each)
    spans = F.transform(kept, lambda x: F.struct(x["entity_type"], x["start"], x["end"], x["score"], F.lit(name).alias("recognizer"))).cast(f"array<{SPAN}>")
    return coalesce_adjacent(text, spans)


def recognize_with_model(docs: DataFrame, model: Model, threshold: float = 0.4, wanted: list[str] | None = None, demote: bool = True, text: str = "text") -> DataFrame:
    """docs with ``spans``: the passes' proposals, checked and joined. Rows keep their number, null and repeated ids too."""
    return propose(docs, model, passes(threshold), text).withColumn("spans", accept(F.col(text), F.col("guesses"), threshold, wanted, demote)).drop("guesses")
