"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(text: Column) -> Column:
    """The ASCII digits of a text, in order."""
    return F.regexp_replace(text, "[^0-9]", "")


def normalize(text: Column) -> Column:
    """Ends trimmed, white space collapsed, lower case. Full case folding is not done: ``ß`` stays as it is."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " "))


def collapse(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed at both ends, case kept."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def squash_confusable(text: Column) -> Column:
    """Lower-case letters and digits only, with signs that OCR confuses mapped to one of them."""
    # fixed values: the confusion classes
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""), "0q1lj582697", "ooiiisbzggt")


def squash(text: Column) -> Column:
    """Lower-case letters and digits of any script."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def norm_lines(text: Column) -> Column:
    """Array of lines with white space collapsed, blank lines left out."""
    return F.filter(F.transform(F.split(text, "\n"), collapse), lambda x: x != "")


def sanitize_glyphs(text: Column) -> Column:
    """Bullets and the dash to ``-``, tabs to two blanks, alerts and backspaces dropped."""
    # fixed values: characters that become a dash, and those dropped
    dashes, dropped = "\uf0b7\u2022\u25cf\u2013\u00b7", "\x07\x08"
    return F.replace(F.translate(text, dashes + dropped, "-" * len(dashes)), F.lit("\t"), F.lit("  "))


def name_forms(name: Column) -> Column:
    """A name of two words also in reversed order."""
    words = F.split(collapse(name), " ")
    return F.when(F.size(words) == 2, F.array(name, F.concat_ws(" ", F.get(words, 1), F.get(words, 0)))).otherwise(F.array(name))


def highlight(text: Column, query: Column) -> Column:
    """Position (from 1) of the first hit without regard to case; 0 if there is none."""
    return F.position(F.lower(query), F.lower(text))


def money(amount: Column) -> Column:
    """Two decimals with thousands separators."""
    return F.format_number(amount, 2)


def escape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def stem(path: Column) -> Column:
    """File name without folders and its last ending."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "^.*/", ""), r".(\.[^.]*)$", 1)


def error_bucket(a: Column, b: Column) -> Column:
    """Kind of an edit from a to b, characters of which one may be empty.

    A lost blank is a merge, a gained one a split, also by substitution. Else deletions and insertions are of a digit,
    letter (alpha) or other; substitutions are sub_digit_digit, sub_digit_alpha, sub_case, sub_alpha or sub_other.
    """
    digit, alpha = (lambda c: c.rlike(r"^\p{Nd}")), (lambda c: c.rlike(r"^\p{L}"))
    kind = lambda c: F.when(digit(c), "digit").when(alpha(c), "alpha").otherwise("other")
    return (
        F.when(a == " ", "merge").when(b == " ", "split")
        .when(b == "", F.concat(F.lit("del_"), kind(a))).when(a == "", F.concat(F.lit("ins_"), kind(b)))
        .when(digit(a) & digit(b), "sub_digit_digit").when((digit(a) & alpha(b)) | (alpha(a) & digit(b)), "sub_digit_alpha")
        .when(alpha(a) & alpha(b), F.when(F.lower(a) == F.lower(b), "sub_case").otherwise("sub_alpha"))
        .otherwise("sub_other")
    )


def matches(text: Column, pattern: str) -> Column:
    """All matches with offsets: array of struct(start, end, value); offsets count code points from 0.

    Values come from one scan, the gaps between them from another; a match starts where the gaps and values before it
    end. Matches must not be empty.
    """

    def place(values: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.aggregate(
            F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("g"), v.alias("v"))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + F.length(x["v"])).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + F.length(x["v"])).alias("end"), x["v"].alias("value"))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")), lambda v: F.when(F.size(v) > 0, place(v)).otherwise(none))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)
