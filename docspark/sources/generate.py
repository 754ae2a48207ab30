"""Synthetic identifiers and documents with ground truth, from ids and a seed: the same rows on any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import checksum
from docspark.functions.text import let


def number(seed: int, key: Column, low: int, high: int, salt: str) -> Column:
    """A whole number from low to high, by hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key), F.lit(high - low + 1)) + low).cast("long")


def _digits(seed: int, key: Column, n: int, salt: str) -> Column:
    return F.lpad(number(seed, key, 0, 10**n - 1, salt).cast("string"), n, "0")


def _complete(head: Column, check: Column) -> Column:
    return F.concat(head, check.cast("string"))


def _weighted(d: Column, weights: tuple[int, ...]) -> Column:
    w = F.expr(f"array({', '.join(map(str, weights))})")
    return F.aggregate(F.zip_with(F.slice(F.split(d, ""), 1, len(weights)), w, lambda c, x: c.cast("int") * x), F.lit(0), lambda s, x: s + x)


def tfn(seed: int, key: Column) -> Column:
    """Nine digits that pass; the last weight is -1 modulo 11, so a remainder of 10 moves to a head one higher."""
    heads = F.transform(F.array(*map(F.lit, range(3))), lambda k: F.lpad(F.pmod(number(seed, key, 0, 10**8 - 1, "tfn") + k, F.lit(10**8)).cast("string"), 8, "0"))
    whole = F.transform(heads, lambda h: let(_weighted(h, checksum.TFN[:8]) % 11, lambda c: F.when(c < 10, _complete(h, c))))
    return F.get(F.filter(whole, lambda v: v.isNotNull()), 0)


def acn(seed: int, key: Column) -> Column:
    return let(_digits(seed, key, 8, "acn"), lambda head: _complete(head, (10 - _weighted(head, checksum.ACN) % 10) % 10))


def medicare(seed: int, key: Column) -> Column:
    head = F.concat(number(seed, key, 2, 6, "m0").cast("string"), _digits(seed, key, 7, "m"))
    return F.concat(head, (_weighted(head, checksum.MEDICARE) % 10).cast("string"), number(seed, key, 1, 9, "mi").cast("string"))


def abn(seed: int, key: Column) -> Column:
    """Two check digits before nine others."""
    tail = _digits(seed, key, 9, "abn")
    rest = _weighted(tail, checksum.ABN[2:]) % 89
    lead = (89 - rest) % 89
    # the two leading digits, the first less one, weigh 10 and 1: as a number they are 11 to 99
    return F.concat((lead + 10).cast("string"), tail)


def card(seed: int, key: Column) -> Column:
    """Sixteen digits that pass the Luhn test."""
    doubled = lambda c, i: F.when(i % 2 == 1, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
    total = lambda head: F.aggregate(F.transform(F.split(head, ""), doubled), F.lit(0), lambda s, x: s + x)
    return let(F.concat(F.lit("4"), _digits(seed, key, 14, "card")), lambda head: _complete(head, (10 - total(head) % 10) % 10))


def bsb(seed: int, key: Column) -> Column:
    return F.format_string("%s-%s", _digits(seed, key, 3, "b1"), _digits(seed, key, 3, "b2"))


def account(seed: int, key: Column) -> Column:
    """One of four written styles."""
    d = _digits(seed, key, 9, "acct")
    styles = [F.substring(d, 1, 9), F.concat_ws(" ", F.substring(d, 1, 4), F.substring(d, 5, 4)), F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 3), F.substring(d, 6, 4)), F.concat_ws("-", F.substring(d, 1, 5), F.substring(d, 6, 4))]
    return F.get(F.array(*styles), number(seed, key, 0, 3, "style").cast("int"))


def mobile(seed: int, key: Column) -> Column:
    return F.format_string("04%s %s %s", _digits(seed, key, 2, "p1"), _digits(seed, key, 3, "p2"), _digits(seed, key, 3, "p3"))


def landline(seed: int, key: Column) -> Column:
    return F.format_string("(0%s) %s %s", F.get(F.array(*map(F.lit, "2378")), number(seed, key, 0, 3, "area").cast("int")), _digits(seed, key, 4, "l1"), _digits(seed, key, 4, "l2"))


def corrupt(value: Column, ok, also=None) -> Column:
    """The first value with one digit raised by 1 to 9 that fails ``ok`` (and ``also``); flips are tried from the last digit."""
    def flips(v: Column) -> Column:
        n = F.length(v)
        return F.flatten(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.concat(F.substring(v, F.lit(1), i - 1), ((F.substring(v, i, F.lit(1)).cast("int") + k) % 10).cast("string"), F.substring(v, i + 1, n)))))

    return F.get(F.filter(let(value, flips), lambda t: ~ok(t) & (~also(t) if also else F.lit(True))), 0)


def group(value: Column, *sizes: int) -> Column:
    """Digits in groups of the given sizes, by blanks."""
    parts, at = [], 1
    for n in sizes:
        parts.append(F.substring(value, at, n))
        at += n
    return F.concat_ws(" ", *parts)


# fixed values of our own: name and merchant pools
FIRST = ("Ada", "Ben", "Cleo", "Dan", "Eve", "Finn", "Gia", "Hal")
LAST = ("Abbott", "Birch", "Calder", "Dunne", "Ellis", "Frost", "Grady", "Hale")
MERCHANTS = ("Harbour Grocers", "Metro Fuel", "Corner Books", "City Rail", "Bay Pharmacy", "Lane Cafe")


def people(spark: SparkSession, n: int = 8, seed: int = 42) -> DataFrame:
    """A pool of n persons with their identifiers."""
    k = F.col("id")
    pick = lambda pool, salt: F.get(F.array(*map(F.lit, pool)), number(seed, k, 0, len(pool) - 1, salt).cast("int"))
    df = spark.range(n).select("id", pick(FIRST, "first").alias("first"), pick(LAST, "last").alias("last"), tfn(seed, k).alias("tfn"), medicare(seed, k).alias("medicare"), abn(seed, k).alias("abn"), card(seed, k).alias("card"), bsb(seed, k).alias("bsb"), account(seed, k).alias("account"), mobile(seed, k).alias("mobile"))
    return df.withColumn("email", F.lower(F.concat("first", F.lit("."), "last", F.col("id").cast("string"), F.lit("@example.com"))))


def build(parts: Column) -> Column:
    """struct(text, truth) from array<struct(text, type, critical)>: parts joined, with the exact spans of typed ones."""
    run = F.aggregate(
        parts,
        F.struct(F.lit("").alias("text"), F.array().cast("array<struct<type:string,start:int,end:int,value:string,critical:boolean>>").alias("truth")),
        lambda acc, p: F.struct(
            F.concat(acc["text"], p["text"]).alias("text"),
            F.when(p["type"].isNull(), acc["truth"]).otherwise(F.array_append(acc["truth"], F.struct(p["type"].alias("type"), F.length(acc["text"]).alias("start"), (F.length(acc["text"]) + F.length(p["text"])).alias("end"), p["text"].alias("value"), p["critical"].alias("critical")))).alias("truth"),
        ),
    )
    return run


def loan_applications(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(doc_id, text, truth): application texts with grouped identifiers, of which all must go."""
    p = people(spark, n, seed)
    said = lambda t: F.struct(F.lit(t).alias("text"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("critical"))
    typed = lambda c, kind: F.struct(c.alias("text"), F.lit(kind).alias("type"), F.lit(True).alias("critical"))
    parts = F.array(
        said("Application\nTFN: "), typed(group(F.col("tfn"), 3, 3, 3), "AU_TFN"), said("\nMedicare: "), typed(group(F.col("medicare"), 4, 5, 1), "AU_MEDICARE"),
        said("\nABN: "), typed(group(F.col("abn"), 2, 3, 3, 3), "AU_ABN"), said("\nCard: "), typed(group(F.col("card"), 4, 4, 4, 4), "CREDIT_CARD"),
        said("\nE-mail: "), typed(F.col("email"), "EMAIL_ADDRESS"), said("\nMobile: "), typed(F.col("mobile"), "PHONE_NUMBER"), said("\nEnd of form\n"),
    )
    return p.select(F.col("id").alias("doc_id"), build(parts).alias("b")).select("doc_id", "b.text", "b.truth")


def transactions(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(row, date, description, debit, credit, balance): signed amounts with a running balance, as decimals."""
    from pyspark.sql import Window

    k = F.col("id")
    amount = (number(seed, k, 100, 250000, "amt") / 100).cast("decimal(18,2)")
    merchant = F.get(F.array(*map(F.lit, MERCHANTS)), number(seed, k, 0, len(MERCHANTS) - 1, "merchant").cast("int"))
    out = number(seed, k, 0, 3, "dir") > 0
    forms = [F.concat(F.lit("EFTPOS "), F.upper(merchant)), F.concat(F.lit("OSKO PAYMENT TO "), bsb(seed, k), F.lit(" "), account(seed, k)), F.concat(F.lit("DIRECT DEBIT A/C "), account(seed, k)), F.concat(F.lit("CARD PURCHASE "), merchant)]
    described = F.when(out, F.get(F.array(*forms), number(seed, k, 0, len(forms) - 1, "form").cast("int"))).otherwise("SALARY CREDIT")
    df = spark.range(n).select(k.alias("row"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")), "dd/MM/yyyy").alias("date"), described.alias("description"), F.when(out, amount).alias("debit"), F.when(~out, amount).alias("credit"))
    moved = F.coalesce("credit", F.lit(0).cast("decimal(18,2)")) - F.coalesce("debit", F.lit(0).cast("decimal(18,2)"))
    return df.withColumn("balance", (F.lit(1000).cast("decimal(18,2)") + F.sum(moved).over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, 0))).cast("decimal(18,2)"))
