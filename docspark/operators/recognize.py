"""Recognizers: patterns with scores, context words and rules, compiled to one column expression per document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import checksum
from docspark.functions.text import digits, let, matches
from docspark.operators.spans import INVALID_RULES, SPAN

THRESHOLD = 0.4
BOOST, BOOSTED_LEAST, WORDS_BEFORE = 0.35, 0.4, 5
TIERS = ("ignore", "likely", "context", "all")

#: Outcome of a rule on a matched value: null keeps the score, true lifts it to 1, false drops the match.
Rule = Callable[[Column], Column]


@dataclass(frozen=True)
class Recognizer:
    """name, the entity it finds, (pattern, score) pairs, context words, a rule, and a cheap test before the scans."""

    name: str
    entity: str
    patterns: tuple[tuple[str, float], ...]
    context: tuple[str, ...] = ()
    rule: Rule | None = None
    guard: str = "[0-9]{3}"
    validated: bool = field(default=False)



def _keep_if(ok: Column) -> Column:
    return F.when(ok, F.lit(None).cast("boolean")).otherwise(F.lit(False))


def _must(check: Callable[[Column], Column]) -> Rule:
    return lambda v: check(digits(v))


def _fails(n: tuple[int, ...], check: Callable[[Column], Column]) -> Rule:
    return lambda v: _keep_if(F.length(digits(v)).isin(*n) & ~check(digits(v)))


# fixed values: corporate words that are no surnames
CORPORATE = (
    "ACCOUNTANTS", "ASSOCIATES", "BROTHERS", "CO", "CONSULTING", "GROUP", "HOLDINGS", "LAWYERS", "LIMITED", "LTD",
    "MANAGEMENT", "PARTNERS", "PTY", "SERVICES", "SOLICITORS", "SONS", "TRADING", "TRUST",
)

# fixed values: patterns, scores and context words of the detectable identifiers
I = "(?ism)"
BANKING: tuple[Recognizer, ...] = (
    Recognizer("AuBsbRecognizer", "AU_BSB", (
        (I + r"\b\d{3}[- ]\d{3}(?=[- ]?\s?\d{5,10}\b)", 0.6),
        (I + r"\b\d{6}(?=[ -]\d{5,10}\b)", 0.55),
        (I + r"\b\d{3}[- ]\d{3}\b", 0.2),
    ), ("bsb", "branch", "bank", "deposit", "transfer")),
    Recognizer("AuAccountNumberRecognizer", "AU_BANK_ACCOUNT", (
        (I + r"\b\d{5,10}\b", 0.15),
        (I + r"\b(?<![.,])(?!(?:19|20)\d{2}[ -](?:19|20)?\d{2}\b)\d{2,6}(?:[ -]\d{1,6}){1,3}(?![.,]?\d)\b", 0.15),
        (I + r"\b\d{2,4}-\d{3}-\d{3,4}\b", 0.45),
        (I + r"\b(?!(?:19|20)\d{2}-(?:(?:19|20)?\d{2})\b)\d{4,6}-\d{2,6}\b", 0.45),
        (I + r"(?<=\b\d{3}[- ]\d{3}[- ]?\s?)\d{5,10}\b", 0.55),
        (I + r"(?<=\b\d{6}[ -])\d{5,10}\b", 0.55),
        (I + r"\b(?:a/?c|acct?)\b\.?\s*(?:no\.?|number|#)?\s*:?\s*(?:\d{5,10}|\d{1,6}(?:[ -]\d{1,6}){1,3})(?![.,]?\d)\b", 0.5),
    ), ("account", "acct", "acc", "savings", "cheque", "offset", "loan", "repayment", "redraw"), lambda v: _keep_if(F.length(digits(v)) >= 5), "[0-9]{2}"),
    Recognizer("PayIdRecognizer", "AU_PAYID", ((I + r"\b\d{9,11}\b", 0.15),), ("payid", "pay id", "osko", "npp"), guard="[0-9]{9}"),
    Recognizer("AuAfslRecognizer", "AU_AFSL", ((I + r"\b(?:afsl|(?:australian\s+)?financial\s+services\s+licen[cs]e)\s*(?:no\.?|number|#)?\s*:?\s*\d{5,6}\b", 0.7),), guard="(?i)afsl|licen"),
    Recognizer("AuCreditLicenceRecognizer", "AU_CREDIT_LICENCE", ((I + r"\b(?:(?:australian\s+)?credit\s+licen[cs]e|acl)\s*(?:no\.?|number|#)?\s*:?\s*\d{5,6}\b", 0.7),), guard="(?i)acl|licen"),
    Recognizer("JointNameRecognizer", "PERSON", ((r"(?sm)\b[A-Z]\s?&\s?[A-Z]\s+[A-Z][A-Za-z'’-]+\b(?!\s+(?i:" + "|".join(CORPORATE) + r")\b)", 0.5),),
               rule=lambda v: _keep_if(~F.upper(F.element_at(F.split(v, r"\s+"), -1)).isin(*CORPORATE)), guard="&"),
    Recognizer("AtfTailRecognizer", "ORGANIZATION", ((I + r"\b(?:atf|as\s+trustees?\s+for)\s+\S[^\n]{0,60}", 0.45),), guard="(?i)atf|trustee"),
)

# patterns of our own for identifiers with a published checksum or format
CHECKED: tuple[Recognizer, ...] = (
    Recognizer("AuTfnRecognizer", "AU_TFN", ((r"\b\d{3}\s\d{3}\s\d{3}\b", 0.1), (r"\b\d{9}\b", 0.01)), ("tax file number", "tfn"), _must(checksum.tfn_valid), validated=True),
    Recognizer("AuMedicareRecognizer", "AU_MEDICARE", ((r"\b[2-6]\d{3}\s\d{5}\s\d\b", 0.1), (r"\b[2-6]\d{9}\b", 0.01)), ("medicare",), _must(checksum.medicare_valid), validated=True),
    Recognizer("AuAbnRecognizer", "AU_ABN", ((r"\b\d{2}\s\d{3}\s\d{3}\s\d{3}\b", 0.1), (r"\b\d{11}\b", 0.01)), ("australian business number", "abn"), _must(checksum.abn_valid), validated=True),
    Recognizer("AuAcnRecognizer", "AU_ACN", ((r"\b\d{3}\s\d{3}\s\d{3}\b", 0.1), (r"\b\d{9}\b", 0.01)), ("australian company number", "acn"), _must(checksum.acn_valid), validated=True),
    Recognizer("CreditCardRecognizer", "CREDIT_CARD", ((r"\b[1-6]\d{3}[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}\b", 0.3),), ("credit", "card", "visa", "mastercard", "amex", "debit"), _must(checksum.luhn_valid), "[0-9]{4}", True),
    Recognizer("EmailRecognizer", "EMAIL_ADDRESS", ((r"(?i)\b[a-z0-9][a-z0-9._%+'-]*@[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,24}\b", 0.5),), ("email",), lambda v: F.lit(True), "@"),
    Recognizer("IbanRecognizer", "IBAN_CODE", ((r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 0.5),), ("iban",), checksum.iban_valid, "[A-Z]{2}[0-9]{2}"),
    Recognizer("PhoneRecognizer", "PHONE_NUMBER", (
        (r"(?<![\w.,+-])(?:\+61\s?\(?0?\)?|\(?0)(?:4\d{2}\)?[ -]?\d{3}[ -]?\d{3}|[2378]\)?[ -]?\d{4}[ -]?\d{4})(?![\w-]|[.,]\d)", 0.75),
        (r"(?<![\w.,+-])(?:1[38]00[ -]?\d{3}[ -]?\d{3}|13[ -]?\d{2}[ -]?\d{2})(?![\w-]|[.,]\d)", 0.5),
        (r"(?<![\w+])\+(?!61)[1-9]\d{0,2}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,3}(?![\w-])", 0.75),
    ), ("phone", "number", "telephone", "mobile", "call", "contact"), guard="[0-9]{2}", validated=True),
    Recognizer("DateRecognizer", "DATE_TIME", (
        (r"(?i)\b\d{1,2}[/.-]\d{1,2}[/.-](?:19|20)?\d{2}\b", 0.6),
        (r"(?i)\b\d{4}-\d{2}-\d{2}\b", 0.6),
        (r"(?i)\b\d{1,2}\s?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s?(?:\d{4}|\d{2})?\b", 0.5),
    ), guard="[0-9]"),
)

# fixed values: shapes of identifiers whose rule fails; the second group is scored by tier
_SHADOW = (
    ("AU_TFN_INVALID", (r"\b\d{3}[- ]\d{3}[- ]\d{3}\b", r"\b(?:tfn|tax file (?:no\.?|number))\s*:?\s*#?\s*\d{3}[- ]?\d{3}[- ]?\d{3}\b"), (r"\b\d{9}\b",), ("tax file number", "tfn"), _fails((9,), checksum.tfn_valid)),
    ("AU_MEDICARE_INVALID", (r"\b[2-6]\d{3} \d{5} \d\b", r"\bmedicare\s*(?:card|no\.?|number)?\s*:?\s*[2-6]\d{3}[- ]?\d{5}[- ]?\d\b"), (r"\b[2-6]\d{9}\b",), ("medicare",), _fails((10,), checksum.medicare_valid)),
    ("AU_MEDICARE_MALFORMED", (r"\b[017-9]\d{3} \d{5} \d\b", r"\bmedicare\s*(?:card|no\.?|number)?\s*:?\s*[017-9]\d{3}[- ]?\d{5}[- ]?\d\b"), (r"\b[017-9]\d{9}\b",), ("medicare",), None),
    ("AU_ABN_INVALID", (r"\b\d{2}[- ]\d{3}[- ]\d{3}[- ]\d{3}\b", r"\babn\s*(?:no\.?|number)?\s*:?\s*\d{2}[- ]?\d{3}[- ]?\d{3}[- ]?\d{3}\b"), (r"\b\d{11}\b",), ("australian business number", "abn"), _fails((11,), checksum.abn_valid)),
    ("AU_ACN_INVALID", (r"\b\d{3}[- ]\d{3}[- ]\d{3}\b", r"\bacn\s*(?:no\.?|number)?\s*:?\s*\d{3}[- ]?\d{3}[- ]?\d{3}\b"), (r"\b\d{9}\b",), ("australian company number", "acn"), _fails((9,), checksum.acn_valid)),
    ("CREDIT_CARD_INVALID", (r"\b\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}\b", r"\b\d{4}[- ]\d{6}[- ]\d{5}\b", r"\bcard\s*(?:no\.?|number)?\s*:?\s*\d{12,19}\b"), (r"\b\d{15,16}\b",), ("credit", "card", "visa", "mastercard", "amex", "debit"), _fails(tuple(range(12, 20)), checksum.luhn_valid)),
)
_BARE = {"likely": None, "context": 0.15, "all": 0.5}


def shadow_recognizers(tier: str) -> tuple[Recognizer, ...]:
    """Recognizers of identifiers that fail their rule; ``likely`` leaves bare digit runs out, ``ignore`` finds none."""
    if tier not in TIERS:
        raise ValueError(f"tier {tier!r}, expected one of {TIERS}")
    if tier == "ignore":
        return ()
    bare = _BARE[tier]
    return tuple(
        Recognizer(f"Invalid:{entity}", entity, tuple((I + p, 0.5) for p in sure) + tuple((I + p, bare) for p in loose if bare is not None), context, rule)
        for entity, sure, loose, context, rule in _SHADOW
    )


def registry(tier: str = "likely", extra: tuple[Recognizer, ...] = ()) -> tuple[Recognizer, ...]:
    return (*CHECKED, *BANKING, *shadow_recognizers(tier), *extra)


VALIDATED = tuple(r.name for r in CHECKED if r.validated)


def _has_context(text: Column, start: Column, words: tuple[str, ...]) -> Column:
    """A context word among the WORDS_BEFORE words before the start."""
    before = F.lower(F.substring(text, F.greatest(F.lit(1), start - 119), F.least(start, F.lit(120))))
    tokens = F.filter(F.split(before, "[^a-z0-9]+"), lambda w: w != "")
    near = F.concat(F.lit(" "), F.array_join(F.slice(tokens, F.greatest(F.size(tokens) - WORDS_BEFORE + 1, F.lit(1)), WORDS_BEFORE), " "), F.lit(" "))
    return near.rlike(" (?:" + "|".join(words) + ")s? ")


def _as_span(text: Column, r: Recognizer, score: float) -> Callable[[Column], Column]:
    """From a match to a span with its score: the pattern's, lifted by context, then by the rule."""

    def span(m: Column) -> Column:
        own = F.lit(score)
        if r.context:
            own = F.when(_has_context(text, m["start"], r.context), F.least(F.lit(1.0), F.greatest(own + BOOST, F.lit(BOOSTED_LEAST)))).otherwise(own)
        if r.rule:
            verdict = r.rule(m["value"])
            own = F.when(verdict.isNull(), own).when(verdict, F.lit(1.0))
        return F.struct(F.lit(r.entity).alias("entity_type"), m["start"].alias("start"), m["end"].alias("end"), own.alias("score"), F.lit(r.name).alias("recognizer"))

    return span


def recognize(text: str, recognizers: tuple[Recognizer, ...], threshold: float = THRESHOLD) -> Column:
    """array<span> of all that the recognizers find, from the threshold up, in the text column of that name.

    Patterns are scanned only where the recognizer's cheap test holds; null text gives no spans. The expression is large,
    so it is built once per name and set of recognizers.
    """
    return _recognize(text, tuple(recognizers), threshold, id(SparkContext._active_spark_context))


@lru_cache(maxsize=64)
def _recognize(name: str, recognizers: tuple[Recognizer, ...], threshold: float, _context: int) -> Column:
    text = F.col(name)
    found = []
    for r in recognizers:
        hits = []
        for pattern, score in r.patterns:
            hits.append(F.filter(F.transform(matches(text, pattern), _as_span(text, r, score)), lambda s: s["score"] >= threshold))
        own = F.concat(*hits) if len(hits) > 1 else hits[0]
        found.append(F.when(text.rlike(r.guard), own).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.coalesce(F.concat(*found), F.array().cast(f"array<{SPAN}>"))


def invalid_findings(text: Column, spans: Column) -> Column:
    """array<struct(entity_type, start, end, value, rule)>: invalid-class spans worth reporting, by start and type.

    A candidate that a validated recognizer's span covers is a valid identifier of another class; one strictly inside a
    longer candidate is a fragment. Guesses of a model never suppress.
    """
    loose = F.filter(spans, lambda s: s["entity_type"].isin(*INVALID_RULES) & ~F.exists(spans, lambda v: v["recognizer"].isin(*VALIDATED) & (v["start"] <= s["start"]) & (s["end"] <= v["end"])))
    own = let(loose, lambda all_: F.filter(all_, lambda s: ~F.exists(all_, lambda k: (k["start"] <= s["start"]) & (s["end"] <= k["end"]) & ((k["start"] != s["start"]) | (k["end"] != s["end"])))))
    rules = F.create_map(*[F.lit(x) for kv in INVALID_RULES.items() for x in kv])
    out = F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["entity_type"].alias("entity_type"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value"), F.try_element_at(rules, s["entity_type"]).alias("rule")))
    return F.array_sort(F.array_distinct(out))
