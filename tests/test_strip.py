"""Texts in, stripped texts out."""

import json

import pytest
from pyspark.sql import functions as F

from docspark.functions import checksum
from docspark.operators import pseudonyms, spans
from docspark.operators.strip import Options, detect, is_private_entity, strip, strip_cells
from docspark.sources import generate

#: (text, what must be gone, what must stay, what must be there)
GOLDEN = [
    ("Interest Charged From A/C 7412154728", ["7412154728"], [], ["ACCOUNT_1"]),
    *[(f"Salary {label} 1234 5678 credited", ["1234 5678"], ["credited"], ["ACCOUNT_1"]) for label in ("a/c", "A/C", "A/c.", "Ac.", "Ac:", "AC", "acct", "acc")],
    ("Account Number : 0007 3111 4", ["0007 3111 4"], [], ["ACCOUNT_1"]),
    ("account statement period 2023 2024", [], ["2023 2024"], []),
    ("invoice 1234 5678 and 9012 3456", [], ["1234 5678", "9012 3456"], []),
    ("ref a/c 12 34 only", [], ["12 34"], []),
    ("03 APR LOAN PAYMENT 2,148.74 377,970.04DR", [], ["03 APR LOAN PAYMENT 2,148.74 377,970.04DR"], []),
    ("Interest Charged From A/C 32-151-6825 1.50", ["32-151-6825", "A/C"], [" 1.50"], ["ACCOUNT_1"]),
    ("BSB Cash Account Number 014-936 111873883 and later account 111873883 again", ["014-936", "111873883"], [], ["BSB_1", "ACCOUNT_1"]),
    ("ACCOUNT NAME PTY LTD ATF SK BU\nStatement starts 22 February", ["SK BU"], ["Statement starts 22 February"], ["ORG_1"]),
    ("AFSL 234945 and Australian Credit Licence 234945", [], ["234945"], []),
    ("Contact 13 22 65 now", ["13 22 65"], [], ["PHONE_1"]),
    ("Contact 0412 345 678 now", ["0412 345 678"], [], ["PHONE_1"]),
    ("Contact +613 8536 7870 now", ["8536 7870"], [], ["PHONE_1"]),
    ("Contact +1 305 555 0123 now", ["305 555 0123"], [], ["PHONE_1"]),
    ("OSKO P12345678 J & E LAWRENCE RENT", ["LAWRENCE"], ["RENT"], ["PERSON_1"]),
    ("PRINCIPAL AND INTEREST PAYMENT", [], ["PRINCIPAL AND INTEREST PAYMENT"], []),
    ("SALARY AND WAGES CREDIT", [], ["SALARY AND WAGES CREDIT"], []),
    ("TFR E & J HOLDINGS", [], ["E & J HOLDINGS"], []),
    ("EFTPOS P & O CRUISES 4821 AU", ["P & O CRUISES"], ["4821"], ["PERSON_1"]),
    ("TFN: 291 417 775", [], ["291 417 775"], []),
    ("TFN: 291 417 774", ["291 417 774"], [], ["TFN_1"]),
    ("ACN: 526 018 155", ["526 018 155"], [], ["ACN_1"]),
    ("mail jo.bloggs@example.com.au please", ["jo.bloggs"], ["please"], ["EMAIL_1"]),
    ("card 4783 5337 4068 1247 ok", ["4783 5337 4068 1247"], ["ok"], ["CARD_1"]),
]


@pytest.fixture(scope="module")
def golden(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "doc_id long, text string")
    return {r["doc_id"]: r for r in strip(df, scope=F.col("doc_id").cast("string"))[0].collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)), ids=[g[0][:40] for g in GOLDEN])
def test_golden(golden, i):
    _, gone, stay, there = GOLDEN[i]
    out = golden[i]["stripped"]
    assert not [x for x in gone if x in out] and not [x for x in [*stay, *there] if x not in out], out


FINDINGS = [
    ("TFN: 291 417 775", "likely", ["AU_TFN_INVALID"]),
    ("TFN quoted as 123456789 on the form", "likely", []),
    ("TFN quoted as 123456789 on the form", "context", ["AU_TFN_INVALID"]),
    ("receipt 123456789 processed", "context", []),
    ("receipt 123456789 processed", "all", ["AU_ACN_INVALID", "AU_TFN_INVALID"]),
    ("ACN: 526 018 155", "likely", []),
    ("ABN: 24 787 782 328", "likely", ["AU_ABN_INVALID"]),
    ("Medicare 9317 06695 1", "likely", ["AU_MEDICARE_MALFORMED"]),
    ("card 4783 5337 4068 1248", "likely", ["CREDIT_CARD_INVALID"]),
    ("card 4783 5337 4068 1247", "likely", []),
    ("TFN: 291 417 775", "ignore", []),
]


@pytest.mark.parametrize("tier", ["ignore", "likely", "context", "all"])
def test_findings(spark, tier):
    own = [(i, t) for i, (t, k, _) in enumerate(FINDINGS) if k == tier]
    got = detect(spark.createDataFrame(own, "doc_id long, text string"), Options(invalid=tier)).select("doc_id", "text", "invalid").collect()
    for r in got:
        kinds = {f["entity_type"] for f in r["invalid"]}
        want = set(FINDINGS[r["doc_id"]][2])
        assert want <= kinds and (bool(want) == bool(kinds)), (r["text"], kinds)
        assert all(r["text"][f["start"] : f["end"]] == f["value"] and f["rule"] == spans.INVALID_RULES[f["entity_type"]] for f in r["invalid"])
        if "24 787 782 328" in r["text"]:
            assert "787 782 328" not in [f["value"] for f in r["invalid"]]


def test_mask_invalid_round_trip(spark):
    df = spark.createDataFrame([(1, "TFN: 291 417 775 and 😀 jo@example.com, JO@example.com"), (2, None), (3, ""), (4, "nothing")], "doc_id long, text string")
    out, made = strip(df, Options(mask_invalid=True))
    got = {r["doc_id"]: r["stripped"] for r in out.collect()}
    assert got == {1: "TFN_INVALID_1 and 😀 EMAIL_1, EMAIL_1", 2: None, 3: "", 4: "nothing"}
    back = pseudonyms.rehydrate(out.select(F.lit("all").alias("scope"), "doc_id", "stripped"), made, "stripped")
    assert {r["doc_id"]: r["stripped"] for r in back.collect()}[1] == "TFN: 291 417 775 and 😀 jo@example.com, jo@example.com"


def test_options_are_checked():
    with pytest.raises(ValueError):
        Options(invalid="often")
    with pytest.raises(ValueError):
        Options(threshold=2)


def test_map_extends_and_keeps_numbers(spark):
    m = lambda values: spark.createDataFrame([("s", "PERSON", v, i) for i, v in enumerate(values)], "scope string, entity_type string, value string, i int")
    first = pseudonyms.allocate(m(["Ann  Lee", "Bob", "ann lee"]), ["i"])
    both = pseudonyms.allocate(m(["Cy", "BOB", "ANN LEE "]), ["i"], first)
    got = {r["norm_value"]: (r["placeholder"], r["surface"]) for r in both.collect()}
    assert got == {"ann lee": ("PERSON_1", "Ann  Lee"), "bob": ("PERSON_2", "Bob"), "cy": ("PERSON_3", "Cy")}
    stored = pseudonyms.pmap_to_json(both).collect()[0]["json"]
    assert json.loads(stored)["counters"] == {"PERSON": 3}
    texts = spark.createDataFrame([("s", "PERSON_3 met PERSON_1 and PERSON_9")], "scope string, text string")
    assert pseudonyms.rehydrate(texts, both).first()["text"] == "Cy met Ann  Lee and PERSON_9"


def test_cells(spark):
    rows = spark.createDataFrame([(1, "01/02", "transfer to jo@example.com", "1.00", None), (2, "02/02", "from al@example.com, jo@example.com", "", "")], "n int, Date string, Description string, Debit string, Note string")
    done, made, findings = strip_cells(rows, "n")
    got = {r["n"]: r for r in done.collect()}
    assert got[1]["Description"] == "transfer to EMAIL_1" and got[2]["Description"] == "from EMAIL_2, EMAIL_1"
    assert got[1]["Date"] == "01/02" and got[1]["Note"] is None and done.columns == rows.columns and findings.count() == 0
    with pytest.raises(ValueError):
        strip_cells(rows, "n", columns=["nope"])


def test_private_entities(spark):
    names = {"SK Management Pty Ltd": True, "Smith Family Trust": True, "X ATF Y": True, "Jones Super Fund": True, "My SMSF": True, "ANZ Super Fund": False, "QBE Insurance Limited": False, "Westpac": False, "Corner Books": False, "Macquarie Pty Ltd": False}
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("p", is_private_entity(F.col("name")))
    assert {r["name"]: r["p"] for r in df.collect()} == names


def test_checksums(spark):
    one = spark.range(1)
    ok = lambda f, v: one.select(f(F.lit(v))).first()[0]
    assert ok(checksum.tfn_valid, "291417774") and ok(checksum.tfn_valid, "123456782") and not ok(checksum.tfn_valid, "291417775")
    assert ok(checksum.acn_valid, "526018155") and not ok(checksum.tfn_valid, "526018155") and not ok(checksum.abn_valid, "24787782328")
    assert ok(checksum.medicare_valid, "2123456701") and not ok(checksum.medicare_valid, "2123456751") and not ok(checksum.luhn_valid, "") and not ok(checksum.tfn_valid, "12")
    assert ok(checksum.iban_valid, "GB82 WEST 1234 5698 7654 32") and not ok(checksum.iban_valid, "GB82 WEST 1234 5698 7654 33")
    case = lambda k, v: one.select(checksum.post_validate(F.lit(k), F.lit(v))).first()[0]
    assert case("AU_TFN", "12345678") == "AU_TFN" and case("AU_MEDICARE", "2123 45675 1") == "AU_MEDICARE_INVALID" and case("AU_MEDICARE", "9123 45670 1") is None
    assert case("AU_DRIVERS_LICENCE", "W1045366576") is None and case("PERSON", "x") == "PERSON"


def test_generated_identifiers(spark):
    df = spark.range(3000)
    k = F.col("id")
    bad = df.select(
        F.count_if(~checksum.tfn_valid(generate.tfn(7, k))), F.count_if(~checksum.acn_valid(generate.acn(7, k))), F.count_if(~checksum.abn_valid(generate.abn(7, k))),
        F.count_if(~checksum.medicare_valid(F.substring(generate.medicare(7, k), 1, 10))), F.count_if(~checksum.luhn_valid(generate.card(7, k))),
        F.count_if(F.coalesce(checksum.tfn_valid(generate.corrupt(generate.tfn(7, k), checksum.tfn_valid, checksum.acn_valid)), F.lit(True))),
    ).first()
    assert list(bad) == [0] * 6


def test_generated_documents_pass_the_gate(spark):
    from docspark.operators import score

    docs = generate.loan_applications(spark, 60)
    truth = docs.select("doc_id", F.explode("truth").alias("e")).select("doc_id", "e.*", F.lit(True).alias("strip_expected"))
    assert docs.select(F.bool_and(F.forall("truth", lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]) == e["value"]))).first()[0]
    plan = detect(docs.select("doc_id", "text")).select("doc_id", F.explode("plan").alias("s")).select("doc_id", "s.start", "s.end")
    g = score.gate(score.verdicts(truth, plan, ["doc_id"])).first()
    assert g["critical"] == 360 and g["failures"] == 0 and g["passed"]


def test_rows_without_own_ids_are_stripped_and_kept(spark):
    texts = [(None, "mail a@example.com"), (None, "mail b@example.com"), (7, "to a@example.com and c@example.com"), (7, "plain"), (7, "plain"), (8, None), (None, "mail a@example.com")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, scope string, plan_ int")
    out, made = strip(docs)
    got = sorted(((r["doc_id"], r["text"], r["stripped"], r["scope"]) for r in out.collect()), key=repr)
    name = {r["norm_value"]: r["placeholder"] for r in made.collect()}
    assert set(name.values()) == {"EMAIL_1", "EMAIL_2", "EMAIL_3"} and set(name) == {f"{c}@example.com" for c in "abc"}

    def put(t):
        for v, p in name.items():
            t = t and t.replace(v, p)
        return t

    assert got == sorted(((i, t, put(t), "x") for i, t in texts), key=repr)


def test_numbers_do_not_depend_on_partitions(spark):
    values = [(f"v{i * 7919 % 500}", i) for i in range(2000)]
    m = spark.createDataFrame([("s" if i % 3 else None, "PERSON", v, i) for v, i in values], "scope string, entity_type string, value string, i int").repartition(11)
    got = {(r["scope"], r["norm_value"]): r["n"] for r in pseudonyms.allocate(m, ["i"]).collect()}
    want: dict = {}
    for v, i in values:
        own = {k: n for k, n in want.items() if k[0] == ("s" if i % 3 else "")} if ("s" if i % 3 else "", v) not in want else None
        if own is not None:
            want["s" if i % 3 else "", v] = len(own) + 1
    assert got == want
