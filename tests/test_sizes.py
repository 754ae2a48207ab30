"""Steps whose memory or time must not outgrow the input, on rows that the test tables do not have."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docspark.operators import layout, score, search
from docspark.plans.queries import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def scored(spark):
    """(truth rows, verdicts): equal rows, rows of no document, and a plan that covers, touches or misses."""
    truth = [(d, k, s, s + n, go, True) for d in (1, 1, 2, None) for k, s, n, go in (("A", 0, 5, True), ("A", 0, 5, False), ("B", 10, 4, True), ("C", 20, 0, False))]
    plan = [(1, 0, 2), (1, 2, 5), (1, 12, 13), (1, 20, 20), (2, 5, 10), (3, 0, 99), (None, 0, 99)]
    names = "doc_id long, type string, start int, end int, strip_expected boolean, critical boolean"
    return truth, plan, score.verdicts(spark.createDataFrame(truth, names), spark.createDataFrame(plan, "doc_id long, start int, end int"), ["doc_id"])


def expected(truth, plan):
    for d, k, s, e, go, _ in truth:
        n = sum(max(0, min(e, y) - max(s, x)) for p, x, y in plan if p == d and d is not None) or e - s  # untouched: see score.verdicts
        yield d, k, s, e, go, n, ("stripped" if n >= e - s else "partial" if n else "leaked") if go else ("over-stripped" if n else "kept")


def test_verdicts_pass_one_join(spark, scored):
    truth, plan, out = scored
    want = list(expected(truth, plan))
    assert Counter(map(tuple, out.drop("critical").collect())) == Counter(want)
    assert plan_of(out).count("Join ") == 1 and "Window" not in plan_of(out)
    bad = sum(v in ("leaked", "partial") for *_, v in want)
    assert tuple(score.gate(out).first()) == (len(want), bad, False)


def one_pass(df) -> bool:
    return plan_of(df).count("Join ") == 1 and "Window" not in plan_of(df)


def test_types_to_strip_come_from_one_pass(scored):
    truth, plan, out = scored
    kept = {r[1] for r in expected(truth, plan) if r[6] in ("kept", "over-stripped")}
    got = score.strip_types(out)
    assert {r["type"] for r in got.collect()} == {r[1] for r in truth} - kept == {"B"} and one_pass(got)


def test_scores_come_from_one_pass(scored):
    truth, plan, out = scored
    got = out.select("doc_id", "type", "covered", "verdict")
    assert Counter(map(tuple, got.collect())) == Counter((d, k, n, v) for d, k, _, _, _, n, v in expected(truth, plan)) and one_pass(got)


def test_pivot_comes_from_one_pass(scored):
    truth, plan, out = scored
    want = Counter((r[1], r[6]) for r in expected(truth, plan))
    got = score.verdict_pivot(out)
    assert {(r["type"], v): r[v] for r in got.collect() for v in score.VERDICTS if r[v]} == want and one_pass(got)


def in_time(df, seconds=30):
    began = time.perf_counter()
    rows = df.collect()
    assert time.perf_counter() - began < seconds
    return rows


@pytest.fixture(scope="module")
def crowded(spark):
    """(verdicts by entity, their frame) of one document with as many spans as entities; each pair of them would take minutes."""
    n, want = 40000, []
    for i in range(n):
        met = max(0, 5 - i % 8) + (max(0, (i - 1) % 8 - 5) if i else 0)
        full = met or 5  # untouched: see score.verdicts
        want.append((i, "ABC"[i % 3], full, ("stripped" if full >= 5 else "partial") if i % 3 < 2 else "over-stripped"))
    i = F.col("id")
    truth = spark.range(n).select(F.lit(1).alias("doc_id"), F.substring(F.lit("ABC"), (i % 3 + 1).cast("int"), F.lit(1)).alias("type"), i.alias("n"), (i * 10).cast("int").alias("start"), (i * 10 + 5).cast("int").alias("end"), (i % 3 < 2).alias("strip_expected"), F.lit(True).alias("critical"))
    plan = spark.range(n).select(F.lit(1).alias("doc_id"), (i * 10 + i % 8).cast("int").alias("start"), (i * 10 + i % 8 + 5).cast("int").alias("end"))
    return want, score.verdicts(truth, plan, ["doc_id"])


def test_types_to_strip_of_a_crowded_document(crowded):
    assert {r["type"] for r in in_time(score.strip_types(crowded[1]))} == {"A", "B"}


def test_scores_of_a_crowded_document(crowded):
    want, out = crowded
    assert sorted(map(tuple, in_time(out.select("n", "type", "covered", "verdict")))) == want


def test_scores_with_many_spans_equal_those_one_by_one(spark, monkeypatch):
    """Overlapping, empty and backward spans, bounds that are null, numbers of spans about the powers of two."""
    rng, truth, plan = random.Random(3), [], []
    some = lambda v: None if rng.random() < 0.06 else v
    for d in (None, *range(40)):
        for rows, k in ((truth, 12), (plan, d or 0)):
            for _ in range(k):
                s = rng.randrange(-20, 150)
                rows.append((some(d), some(s), some(s + rng.randrange(-2, 30)), len(rows)))
    names = "doc_id long, start int, end int, n int"
    t, p = spark.createDataFrame(truth, names).withColumn("strip_expected", F.lit(True)), spark.createDataFrame(plan, names)
    got = []
    for few in (-1, 1, 32, 99):
        monkeypatch.setattr(score, "FEW", few)
        got.append(sorted((r["n"], str(r["covered"]), r["verdict"]) for r in score.verdicts(t, p, ["doc_id"]).collect()))
    assert len(got[0]) == len(truth) and got[0] == got[1] == got[2] == got[3]

    def alone(s, e, d):
        low = lambda *v: min((x for x in v if x is not None), default=None)
        high = lambda *v: max((x for x in v if x is not None), default=None)
        met = [(high(s, x), low(e, y)) for q, x, y, _ in plan if q == d and d is not None]
        touched = sum(y - x for x, y in met if x is not None and y is not None and x < y)
        return touched or (0 if s is None or e is None else e - s)

    assert [(n, str(alone(s, e, d))) for d, s, e, n in truth] == [x[:2] for x in got[0]]


def test_pivot_of_a_crowded_document(crowded):
    want, out = crowded
    counts = Counter((kind, v) for _, kind, _, v in want)
    assert {(r["type"], v): r[v] for r in in_time(score.verdict_pivot(out)) for v in score.VERDICTS if r[v]} == counts


def test_search_all_ranks_as_pairs_do(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.integers(-2, 3, (300, 3)).astype("f4"))]  # many ties, some of no length
    rows += [(300, None), (301, []), (302, [1.0, None, 2.0]), (303, [1.0, 2.0]), (304, [float("nan"), 1.0, 0.0]), (305, [0.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = e.where("id % 20 = 0 or id >= 300").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    met = e.crossJoin(q).withColumn("relevance", search.cosine(F.col("embedding"), F.col("q")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc_nulls_last(), "id"))
    plain = lambda df: sorted((r["query_id"], r["rank"], r["id"], str(r["relevance"])) for r in df.collect())
    for k in (1, 5):
        want = plain(met.withColumn("rank", rank).where(F.col("rank") <= k))
        assert plain(search.search_all(e, q, k, block=64)) == want and plain(search.search_all(e, q, k)) == want


def test_blocks_are_assigned_in_one_sort(spark):
    box = "struct<left:int,top:int,width:int,height:int>"
    lines = [(p, i, (x, y, 10, 10)) for p in (1, 2) for i, (x, y) in enumerate([(0, 0), (95, 0), (500, 0), (45, 0), (600, 0)])] + [(3, 0, (0, 0, 9, 9)), (None, 0, (0, 0, 9, 9))]
    blocks = [(1, 7, 0, (0, 0, 50, 50)), (1, 8, 1, (40, 0, 60, 50)), (2, 5, 1, (0, 0, 50, 50)), (2, 6, 0, (0, 0, 50, 50)), (4, 1, 0, (0, 0, 9, 9))]
    out = layout.assign_blocks(spark.createDataFrame(lines, f"page int, line int, box {box}"), spark.createDataFrame(blocks, f"page int, block_id int, block_order int, box {box}"), ["page"])
    want = {(1, 0): (7, False), (1, 1): (8, False), (1, 2): (2, True), (1, 3): (7, False), (1, 4): (3, True), (2, 0): (6, False), (2, 1): (2, True), (2, 2): (3, True), (2, 3): (6, False), (2, 4): (4, True), (3, 0): (0, True), (None, 0): (0, True)}
    assert {(r["page"], r["line"]): (r["block_id"], r["synthetic"]) for r in out.collect()} == want and out.count() == len(want)
    assert "Join " not in plan_of(out)


def test_round_trip_gives_every_text_back(spark, tmp_path):
    texts = ["jo@x.com and JO@x.com, Jo@X.com", "EMAIL_1 is jo@x.com_y", "a@b_c@d é", "EMAIL_1, EMAIL_9 and é", "énil@x.comé EMAIL_2", "", None, "jo@x.com and JO@x.com, Jo@X.com"]
    rows = [(7 if i < 3 else None, x) for i, x in enumerate(texts)]  # ids repeat or lack
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["body"]) for r in QUERIES["rehydrate"](spark, str(tmp_path)).collect())
    assert got == Counter((i, x if x is None else hashlib.md5(x.encode()).hexdigest()) for i, x in rows)
