"""Rules held against plain restatements of them."""

import random

from pyspark.sql import functions as F

from docspark.functions import checksum, text
from docspark.operators import align, layout, tree


def test_rows_join_the_last_row_only(spark):
    rng = random.Random(3)
    data = []
    for page in range(300):
        data += [(page, i, rng.randrange(0, 120), rng.randrange(0, 60), rng.randrange(5, 60), rng.randrange(4, 30)) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(data, "page int, idx int, left int, top int, width int, height int")
    for mode in ("halfway", "mean"):
        got = {(r["page"], r["idx"]): r["row"] for r in layout.visual_rows(df, ["page"], mode).collect()}
        for page in range(300):
            own = sorted((r for r in data if r[0] == page), key=lambda r: (r[3] + r[5] / 2, r[2]))
            row, centre, tall, held = -1, 0.0, 0, []
            for _, idx, left, top, width, height in own:
                c = top + height / 2
                joins = row >= 0 and abs(c - centre) < 0.5 * max(height, tall, 1)
                if joins and mode == "halfway":
                    joins = all(min(left + width, b + w) - max(left, b) <= 0.3 * min(width, w) for b, w in held)
                if joins:
                    held.append((left, width))
                    centre += (c - centre) / (2 if mode == "halfway" else len(held))
                    tall = max(tall, height)
                else:
                    row, centre, tall, held = row + 1, c, height, [(left, width)]
                assert got[page, idx] == row


def test_business_numbers(spark):
    rng = random.Random(4)
    values = [f"{rng.randrange(10**11):011d}" for _ in range(3000)] + [f"0{rng.randrange(10**10):010d}" for _ in range(3000)]

    def valid(v):
        n = [int(c) for c in v]
        n[0] = n[0] - 1 if n[0] else 9
        return sum(a * b for a, b in zip(n, checksum.ABN, strict=True)) % 89 == 0

    got = {r["v"]: r["ok"] for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", checksum.abn_valid(F.col("v")).alias("ok")).collect()}
    assert got == {v: valid(v) for v in values} and any(got[v] for v in values[3000:])


def test_error_buckets_agree(spark):
    signs = ["", " ", "a", "A", "b", "é", "É", "1", "2", "-", ".", "\t"]
    pairs = [(a, b) for a in signs for b in signs if a != b]
    got = {(r["a"], r["b"]): r["k"] for r in spark.createDataFrame(pairs, "a string, b string").withColumn("k", text.error_bucket(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b): align.error_bucket(a, b) for a, b in pairs}
    for (a, b), k in {("a", " "): "split", (" ", "1"): "merge", (" ", ""): "merge", ("", " "): "split", ("é", "É"): "sub_case", ("1", "2"): "sub_digit_digit", ("1", "a"): "sub_digit_alpha", ("-", "1"): "sub_other", ("a", "b"): "sub_alpha", ("", "."): "ins_other", ("A", ""): "del_alpha"}.items():
        assert got[a, b] == k


def test_glyphs(spark):
    said = " a •b●c–d·e\x07f\x08g\th\n—▪\x0c"
    assert spark.createDataFrame([(said,)], "t string").select(text.sanitize_glyphs(F.col("t"))).first()[0] == "- a -b-c-d-efg  h\n—▪\x0c"


def test_headers_over_blank_text_stay_apart(spark):
    pieces = [("d", 0, 0, "A"), ("d", 1, 0, "B"), ("d", 2, None, " \n"), ("d", 3, 0, "C"), ("d", 4, None, " text ")]
    df = spark.createDataFrame([(*p, 0, 0.0, 0.0) for p in pieces], "doc string, ord int, level int, text string, page int, x double, y double")
    got = [(r["header"], r["text"]) for r in sorted(tree.build_tree(df, ["doc"]).collect(), key=lambda r: r["node_id"])]
    assert got == [("", ""), ("A B C", "text")]
    nodes = tree.build_tree(df.where("ord <> 2"), ["doc"]).collect()
    assert [r["header"] for r in sorted(nodes, key=lambda r: r["node_id"])] == ["", "A B C"]


def test_chunk_offsets(spark):
    words = [f" w{i}" * (i % 3 + 1) for i in range(997)]
    whole = "".join(words) + "  "
    got = tree.chunks(spark.createDataFrame([("x", whole), ("y", " "), ("z", None), ("x", "a b")], "id string, text string"), "text", 50, 10).collect()
    long = sorted((r for r in got if r["text"] == whole), key=lambda r: r["split"])
    for r in long:
        assert whole[r["pos"] : r["pos"] + r["len"]] == r["chunk"]
    assert [r["split"] for r in long] == list(range(len(long))) and {r["id"] for r in got} == {"x"} and long[-1]["chunk"] == whole.rstrip()[long[-1]["pos"] :]
