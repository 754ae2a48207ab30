"""Stores, page JSON, parsed pages and proposals of models, each held against a plain restatement or a round trip."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from docspark.functions import text
from docspark.operators import entities, pseudonyms, score, search, spans, tree
from docspark.sources import files, pages, plugins, stores

VECTORS = "doc_id string, id string, pos int, len int, embedding array<float>, batch string"


def vectors(spark, rows):
    return spark.createDataFrame([(d, i, 0, 1, [1.0, 2.0], "clash") for d, i in rows], VECTORS)


def test_vector_store_adds_each_document_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    docs = spark.createDataFrame([("a",), ("b",), (None,), ("empty",), ("a",)], "doc_id string")
    assert stores.missing(docs, path).count() == 5 and stores.read_vectors(spark, path).count() == 0
    first = stores.add_vectors(vectors(spark, [("a", "0#0"), ("a", "0#1"), ("b", "0#0"), (None, "0#0")]), path, docs)
    assert sorted((r["doc_id"] or "", r["chunks"]) for r in first.collect()) == [("", 1), ("a", 2), ("b", 1), ("empty", 0)]
    assert stores.missing(docs, path).count() == 0
    again = stores.add_vectors(vectors(spark, [("a", "0#9"), ("c", "0#0"), (None, "0#7")]), path)
    assert [(r["doc_id"], r["chunks"]) for r in again.collect()] == [("c", 1)]
    assert sorted((r["doc_id"] or "", r["id"]) for r in stores.read_vectors(spark, path).collect()) == [("", "0#0"), ("a", "0#0"), ("a", "0#1"), ("b", "0#0"), ("c", "0#0")]
    some = stores.read_vectors(spark, path, ["a", "nowhere"])
    assert sorted(r["id"] for r in some.collect()) == ["0#0", "0#1"]
    assert stores.add_vectors(vectors(spark, []), path).count() == 0


def test_vectors_of_a_broken_run_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    stores.add_vectors(vectors(spark, [("a", "0#0")]), path)
    spark.read.parquet(f"{path}/vectors").withColumn("batch", F.lit("broken")).write.mode("append").partitionBy("bucket").parquet(f"{path}/vectors")
    assert stores.read_vectors(spark, path).count() == 1


def test_trees_go_through_json(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for d in range(20):
        n = rng.randrange(1, 30)
        place: dict = {}
        for i in range(n):
            parent = None if i == 0 else rng.randrange(i)
            ordinal = place[parent] = place.get(parent, -1) + 1
            rows.append((f"d{d}", i, parent, -1 if i == 0 else 0, f"H{i} \"é\"", "t\n" * (i % 3), i, 0.5 * i, 2.0, ordinal))
    nodes = spark.createDataFrame(rows, f"doc_id string, {stores.NODES}")
    back = stores.tree_from_json(stores.tree_to_json(nodes, ["doc_id"]), ["doc_id"])
    assert {tuple(r)[:-1] for r in back.collect()} == set(rows) and back.where("error IS NOT NULL").count() == 0
    one = json.loads(stores.tree_to_json(nodes.where("doc_id = 'd1'"), ["doc_id"]).first()["json"])
    assert list(one)[:6] == ["name", "level", "header", "text", "page", "position"] and one["name"] == "0"
    odd = spark.createDataFrame([("x", None), ("y", "{"), ("z", '{"name": "r", "level": -1, "header": "", "text": "", "page": 0}')], "doc_id string, json string")
    got = {r["doc_id"]: r for r in stores.tree_from_json(odd, ["doc_id"]).collect()}
    assert set(got) == {"y", "z"} and got["y"]["error"] and got["z"]["node_id"] == 0 and got["z"]["x"] == 0.0
    path = f"file://{tmp_path}/trees"
    assert stores.load_trees(spark, path, "doc_id string").count() == 0
    assert stores.save_trees(nodes.where("doc_id < 'd2'"), ["doc_id"], path).count() > 0
    assert stores.save_trees(nodes, ["doc_id"], path).where("doc_id < 'd2'").count() == 0
    assert {tuple(r)[:-1] for r in stores.load_trees(spark, path, "doc_id string").collect()} == set(rows)
    assert tree.tree_paths(back.drop("error"), ["doc_id"]).count() == len(rows)


def test_maps_are_saved_and_extended(spark, tmp_path):
    path = f"file://{tmp_path}/maps"
    assert stores.load_map(spark, path).count() == 0
    mention = lambda *v: spark.createDataFrame([("s", "PERSON", x, i) for i, x in enumerate(v)], "scope string, entity_type string, value string, at int")
    stores.save_map(pseudonyms.allocate(mention("Ann", "Bob"), ["at"]), path)
    longer = pseudonyms.allocate(mention("Cy", "bob"), ["at"], stores.load_map(spark, path))
    assert stores.save_map(longer, path).endswith("version=2")
    assert {(r["surface"], r["placeholder"]) for r in stores.load_map(spark, path).collect()} == {("Ann", "PERSON_1"), ("Bob", "PERSON_2"), ("Cy", "PERSON_3")}
    with pytest.raises(ValueError):
        stores.save_map(longer, None)


def test_results_are_appended_once(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    make = lambda *k: spark.createDataFrame([(x, x * 2) for x in k], "k int, v int")
    assert files.append_results(make(1, 2), path, ["k"]).count() == 2
    assert [r["k"] for r in files.append_results(make(2, 3), path, ["k"]).collect()] == [3]
    assert sorted(r["k"] for r in spark.read.json(path).collect()) == [1, 2, 3]


def test_pages_go_through_json(spark):
    frame = (100, 200, 1, None, "scan.png", "stub", None)
    word = ("a", (1, 2, 3, 4), None)
    rows = [(1, (frame, [(0, "text", "model", (1, 2, 3, 4), 0, 0, None), (1, "text", "synthetic", (5, 6, 7, 8), 1, 0, 0.5)], [("a \"b\"", (1, 2, 3, 4), 0, 0.9, [word, ("b", (5, 2, 3, 4), (4, 1, 5, 6))])])), (2, (frame, [], [])), (3, None)]
    df = spark.createDataFrame(rows, f"id int, page {pages.PAGE}")
    made = df.withColumn("json", pages.page_to_json(F.col("page")))
    got = {r["id"]: r for r in made.withColumn("back", pages.page_from_json(F.col("json"))).collect()}
    assert all(r["back"] == r["page"] for r in got.values()) and got[3]["json"] is None
    plain = json.loads(got[1]["json"])
    assert plain["blocks"][1]["box"] == [5, 6, 7, 8] and plain["lines"][0]["words"][0]["region_box"] is None and plain["frame"]["dpi"] is None
    assert spark.createDataFrame([("{",), ("{}",)], "j string").select(pages.page_from_json(F.col("j")).alias("p")).where("p IS NOT NULL").count() == 0


def test_parsed_pages(spark):
    def parser(content):
        for n, t in enumerate(content.decode().split()):
            if t == "bad":
                raise ValueError("no span")
            yield (n, 0, 0, 0, 12.0, 16, 0, t, 0.0, 0.0, 1.0, 1.0)

    df = spark.createDataFrame([("a", b"x y"), ("b", b"z bad"), ("c", None), ("d", b"wrong")], "path string, content binary")
    got = sorted((r["path"], r["text"] or "", r["sz"] or 0, r["error"] is None) for r in pages.parse_spans(df, parser).collect())
    assert got == [("a", "x", 1203, True), ("a", "y", 1203, True), ("b", "", 0, False), ("b", "z", 1203, True), ("d", "wrong", 1203, True)]
    counts = pages.page_counts(df, lambda c: len(c.split()))
    assert {r["path"]: r["pages"] for r in counts.collect()} == {"a": 2, "b": 2, "c": 0, "d": 1}
    wrong = plugins.per_row(df, "content", lambda c: iter([("text",)]), "n int", ["path"])
    assert wrong.where("n IS NULL AND error IS NOT NULL").count() == 4
    images = spark.createDataFrame([("a", 1, b"p"), ("a", 2, b"q"), ("b", 1, None)], "path string, page_no int, image binary")
    made = pages.transform_pages(images, lambda n, image: image * n)
    assert sorted((r["path"], r["page_no"] or 0, bytes(r["image"] or b"")) for r in made.collect()) == [("a", 1, b"p"), ("a", 2, b"qq"), ("b", 0, b"")]
    assert [r["page_no"] for r in pages.transform_pages(images, lambda n, image: image, {2}).collect()] == [2]
    assert pages.select_pages(images).count() == 3 and pages.select_pages(images, set()).count() == 0
    assert {r["path"]: (r["done"], r["pages"]) for r in pages.progress(made, counts).collect()} == {"a": (2, 2), "b": (0, 2), "c": (0, 0), "d": (0, 1)}


def test_boxes_that_paint_nothing_are_counted(spark):
    data = [(1, "A", (5, 5, 10, 10), 50, 50), (1, "B", (90, 5, 10, 10), 50, 50), (1, "B", (5, 5, -20, 10), 50, 50), (2, "C", None, 50, 50)]
    kept, lost = pages.paintable(spark.createDataFrame(data, f"page int, label string, box {pages.BOX}, width int, height int"), ["page"])
    assert [r["label"] for r in kept.collect()] == ["A"]
    assert {(r["page"], r["label"], r["skipped"]) for r in lost.collect()} == {(1, "B", 2), (2, "C", 1)}
    pixels = [(1, x, y, 7 if x == 0 or y in (0, 3) else 9, 5, 4) for x in range(5) for y in range(4)]
    assert pages.background(spark.createDataFrame(pixels, "page int, x int, y int, colour int, width int, height int"), ["page"]).first()["colour"] == 7


def test_proposals_are_checked_and_joined(spark):
    said = "Dr Olga Kulik met KULIK OLGA. AFSL 123456 TFN 123 456 782, bad 123 456 789. 5 High St, NEWTOWN NSW 2042"

    def model(texts, labels, threshold):
        named = {"person": [("Olga Kulik", 0.9)], "driver licence number": [("123456", 0.8)], "tax file number": [("123 456 782", 0.7), ("123 456 789", 0.7), ("12", 0.9)], "street address": [("5 High St", 0.35)], "suburb state postcode": [("NEWTOWN NSW 2042", 0.5)], "address": [("5 High St", 0.6)]}
        return [[(k, s, p) for k in labels for s, p in named.get(k, []) if p >= threshold and s in t] for t in texts]

    df = spark.createDataFrame([(1, said), (None, None), (1, " "), (1, said)], "doc_id int, text string")
    found = [[(x["entity_type"], said[x["start"] : x["end"]], x["score"]) for x in r["spans"]] for r in entities.recognize_with_model(df, model).collect()]
    want = [("PERSON", "Dr Olga Kulik", 0.9), ("PERSON", "KULIK OLGA", 0.9), ("AU_TFN", "123 456 782", 0.7), ("AU_TFN_INVALID", "123 456 789", 0.7), ("ADDRESS", "5 High St, NEWTOWN NSW 2042", 0.6)]
    assert sorted(map(len, found)) == [0, 0, 5, 5] and all(f in ([], want) for f in found)
    strict = entities.recognize_with_model(df.limit(1), model, wanted=["AU_TFN_INVALID"]).first()["spans"]
    assert [x["entity_type"] for x in strict] == ["AU_TFN_INVALID"]
    assert not entities.recognize_with_model(df.limit(1), model, wanted=["AU_TFN_INVALID"], demote=False).first()["spans"]


def test_repeats_inside_their_class_go(spark):
    rng = random.Random(9)
    rows = []
    for d in range(60):
        for _ in range(rng.randrange(1, 12)):
            a = rng.randrange(0, 12)
            rows.append((d if d else None, rng.choice("XY"), a, a + rng.randrange(1, 8), rng.choice([0.0, 0.3, 0.5]), "r"))
    want = []
    for d in {r[0] for r in rows}:
        kept: list = []
        for r in sorted({r for r in rows if r[0] == d and r[4] > 0}, key=lambda r: (-r[4], r[2], r[2] - r[3])):
            if not any(k[1] == r[1] and k[2] <= r[2] and r[3] <= k[3] for k in kept):
                kept.append(r)
        want += kept
    df = spark.createDataFrame(rows, "doc_id int, entity_type string, start int, `end` int, score double, recognizer string")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, map(tuple, spans.drop_repeats(df, ["doc_id"]).collect()))) == sorted(map(key, want))


def test_survival_is_split_by_expectation(spark):
    rows = [("P", "stripped", None, True), ("P", "leaked", "fuzzy", True), ("P", "leaked", "exact", True), ("P", "kept", "exact", False), ("O", "over-stripped", None, False)]
    go, stay = score.survival(spark.createDataFrame(rows, "type string, verdict string, match string, strip_expected boolean"))
    assert [tuple(r) for r in go.collect()] == [("P", 1, 2, 1, 3, 1 / 3)]
    assert {tuple(r) for r in stay.collect()} == {("P", 1, 0, 1), ("O", 0, 1, 1)}
    truth = spark.createDataFrame([("a.txt", "P"), ("b.txt", "O")], "file string, type string")
    renders = spark.createDataFrame([("a1.png", "a.txt"), ("a2.png", "a.txt")], "file string, source string")
    assert {(r["file"], r["type"]) for r in score.rendered_truth(renders, truth).collect()} == {("a1.png", "P"), ("a2.png", "P")}


def test_matches_and_splices_of_any_length(spark):
    import re

    texts = ["", "no", "12", "é1 22 😀 333", "".join(f"x{i} " for i in range(3000)), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("m", text.matches(F.col("t"), "[0-9]+"))
    parts = F.transform("m", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("<N>").alias("placeholder")))
    for r in df.withColumn("s", pseudonyms.splice(F.col("t"), parts)).collect():
        t = texts[r["i"]]
        assert [(m["start"], m["end"], m["value"]) for m in r["m"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", t or "")]
        assert r["s"] == (None if t is None else re.sub("[0-9]+", "<N>", t))


def test_embedder_over_http(spark):
    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            body = json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(texts)))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([("abc",), ("",), ("abcde",)], "text string")
    got = {r["text"]: r["embedding"] for r in search.embed(df, search.HttpEmbedder(f"http://127.0.0.1:{server.server_port}/embeddings"), batch=2).collect()}
    server.shutdown()
    assert got == {"abc": [3.0, 1.0], "": [0.0, 1.0], "abcde": [5.0, 1.0]}
