"""Each operator against brute force on small tables with odd rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docspark.llm import chat, components, gif, lines, mixing, packing, quality, simhash, topk, toxicity, urls
from docspark.llm.labelled import held_out, training_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- 1: GIF ----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)) * 40, b"\0" * 200_000, np.random.default_rng(1).bytes(64 * 1100), "häßlich ".encode() * 9000])
def test_gif_round_trip(data):
    payload = gif.padded(data)
    media = gif.encode(payload)
    assert b"".join(f.indices for f in gif.frames(media)) == payload
    assert len(list(gif.frames(media))) == -(-len(payload) // 65536)


def test_gif_query_matches_hashes(odd_docs):
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows(gif.read_payloads(gif.store_texts(odd_docs))))
    want = Counter()
    for r in odd_docs.collect():
        b = (r.text or "").encode()
        p = gif.padded(b)
        want[r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == want


def small_gif(frames, width=2, height=2, palette=(b"\x00\x00\x00", b"\xff\x00\x00", b"\x00\xff\x00", b"\x00\x00\xff")):
    """frames: (indices, disposal, transparent or None, delay, interlaced)."""
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + b"".join(palette)
    for data, disposal, transparent, delay, interlaced in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0x40 if interlaced else 0) + b"\x02"
        bits, n = 0, 0
        for c in [4, *[x for i in data for x in (i, 4)][:-1], 5]:  # three-bit codes, cleared after each sample
            bits |= c << n
            n += 3
        stream = bits.to_bytes(-(-n // 8), "little")
        out += bytes([len(stream)]) + stream + b"\0"
    return out + b";"


def test_gif_disposal_transparency_interlace_and_time(spark):
    media = small_gif([([1, 1, 1, 1], 1, None, 5, False), ([2, 0, 0, 2], 3, 0, 7, False), ([0, 3, 0, 0], 2, 0, 1, False), ([0, 0, 0, 2], 0, 0, 1, False)])
    f = list(gif.frames(media))
    colour = lambda k: [tuple(p[:3]) if p[3] else None for p in f[k].screen.reshape(-1, 4).tolist()]
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    assert colour(0) == [red] * 4
    assert colour(1) == [green, red, red, green]
    assert colour(2) == [red, blue, red, red]  # frame 1 was undone
    assert colour(3) == [None, None, None, green]  # frame 2 was cleared
    assert [x.delay_ms for x in f] == [50, 70, 10, 10]
    tall = small_gif([([1, 2, 3, 1, 2, 3, 1, 2], 0, None, 0, True)], 1, 8)
    straight = next(gif.frames(tall)).indices
    assert [straight[i] for i in (0, 4, 2, 6, 1, 3, 5, 7)] == [1, 2, 3, 1, 2, 3, 1, 2]
    df = spark.createDataFrame([(1, media), (2, None), (3, b"junk"), (4, media[:40])], "doc_id int, media binary")
    got = rows(gif.gif_frames(df))
    assert [(r["frame"], r["start_ms"]) for r in got if r["doc_id"] == 1] == [(0, 0), (1, 50), (2, 120), (3, 130)]
    assert sum(r["colours"][48] for r in got if r["doc_id"] == 1) == 4 + 2 + 3
    assert not [r for r in got if r["doc_id"] == 2] and next(r for r in got if r["doc_id"] == 3)["error"]
    assert [(r["frame"], r["error"] is None) for r in got if r["doc_id"] == 4] == [(None, False)]


def test_gif_faults_are_rows(spark):
    whole = gif.encode(bytes(range(256)) * 300)  # two frames
    huge = whole[:6] + struct.pack("<HH", 65535, 65535) + whole[10:]
    wide = small_gif([([1, 1, 1, 1], 1, None, 5, False)])
    at = wide.index(b"\x2c\0\0\0\0\x02\0\x02\0")
    tall = wide[: at + 7] + struct.pack("<H", 3) + wide[at + 9 :]  # three lines claimed, two there
    code = wide[: at + 10] + b"\x0b" + wide[at + 11 :]
    cases = [(0, whole, 2, False), (1, whole[:-1], 2, True), (2, whole[:-400], 1, True), (3, huge, 0, True), (4, tall, 0, True), (5, code, 0, True), (6, whole[:500], 0, True), (7, wide, 1, False), (8, b"", 0, False)]
    got = rows(gif.gif_frames(spark.createDataFrame([(i, m) for i, m, _, _ in cases], "doc_id int, media binary")))
    assert [(i, sum(r["frame"] is not None for r in got if r["doc_id"] == i), any(r["error"] for r in got if r["doc_id"] == i)) for i, *_ in cases] == [(i, n, e) for i, _, n, e in cases]


def test_gif_stored_form_and_feature(odd_docs):
    stored = gif.store_texts(odd_docs)
    media = {(r["doc_id"], bytes(r["media"])) for r in rows(stored)}
    got = rows(gif.read_payloads(stored))
    assert {(r["doc_id"], r["media_bytes"], r["media_sha256"]) for r in got} == {(i, len(m), hashlib.sha256(m).hexdigest()) for i, m in media}
    by_sha = {hashlib.sha256(m).hexdigest(): m for _, m in media}
    for r in got:
        counts, shown = Counter(), b""
        for f in gif.frames(by_sha[r["media_sha256"]]):
            shown = f.indices + shown[len(f.indices) :]  # a shorter last frame leaves the rest of the screen as it was
            counts.update((b >> 6) * 21 for b in shown)
        assert r["feature"] == f"{r['frames']} frames; colours {' '.join(f'{c}:{counts[c]}' for c in sorted(counts))} of {sum(counts.values())}"


# --- 2: top-k --------------------------------------------------------------------------------------------------------

def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, rng.uniform(0.05, 1), 16).astype("f4").tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(60)] + [(40, vectors[7][1]), (40, vectors[40][1])]
    vectors += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 16), (503, [float("inf")] * 16), (504, [1.0, 2.0]), (None, vectors[3][1]), (520, [])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in vectors], "vec_id long, embedding array<float>, score string, qb string")
    got = rows(topk.top_inner_products(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))))
    ok = [(i, np.floor(np.array(v, float) * 64).astype(int)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for k, (i, q) in enumerate(ok):
        if i is not None and i % 20 == 0:
            s = sorted((-int(q[: len(v)] @ v[: len(q)]), 2**62 if j is None else j) for n, (j, v) in enumerate(ok) if n != k)[:20]
            want.update((i, r + 1, None if j == 2**62 else j, -x) for r, (x, j) in enumerate(s))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


@pytest.mark.parametrize("size", [64, 1024])
def test_scan_prunes_nothing_that_counts(size):
    rng = np.random.default_rng(8)
    v = rng.normal(0, 1, (6 * size, 32)) * np.sort(rng.uniform(0.2, 1, 6 * size))[::-1, None]
    v = np.floor(64 * v / np.linalg.norm(v, axis=1).mean()).astype(np.int64)
    v = v[np.argsort(-np.linalg.norm(v, axis=1), kind="stable")]
    ids = rng.permutation(len(v))
    found = [(float(np.linalg.norm(v[i : i + size], axis=1).max()), ids[i : i + size], v[i : i + size]) for i in range(0, len(v), size)]
    query = v[rng.choice(len(v), 40, replace=False)]
    rotation = np.linalg.svd((v.T @ v).astype(float))[0]
    scores, got = topk.scan(query, found, rotation, 21)
    products = query @ v.T
    for q, row in enumerate(products):
        best = np.lexsort((ids, -row))[:21]
        assert scores[q].tolist() == row[best].tolist() and got[q].tolist() == ids[best].tolist()


@pytest.mark.parametrize("alike", [False, True])
def test_topk_of_many_runs(spark, alike):
    rng = np.random.default_rng(9)
    v = rng.normal(0, 1, (9000, 12))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v = (v if alike else v * rng.uniform(0.05, 3, 9000)[:, None] ** 2).astype("f4")
    v[4000:5000] = v[4000]  # a third of a block and more of one vector
    df = spark.createDataFrame([(i if i != 40 else None, x.tolist(), i) for i, x in enumerate(v)], "vec_id long, embedding array<float>, n int").repartition(5)
    got = rows(topk.top_inner_products(df, F.col("n") % 20 == 0, run=1500))
    m = np.floor(v.astype(float) * 64).astype(int)
    ids = np.array([2**62 if i == 40 else i for i in range(9000)])
    want = set()
    for q in range(0, 9000, 20):
        s = m @ m[q]
        s[q] = -(2**40)
        want.update((None if q == 40 else q, r + 1, None if j == 40 else int(j), int(s[j])) for r, j in enumerate(np.lexsort((ids, -s))[:20]))
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == 450 * 20


def test_topk_moves_in_proportion(spark):
    rng = np.random.default_rng(10)
    moved = []
    for n in (40_000, 80_000):
        blocks = spark.range(n // 1024).select(F.col("id").alias("block"), F.col("id").alias("ids"), F.lit(b"").alias("m"), (2 - F.col("id") / (n // 1024)).alias("longest"), F.floor(F.col("id") / 16).alias("run"))
        queries = spark.range(n // 20 // 1024 + 1).select(F.lit(0).cast("long").alias("grp"), *[F.col("id").alias(c) for c in ("keys", "ids", "own", "least", "m")], F.lit(float(rng.uniform(0, 0.1))).alias("need"))
        moved.append([x.count() for x in topk.tiles(blocks, queries)])
        assert moved[-1] == [(n // 20 // 1024 + 1) * -(-(n // 1024) // 16), n // 1024]
    near = [x.count() for x in topk.tiles(blocks, queries.withColumn("need", F.lit(1.9)))]
    assert near[1] < moved[1][1] / 4 and near[0] < moved[1][0] / 2  # short vectors stay where they are


def test_topk_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e9, 1.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64-bit"):
        topk.top_inner_products(df, F.col("vec_id") == 0)


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rows(topk.top_inner_products(df, F.col("vec_id") % 20 == 0)) == []


# --- 3: chat ---------------------------------------------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\|im_end|>x<|im_end|>", "[[INST]]", "\\", "", None, "$1 \\1", "<s<s>", "plain\nlines"]


def test_chat_round_trip_and_masks(spark):
    data = [(c, i, r, t) for c in (1, 2, None) for i, (r, t) in enumerate([("user", t) if k % 2 == 0 else ("assistant", t) for k, t in enumerate(NASTY * 2)])]
    data += [(3, None, "assistant", "b"), (3, None, "assistant", "a"), (4, 0, None, "x"), (4, 0, None, "x"), (5, 1, "assi<s>stant", "q")]
    df = spark.createDataFrame([(*x, 1) for x in data], "conv_id long, turn long, role string, text string, seq int")
    turns = chat.format_turns(df)
    got = {r["conv_id"]: r for r in rows(chat.read_back(turns))}
    by = defaultdict(list)
    for c, i, r, t in data:
        by[c].append((-1 if i is None else i, r or "", t or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = rows(chat.example_texts(turns.where("conv_id = 1")))
    assert len(texts) == 10
    for r in texts:
        target = r["text"][r["target_start"] : r["target_end"]]
        assert chat.unescape(target) == by[1][r["seq"] - 1][2] and r["text"].endswith(target)
        assert not re.search(r"</?s>|\[/?INST\]", r["text"])


def test_chat_masks_come_from_the_examples(spark, monkeypatch):
    data = [(c, i, "user" if i % 2 == 0 else "assistant", f"turn {i} of {c}") for c in (1, 2) for i in range(6)]
    turns = chat.format_turns(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    own = chat.prefix_targets
    monkeypatch.setattr(chat, "prefix_targets", lambda turns: own(turns).where("example = 1"))
    for r in rows(chat.read_back(turns)):
        learned = f"turn 3 of {r['conv_id']}"
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (6, len(learned), hashlib.sha256(learned.encode()).hexdigest())


@pytest.mark.parametrize("part", [1, 7, 64, 65536])
def test_chat_is_parsed_wherever_it_is_cut(spark, part):
    data = [(c, i, r, t) for c in (1, None) for i, (r, t) in enumerate(("assistant" if k % 3 else "us<|im_sep|>er", t) for k, t in enumerate(NASTY * 2))] + [(2, i, "assistant", "") for i in range(50)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(7)
    turns = chat.format_turns(df)
    assert sum(len(r["text"]) for r in rows(chat.conversation_texts(turns, part))) == sum(len(r["segment"]) for r in rows(turns))
    for r in rows(chat.read_back(turns, part)):
        own = [(x, t or "") for c, _, x, t in data if c == r["conv_id"]]
        loss = "".join(t for x, t in own if x == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x}\n{t}\n" for x, t in own).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [r["example"] for r in sorted(rows(chat.prefix_targets(turns)), key=lambda r: r["seq"]) if r["conv_id"] == 2] == list(range(50))


def test_chat_refuses_what_does_not_parse():
    for text in ("<|im_start|>user<|im_sep|>x", "x<|im_end|>", "<|im_start|>user x<|im_end|>"):
        with pytest.raises(ValueError):
            r = chat.Reader()
            r.read(text)
            r.digests()


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows(chat.read_back(chat.format_turns(df))) == []


# --- 4: mixing -------------------------------------------------------------------------------------------------------

def test_mixing_limits_and_targets(odd_docs):
    parts = mixing.mix_sources(odd_docs, block_words=7)
    got = rows(mixing.taken_words(*parts))
    assert len(got) == odd_docs.count()
    by, target, size = Counter(), {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    for s, x in target.items():
        assert abs(by[s] - x) <= 1 and x <= 2 * size[s] + 1e-6
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert sorted(got, key=repr) == sorted(rows(mixing.taken_words(*mixing.mix_sources(odd_docs.repartition(3), block_words=7))), key=repr)


def test_mixing_weights_reshare(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 1000), ("d", 1)])], "doc_id long, text string, source string")
    got = {r["source"]: r for r in rows(mixing.taken_words(*mixing.mix_sources(docs, block_words=16)))}
    # weights 3, 1, 2, 3 of 3016.5; a and d stop at 20 and 2, and of the rest b and c get 1 : 2, within their 2000
    assert {s: round(r["target"], 3) for s, r in got.items()} == {"a": 20, "b": 998.167, "c": 1996.333, "d": 2}
    assert {s: r["taken"] for s, r in got.items()} == {"a": 20, "b": 998, "c": 1996, "d": 2}


def test_mixing_schedule_is_low_discrepancy(spark):
    docs = spark.createDataFrame([(i, "w " * 200, f"s{i % 3}") for i in range(90)], "doc_id long, text string, source string")
    sources, slots, _ = mixing.mix_sources(docs, block_words=50)
    share = {r["sid"]: r["high"] - r["low"] for r in rows(sources)}
    seen = Counter()
    for n, r in enumerate(sorted(rows(slots), key=lambda r: r["slot"]), 1):
        seen[r["sid"]] += 1
        assert all(abs(seen[s] - n * p) < 6 for s, p in share.items())


def test_mixing_empty(no_docs, spark):
    assert rows(mixing.taken_words(*mixing.mix_sources(no_docs))) == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in rows(mixing.taken_words(*mixing.mix_sources(blank)))] == [(0, 0.0, 0)] * 2


# --- 5 and 6: classifiers --------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    syllables = ["ta", "re", "mi", "so", "lun", "ker", "vo", "pa", "ni", "du"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    data, labels = [], []
    for i in range(900):
        ws = [word() for _ in range(int(rng.integers(20, 200)))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            ws.insert(int(rng.integers(0, len(ws))), str(rng.choice(["grumblefitz", "snorkwit", "blarghead"])))
        text = " ".join(ws)
        if not good:
            text = " ".join(w + "!!" for w in text.upper().split())
        data.append((i, text))
        labels.append((i, good, toxic))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")


def accuracy(scored, labels, name, threshold):
    met = scored.join(labels, "doc_id").where(held_out(F.col("doc_id")) & F.col(name).isNotNull())
    return met.select(F.avg(((F.col("score") >= threshold).cast("int") == F.col(name)).cast("int"))).first()[0]


def test_toxicity_held_out(labelled, odd_docs):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    assert accuracy(toxicity.score_documents(docs.withColumn("counts", F.lit(1)), model), labels, "toxic", 0.5) > 0.93
    got = rows(toxicity.score_documents(odd_docs, model))
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)


def test_quality_held_out(labelled, odd_docs):
    docs, labels = labelled
    model = quality.train(docs, labels)
    assert accuracy(quality.score_documents(docs, model), labels, "quality", 0.3) > 0.95
    got = rows(quality.score_documents(odd_docs, model))
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1


def test_classifiers_without_labels_or_rows(spark, odd_docs, no_docs, labelled):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(odd_docs, none) is None and quality.train(odd_docs, none) is None
    assert {r["score"] for r in rows(toxicity.score_documents(odd_docs, None))} == {0.0}
    assert {r["score"] for r in rows(quality.score_documents(odd_docs, None))} == {1.0}
    model = toxicity.train(*labelled)
    assert rows(toxicity.score_documents(no_docs, model)) == []
    assert toxicity.train(no_docs, labelled[1]) is None and quality.train(no_docs, labelled[1]) is None


def test_toxic_distances_against_plain_compression(labelled):
    model = toxicity.train(*labelled)
    a, b = toxicity.compressor(model.toxic), toxicity.compressor(model.ordinary)
    text = "Ta GrumbleFitz lunker vo\tpa  ni SNORKWIT\n" + "x" * 150
    words = text.lower().split()[:-1] + ["x" * 64, "x" * 64, "x" * 22]
    far = lambda w: len(b.compress(f" {w} ".encode() + toxicity.TAIL)) - len(a.compress(f" {w} ".encode() + toxicity.TAIL))
    want = np.zeros((2, toxicity.BINS), int)
    for row, own in enumerate((words, [" ".join(words[i : i + 4]) for i in range(0, len(words), 4)])):
        for w in own:
            want[row, min(max(far(w), toxicity.LOW), toxicity.HIGH) - toxicity.LOW] += 1
    got = toxicity.Distance(model.toxic, model.ordinary).counts(text.encode())
    assert got.tolist() == want.ravel().tolist() and far("grumblefitz") > 2 > far("lunker")
    assert toxicity.Distance(model.toxic, model.ordinary).counts(b"").sum() == 0


def test_toxicity_of_few_documents(spark):
    docs = spark.createDataFrame([(1, "a vile word"), (2, "a mild word"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in rows(toxicity.score_documents(docs, toxicity.train(docs, labels))))


def test_sample_holds_whole_texts_within_its_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i % 90)) for i in range(300)] + [(1000, "y" * 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1000, 1)], "doc_id long, quality int")
    got = rows(training_sample(docs, labels, "quality", 100, 800)[0])
    assert all(r["text"] == "x" * (10 * r["doc_id"] % 90) for r in got)
    for y in (0, 1):
        assert 700 < sum(len(r["text"]) for r in got if r["label"] == y) <= 800


def test_attention_forward_and_gradients():
    rng = np.random.default_rng(12)
    sizes = [1, 4, 2]
    x, y, weight = rng.normal(0, 1, (7, 5)), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    w = [rng.normal(0, 0.7, s) for s in ((5, 4), (4,), (4, 3), (4, 3), (3,), (4,), (1,))]
    first, doc = np.array([0, 1, 5]), np.repeat(np.arange(3), sizes)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def plain():
        out = []
        for d in range(3):
            h = [np.tanh(r @ w[0] + w[1]) for r in x[doc == d]]
            e = np.array([np.exp((np.tanh(r @ w[2]) * sigmoid(r @ w[3])) @ w[4]) for r in h])
            out.append(sigmoid(sum(a * r for a, r in zip(e / e.sum(), h, strict=True)) @ w[5] + w[6][0]))
        return np.array(out)

    assert np.allclose(quality.forward(w, x, first, doc)[0], plain())
    loss = lambda: -(weight * (y * np.log(plain()) + (1 - y) * np.log(1 - plain()))).mean()
    for k, grad in enumerate(quality.gradients(w, x, first, doc, y, weight)):
        for at in np.ndindex(w[k].shape):
            before = w[k][at]
            w[k][at] = before + 1e-5
            up = loss()
            w[k][at] = before - 1e-5
            assert np.isclose((up - loss()) / 2e-5, grad[at], atol=1e-6)
            w[k][at] = before


def test_gradients_of_attention():
    rng = np.random.default_rng(2)
    bags = [rng.normal(0, 1, (int(n), quality.WIDTH)) for n in rng.integers(1, 6, 200)]
    y = rng.integers(0, 2, 200)
    for b, k in zip(bags, y, strict=True):
        b[rng.integers(0, len(b)), 0] += 6 * k  # one passage tells
    model = quality.fit(bags, y.astype(float), np.ones(200), epochs=80)
    assert np.mean([(model.score(b) >= 0.5) == k for b, k in zip(bags, y, strict=True)]) > 0.95


# --- 7: URLs ---------------------------------------------------------------------------------------------------------

def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


URLS = [
    "http://a.example.com/en/7", "http://EXAMPLE.com/en/8", "https://x.net/de/1", "http://b.example.net/de/88?q=1", "http://q.org/es/", "http://com/en/", "http://notcom/en/",
    "http://xcom/en/", None, "", "no scheme", "http://", "http://h#f://x", "http://h?x=/en/", "a://b://c/d", "http://É.com/en/7\nline", "http://example.com", "http://org/es/x#y",
]


def test_url_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, path string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows(urls.judge_urls(pages, labels))
    assert len(got) == len(URLS) + 1
    for r in got:
        u = [*URLS, URLS[0]][r["page_id"]]
        host, path = brute_url(u)
        fits = [(len(x), x, v) for v, x in urls.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        best = max(fits, default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[1] if best else None, best[2] if best else "allow"), u


def test_url_mining_finds_bad_hosts(spark):
    pages = spark.createDataFrame([(i, f"http://{'casino' if i % 4 == 0 else 'news'}.site{i % 7}.io/{'win' if i % 4 == 0 else 'read'}/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(300)] + [(1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = rows(urls.judge_urls(pages, labels))
    assert all((r["verdict"] == "block") == (r["page_id"] % 4 == 0) for r in got)
    assert rows(urls.judge_urls(pages.limit(0), labels)) == []


def test_mined_rules_against_counting(spark):
    rng = np.random.default_rng(13)
    data = []
    for i in range(600):
        own = sorted({f"t{int(k)}" for k in rng.integers(0, 7, rng.integers(1, 6))} | {"all", "always"})
        bad = "t1" in own and "t2" in own or "t3" in own and "t4" in own and "t5" in own
        data.append((own, int(rng.random() < (0.95 if bad else 0.1))))
    data += [([*"abcdefghij", *[f"deep{k}" for k in range(40)]], 1)] * 20 + [([*"abcdefghij"], 0)] * 20 + [([], 1)]
    df = spark.createDataFrame(data, "tokens array<string>, block int")
    rules, counts = urls.mine_rules(df, 0.01, 0.7)
    got = {tuple(r["rule"]): (r["frequency"], r["confidence"]) for r in rows(rules)}
    from itertools import combinations

    n, real = 640, [(set(t), b) for t, b in data if t]
    stats = lambda c: (sum(set(c) <= t for t, _ in real), sum(b for t, b in real if set(c) <= t))
    for rule, (frequency, confidence) in got.items():
        f, both = stats(rule)
        assert (f, both / f) == (frequency, confidence) and f >= 0.01 * n and both >= 0.7 * f
        assert not any(set(other) < set(rule) for other in got)
    small = sorted({x for t, _ in real for x in t if x[0] == "t"})
    for size in (1, 2, 3):
        for c in combinations(small, size):
            f, both = stats(c)
            if f >= 0.01 * n and both >= 0.7 * f:
                assert any(set(rule) <= set(c) for rule in got), c
    assert all((f"deep{k}",) in got for k in range(40))
    assert {r["token"]: r["n"] for r in rows(counts)} == Counter(x for t, _ in real for x in t)


def test_mined_rules_of_wide_urls_are_whole(spark):
    u = [f"u{i}" for i in range(10)]  # each surer by itself than p and q, and more than a URL's share of any cap
    data = [(["p", "q", "q2", *u], 1)] * 40 + [([x for x in u if x != u[i % 10]], 0) for i in range(30)] + [(["p"], 0)] * 60 + [(["q", "q2"], 0)] * 60
    rules, counts = urls.mine_rules(spark.createDataFrame(data, "tokens array<string>, block int"), 0.01, 0.7)
    from itertools import combinations, product

    got = [(frozenset(c), r["frequency"], r["confidence"]) for r in rows(rules) for c in product(*r["alike"])]
    want = {}
    for size in range(1, 7):
        for c in map(frozenset, combinations(["p", "q", "q2", *u], size)):
            labels = [b for t, b in data if c <= set(t)]
            if len(labels) >= 0.01 * len(data) and sum(labels) >= 0.7 * len(labels) and not any(c - {x} in want or any(w < c for w in want) for x in c):
                want[c] = (len(labels), sum(labels) / len(labels))
    assert len(got) == len(want) and {c: (n, k) for c, n, k in got} == want and frozenset({"p", "q"}) in want
    seen = [["p", "q"], ["p", "q2"], ["p", "u9", "x"], ["p"], ["q", "q2"], u[:4], u[5:]]
    out = rows(urls.match_rules(spark.createDataFrame([(t,) for t in seen], "tokens array<string>"), rules, counts))
    assert {tuple(r["tokens"]): r["mined"] for r in out} == dict(zip(map(tuple, seen), (1.0, 1.0, 1.0, None, None, None, 40 / 55), strict=True)) and len(out) == len(seen)


def test_mining_ends_where_a_site_shares_many_tokens(spark):
    site = [f"s{i:02}" for i in range(30)]  # a URL lacks one of them at most, so all 2^30 sets are frequent
    own = {0: ["bad", "worse"], 1: ["bad"], 2: ["worse"]}
    data = [([*(x for j, x in enumerate(site) if (i // 3 + j) % 100), *own[i % 3]], int(i % 3 == 0)) for i in range(900)]
    rules, _ = urls.mine_rules(spark.createDataFrame(data, "tokens array<string>, block int"), 0.005, 0.7)
    assert {(tuple(r["rule"]), r["frequency"], r["confidence"]) for r in rows(rules)} == {(("bad", "worse"), 300, 1.0)}


def test_url_tokens_keep_what_ends_in_a_colon(spark):
    df = spark.createDataFrame([("http://a.b.co/x:/y//7?k=1&&l#f:",), (None,)], "url string")
    got = [r["t"] for r in df.select(urls.url_tokens(F.col("url")).alias("t")).collect()]
    assert got == [["domain:b.co", "fragment:f:", "host:a", "host:b", "host:co", "path:#", "path:x:", "path:y", "query:k", "query:l", "scheme:http"], []]


def test_urls_with_null_and_repeated_ids(spark):
    pages = spark.createDataFrame([(None, "http://bad.io/x"), (1, "http://bad.io/x"), (1, "http://bad.io/x"), (2, "http://ok.io/y"), (3, None)], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = Counter((r["page_id"], r["verdict"]) for r in rows(urls.judge_urls(pages, labels)))
    assert got == {(None, "block"): 1, (1, "block"): 2, (2, "allow"): 1, (3, "allow"): 1}


# --- 8: lines --------------------------------------------------------------------------------------------------------

def test_lines_against_brute_force(odd_docs, no_docs):
    data = [(r.doc_id, r.text or "", r.source) for r in odd_docs.collect()]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, text, _ in data:
        for x in text.split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    gone = {k: max(i for i in h if i is not None) for k, h in holders.items() if len(h) >= 3}
    want = Counter()
    for i, text, s in data:
        own = text.split("\n")
        kept = [x for x in own if key(x) not in gone or gone[key(x)] == i]
        want[i, "\n".join(kept), len(own), len(own) - len(kept), s] += 1
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["source"]) for r in rows(lines.dedup_lines(odd_docs, keep=("source",))))
    assert got == want and any(k[3] for k in want)
    assert rows(lines.dedup_lines(no_docs)) == []


# --- 9: SimHash ------------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    own = sorted(values)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(b)] = root(a)
    return {v: root(v) for v in values}


def test_simhash_against_brute_force(odd_docs, no_docs):
    data = [(r.doc_id, brute_fingerprint(r.text)) for r in odd_docs.collect()]
    comp = brute_components({f for _, f in data})
    least = {}
    for i, f in data:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in rows(simhash.near_duplicates(odd_docs)))
    assert got == Counter((i, f, least.get(comp[f])) for i, f in data)
    assert rows(simhash.near_duplicates(no_docs)) == []


def test_similar_fingerprints_lose_no_link(spark):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    values = {int(x) for x in rng.integers(0, 2**63, 200)} | {0, 2**64 - 1, 7}
    for _ in range(700):  # a dense group, and chains that lead away from it
        values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)))
    chain = centre
    for _ in range(60):
        chain ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        values.add(chain)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    want = brute_components(values)
    for limit in (simhash.LIST, 20):  # the second forces the second level, and within it long lists
        before, simhash.LIST = simhash.LIST, limit
        try:
            edges = simhash.similar_fingerprints(spark.createDataFrame(signed, "fp long"))
            got = {r["node"] & (2**64 - 1): r["root"] for r in rows(components.connected_components(edges))}
            assert edges.count() < 8 * 11 * len(values)
        finally:
            simhash.LIST = before
        groups = defaultdict(set)
        for v in values:
            groups[got.get(v, v)].add(v)
        expected = defaultdict(set)
        for v in values:
            expected[want[v]].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_long_lists_are_looked_up():
    rng = np.random.default_rng(6)
    mask = 0xFFFFFFFFFF
    fps = np.unique(np.uint64(5) | (rng.integers(0, 2**24, 300).astype(np.uint64) << np.uint64(40)))
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(1 << 50), fps ^ np.uint64(7 << 41)]))
    before, simhash.LIST = simhash.LIST, 1
    try:
        found = simhash.links(fps, mask)
    finally:
        simhash.LIST = before
    parent = {int(x): int(x) for x in fps}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in found:
        assert (a ^ b).bit_count() <= 3
        parent[root(a)] = root(b)
    want = brute_components({int(x) for x in fps})
    assert len({root(int(x)) for x in fps}) == len(set(want.values()))


# --- 10: packing -----------------------------------------------------------------------------------------------------

def check_packed(got, capacity):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_ids_and_places(odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = rows(packing.pack_documents(odd_docs, with_ids=True))
    check_packed(got, 4096)
    want = Counter()
    for r in odd_docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for p, s in enumerate(range(0, len(ids), 4096)):
            own = ids[s : s + 4096]
            want[r.doc_id, p, s, len(own), zlib.crc32(own.tobytes()), own.tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    assert rows(packing.pack_documents(no_docs)) == []


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    texts = ["It's he'll! 12,5 <|endoftext|> e\u0301a İstanbul ΣΑΣ", "a\u00a0b\u2003c", "naïve\tÉTÉ... x×y ﬁn ǅ", "\u0301 start", "Hello, world. ok!", "", "漢字🎉 <|startoftext|>x"]
    rng = np.random.default_rng(11)
    signs = [*"abzABZ019 \t\n.,;'!?&_-<|>", "'s", "'ll", "\u2019t", "\u0301", "\u00e9", "\u00c9", "\u0130", "\u0131", "\u017f", "\u0149", "\u00df", "\u03a3", "\u03c3", "\u00a0", "\u2003", "\u6f22", "\U0001f389", "\u01c5", "\x0b", "\x1f", "\x85", "<|endoftext|>", "\u00d7", "\u0660", "\u00bd"]
    texts += ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(4000)]
    ids_of = packing.WordIds(path)
    for own in packing.slices(pa.array([None, *texts]), 2000):
        ids, bounds = ids_of(own)
        for i, t in enumerate(own.to_pylist()):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_slices_hold_all_texts():
    texts = [None, "", "a" * 30, "b" * 5, None, "c" * 5, "d"] * 3
    got = list(packing.slices(pa.array(texts), 10))
    assert [t for s in got for t in s.to_pylist()] == texts
    assert all(len(s) == 1 or sum(len(t or "") for t in s.to_pylist()) <= 10 for s in got)
    assert not list(packing.slices(pa.array([], pa.string())))


def test_memory_keeps_two_generations():
    asked = []
    memory = packing.Memory(lambda keys: [asked.append(k) or k.encode() for k in keys], 3)
    for keys in (["a", "b"], ["b", "c", "d"], ["a", "e"], ["f", "g", "h"], ["a", "b"], ["z"]):
        assert memory(keys) == [k.encode() for k in keys]
    assert asked == ["a", "b", "c", "d", "e", "f", "g", "h", "b", "z"]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_all_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(np.maximum(rng.lognormal([6, 7, 5, 7.5][seed], [1, 0.6, 0.5, 0.3][seed], 20000).astype(int), 1), 4096)
    histogram = Counter(lengths.tolist())
    groups = packing.plan(dict(histogram))
    placed = Counter()
    for count, own in groups:
        assert sum(own) <= 4096 and count > 0
        for n in own:
            placed[n] += count
    assert placed == histogram
    plain = packing.fit_plan(dict(histogram), 4096, 4096, 1)  # best fit alone
    assert sum(c for c, _ in groups) <= 1.005 * sum(c for c, _ in plain) + 1


def test_nnls_against_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.normal(0, 1, 12)
        x = packing.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-6).all() and np.abs(g[x > 0]).max(initial=0) < 1e-6
