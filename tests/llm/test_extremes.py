"""Very long texts, repeated ids, and odd numbers, in the operators that they could break."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import binary, bpe, itq, minhash, mixing, packing, topk, toxicity
from docloom.llm import words as W
from docloom.llm.bpe import encoder
from tests.llm.test_text_operators import water_level

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


# -- token ids ---------------------------------------------------------------------------


def test_parts_of_a_text_have_its_ids(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 16)
    monkeypatch.setattr(bpe, "_RUN", re.compile(f"[{bpe._SPACE}]{{3,}}"))
    encode, rng = encoder(PATH), random.Random(4)
    bits = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "don't", "'s", "12", "é", "日本", "!?", "🙂", "   \n\n  "]
    for _ in range(400):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 60)))
        assert "".join(p for p, _ in bpe.parts(text)) == text
        assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000 + "x", "a" + " \t" * 700_000 + " b", "x" * 1_000_000])
def test_long_runs_have_the_ids_of_the_library(text):
    encode = encoder(PATH)
    assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


UNIT = " some words, 12 numbers\n  and é signs."


def test_packing_of_very_long_texts(spark):
    """A text of 50 MB and blanks by the million go through both packers whole."""
    times = 50_000_000 // len(UNIT.encode())
    docs = spark.range(3).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"),
        F.expr(f"CASE id WHEN 0 THEN repeat(' ', 2000000) WHEN 1 THEN repeat('\\n', 2000000) ELSE repeat('{UNIT}', {times}) END").alias("text"),
    )
    encode = encoder(PATH)
    want = {0: encode(" " * 2_000_000), 1: encode("\n" * 2_000_000), 2: np.tile(encode(UNIT), times)}
    want = {d: np.append(ids, 1).astype("<u4") for d, ids in want.items()}
    assert encode(UNIT * 3).tolist() == np.tile(encode(UNIT), 3).tolist()
    found: dict[int, int] = {}
    for r in packing.pack(docs, PATH).collect():
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == {d: len(ids) for d, ids in want.items()}
    found = {}
    for r in binary.pack(docs, PATH).collect():
        row = np.frombuffer(r["ids"], "<u2")
        for d, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert (row[a:b] == want[d][start : start + b - a]).all()
            found[d] = found.get(d, 0) + b - a
    assert found == {d: len(ids) for d, ids in want.items()}


# -- mixing ------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.mark.parametrize("doc_id", [None, 7])
@pytest.mark.parametrize("alike", [True, False])
def test_mix_draws_rows_of_one_id_each(spark, doc_id, alike):
    """200 rows of no id or of one id, of one text or of many, beside a source that takes the larger share."""
    rows = [(doc_id, "w " * 9 + ("x" if alike else f"x{i}"), "a", None, None) for i in range(200)]
    rows += [(1000 + i, "v " * 5, "b", None, None) for i in range(47)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert len(got) == len(rows)
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        target, taken = mine[0]["target"], sum(r["taken"] for r in mine)
        assert abs(taken - target) <= 10 and max(r["taken"] - 3 * r["size"] for r in mine) <= 0
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    plain = lambda rs: sorted((r["doc_id"] or 0, r["size"], r["taken"], r["source"]) for r in rs)
    assert plain(got) == plain(again)
    out = mixing.remix(spark.createDataFrame(rows, DOCS).repartition(5))
    assert out.groupBy("source").count().count() == 2 and out.count() == sum(r["copies"] for r in got)


def test_mix_of_many_sources(spark):
    """Targets are those of the water level where sources are limited one after the other."""
    sizes = {f"s{i:03d}": 1 + (i * i * 37) % 997 for i in range(150)} | {None: 20_000}
    rows = [(i, "w " * n, s, None, None) for i, (s, n) in enumerate(sizes.items())]
    got = {r["source"]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    want = water_level(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


# -- near duplicates ---------------------------------------------------------------------


def prose(seed, n=60):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_a_doc_id_of_two_texts_links_by_both(spark):
    t, u = " ".join(prose(1)), " ".join(prose(2))
    rows = [(5, t), (5, u), (6, t + " word"), (7, u + " word"), (8, " ".join(prose(3))), (9, ""), (9, t), (None, t), (None, "x y z"), (4, None)]
    docs = spark.createDataFrame([(d, x, "s", str(i), 0) for i, (d, x) in enumerate(rows)], DOCS)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, k=4).collect())
    assert got == [
        (0, 1, None, True), (0, 57, None, True), (4, 0, 4, True), (5, 57, 5, True), (5, 57, 5, True), (6, 58, 5, False), (7, 58, 5, False),
        (8, 57, 8, True), (9, 0, 5, False), (9, 57, 5, False),
    ]
    left = minhash.drop_near_duplicates(docs, k=4)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.where("text <> ''").collect()) == sorted([(0, "x y z"), (5, min(t, u, key=lambda x: spark.range(1).select(F.xxhash64(F.lit(x))).first()[0])), (8, " ".join(prose(3)))])
    assert left.where("coalesce(text, '') = ''").count() == 2


def test_repeated_rows_and_rows_without_id_leave_one(spark):
    t = " ".join(prose(4))
    rows = [(None, t)] * 300 + [(3, t + " z")] * 300 + [(2, "a b c d e f")] * 2 + [(None, "p q r s t")] * 2
    left = minhash.drop_near_duplicates(spark.createDataFrame([(d, x, "s", str(i), 0) for i, (d, x) in enumerate(rows)], DOCS).repartition(3))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, "p q r s t"), (2, "a b c d e f"), (3, t + " z")]


def test_unlike_members_of_a_bucket_move_without_texts(spark):
    """Members whose signatures differ in all but the buckets' band are sifted out before texts are joined."""
    rng = np.random.default_rng(1)
    n = minhash.BANDS * minhash.ROWS
    looks = minhash._sift(80, 100, n, minhash.MISS)
    sig = rng.integers(0, 1 << 16, (40, n)).astype("<u2")
    sig[:, :6] = 1
    rows = [{"bucket": 1, "i": 0, "j": 0, "side": int(i >= 20), "rep": i, "n": 100, "c": i, "out": True, "sig": sig[i].tobytes()} for i in range(40)]
    assert list(looks([pa.RecordBatch.from_pylist(rows)])) == []
    rows[30]["sig"] = rows[3]["sig"]
    (kept,) = looks([pa.RecordBatch.from_pylist(rows)])
    assert kept.column("rep").to_pylist() == [3, 30]


# -- vectors -----------------------------------------------------------------------------


def test_vectors_of_huge_and_tiny_components(spark):
    """Cosines of finite vectors don't over- or underflow."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6, 16))
    near = x + rng.standard_normal((6, 16)) * 0.05
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(np.concatenate((x, near)), [1e-200, 1e200, 1e-300, 1e300, 1.0, 1e-310] * 2))]
    rows += [(20, [1e-200] * 16), (21, [5e-324] + [0.0] * 15), (22, [1.7e308] * 16)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (1, i % 6) for i in range(12)} | {20: (1, 20), 21: (0, 21), 22: (1, 20)}


def test_spanning_edges():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (50, 30), (200, 150), (300, 5000)):
        a, b = rng.integers(0, n, (2, m))
        a, b = a[a != b], b[a != b]
        top = list(range(n))

        def find(v):
            while top[v] != v:
                v = top[v]
            return v

        kept = itq._span(a, b, n)
        for e in kept.tolist():
            assert find(a[e]) != find(b[e])
            top[find(a[e])] = find(b[e])
        assert all(find(p) == find(q) for p, q in zip(a.tolist(), b.tolist()))


def test_only_near_codes_are_sifted_in():
    rng = np.random.default_rng(6)
    code = rng.integers(0, 2, (6, 8, 9))
    code[:, 3] = code[0, 3]  # all share the key of table 3 only
    code[1], code[1, 0] = code[0], 1 - code[0, 0]  # near, and first met in table 1
    for t, want in ((1, [0, 1]), (3, [])):
        words = (code << np.arange(9)).sum(axis=2).astype("<u2")
        rows = [{"cell": 8 * int(words[0, t]) + t, "i": 0, "j": 0, "side": 0, "rep": r, "code": words[r].tobytes()} for r in range(6)]
        (kept,) = itq._sift(9, 20)([pa.RecordBatch.from_pylist(rows)])
        assert kept.column("rep").to_pylist() == want


# -- top-k -------------------------------------------------------------------------------


def test_bounds_skip_work():
    """Where energy falls with the dimension most products are skipped, and none of the best is lost."""
    rng = np.random.default_rng(7)
    q, d = (np.floor(rng.standard_normal((64, n)) * 2560 / np.arange(1, 65)[:, None] ** 1.5) for n in (50, 2000))
    full, work = q.T @ d, []
    floor = np.sort(full, axis=1)[:, -5]
    who, cand, s = topk.pair_scores(q, d, floor, np.arange(64), work)
    assert set(zip(who.tolist(), cand.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(full >= floor[:, None])))) and (s == full[who, cand]).all()
    assert work[0] < 0.5 * 64 * 50 * 2000


def test_cells_emit_little_and_lose_nothing(spark, monkeypatch):
    """Many cells of small blocks give the same rows as one; floors keep what leaves them small."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-2000, 2000, 12) / 256).tolist()) for i in range(3000)] + [(i, [1.0] * 12) for i in range(3000, 3100)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = sorted(map(tuple, topk.search(docs, "vec_id % 50 = 0").collect()))
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    assert sorted(map(tuple, topk.search(docs, "vec_id % 50 = 0").collect())) == want
    ints = np.floor(np.array([v for _, v in rows]) * 256)
    for q, rank, v, score in want:
        assert score == int(ints[q] @ ints[v]) and rank <= 5
    assert len(want) == 62 * 5


def test_the_grid_moves_least():
    for q, c, n in ((0, 0, 32), (1, 1, 32), (6, 51, 32), (2000, 100_000, 16_000), (50, 3, 8)):
        rows, columns = topk.grid(q, c, n)
        assert 1 <= rows <= max(1, q) and 1 <= columns <= max(1, c) and rows * columns <= max(1, n)
    rows, columns = topk.grid(2000, 100_000, 16_000)
    assert 2000 * columns + 100_000 * rows < 0.2 * (2000 * 16_000 + 100_000)


# -- toxicity ----------------------------------------------------------------------------


def brute_bucket(gram: str) -> int:
    """Bucket of one n-gram, in whole numbers."""
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c) * 0x9E3779B1) % 2**32
    return ((h ^ (h >> 15)) * (0x85EBCA77 + 2 * len(gram)) % 2**32) >> (32 - toxicity.BITS)


def brute_grams(text):
    """By position, of a blank, the text and a blank: the n-grams that end there."""
    plain = "".join(c if c.isalnum() and c < "\x80" or c >= "\x80" else " " for c in text.lower())
    plain = f" {plain} "
    return [[plain[i - n + 1 : i + 1] for n in toxicity.SIZES if i - n + 1 >= 0] for i in range(len(plain))]


def brute_score(model, text):
    if not text:
        z = model.offset
    else:
        by_place = [sum(float(model.weights[brute_bucket(g)]) for g in grams) for grams in brute_grams(text)]
        n, worst, start = len(by_place), -np.inf, 0
        while True:
            worst = max(worst, sum(by_place[start : min(n, start + toxicity.SPAN)]))
            if start + toxicity.SPAN >= n:
                break
            start += toxicity.STRIDE
        z = model.slope * worst + model.offset
    return 1 / (1 + np.exp(-z))


def sample_texts():
    rng = random.Random(9)
    clean, bad = [f"w{rng.randrange(40)}é" for _ in range(60)], ["idiot", "ДУРАК", "馬鹿野郎", "vile", "scum"]
    texts, labels = [], []
    for i in range(160):
        words = [rng.choice(clean) for _ in range(rng.randrange(1, 200))]
        if i % 2:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(i % 2)
    return texts, np.array(labels)


def test_ratios_and_scores_as_by_brute_force(monkeypatch):
    texts, labels = sample_texts()
    read = [toxicity.points(t) for t in texts]
    got = toxicity.ratios(read, labels)
    held = [{}, {}]
    for t, y in zip(texts, labels):
        for b in {brute_bucket(g) for grams in brute_grams(t) for g in grams}:
            held[y][b] = held[y].get(b, 0) + 1
    n = np.bincount(labels)
    for b in {*held[0], *held[1]}:
        clean, toxic = held[0].get(b, 0), held[1].get(b, 0)
        want = np.log((toxic + 1) / (n[1] + 2)) - np.log((clean + 1) / (n[0] + 2)) if b and clean + toxic >= toxicity.LEAST_TEXTS else 0.0
        assert got[b] == pytest.approx(want)
    assert np.count_nonzero(got) <= len({*held[0], *held[1]})
    model = toxicity.fit(read, labels, 0.5)
    odd = ["", "x", "ab", "İİ scum", "idiot " * 200, " ".join(texts[:40])]
    for part in (toxicity.PART, 2 * toxicity.STRIDE):
        monkeypatch.setattr(toxicity, "PART", part)
        for t in [*texts[:30], *odd]:
            assert model.score(toxicity.points(t)) == pytest.approx(brute_score(model, t), rel=1e-4, abs=1e-6)
    assert np.mean([(model.score(x) >= 0.5) == y for x, y in zip(read, labels)]) > 0.95
    held_out = ["w1é w2é ДУРАК w3é ДУРАК", "w1é w2é 馬鹿野郎 w3é 馬鹿野郎 w9é"]
    assert all(model.score(toxicity.points(t)) > model.score(toxicity.points("w1é w2é w3é w4é w5é")) for t in held_out)


def test_training_does_not_depend_on_the_order_of_repeated_ids(spark):
    texts, labels = sample_texts()
    docs = [(i // 2, t, "s", "en", 0) for i, t in enumerate(texts)] + [(500, texts[1], "s", "en", 0), (501, "z" * 100_000, "s", "en", 0)]
    known = [(i, int(i % 2)) for i in range(80)] + [(500, 0), (500, 1), (3, 1), (501, 1)]
    models = []
    for seed in (1, 2):
        rng = random.Random(seed)
        rng.shuffle(docs)
        rng.shuffle(known)
        df = spark.createDataFrame(docs, DOCS).repartition(seed + 1)
        models.append(toxicity.train(df, spark.createDataFrame(known, "doc_id long, toxic int")))
    assert (models[0].weights == models[1].weights).all() and (models[0].slope, models[0].offset) == (models[1].slope, models[1].offset)


# -- words -------------------------------------------------------------------------------


def test_words_across_parts_are_those_of_the_whole(monkeypatch):
    rng = random.Random(10)
    texts = ["".join(rng.choices("aB é\n.", k=rng.randrange(0, 90))) for _ in range(200)] + ["x" * 300, "", None, " " * 50, "y" * 64, "é " * 40]
    column = pa.array(texts)
    for kind in (W.SPACED, W.ALNUM):
        (want,) = W.words(column, kind)
        for size in (1, 7, 64):
            monkeypatch.setattr(W, "CHUNK", size)
            got = list(W.words(column, kind))
            monkeypatch.setattr(W, "CHUNK", 1 << 20)
            assert np.concatenate([w.hashes for w in got]).tolist() == want.hashes.tolist()
            assert b"".join(bytes(w.data) for w in got) == bytes(want.data)
            assert np.concatenate([np.diff(w.first) for w in got]).tolist() == np.diff(want.first).tolist()
            assert np.concatenate([w.ends - w.starts for w in got]).tolist() == (want.ends - want.starts).tolist()


def test_a_long_text_takes_little_memory():
    import tracemalloc

    text = pa.array(["some words of prose " * 1_000_000])  # 20 MB
    tracemalloc.start()
    (w,) = W.words(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w.hashes) == 4_000_000 and peak < 12 * 20_000_000


# -- pipeline ----------------------------------------------------------------------------


def test_odd_rows_go_through_all_stages(spark, folder):
    """Nulls in any column, empty and long texts, repeated rows and clashing columns; each stage keeps what it should."""
    t = " ".join(prose(20))
    docs = [(1, t, "a", "en", 1), (1, t, "a", "en", 1), (2, t + " end", None, None, None), (None, t, "b", "en", 2), (3, None, None, None, None), (4, "", "b", "en", 0)]
    docs += [(5, "long " * 300_000, "b", "en", 9), (6, " \n " * 50_000, "a", "en", 9), (None, "own words of nobody here", None, "en", 3), (7, " ".join(prose(21)), "a", "en", 5)]
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("rep", "seq", "digest", "component", "sid", "u", "key", "score")})
    df.write.parquet(f"{folder}/documents.parquet")
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/stage{n}")
        if n < 3:
            assert out.columns == df.columns
            now = spark.read.parquet(f"{folder}/stage{n}")
            kept.append(sorted((r["doc_id"] or 0, (r["text"] or "").strip()[:5]) for r in now.collect()))
    assert len(kept[0]) == len(docs)
    assert kept[1] == sorted([(1, t[:5]), (3, ""), (4, ""), (5, "long "), (6, ""), (0, "own w"), (7, " ".join(prose(21))[:5])])
    assert {d for d, _ in kept[2]} <= {d for d, _ in kept[1]} and not {3, 4, 6} & {d for d, _ in kept[2]}
    pieces = spark.read.parquet(f"{folder}/stage3").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    assert {r["doc_id"] or 0: r["n"] // r["whole"] for r in pieces} == {d: [x for x, _ in kept[2]].count(d) for d in {x for x, _ in kept[2]}}
    assert corpus_pipeline.run(spark, folder).count() > 0
