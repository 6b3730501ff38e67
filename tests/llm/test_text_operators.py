from __future__ import annotations

import itertools
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import binary, license, minhash, mixing, packing, queries, rollup, toxicity
from docloom.llm import words as W
from docloom.llm.bpe import encoder

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"

ODD = [
    (1, None, None, None, None), (2, "", "b", "en", 0), (3, "one two", "b", "en", 7), (4, "a b c d e f g h", "a", "en", 15),
    (5, "a b c d e f g h", "a", "en", 15), (6, " \t\n ", None, None, None), (None, "x y z", "a", "en", 5), (4, "a b c d e f g h", "a", "en", 15),
    (7, "Ünï cödé 日本語 text 🙂 " * 40, "c", "xx", None), (8, "w " * 30_000, "a", None, None), (9, "CC-BY all rights reserved", "é", "en", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("size", "u", "row", "rep", "n", "key", "task")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(text):
    return (text or "").encode().lower().split()


# -- shared parts ------------------------------------------------------------------------


def test_words_are_those_of_the_patterns():
    texts = ["A b  c\td", None, "", "no-break space É9 x_y", "  lead\x0b\n", "word", "\x1c\x1dA\x1f"]
    for is_word, pattern in ((W.SPACED, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = [[] for _ in texts]
        for w in W.words(pa.array(texts), is_word):
            for i in range(len(w.first) - 1):
                got[w.row + i] = [bytes(w.data[s:e]).decode() for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        assert got == [re.findall(pattern, (t or "").translate(low)) for t in texts]


def test_hashes_do_not_depend_on_place():
    (a,), (b,) = W.words(pa.array(["x yy zzz yy"])), W.words(pa.array(["filler filler", "x yy zzz yy"]))
    assert a.hashes.tolist() == b.hashes[2:].tolist() and a.hashes[1] == a.hashes[3] and len(set(a.hashes.tolist())) == 3


def test_both_engines_give_the_same_ids():
    encode = encoder(PATH)
    assert encode.fast is not None
    points = [c for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)}. {chr(c)}{chr(c)} x's" for c in points] + ["<|endoftext|> a <|endoftext|>", "  two   spaces \n\n x", ""]
    want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(encode(t).tolist() == e.ids for t, e in zip(texts, want))


# -- toxicity ------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    """These small tables have some 50 toxic texts in each language but English, too few to learn from."""
    tables = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("labels", "documents")]
    found = queries.op1_toxicity(spark, "/root/testdata/sf0.1").join(tables[0], "doc_id").join(tables[1].select("doc_id", "lang"), "doc_id").where("held_out")
    n = {tuple(r[:3]): r["count"] for r in found.groupBy(F.expr("lang = 'en'"), "toxic", "predicted").count().collect()}
    wrong, right = (sum(n.get((en, 0, p), 0) for en in (True, False)) for p in (1, 0))
    assert n[True, 1, 1] / (n[True, 1, 1] + n.get((True, 1, 0), 0)) > 0.85 and wrong / (wrong + right) < 0.04


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (3, 0), (None, 1), (9, None), (77, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    untrained = toxicity.train(odd, labels.limit(0))
    assert toxicity.score(none, untrained).count() == 0 and toxicity.keep_clean(odd, untrained).columns == odd.columns
    assert toxicity.keep_clean(odd, untrained).count() == len(ODD)


def test_every_span_of_a_text_counts():
    assert all((ends[-1] == n and (starts[1:] <= ends[:-1]).all()) for n in (1, 319, 320, 321, 5000) for starts, ends in [toxicity.spans(n)])


# -- mixing ----------------------------------------------------------------------------------


def water_level(sizes: dict, most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, total, free = {}, sum(sizes.values()), set(names)
    while free:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        target |= {s: most * sizes[s] for s in over} if over else share
        free = free - over if over else set()
    return target


def check_mix(rows, near):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    want = water_level(sizes)
    for s, rs in by.items():
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - want[s]) <= near * want[s]


def test_mix_meets_its_targets(spark):
    rows = queries.op2_entropy_mix(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    check_mix(rows, 0.01)
    again = queries.op2_entropy_mix(spark, "/root/testdata/sf0.01").collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}


def test_mix_of_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and sorted(r["size"] for r in rows) == sorted(len(spaced(r[1])) for r in ODD)
    check_mix(rows, 1.0)
    out = mixing.remix(odd)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.remix(none).count() == 0


def test_one_small_source_cannot_be_over_three_times_itself(spark):
    rows = [(i, "w " * n, s, None, None) for i, (s, n) in enumerate([("a", 90), ("b", 5), ("b", 5), ("c", 300), ("c", 7)])]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    check_mix(got, 1.0)
    assert {r["taken"] for r in got if r["source"] == "b"} == {15}


# -- packing ----------------------------------------------------------------------------------


def check_pack(rows, texts, length=2048):
    encode = encoder(PATH)
    ids = {d: np.append(encode(t), 1).astype("<u4") for d, t in texts}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    times = Counter(d for d, _ in texts)
    for d, rs in by_doc.items():
        x = ids[d]
        assert Counter(i for r in rs for i in range(r["start"], r["start"] + r["length"])) == {i: times[d] for i in range(len(x))}
        assert all(r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for r in rs)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length and (at == length or at & (at - 1) == 0)


def test_pack_holds_every_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op3_mixture_pack(spark, SF).collect()
    check_pack(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_pack_of_odd_rows(spark, odd, none):
    check_pack(packing.pack(odd, PATH, length=64, window=256).collect(), [(r[0], r[1]) for r in ODD], 64)
    assert packing.pack(none, PATH).count() == 0


@pytest.mark.parametrize("weights", [None, [1, 1, 1], [3, 0, 1], [0, 0, 0], [0.001, 5, 5]])
def test_windows_keep_their_mixture(weights):
    sizes, window = [1000, 37, 5000], 64
    s = packing.Schedule(sizes, weights, window)
    windows = 1 + max(s.window_of(q, n - 1) for q, n in enumerate(sizes))
    for q, n in enumerate(sizes):
        starts = [s.before(q, w) for w in range(windows + 1)]
        assert starts[0] == 0 and starts[-1] == n and starts == sorted(starts)
        for t in range(0, n, 13):
            assert starts[s.window_of(q, t)] <= t < starts[s.window_of(q, t) + 1]
    if weights is None:
        share = np.array(sizes) / sum(sizes)
        for w in range(windows - 1):
            part = [s.before(q, w + 1) - s.before(q, w) for q in range(3)]
            assert np.abs(part - window * share).max() <= 1
    places = sorted(s.layout(w)[1][q] + t - s.layout(w)[0][q] for q, n in enumerate(sizes) for t in range(n) for w in [s.window_of(q, t)])
    assert places == list(range(sum(sizes)))


# -- near duplicates --------------------------------------------------------------------------


def brute_components(texts: dict, k=4):
    sets = {}
    for d, t in texts.items():
        w = spaced(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    both = Counter(p for ds in holders.values() for p in itertools.combinations(sorted(ds), 2))
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_as_by_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    for i in range(120):  # a large group of near copies, many at the threshold
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs[1000 + i] = " ".join(w)
    df = spark.createDataFrame([(d, t, "s", "en", 0) for d, t in docs.items()], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, k=4).collect()}
    assert got == brute_components(docs)
    left = minhash.drop_near_duplicates(df, k=4)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {c for _, c in got.values()}


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = minhash.near_duplicates(odd, k=4).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got[1] == (0, 1, True) and got[5] == (5, 4, False) and got[4] == (5, 4, True) and got[3] == (1, 3, True) and got[8] == (1, 8, True)
    assert got[None][1:] == (None, True)
    assert minhash.near_duplicates(none).count() == 0


def test_pruning_bound_is_the_posterior():
    for n, t, miss in ((24, 0.8, 1e-6), (216, 0.8, 1e-6), (48, 0.5, 1e-3)):
        m = minhash.least_matches(n, t, miss)
        s = np.linspace(0, 1, 200_001)

        def above(m):
            y = s**m * (1 - s) ** (n - m)
            return y[s >= t].sum() / y.sum()

        assert above(m) >= miss * 0.98 and (m == 0 or above(m - 1) < miss * 1.02)


# -- rollup -----------------------------------------------------------------------------------


def test_rollup_commits_count_once(spark, folder):
    r = rollup.TokenRollup(spark, f"{folder}/r")
    rows = spark.createDataFrame([("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, None), (None, "en", "v1", 1, 5), ("a", "en", "v1", None, 99)], "source string, lang string, version string, sign int, tokens long")
    assert r.totals().count() == 0
    assert r.commit("b/1", rows) and not r.commit("b/1", rows)
    again = rollup.TokenRollup(spark, f"{folder}/r")
    assert not again.commit("b/1", rows) and again.committed() == ["b/1"]
    state = lambda: {(x["source"], x["docs"], x["tokens"]) for x in again.totals().collect()}
    assert state() == {("a", 2, 10), (None, 1, 5)}
    again.fold()
    assert again.commit("b/2", rows.where("source is null").withColumn("sign", F.lit(-1))) and state() == {("a", 2, 10)}
    again.fold()
    assert state() == {("a", 2, 10)} and not again.commit("b/2", rows)
    assert again.commit("empty", rows.limit(0)) and state() == {("a", 2, 10)}
    docs = spark.createDataFrame([("a", "en", 1, 4), ("a", "en", 2, 2)], "source string, lang string, old long, new long")
    assert again.commit("rev", rollup.revised(docs, F.lit(1), F.col("old"), F.col("new"), "v1")) and state() == {("a", 2, 13)}


def brute_rollup(rows):
    """Totals of (doc_id, text, source, lang) by the libraries themselves, a text once, the second with an end token."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(PATH)
    one.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    two = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    seen, totals = set(), {}
    for _, text, source, lang in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        if text is not None and text in seen:
            continue
        seen.add(text)
        for version, n in (("byte_bpe_50k", len(one.encode(text or "", add_special_tokens=False).ids)), ("byte_bpe_multi_50k", len(two.encode_ordinary(text or "")) + 1)):
            d, t = totals.get((source, lang, version), (0, 0))
            totals[source, lang, version] = d + 1, t + n
    return {(*k, *v) for k, v in totals.items()}


def rollup_of(spark, folder, df):
    df.write.parquet(f"{folder}/documents.parquet")
    return {tuple(r) for r in queries.op5_token_rollup(spark, folder).select("source", "lang", "version", "docs", "tokens").collect()}


def test_rollup_query_as_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rollup_of(spark, f"{folder}/a", docs) == brute_rollup([tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()])


def test_rollup_query_of_odd_rows(spark, folder, odd, none):
    rows = [(r[0], r[1], r[2], r[3]) for r in ODD]
    rows += [(100 + i, "the same text", "abc"[i % 3], "en") for i in range(50)] + [(50, "the same text", "b", None), (None, "the same text", None, None), (60, None, "b", "en")]
    df = spark.createDataFrame([(d, t, s, lang, 0) for d, t, s, lang in rows], SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "tokens", "sign", "version", "n")})
    assert rollup_of(spark, f"{folder}/a", df.repartition(3)) == brute_rollup(rows)
    assert rollup_of(spark, f"{folder}/b", none) == set()


def test_two_commits_of_one_batch_at_once(spark, folder):
    """Of attempts at the same time exactly one counts, in each of several rounds."""
    from concurrent.futures import ThreadPoolExecutor

    rows = spark.createDataFrame([("a", "en", "v", 1, 10)], "source string, lang string, version string, sign int, tokens long")
    states = [rollup.TokenRollup(spark, f"{folder}/r") for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        for n in range(6):
            assert sum(pool.map(lambda s: s.commit(f"batch-{n}", rows), states)) == 1
    assert [tuple(r) for r in states[0].totals().select("docs", "tokens").collect()] == [(6, 60)] and len(states[0].committed()) == 6


# -- binary output -------------------------------------------------------------------------------


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 65) for _ in range(400)]
    rooms, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in rooms if r >= sizes[i]]
        room = min(fits) if fits else 64
        if fits:
            rooms.remove(room)
        else:
            want.append(1)
        rooms.append(room - sizes[i])
    bins = binary.best_fit_decreasing(sizes, 64)
    assert len(bins) == len(want) and sorted(i for b in bins for i in b) == list(range(400)) and all(sum(sizes[i] for i in b) <= 64 for b in bins)
    assert sorted(64 - sum(sizes[i] for i in b) for b in bins) == sorted(rooms)


def test_binary_round_trip(spark, odd, none, tmp_path):
    binary.write(binary.pack(odd, PATH, length=128), f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    ids, seqlens, positions = binary.matrix(rows)
    back = {}
    for r, row, cu, at in zip(rows, ids, seqlens, positions):
        assert r["position_resets"] == r["cu_seqlens"][:-1] and (row[r["n_tokens"] :] == 0).all() and all(at[s] == 0 for s in r["position_resets"])
        for d, start, a, b in zip(r["doc_ids"], r["starts"], cu, cu[1:]):
            back.setdefault(d, Counter())[start, row[a:b].tobytes()] += 1
    encode, times = encoder(PATH), Counter(r[0] for r in ODD)
    for d, t, *_ in ODD:
        whole = b"".join(piece for _, piece in sorted(back[d]))
        assert whole == np.append(encode(t), 1).astype("<u2").tobytes() and set(back[d].values()) == {times[d]}
    assert binary.pack(none, PATH).count() == 0


# -- licenses ------------------------------------------------------------------------------------


def base_of(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
    at = [(i, label) for phrase, label in license.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_labels_as_by_brute_force(spark, none):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs += [(5000, "cc by cc-BY, CC  by all rights reserved general public license"), (5001, None), (5002, "rights reserved all rights"), (5003, "cc by " * 5000)]
    df = spark.createDataFrame([(d, t, "s", "en", 0) for d, t in docs], SCHEMA)
    got = {r["doc_id"]: r for r in license.scan(df).collect()}
    for d, t in docs:
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_of(t)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license.scan(none).count() == 0


def test_notices_with_words_put_in_or_left_out(spark, odd):
    words = license.NOTICES["notice-mit"][0].split()
    whole, cut, part = " ".join(words), " ".join(words[:20] + ["indeed"] + words[20:40] + words[42:]), " ".join(words[:12])
    df = spark.createDataFrame([(i, f"prose before {t} and after", "s", "en", 0) for i, t in enumerate((whole, cut, part))], SCHEMA)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license.scan(df).collect()}
    assert got[0] == ("notice-mit", 1.0) and got[1][0] == "notice-mit" and 0.6 <= got[1][1] < 1 and got[2] == ("", 0.0)
    assert license.scan(odd).count() == len(ODD)


def test_notices_drift_with_their_length_and_count_runs_once(spark):
    mit, bsd = license.NOTICES["notice-mit"][0].split(), license.NOTICES["notice-bsd"][0].split()
    some = [f"w{i}" for i in range(12)]
    texts = [
        mit[:30] + some[:4] + mit[30:], mit[:30] + some + mit[30:], bsd[:10] + some[:4] + bsd[10:],
        mit[:20] + some + mit[:8] + mit[20:],  # some words of the notice among those put in
        (mit[:12] + ["and"]) * 6,  # the same part again and again
        mit[45:] + mit[20:45] + mit[:20],  # the notice's parts backwards
        mit[:12] + some + mit + some + mit[:30],
    ]
    df = spark.createDataFrame([(i, " ".join(t), "s", "en", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license.scan(df).collect()}
    assert [got[i][0] for i in range(7)] == ["notice-mit", "notice-mit", "notice-bsd", "notice-mit", "", "", "notice-mit"]
    assert all(0.6 <= got[i][1] < 1 for i in range(4)) and got[6][1] == 1.0
    assert license.in_order([3, 1, 2, 2, 5, 4]) == 3 and license.in_order([]) == 0


LINES = [
    ("Released under the MIT License.", "notice-mit", 0), ("It is licensed under the GNU General Public License, version 3 or later", "gpl,notice-gpl", 1),
    ("Licensed under CC BY-NC 4.0 by us", "cc-by,notice-cc", 1), ("SPDX-License-Identifier: MIT", "notice-mit", 0), ("it was released under a license of MIT", "", 0),
    ("the MIT license", "", 0), ("licensed under the apache license version 2.0", "notice-apache", 0),
]


def test_notices_of_one_line_and_their_spans(spark):
    df = spark.createDataFrame([(i, f"some prose {t} more prose", "s", "en", 0) for i, (t, *_) in enumerate(LINES)], SCHEMA)
    got = {r["doc_id"]: r for r in license.scan(df).collect()}
    for i, (text, labels, n_base) in enumerate(LINES):
        r, n = got[i], len(license._split(text))
        assert (r["labels"], r["n_base"], r["score"]) == (labels, n_base, float(bool(labels))), text
        assert {s["label"] for s in r["spans"]} == set(filter(None, labels.split(",")))
        assert all(2 <= s["first"] <= s["last"] < 2 + n and 0.6 <= s["share"] <= 1 for s in r["spans"])
        assert [s["first"] for s in r["spans"]] == sorted(s["first"] for s in r["spans"])


def brute_score(text):
    """The best share of a template's runs in one span, for texts in which nothing is put into a notice."""
    words, best = license._split(text), 0.0
    for label, base, n, k, *_ in {t[:4] for t in license.templates()}:
        runs = [t[6].encode() for t in license.templates() if t[2] == n]
        at = {}
        for i in range(len(words) - k + 1):
            run = b" ".join(words[i : i + k])
            for j in (j for j, r in enumerate(runs) if r == run):
                at[i - j] = at.get(i - j, 0) + 1
        best = max([best, *(v / len(runs) for v in at.values() if v >= (1.0 if base else license.COVER) * len(runs))])
    return best


def test_score_as_by_brute_force(spark):
    mit = license.NOTICES["notice-mit"][0].split()
    texts = [" ".join(mit[:n]) for n in range(0, len(mit) + 1, 7)] + [" ".join(mit[n:]) for n in range(0, len(mit), 9)] + [t for t, *_ in LINES]
    got = {r["doc_id"]: r["score"] for r in license.scan(spark.createDataFrame([(i, t, "s", "en", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert all(got[i] == pytest.approx(brute_score(t)) for i, t in enumerate(texts))


def test_results_are_plain_json(spark):
    assert json.dumps(queries.op9_license_scan(spark, SF).limit(1).toJSON().first() or "")
