"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact check.

1.  One pass over the texts gives each document its set of k-word shingles (as
    64-bit hashes), the set's size and identity, and a signature of
    ``bands * rows`` MinHash values of 16 bits.  Documents with equal sets are
    one class from here on, so thousands of copies are one row.
2.  Classes that share a band fall into a bucket; buckets with the same members
    count once.
3.  Buckets are not worked off by all pairs.  First, each member is compared with
    its bucket's leader, the member that shares most buckets with others, so that
    most of a group of near copies falls into one component at about one
    comparison each.  Then only members outside their bucket's largest component
    are compared with those of other components, in blocks of at most ``BLOCK``
    a side, dealt out over tasks and compared as arrays.  Signatures alone move
    first; only members that a pair has left move again, with their texts, and a
    task then verifies the most similar pairs first and skips what its findings
    have joined already.  Every pair of a bucket is compared or in one component,
    so no component is lost, and what leaves a task is at most one link for each
    member.
4.  A pair's signatures are compared in batches.  After n values with m equal
    the posterior of the similarity s under a uniform prior is
    Beta(m + 1, n - m + 1); the pair is dropped as soon as
    P(s >= threshold) < ``miss``.  Survivors are confirmed on their full sets in
    integers.
5.  Confirmed links give connected components.  A doc_id that stands on several
    texts is one document, so their classes are linked too.

A pair at the threshold of 0.8 shares no band with probability
(1 - 0.8 ** rows) ** bands, 2e-5 by default.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .graph import components
from .shared import Scratch

BANDS, ROWS = 36, 6
#: Signature values that are compared between two looks at the posterior.
BATCH = 24
#: Chosen probability that a pair at the threshold is pruned at one look.
MISS = 1e-6
#: Members on one side of two blocks that are compared.
BLOCK = 256
#: Hashes of one text that are worked on together.
WIDTH = 4096


@lru_cache(maxsize=4)
def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 32, (n, 1), dtype=np.uint64).astype(np.uint32)
    return draw() | np.uint32(1), draw()


def signature(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n MinHash values of 16 bits of a set of 64-bit hashes."""
    a, b = _coefficients(n, seed)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), WIDTH):
        np.minimum(low, (short[i : i + WIDTH] * a + b).min(axis=1), out=low)
    low *= np.uint32(0x9E3779B1)  # the least values differ in their low bits; all bits go into the 16
    return (low >> np.uint32(16)).astype("<u2")


def _sign(k: int, n: int):
    def run(batches):
        for batch in batches:
            sizes, first, second, signs = [], [], [], []
            for w in W.words(batch.column("text")):
                for i in range(len(w.first) - 1):
                    found = W.shingle_set(w.hashes[w.first[i] : w.first[i + 1]], k)
                    sizes.append(len(found))
                    first.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                    second.append(int(W.mix(found ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)))
                    signs.append(signature(found, n).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(signs, pa.binary())],
                names=["doc_id", "digest", "n_shingles", "set_a", "set_b", "sig"],
            )

    return run


def _band(bands: int, rows: int):
    def run(batches):
        roll = W._ROLL[:rows]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(n, bands, rows)
            keys = W.mix((sig.astype(np.uint64) * roll).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
            rep, size = (np.repeat(batch.column(c).to_numpy(), bands) for c in ("rep", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(rep), pa.array(size)], names=["key", "rep", "n"])

    return run


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest equal values among n that leave P(s >= threshold) at ``miss`` or more.

    Under a uniform prior P(s >= t | m of n) is the chance that n + 1 coins of
    bias t show at most m heads.
    """
    below, m = 0.0, -1
    while below < miss:
        m += 1
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
    return m


def _prune(n: int, threshold: float, miss: float):
    looks = [(at, least_matches(at, threshold, miss)) for at in [*range(BATCH, n, BATCH), n]]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, n) for c in ("sig_a", "sig_b"))
            alive, equal, seen = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for at, least in looks:
                equal = equal + (left[alive, seen:at] == right[alive, seen:at]).sum(axis=1)
                keep = equal >= least
                alive, equal, seen = alive[keep], equal[keep], at
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("a", "b")], names=["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _confirm(k: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            for side in ("a", "b"):
                ids = batch.column(side).to_pylist()
                new = [i for i, x in enumerate(ids) if x not in sets and not sets.update({x: None})]
                texts = batch.column(f"text_{side}").take(pa.array(new, pa.int64()))
                for w in W.words(texts):
                    for i in range(len(w.first) - 1):
                        sets[ids[new[w.row + i]]] = W.shingle_set(w.hashes[w.first[i] : w.first[i + 1]], k)
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                if _linked(sets[a], sets[b], num, den):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def _alive(left: list[dict], right: list[dict], num: int, den: int, n: int, looks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place on the left, place on the right, equal values) of the pairs of two blocks that their signatures leave."""
    size_l, size_r, c_l, c_r, id_l, id_r = (np.array([r[c] for r in side]) for c in ("n", "c", "rep") for side in (left, right))
    fit = (c_l[:, None] != c_r) & (den * np.minimum(size_l[:, None], size_r) >= num * np.maximum(size_l[:, None], size_r))
    # a pair of two outliers stands in two blocks
    a, b = np.nonzero(fit & (~np.array([r["out"] for r in right]) | (id_l[:, None] < id_r)))
    sig_l, sig_r = (np.frombuffer(b"".join(r["sig"] for r in side), "<u2").reshape(-1, n) for side in (left, right))
    equal, seen = np.zeros(len(a), np.int64), 0
    for at, least in looks:
        equal = equal + (sig_l[a, seen:at] == sig_r[b, seen:at]).sum(axis=1)
        a, b, equal, seen = a[equal >= least], b[equal >= least], equal[equal >= least], at
    return a, b, equal


def _by_block(work):
    """Runs ``work(left, right)`` on each pair of blocks; rows come sorted by bucket, i, j and side."""

    def run(batches):
        group, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["bucket"], r["i"], r["j"]) != group:
                    yield from sides(rows)
                    group, rows = (r["bucket"], r["i"], r["j"]), []
                rows.append(r)
        yield from sides(rows)

    def sides(rows: list[dict]):
        left, right = ([r for r in rows if r["side"] == side] for side in (0, 1))
        if left and right:
            yield from work(left, right)

    return run


def _sift(num: int, den: int, n: int, miss: float):
    """The members of each pair of blocks that some pair of signatures leaves."""
    looks = [(at, least_matches(at, num / den, miss)) for at in [*range(BATCH, n, BATCH), n]]
    kinds = {"bucket": pa.int64(), "i": pa.int32(), "j": pa.int32(), "side": pa.int32(), "rep": pa.int64(), "n": pa.int64(), "c": pa.int64(), "out": pa.bool_()}

    def work(left: list[dict], right: list[dict]):
        a, b, _ = _alive(left, right, num, den, n, looks)
        kept = [left[i] for i in np.unique(a)] + [right[i] for i in np.unique(b)]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], t) for c, t in kinds.items()], names=list(kinds))

    return _by_block(work)


def _settle(k: int, num: int, den: int, n: int, miss: float):
    """Links between the components of a bucket, from its blocks."""
    looks = [(at, least_matches(at, num / den, miss)) for at in [*range(BATCH, n, BATCH), n]]

    def work(left: list[dict], right: list[dict]):
        a, b, equal = _alive(left, right, num, den, n, looks)
        up: dict[int, int] = {}
        found: list[tuple[int, int]] = []

        def top(v: int) -> int:
            while up.setdefault(v, v) != v:
                up[v] = v = up[up[v]]
            return v

        sets: dict[tuple[int, int], np.ndarray] = {}

        def shingles(side: int, i: int) -> np.ndarray:
            if (side, i) not in sets:
                (w,) = W.words(pa.array([(left, right)[side][i]["text"]]))
                sets[side, i] = W.shingle_set(w.hashes, k)
            return sets[side, i]

        for o in np.argsort(-equal, kind="stable").tolist():
            u, v = top(left[a[o]]["c"]), top(right[b[o]]["c"])
            if u != v and _linked(shingles(0, a[o]), shingles(1, b[o]), num, den):
                up[u] = v
                found.append((left[a[o]]["rep"], right[b[o]]["rep"]))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return _by_block(work)


_SAME = ["set_a", "set_b", "n_shingles"]


def _resolve(
    scratch: Scratch, docs: DataFrame, k: int, num: int, den: int, bands: int, rows: int, miss: float, whole: bool
) -> DataFrame:
    """(doc_id, digest, n_shingles, component, first_id) of each row; component is null where there are no words.

    ``digest`` is a hash of the text, ``first_id`` the least doc_id of the
    component.  Rows without doc_id take part only if ``whole``.
    """
    n = bands * rows
    # what identifies a row, without nulls, so that joins and distinct rows share a partitioning
    id_ = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("digest", F.xxhash64("text"))
    signed = base.mapInArrow(_sign(k, n), "doc_id long, digest long, n_shingles long, set_a long, set_b long, sig binary")
    signed = scratch.save(signed.withColumn("seq", F.monotonically_increasing_id()))
    some = signed.where("n_shingles > 0" if whole else "n_shingles > 0 and doc_id is not null")
    # a class by its set; its row of least doc_id and digest stands for it
    classes = some.groupBy(*_SAME).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "seq")).alias("x"))
    classes = scratch.save(classes.select(*_SAME, "x.doc_id", F.col("x.seq").alias("rep")))
    signs = signed.join(classes.select(F.col("rep").alias("seq")), "seq", "left_semi")
    signs = scratch.save(signs.select(F.col("seq").alias("rep"), F.col("n_shingles").alias("n"), "sig", id_.alias("id"), "digest"))

    banded = signs.mapInArrow(_band(bands, rows), "key long, rep long, n long")
    met = banded.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("m > 1")
    met = scratch.save(met.groupBy("m", "who").agg(F.min("key").alias("key")).select("key"))
    members = scratch.save(banded.join(met, "key").select(F.col("key").alias("bucket"), "rep", "n"))
    scratch.free(met)
    edges = _verify_buckets(scratch, base.select(id_.alias("id"), "digest", "text"), signs, members, k, num, den, n, miss)
    scratch.free(members, signs)

    # a doc_id of several sets is one document
    set_ = F.struct(*_SAME)
    several = some.where("doc_id is not null").groupBy("doc_id").agg(F.min(set_).alias("low"), F.max(set_).alias("high")).where("low <> high")
    several = scratch.save(several.select("doc_id"))
    if not several.isEmpty():
        theirs = some.join(several, "doc_id").join(classes.select(*_SAME, "rep"), _SAME).select("doc_id", "rep")
        least = theirs.groupBy("doc_id").agg(F.min("rep").alias("a"))
        edges = edges.union(theirs.join(least, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct())
    labels = components(scratch, edges)

    found = classes.join(labels.toDF("rep", "component"), "rep", "left").select(*_SAME, "doc_id", F.coalesce("component", "rep").alias("component"))
    found = scratch.save(found)
    first = found.groupBy("component").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("m"))
    linked = found.join(first.where("m > 1").select("component", "first_id"), "component", "left")
    linked = linked.select(*_SAME, "component", F.coalesce("first_id", "doc_id").alias("first_id"))
    return signed.drop("sig").join(linked, _SAME, "left").select("doc_id", "digest", "n_shingles", "component", "first_id")


def near_duplicates(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS, miss: float = MISS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Documents whose sets of k-word shingles have a Jaccard similarity of at
    least num / den are linked; component_id is the smallest doc_id reachable.
    Null texts and texts without words have n_shingles 0 and are linked with
    nothing.  Rows that repeat a doc_id are one document, by all of their texts,
    and each has its own n_shingles; a null doc_id is in no component
    (component_id null) and kept.  An empty table gives an empty one.  Other
    columns of ``docs`` play no part.
    """
    out = _resolve(Scratch(docs.sparkSession, "minhash"), docs, k, num, den, bands, rows, miss, whole=False)
    # rows without words may repeat the doc_id of a row with some
    named = out.where("doc_id is not null and component is not null").groupBy("doc_id").agg(F.min("first_id").alias("own"))
    bare = out.where("doc_id is not null and component is null")
    bare = bare.join(named, "doc_id", "left").withColumn("component_id", F.coalesce("own", "doc_id")).drop("own")
    rest = out.where("doc_id is null or component is not null")
    rest = rest.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("first_id")))
    out = rest.unionByName(bare)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row of ``docs``, with all its columns, of each group of near copies: that of the smallest doc_id.

    Here rows without doc_id are copies like others, and of rows that repeat a
    doc_id or stand there several times one stays, too; rows without words are
    copies of nothing and all stay.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    out = scratch.save(_resolve(scratch, docs, k, num, den, bands, rows, miss, whole=True).where("component is not null"))
    id_, digest = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.col("text").cast("string"))
    none = F.col("doc_id").isNull()
    first = out.groupBy("component").agg(F.min(F.struct(none.alias("none"), id_.alias("id"), "digest")).alias("x")).select("x.id", "x.digest")
    rows_ = out.groupBy(id_.alias("id"), "digest").agg(F.count("*").alias("times"))
    gone = scratch.save(rows_.join(first, ["id", "digest"], "left_anti").select(F.col("id").alias("gone_id"), F.col("digest").alias("gone")))
    twice = rows_.where("times > 1").join(first, ["id", "digest"], "left_semi")
    twice = scratch.save(twice.select(F.col("id").alias("gone_id"), F.col("digest").alias("gone")))
    same = lambda other: (id_ == other["gone_id"]) & (digest == other["gone"])
    left = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return left
    alike = docs.join(twice, same(twice), "left_semi").withColumns({"_id": id_, "_digest": digest}).dropDuplicates(["_id", "_digest"]).drop("_id", "_digest")
    return left.join(twice, same(twice), "left_anti").union(alike)


def _verify_buckets(
    scratch: Scratch, base: DataFrame, signs: DataFrame, members: DataFrame, k: int, num: int, den: int, n: int, miss: float
) -> DataFrame:
    """Confirmed links (a, b) between classes, which span their components; see step 3 of the module."""
    pair = "a long, b long"
    met = members.select("rep").distinct()
    # by hash at every size: the texts move once, and what moves grows with the input
    wanted = signs.join(met.hint("shuffle_hash"), "rep", "left_semi").select("rep", "sig", "id", "digest")
    known = base.join(wanted.hint("shuffle_hash"), ["id", "digest"]).dropDuplicates(["id", "digest"])
    known = scratch.save(known.select("rep", "sig", "text"))
    sigs, texts = known.select("rep", "sig"), known.select("rep", "text")

    degree = members.groupBy("rep").agg(F.count("*").alias("degree"))
    leads = members.join(degree, "rep").groupBy("bucket").agg(F.max(F.struct("degree", "rep", "n")).alias("x"))
    leads = scratch.save(leads.select("bucket", F.col("x.rep").alias("lead"), F.col("x.n").alias("lead_n")))
    rest = members.join(leads, "bucket").where("rep <> lead")
    pairs = rest.where(den * F.least("n", "lead_n") >= num * F.greatest("n", "lead_n"))
    pairs = pairs.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    likely = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b").mapInArrow(_prune(n, num / den, miss), pair)
    both = likely.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    edges = scratch.save(both.mapInArrow(_confirm(k, num, den), pair))
    labels = components(scratch, edges)

    now = rest.join(labels, rest["rep"] == labels["node"], "left")
    now = scratch.save(now.select("bucket", "rep", "n", F.coalesce("component", "rep").alias("c")))
    parts = now.groupBy("bucket", "c").agg(F.count("*").alias("m"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("m", "c")).alias("x"), F.sum("m").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    open_ = open_.select("bucket", F.col("x.c").alias("main"), blocks(F.col("m")).alias("right"), blocks(F.col("m") - F.col("x.m")).alias("left"))
    rows = now.join(open_, "bucket").withColumn("out", F.col("c") != F.col("main"))
    own = lambda many: F.pmod(F.xxhash64("rep", "bucket"), F.col(many)).cast("int")
    upto = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
    at = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    places = F.concat(
        F.transform(upto("left"), lambda i: at(i, own("right"), 1)),
        F.when(F.col("out"), F.transform(upto("right"), lambda j: at(own("left"), j, 0))).otherwise(F.array()),
    )
    rows = rows.select("bucket", "rep", "n", "c", "out", F.explode(places).alias("x")).select("bucket", "x.*", "rep", "n", "c", "out")
    dealt = lambda df: df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    left = dealt(rows.join(sigs, "rep")).mapInArrow(_sift(num, den, n, miss), "bucket long, i int, j int, side int, rep long, n long, c long, out boolean")
    more = scratch.save(dealt(scratch.save(left).join(known, "rep")).mapInArrow(_settle(k, num, den, n, miss), pair))
    scratch.free(now, leads, known)
    return edges.union(more)
