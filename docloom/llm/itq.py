"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index Hamming tables, exact rerank.

Iterative quantisation learns, on a bounded sample, a rotation under which the
signs of the centred vectors lose least; each bit is cut at its median over the
sample's distinct vectors, so that codes are balanced.  Several rotations from
different starts give the bits of as many tables as the wanted recall needs.
Every table keys a vector by ``width`` bits of its code; the width follows the
number of vectors, so that a key holds about a hundred of them, and the number
of tables follows from the width.  It is measured: cuts lie around the data's
centre, where a pair at the threshold subtends a larger angle if vectors share a
direction, so pairs of just the threshold's cosine are built from sampled
vectors, and there are so many tables that a share ``miss`` of them at most
shares no key or is further apart than the Hamming radius, which is measured on
the same pairs.  ``plan`` gives the number for vectors without a common
direction; where twice as many are too few, keys get narrower, down to one key
for all.

Through the tables go codes only.  The members of one key are compared by the
Hamming distance of their whole codes; those within the radius of another, in
the first table that both share, go on to the rerank, and only there do the
original vectors come in: pairs are linked by their cosine in doubles.  A hot key
is split into blocks of ``BLOCK`` members and its pairs of blocks are dealt out,
so no task holds a key.  As a pair counts in its first table only, which a task
sees from the codes, counts need no list of pairs: a task returns, for each
vector of a block, its number of links, and edges that span them.  Equal vectors
are one vector with a count throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch

#: Vectors that the rotations are learnt on, at most, by hash of vec_id.
SAMPLE = 8192
ITERATIONS = 30
BLOCK = 2048
#: Vectors of a key, as a power of two.
FILL = 7
MISS = 0.03
#: Pairs of each kind that the recall is measured on.
PROBES = 4096


def thin(sample: np.ndarray, threshold: float) -> np.ndarray:
    """The unit vectors that are near no earlier one, so that a crowd of near copies weighs as one vector.

    Else the median of a bit would lie within the crowd and part its members.
    """
    kept = np.empty((0, sample.shape[1]))
    for at in range(0, len(sample), 256):
        block = sample[at : at + 256]
        block = block[(block @ kept.T).max(axis=1, initial=-1) < threshold]
        near = np.tril(block @ block.T >= threshold, -1).any(axis=1)
        kept = np.concatenate((kept, block[~near]))
    return kept


def learn(sample: np.ndarray, rotations: int, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rotation, cuts) pairs: bit j of x is (x @ rotation)[j] > cuts[j]."""
    out, dims = [], sample.shape[1]
    mean = sample.mean(axis=0)
    x = sample - mean
    for r in range(rotations):
        rotation, _ = np.linalg.qr(np.random.default_rng(seed + r).standard_normal((dims, dims)))
        for _ in range(ITERATIONS):
            codes = np.where(x @ rotation > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(x.T @ codes)
            rotation = u @ vt
        out.append((rotation, np.median(sample @ rotation, axis=0)))
    return out


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key, and number of tables, for n vectors."""
    width = max(4, math.ceil(math.log2(max(2, n))) - FILL)
    agree = (1 - math.acos(threshold) / math.pi) ** width
    return width, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is divided out first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bits(x: np.ndarray, model: list) -> np.ndarray:
    return np.concatenate([x @ r > c for r, c in model], axis=1)


def _picks(bits: int, width: int, tables: int) -> np.ndarray:
    """The bits of each table's key."""
    if bits < width * tables:  # short vectors: tables draw their bits
        return np.random.default_rng(9).integers(0, bits, (tables, width))
    return np.arange(width * tables).reshape(tables, width)


def probes(x: np.ndarray, threshold: float, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of unit vectors of just the threshold's cosine: y lies in any direction from x, or towards another vector of x."""
    rng, out = np.random.default_rng(seed), []
    x = x[np.arange(max(len(x), PROBES)) % len(x)][:PROBES]
    for way in (rng.standard_normal(x.shape), x[rng.permutation(len(x))]):
        way = way - (way * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(way, axis=1)
        some = size > 1e-6
        if some.any():
            out.append((x[some], threshold * x[some] + math.sqrt(1 - threshold**2) * way[some] / size[some, None]))
    return out


def fit(x: np.ndarray, held: np.ndarray, n: int, threshold: float, miss: float = MISS) -> tuple[list, int, int, int]:
    """(model, width, tables, radius) for n vectors, learnt on ``x``; tables and radius suffice for pairs built from ``held``."""
    (width, tables), dims = plan(n, threshold, miss), x.shape[1]
    most = 2 * tables
    model = learn(x, -(-width * tables // dims) if dims > 8 else 4)
    pairs = probes(held, threshold) + probes(thin(held, threshold), threshold)  # as vectors lie, and with a crowd as one
    agree = [_bits(a, model) == _bits(b, model) for a, b in pairs]

    def enough(most: int) -> tuple[int, int]:
        """The least number of tables that meets the plan, with its radius; 0 tables if more than ``most``."""
        met, apart = ([np.zeros(len(g), kind) for g in agree] for kind in (bool, np.int64))
        for t, picks in enumerate(_picks(len(model) * dims, width, most)):
            for m, d, g in zip(met, apart, agree):
                m |= g[:, picks].all(axis=1)
                d += (~g[:, picks]).sum(axis=1)
            if t + 1 >= tables:
                radius = int(max((np.quantile(d, 1 - miss / 10, method="higher") for d in apart), default=width * tables))
                if all((m & (d <= radius)).mean() >= 1 - miss for m, d in zip(met, apart)):
                    return t + 1, radius
        return 0, 0

    if dims > 8 and not enough(tables)[0]:
        model += learn(x, -(-width * most // dims) - len(model), seed=3 + len(model))
        agree = [_bits(a, model) == _bits(b, model) for a, b in pairs]
    while width and not enough(most)[0]:
        width, tables = width - 1, 1
    return model, width, *(enough(most) if width else (1, 0))


def keys(x: np.ndarray, model: list, width: int, tables: int) -> np.ndarray:
    """Key of each vector in each table."""
    bits = _bits(x, model)
    picks = _picks(bits.shape[1], width, tables)
    out = np.zeros((len(x), tables), np.int64)
    for b in range(width):
        out |= bits[:, picks[:, b]].astype(np.int64) << b
    return out


def _code(width: int) -> str:
    """The smallest type of a key."""
    return "<u2" if width <= 16 else "<u4" if width <= 32 else "<i8"


def _encode(model: list, width: int, tables: int, kind: str):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            x = np.asarray(flat, np.float64).reshape(batch.num_rows, -1)
            k = keys(unit(x), model, width, tables)
            raw = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
            code = pa.array([v.tobytes() for v in k.astype(_code(width))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("many"), raw, code], names=["rep", "many", "raw", "code"])

    return run


def _entries(width: int, tables: int):
    """(rep, cell) of each vector and table; a cell is a table's key."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), _code(width)).reshape(-1, tables)
                cell = code.astype(np.int64) * tables + np.arange(tables)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), tables)), pa.array(cell.ravel())], names=["rep", "cell"])

    return run


#: Groups of so many vectors are compared pair by pair, many groups at once; larger ones as matrices.
SMALL = 48


def _pairs(group: np.ndarray, ends: np.ndarray, side: np.ndarray, whole: np.ndarray, x: np.ndarray, least: float):
    """Places of the pairs within each group of sorted rows whose product is ``least`` or more."""
    starts = np.concatenate(([0], ends[:-1]))
    left, right = [], []
    small = (ends - starts <= SMALL)[group]
    for d in range(1, SMALL):
        a = np.flatnonzero((group[d:] == group[:-d]) & small[d:]) if d < len(group) else np.empty(0, np.int64)
        if not len(a):
            break
        a = a[whole[a] | (side[a] != side[a + d])]
        a = a[np.einsum("ij,ij->i", x[a], x[a + d]) >= least]
        left.append(a)
        right.append(a + d)
    for s, e in zip(starts, ends):
        if e - s > SMALL:
            cut = s + int(np.searchsorted(side[s:e], 1)) if not whole[s] else e
            a, b = np.nonzero(x[s:cut] @ x[s if whole[s] else cut : e].T >= least)
            a, b = a + s, b + (s if whole[s] else cut)
            up = a < b
            left.append(a[up])
            right.append(b[up])
    return np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])


def _span(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which pairs of places under n make a spanning forest: each root hooks on to its least neighbour, round by round."""
    top, left, kept = np.arange(n), np.arange(len(a)), []
    while True:
        low, high = np.minimum(top[a[left]], top[b[left]]), np.maximum(top[a[left]], top[b[left]])
        left, low, high = (v[low < high] for v in (left, low, high))
        if not len(left):
            return np.concatenate(kept) if kept else left
        to = np.arange(n)
        np.minimum.at(to, high, low)
        least = to[high] == low
        pick = np.full(n, -1)
        pick[high[least]] = left[least]
        kept.append(pick[pick >= 0])
        while (to[to] != to).any():
            to = to[to]
        top = to[top]


_NAMES = ("cell", "i", "j", "side", "rep")
_ROW = "cell long, i int, j int, side int, rep long"


def _by_group(binaries: tuple[str, ...], numbers: tuple[str, ...], work):
    """Runs ``work`` on whole groups of rows, many at once; rows come sorted by cell, i, j and side."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            table = {c: batch.column(c).to_numpy().astype(np.int64) for c in numbers} | {c: batch.column(c).to_pylist() for c in binaries}
            if held:
                table = {c: np.concatenate((held[c], v)) if c in numbers else held[c] + v for c, v in table.items()}
            head = np.stack([table[c] for c in _NAMES[:3]])
            last = int(np.flatnonzero((head != head[:, -1:]).any(axis=0)).max(initial=-1)) + 1  # the last group may go on
            if last:
                yield work({c: v[:last] for c, v in table.items()})
            held = {c: v[last:] for c, v in table.items()}
        if held:
            yield work(held)

    return run


def _groups(table: dict) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's group, and the groups' ends."""
    head = np.stack([table[c] for c in _NAMES[:3]])
    new = np.concatenate(([True], (head[:, 1:] != head[:, :-1]).any(axis=0)))
    return np.cumsum(new) - 1, np.append(np.flatnonzero(new)[1:], len(new))


def _first(code: np.ndarray, cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether no table before the one at hand holds both of a pair in one key."""
    tables = code.shape[1]
    first, step = np.ones(len(a), bool), max(1, (4 << 20) // tables)
    for at in range(0, len(a), step):
        p, q = a[at : at + step], b[at : at + step]
        before = np.arange(tables) < (cell[p] % tables)[:, None]
        first[at : at + step] = ~((code[p] == code[q]) & before).any(axis=1)
    return first


def _sift(width: int, radius: int):
    """The rows that are within the Hamming radius of another of their group whose first table it is."""

    def work(table: dict) -> pa.RecordBatch:
        group, ends = _groups(table)
        code = np.frombuffer(b"".join(table["code"]), _code(width)).reshape(len(group), -1)
        bits = (code[:, :, None] >> np.arange(width, dtype=code.dtype)) & 1
        signs = (bits.reshape(len(group), -1) * 2.0 - 1).astype(np.float32)
        a, b = _pairs(group, ends, table["side"], table["i"] == table["j"], signs, signs.shape[1] - 2 * radius)
        first = _first(code, table["cell"], a, b)
        some = np.unique(np.concatenate((a[first], b[first])))
        return pa.RecordBatch.from_arrays([pa.array(table[c][some], pa.int64() if c in ("cell", "rep") else pa.int32()) for c in _NAMES], names=list(_NAMES))

    return _by_group(("code",), _NAMES, work)


def _link(threshold: float, kind: str, width: int):
    """Links and spanning edges of each group of rows, by cosine."""

    def work(table: dict) -> pa.RecordBatch:
        group, ends = _groups(table)
        x = unit(np.frombuffer(b"".join(table["raw"]), kind).reshape(len(group), -1).astype(np.float64))
        a, b = _pairs(group, ends, table["side"], table["i"] == table["j"], x, threshold)
        first = _first(np.frombuffer(b"".join(table["code"]), _code(width)).reshape(len(group), -1), table["cell"], a, b)
        a, b = a[first], b[first]
        links = sum(np.bincount(p, table["many"][q], len(group)) for p, q in ((a, b), (b, a))).astype(np.int64)
        edges, rep, some = _span(a, b, len(group)), table["rep"], np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((rep[some], rep[a[edges]]))), pa.array([None] * len(some) + rep[b[edges]].tolist(), pa.int64()),
                pa.array(np.concatenate((links[some], np.zeros(len(edges), np.int64)))),
            ],
            names=["a", "b", "links"],
        )

    return _by_group(("raw", "code"), (*_NAMES, "many"), work)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Vectors with a cosine of at least ``threshold`` are linked; n_links counts
    the other rows linked directly, equal ones too.  Null vectors, zero vectors
    and vectors with null or non-finite components link with nothing, and only
    vectors of one length are compared.  Rows that repeat a vec_id with the same
    vector count as separate rows in n_links; a null vec_id is in no component
    and kept.  An empty table gives an empty one; other columns play no part.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "itq")
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: c + F.lit(0.0))  # -0.0 is 0.0
    base = scratch.save(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda c: c != 0)
    classes = scratch.save(base.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")))
    lengths = [(r["d"], r["n"]) for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()]
    found = scratch.save(spark.createDataFrame([], "a long, b long, links long"))
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"  # what holds the values exactly
    for dims, n in lengths:
        mine = classes.where(F.size("embedding") == dims)
        found = scratch.save(found.union(_one_length(scratch, mine, n, dims, kind, threshold, sample)))
    labels = components(scratch, found.where("b is not null").select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    classes = classes.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(labels.toDF("rep", "component"), "rep", "left")
    classes = classes.select("embedding", "many", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = base.withColumn("ok", F.when(sound, F.col("embedding"))).join(classes.withColumnRenamed("embedding", "ok"), "ok", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id", F.coalesce(F.col("many") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _one_length(scratch: Scratch, classes: DataFrame, n: int, dims: int, kind: str, threshold: float, sample: int) -> DataFrame:
    """(a, b, links) over classes of vectors of one length: links of a, or an edge where b isn't null."""
    picked = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").collect()  # bounded
    x = unit(np.array([r["embedding"] for r in picked], np.float64))
    part = len(x) // 5 if n > sample else 0  # of a true sample, a fifth is held out; else all vectors are learnt on
    model, width, tables, radius = fit(thin(x[part:], threshold), x[:part] if part else x, n, threshold)
    coded = scratch.save(classes.mapInArrow(_encode(model, width, tables, kind), "rep long, many long, raw binary, code binary"))
    entries = coded.select("rep", "code").mapInArrow(_entries(width, tables), "rep long, cell long")
    shared = entries.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1")
    shared = scratch.save(shared.select("cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    met = entries.join(shared, "cell").withColumn("own", F.pmod(F.xxhash64("rep", "cell"), F.col("blocks")).cast("int"))
    met = met.select("rep", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1)
    met = met.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "rep")
    dealt = lambda df: df.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")
    near = scratch.save(dealt(met.join(coded.select("rep", "code"), "rep")).mapInArrow(_sift(width, radius), _ROW))
    return dealt(near.join(coded, "rep")).mapInArrow(_link(threshold, kind, width), "a long, b long, links long")
