"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is read as lower-cased code points with all but ASCII letters, digits and
non-ASCII characters as blanks, and its n-grams (of ``SIZES`` characters) are
hashed into buckets.  Bucket j has the log-count ratio r_j of the naive Bayes
model, from the numbers of toxic and clean training texts that hold it; the
classifier's features are the n-gram counts scaled by r_j, so its score of a span
is bias + sum of r_j v_j.

A toxic document may be toxic in one place only, so a document scores as its
worst span: all spans of ``SPAN`` characters, ``STRIDE`` apart, over the whole
text, which is worked on in parts.  v starts at 1, which is plain naive Bayes, and
is then fitted by logistic regression on each training text's worst span, chosen
anew in each round, so that clean texts contribute their most suspicious spans.
A last logistic fit of slope and offset, on training texts that the weights
haven't seen, turns sums into probabilities.

Training reads at most ``per_class`` texts of either label, by hash of doc_id, of
at most ``LONGEST`` bytes each; these bounds are the only sampling.  It runs in
one task, and its model is an array of ``2 ** BITS`` weights.  Scoring is one pass
without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import ship

SIZES = (3, 4, 5)
BITS = 20
SPAN, STRIDE = 320, 160
#: Span starts of a text that are worked on together.
PART = 4096 * STRIDE
#: The most training texts of each label, and their most bytes.
PER_CLASS, LONGEST = 4000, 1 << 16
ROUNDS = 4
#: Of so many training texts one is kept for the last logistic fit alone.
CALIBRATION = 5
#: A bucket that fewer training texts hold has no weight.
LEAST_TEXTS = 5

_ASCII = np.where(W.ALNUM, W._LOWER, 0x20).astype(np.uint32)[:128]
_MUL = np.uint32(0x01000193)


def points(text: str | None) -> np.ndarray:
    """The code points that a text is read as."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(x < 128, _ASCII[np.minimum(x, 127)], x)


def buckets(text: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
    """Bucket of the n-gram that ends at each position, a row for each of SIZES; 0 where none does.

    Positions are those of the text's characters with a blank before and one
    behind; of them the ones from ``start`` to ``end``.
    """
    end = len(text) + 2 if end is None else end
    low = max(0, start - max(SIZES) + 1)
    x = np.full(end - low, 0x20, np.uint32)
    inside = text[max(0, low - 1) : end - 1]
    x[max(0, 1 - low) : max(0, 1 - low) + len(inside)] = inside
    x *= np.uint32(0x9E3779B1)
    out = np.zeros((len(SIZES), len(x)), np.int32)
    h = x.copy()
    for n in range(2, max(SIZES) + 1):
        if n > len(x):
            break
        h = h[:-1] * _MUL + x[n - 1 :]
        if n in SIZES:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)
            out[SIZES.index(n), n - 1 :] = mixed >> np.uint32(32 - BITS)
    return out[:, start - low :]


def spans(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the spans of n positions; the last one ends at n."""
    starts = np.arange(0, max(1, n - SPAN + STRIDE), STRIDE)
    return starts, np.minimum(starts + SPAN, n)


@dataclass
class Model:
    weights: np.ndarray  # float32; bucket 0 is 0
    slope: float = 1.0
    offset: float = -30.0

    def worst(self, text: np.ndarray) -> tuple[float, int, int]:
        """Largest sum over the spans of one text, and that span."""
        starts, ends = spans(len(text) + 2)
        best = (-np.inf, 0, 0)
        for at in range(0, len(starts), PART // STRIDE):
            s, e = starts[at : at + PART // STRIDE], ends[at : at + PART // STRIDE]
            found = buckets(text, int(s[0]), int(e[-1]))
            sums = np.concatenate(([0.0], np.cumsum(self.weights[found].sum(axis=0, dtype=np.float64))))
            by_span = sums[e - s[0]] - sums[s - s[0]]
            i = int(by_span.argmax())
            best = max(best, (float(by_span[i]), -int(s[i]), int(e[i])))  # of equal ones the first
        return best[0], -best[1], best[2]

    def score(self, text: np.ndarray) -> float:
        z = self.slope * self.worst(text)[0] + self.offset if len(text) else self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def ratios(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The log-count ratio of each bucket: of the shares, with one added, of toxic and clean texts that hold it."""
    held = np.zeros((2, 1 << BITS))
    for text, y in zip(texts, labels):
        held[y, np.unique(buckets(text))] += 1
    n = np.bincount(labels, minlength=2)
    r = np.log((held[1] + 1) / (n[1] + 2)) - np.log((held[0] + 1) / (n[0] + 2))
    r[held.sum(axis=0) < LEAST_TEXTS] = 0
    r[0] = 0
    return r


def fit(texts: list[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    """Trains on texts (their points) and 0/1 labels; ``prior`` is the share of toxic texts in the corpus."""
    size, everything = 1 << BITS, (texts, labels)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(size, np.float32), 0.0, 30.0 if len(labels) and labels[0] else -30.0)
    fitted = np.arange(len(texts)) % CALIBRATION > 0
    if len(set(labels[fitted])) == len(set(labels[~fitted])) == 2:
        texts, labels = [t for t, f in zip(texts, fitted) if f], labels[fitted]
    r = ratios(texts, labels)
    v, squares, bias = np.ones(size), np.full(size, 1e-1), 0.0
    model, rng = Model(r.astype(np.float32)), np.random.default_rng(5)
    for _ in range(ROUNDS):
        picked = []
        for text in texts:
            _, a, b = model.worst(text)
            picked.append(np.unique(buckets(text, a, b), return_counts=True))
        for _ in range(3):
            for i in rng.permutation(len(texts)):
                js, counts = picked[i]
                x = r[js] * counts
                p = 1 / (1 + np.exp(-np.clip(bias + x @ v[js], -30, 30)))
                g = (p - labels[i]) * x + 1e-4 * (v[js] - 1)
                squares[js] += g * g
                v[js] -= 0.1 * g / np.sqrt(squares[js])
                bias -= 0.02 * (p - labels[i])
        model = Model((r * v).astype(np.float32))
    if len(everything[0]) > len(texts):
        texts, labels = [t for t, f in zip(everything[0], fitted) if not f], everything[1][~fitted]
    n = np.bincount(labels, minlength=2)
    z = np.array([model.worst(text)[0] for text in texts])
    weight = np.where(labels == 1, prior / n[1], (1 - prior) / n[0]) * len(labels)
    centre, scale = z.mean(), z.std() + 1e-9
    t = np.array([1.0, 0.0])
    features = np.stack(((z - centre) / scale, np.ones_like(z)), 1)
    for _ in range(50):  # Newton, with a ridge that keeps a separable fit finite
        p = 1 / (1 + np.exp(-np.clip(features @ t, -30, 30)))
        grad = features.T @ (weight * (p - labels)) + 0.01 * t
        hess = (features * (weight * p * (1 - p))[:, None]).T @ features + 0.01 * np.eye(2)
        t -= np.linalg.solve(hess, grad)
    slope = max(t[0], 1e-6) / scale
    return Model(model.weights, float(slope), float(t[1] - slope * centre))


def held_out(doc_id):
    """Rows whose labels are never learnt from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fits on the labelled texts that are not held out; no labels give a model that scores near 0.

    A doc_id that has both labels is not learnt from; of one that stands on
    several texts each is a training text.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("high")).where("y = high").drop("high")
    share = known.agg(F.avg("y")).first()[0]
    if share is None:
        return fit([], np.empty(0, np.int64), 0.0)
    chosen = [known.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = chosen[0].union(chosen[1])  # 2 * per_class rows at most, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = rows.select("doc_id", "y", "text").repartition(1)

    def run(batches):
        got = sorted(x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y"))))
        m = fit([points(x[1]) for x in got], np.array([x[2] for x in got], np.int64), share)
        yield pa.RecordBatch.from_pydict({"weights": [m.weights.tobytes()], "slope": [m.slope], "offset": [m.offset]})

    row = rows.mapInArrow(run, "weights binary, slope double, offset double").first()
    if row is None:
        return fit([], np.empty(0, np.int64), 0.0)
    return Model(np.frombuffer(row["weights"], np.float32), row["slope"], row["offset"])


def _scores(model: Model, column) -> np.ndarray:
    return np.array([model.score(points(text.as_py())) for text in column])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Null and empty texts score as a text without n-grams, near 0; equal texts
    score alike; a null doc_id is not held out.  An empty table gives an empty
    one; other columns play no part.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(_scores(shared.value, b.column("text")))], names=["doc_id", "held_out", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = base.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(shared.value, b.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
