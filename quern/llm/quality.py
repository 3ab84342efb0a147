"""Quality classifier: naive Bayes log-count ratios as features of a linear hinge-loss model (dual coordinate descent).

Features are indicators of n-grams, hashed to ``BUCKETS``: one and two words, and one to three word *shapes*. A shape
keeps a word's kind, not its letters: ``=`` if it repeats the word before, else its runs of letters (all upper case or not), runs of
digits and other characters, in order. With p and q the smoothed indicator counts of the two
classes, r = log((p / |p|) / (q / |q|)); a document's vector is its indicators scaled by r, at unit length. The hinge-loss
dual is solved one coordinate at a time; weights are interpolated with their mean magnitude; margins of rows left out of
the fit give a logistic calibration, corrected to the classes' shares before sampling.

Learned from a bounded sample: about ``SAMPLE`` labelled rows of each class, chosen by a hash of the id, in one task; of
texts that share an id the least counts.

Defined results: null and empty texts have no features and get the calibrated score of the bias; rows without a label teach
nothing; of several labels of a document the least counts; with fewer than two classes the score is that class (or 0.5);
repeated rows are scored each; texts of any length are scored whole; null ids fold as the empty string; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import parts, placed, table
from .language import fold

SAMPLE = 6_000  # labelled rows of each class, about
BUCKETS = 1 << 19
MIN_ROWS = 3  # of the sample that must hold an n-gram
EPOCHS, COST, BLEND = 10, 1.0, 0.75
THRESHOLD = 0.7
CACHE = 150_000  # words that a worker remembers
REPEAT = 0x3D3D3D3D
PIECE = 200_000  # words of a text that are looked at together

_DIGIT, _WORD = re.compile(r"\d+"), re.compile(r"[^\W\d_]+")
_TWICE = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    upper = word.upper() == word and word.lower() != word
    kind = _DIGIT.sub("0", word)
    kind = _WORD.sub("A" if upper and sum(c.isalpha() for c in word) > 1 else "a", kind)
    return _TWICE.sub(r"\1", kind)


class Features:
    """N-gram buckets of texts; remembers words."""

    def __init__(self) -> None:
        self.cache: dict[str, tuple[int, int]] = {}

    def _new(self, word: str) -> tuple[int, int]:
        out = (zlib.crc32(word.lower().encode("utf-8", "surrogatepass")), zlib.crc32(shape(word).encode("utf-8", "surrogatepass"), 77))
        self.cache[word] = out
        return out

    def of(self, text: str | None) -> np.ndarray:
        """The distinct buckets of a text, sorted."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, dtype=np.int64)
        if len(self.cache) > CACHE:
            self.cache = {}
        parts = []
        get, new = self.cache.get, self._new
        for i in range(0, len(words), PIECE):  # pieces overlap by the longest n-gram less one, and the word before that
            found = np.array([get(w) or new(w) for w in words[max(0, i - 3) : i + PIECE]], dtype=np.uint32)
            w, s = found[:, 0].astype(np.uint64), found[:, 1].astype(np.uint64)
            s[1:][w[1:] == w[:-1]] = REPEAT
            if i > 2:
                w, s = w[1:], s[1:]  # only there to tell whether the next word repeats it
            m = np.uint64(0x9E3779B97F4A7C15)
            two = s[:-1] * m + s[1:]
            three = two[:-1] * m + s[2:]
            for salt, h in ((1, w), (2, w[:-1] * m + w[1:]), (3, s), (4, two), (5, three)):
                mixed = (h + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)
                parts.append((mixed ^ (mixed >> np.uint64(29))) * m >> np.uint64(64 - 19))
        return np.unique(np.concatenate(parts)).astype(np.int64)


def descend(docs: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rows: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of least |w|^2 / 2 + bias^2 / 2 + sum of cost * hinge loss over ``rows``, by dual coordinate descent.

    A row's vector has ``values`` at the buckets ``docs``, at unit length or empty; the bias is one more feature, of value one.
    """
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(rows):
            f, v, yi = docs[i], values[i], int(y[i])
            gradient = yi * (float(w[f] @ v) + bias) - 1
            old = alpha[i]
            square = (1.0 if len(f) else 0.0) + 1.0
            alpha[i] = min(max(old - gradient / square, 0.0), cost[i])
            step = (alpha[i] - old) * yi
            if step:
                w[f] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def fit(rows: list[tuple[int, np.ndarray]], shares: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Weights and ratios by bucket, bias, and the slope and offset of the calibration. rows: (label, buckets); shares before sampling."""
    y = np.array([1 if label == 1 else -1 for label, _ in rows])
    order = np.random.default_rng(5).permutation(len(rows))
    apart = np.zeros(len(rows), dtype=bool)
    apart[order[: len(rows) // 5]] = True
    known = np.zeros(BUCKETS, dtype=np.int64)
    p, q = np.ones(BUCKETS), np.ones(BUCKETS)
    for i, (label, f) in enumerate(rows):
        if not apart[i]:
            known[f] += 1
            (p if label == 1 else q)[f] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[known < MIN_ROWS] = 0
    docs = [f[ratio[f] != 0] for _, f in rows]
    norms = [float(np.sqrt((ratio[f] ** 2).sum())) or 1.0 for f in docs]
    values = [ratio[f] / n for f, n in zip(docs, norms)]
    n_pos, n_neg = max(1, int(((y == 1) & ~apart).sum())), max(1, int(((y == -1) & ~apart).sum()))
    cost = np.where(y == 1, COST * (n_pos + n_neg) / (2 * n_pos), COST * (n_pos + n_neg) / (2 * n_neg))
    w, bias = descend(docs, values, y, cost, np.flatnonzero(~apart))
    used = ratio != 0
    mean = float(np.abs(w[used]).mean()) if used.any() else 0.0
    w = np.where(used, (1 - BLEND) * mean * np.sign(w) + BLEND * w, 0.0)
    margin = np.array([float(w[docs[i]] @ values[i]) + bias for i in range(len(rows))])
    held = apart if len(set(y[apart])) == 2 else np.ones(len(rows), dtype=bool)
    m, t = margin[held], (y[held] + 1) / 2
    n1, n0 = max(1.0, t.sum()), max(1.0, len(t) - t.sum())
    weight = np.where(t == 1, shares[1] / n1, shares[0] / n0) * len(t)
    target = np.where(t == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps on the weighted log loss
        s = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        g, h = weight * (s - target), weight * s * (1 - s) + 1e-9
        hessian = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, np.array([(g * m).sum(), g.sum()]))
        size = np.abs(step).max()
        step = step * min(1.0, 2.0 / size) if size else step
        a, b = a - step[0], b - step[1]
        if size < 1e-6:
            break
    return (w * ratio).astype(np.float32), ratio.astype(np.float32), bias, float(a), float(b)


class Scorer:
    def __init__(self, weights: np.ndarray, ratio: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.square, self.bias, self.slope, self.offset = weights, ratio.astype(np.float64) ** 2, bias, slope, offset
        self.features = Features()

    def score(self, text: str | None) -> float:
        f = self.features.of(text)
        size = float(np.sqrt(self.square[f].sum())) or 1.0
        margin = float(self.weights[f].sum()) / size + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> list:
    """The model (weights, ratios, bias, slope, offset; empty arrays if there is nothing to learn), fitted in one task."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    shares = (counts.get(0, 0) / max(1, total), counts.get(1, 0) / max(1, total))
    if len(counts) < 2:
        return [np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 0.0, {0: -35.0, 1: 35.0}.get(next(iter(counts), -1), 0.0)]
    spot = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) / (1 << 20)
    keep = F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("label") == label) & (spot < sample / n))
    chosen = known.where(keep)  # 2 x SAMPLE rows, about: small enough to send to every executor
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, rows = Features(), []
        for batch in batches:
            rows += [(a, features.of(t)) for a, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        if rows:
            w, r, *rest = fit(rows, shares)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.tobytes()]), pa.array([r.tobytes()]), pa.array([[float(x) for x in rest]])], names=["w", "r", "rest"]
            )

    found = texts.repartition(1).mapInArrow(run, "w binary, r binary, rest array<double>").collect()
    if not found:
        return [np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 0.0, 0.0]
    return [np.frombuffer(bytes(found[0]["w"]), np.float32), np.frombuffer(bytes(found[0]["r"]), np.float32), *found[0]["rest"]]


def score(docs: DataFrame, model: list, text_col: str = "text", into: str = "score") -> DataFrame:
    """The rows of ``docs`` with the probability of label 1 added (a column of that name is replaced)."""
    base = docs.drop(into)
    at, rows = base.columns.index(text_col), placed(base)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in parts(batches):
            new = pa.array([scorer.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("score", "double")).toDF(*base.columns, into)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of three folds of four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    found = score(docs, train(docs, labels))
    return found.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
