"""A quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text; that a document of label 1 is preferred to one of label 0 has the
logistic probability of the difference of their strengths. The weights minimise that loss over preference pairs (Newton's
method on feature differences, ridge). The threshold is the quantile of the training strengths at the share of label 0; a
strength there has the score 0.3, and the score is logistic in the strength, so that ``score >= 0.3`` is the quantile rule.

Training takes at most MAX_LABELLED labelled documents (those with the least hash of their id) and MAX_PAIRS pairs, both parameters;
scoring reads every whole text, with no shuffle. Labels, lang, source and doc_id are not inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deskdb.llm.common import documents, spread

MAX_LABELLED = 20_000
MAX_PAIRS = 200_000
HELD_OUT, FOLDS = 0, 5
CUT = 0.3
RIDGE = 1e-3
SLICE = 1 << 20
WINDOW_WORDS = 200

_WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Byte classes whose share among a text's bytes is a feature.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|", b"#$%&*@^~=+<>\\/_", b".", b",;:", b"\n\r", b"\"'`()[]{}", bytes(range(32)).translate(None, b"\t\n\r")]
FEATURES = ["upper", "digit", "mark", "bar", "symbol", "stop", "comma", "line", "bracket", "control", "high", "repeat", "distinct", "word_bytes", "log_words", "odd_words", "no_words"]


def text_features(text: str | None) -> list[float]:
    """The features of a whole text, taken in slices so that memory stays bounded; null counts as empty."""
    raw = (text or "").encode()
    counts, words, repeats, fresh, odd = np.zeros(256, np.int64), 0, 0, 0.0, 0
    lo, held, last = 0, [], b""
    while lo < len(raw):
        cut = _WHITE.search(raw, lo + SLICE)  # no word is cut
        hi = cut.start() if cut else len(raw)
        part = raw[lo:hi]
        counts += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        own = part.split()
        words += len(own)
        repeats += sum(map(bytes.__eq__, own, own[1:])) + (own[:1] == [last])
        odd += sum(map(bytes.isupper, own))
        last = own[-1] if own else last
        held += own
        whole = len(held) // WINDOW_WORDS * WINDOW_WORDS
        for k in range(0, whole, WINDOW_WORDS):
            fresh += len(set(held[k : k + WINDOW_WORDS]))
        held = held[whole:]
        lo = hi
    fresh += len(set(held))
    n, w = max(1, len(raw)), max(1, words)
    shares = [counts[list(c)].sum() / n for c in CLASSES]
    return [*shares, counts[128:].sum() / n, repeats / w, fresh / w, min(50.0, len(raw) / w) / 10, np.log1p(words) / 10, odd / w, float(words == 0)]


def _feature_rows(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """columns and ``x``, the features."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([text_features(t) for t in b.column("__text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), x], [*columns, "x"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text).alias("__text")).mapInArrow(run, f"{schema}, x array<double>")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


class Ranking:
    """Weights, and what turns a strength into a score."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, threshold: float) -> None:
        self.weights, self.mean, self.scale, self.threshold = weights, mean, scale, threshold

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.strength(x) - self.threshold, -500, 500) + np.log(CUT / (1 - CUT))
        score = 1 / (1 + np.exp(-z))
        return np.where(z >= np.log(CUT / (1 - CUT)), np.maximum(score, CUT), score)


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, seed: int = 1) -> Ranking:
    """Bradley-Terry weights from rows of features and labels. Without both labels, all strengths are 0 and all scores CUT or more."""
    x, y = np.asarray(x, float).reshape(len(y), -1 if len(y) else len(FEATURES)), np.asarray(y)
    mean = x.mean(0) if len(x) else np.zeros(len(FEATURES))
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(len(FEATURES))
    z = np.clip((x - mean) / scale, -20, 20) if len(x) else x
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(len(mean))
    if not len(good) or not len(bad):
        return Ranking(weights, mean, scale, 0.0 if len(good) or not len(bad) else 1.0)
    if len(good) * len(bad) <= max_pairs:
        a, b = np.repeat(good, len(bad)), np.tile(bad, len(good))
    else:
        rng = np.random.default_rng(seed)
        a, b = (np.resize(rng.permutation(rows), max_pairs) for rows in (good, bad))  # each row as often as any other, in some pair
        b = rng.permutation(b)
    d = z[a] - z[b]
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(d @ weights, -500, 500)))
        grad = RIDGE * weights - d.T @ p / len(d)
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ weights)
    k = len(bad)
    return Ranking(weights, mean, scale, float((s[k - 1] + s[k]) / 2))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, text: str = "text") -> Ranking:
    """Several labels of a document are averaged; null labels and ids are left out, and so are documents of the held-out fold."""
    own = labels.filter("doc_id is not null and quality is not null").filter(fold(F.col("doc_id")) != HELD_OUT)
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("__y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("__text")).join(F.broadcast(own), "doc_id")  # max_labelled rows
    # of repeated rows one is taken, or a copied id could fill the sample
    rows = rows.groupBy("doc_id", "__y").agg(F.min("__text").alias("__text"))
    got = sorted(((r["doc_id"], r["__y"], r["x"]) for r in _feature_rows(rows, ["doc_id", "__y"], "__text").collect()), key=lambda r: r[0])
    return fit(np.array([r[2] for r in got]), np.array([r[1] for r in got], int))


def with_scores(docs: DataFrame, ranking: Ranking, score: str, text: str = "text") -> DataFrame:
    """``docs`` with the column ``score``; only the texts go to Python."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(ranking.score(np.array([text_features(t) for t in texts.to_pylist()]).reshape(len(texts), -1)), pa.float64())

    return docs.withColumn(score, run(F.coalesce(F.col(text), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null texts count as empty and are scored as such. Repeated rows get equal scores. Rows with a null doc_id are not held out. Without
    labels of both kinds every score is the same. Other columns, also one named score, are ignored.
    """
    ranking = train(docs, labels, text=text)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    made = with_scores(spread(ids), ranking, "score").select("doc_id", held.alias("held_out"), "score")
    return made.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


QUERIES = {"op5_quality": op5_quality}
ORACLE: dict = {}
