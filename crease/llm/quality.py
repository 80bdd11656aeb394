"""Operator 8: quality scores by random Fourier features, ridge regression and isotonic calibration."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm.common import map_batches, materialize, read_table, texts_of

#: Random features, kernel width and ridge penalty; seed of the random features.
FEATURES, WIDTH, PENALTY, SEED = 192, 4.0, 1e-3, 20240
#: Bins of the raw score in which calibration counts labels: what the driver sees of the labels, at any input size.
BINS = 512
#: Documents whose crc32 has this remainder modulo FOLDS are never learned from; this other fold calibrates.
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 1

STATISTICS = [
    "log_bytes",
    "log_words",
    "letters",
    "upper",
    "digits",
    "spaces",
    "marks",
    "pipes",
    "exclamations",
    "symbols",
    "other_bytes",
    "sentence_ends",
    "word_length",
    "distinct_words",
    "top_word",
    "same_as_before",
    "distinct_lines",
    "line_length",
]

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGITS = np.arange(48, 58)
_MARKS = [ord(c) for c in ",;:'\"-()"]
_SYMBOLS = [ord(c) for c in "#$%&*@^~<>{}[]\\/_=+`"]


def statistics(text: str) -> list[float]:
    """The numbers of a text that its score depends on; all finite, for empty texts too."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(len(raw), 1)
    counts = np.bincount(raw, minlength=256)
    part = lambda codes: counts[codes].sum() / n
    words = text.split()
    m = max(len(words), 1)
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = text.split("\n")
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        part(_LOWER),
        part(_UPPER),
        part(_DIGITS),
        (counts[32] + counts[10]) / n,
        part(_MARKS),
        counts[124] / n,
        counts[33] / n,
        part(_SYMBOLS),
        counts[128:].sum() / n,
        (counts[46] + counts[63]) / m,
        sum(map(len, words)) / m,
        len(kinds) / m,
        max(kinds.values(), default=0) / m,
        sum(map(str.__eq__, words, words[1:])) / m,
        len(set(lines)) / len(lines),
        np.log1p(len(text) / len(lines)),
    ]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fold (crc32 of the key as text modulo FOLDS; HELD_OUT for a null key) and the statistics of each text."""
    kind = docs.schema[key].dataType.simpleString()

    def start():
        def each(batch: pa.RecordBatch):
            rows = np.array([statistics(x) for x in texts_of(batch, text)])
            offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32())
            x = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(key), x], [key, "x"])

        return each

    out = map_batches(docs.select(key, text), f"`{key}` {kind}, x array<double>", start)
    fold = F.coalesce((F.crc32(F.col(key).cast("string")) % FOLDS).cast("int"), F.lit(HELD_OUT))
    return out.withColumn("fold", fold)


class Model(NamedTuple):
    """A fitted scorer; its size depends on FEATURES and BINS alone."""

    mean: np.ndarray
    scale: np.ndarray
    low: np.ndarray
    high: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, with a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase)
        return np.hstack([waves, np.ones((len(x), 1))])

    def bins(self, x: np.ndarray) -> np.ndarray:
        raw = self.expand(x) @ self.weights
        return np.clip(np.round((raw + 0.5) * (BINS / 2)), 0, BINS - 1).astype(int)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.levels[self.bins(x)]


def isotonic(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing rates of ones per count, by pooling adjacent violators; gaps are interpolated."""
    full = np.flatnonzero(counts)
    if not len(full):
        return np.linspace(0, 1, len(counts))
    blocks: list[list[float]] = []
    for i in full:
        blocks.append([ones[i], counts[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, b, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + c]
    rates = np.concatenate([np.full(int(c), a / b) for a, b, c in blocks])
    return np.interp(np.arange(len(counts)), full, rates)


def fit(labelled: DataFrame, label: str = "quality") -> Model:
    """Fit on rows of features() joined with a 0/1 label; rows of the HELD_OUT fold and null labels are left out.

    Each task adds up its share of the normal equations and sends their entries, (FEATURES + 1)² / 2 numbers; Spark
    sums them by entry, so the driver gets one copy whatever the input. The CALIBRATE fold gives the counts by bin
    that the isotonic levels come from. Without any label, or with one kind only, scores are constant.
    """
    rows = labelled.filter((F.col("fold") != HELD_OUT) & F.col(label).isNotNull()).select(
        "x", "fold", F.col(label).cast("double").alias("y")
    )
    d = len(STATISTICS)
    numbers = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i")
    stats = {
        r["i"]: r
        for r in numbers.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("*").alias("n")).collect()
    }
    mean = np.array([stats[i]["m"] if i in stats else 0.0 for i in range(d)])
    scale = np.array([stats[i]["s"] if i in stats else 1.0 for i in range(d)])
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    omega = rng.normal(0, 1 / (WIDTH * np.sqrt(d / 4)), (d, FEATURES))
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    unfit = Model(mean, scale, mean, mean, omega, phase, np.zeros(FEATURES + 1), np.full(BINS, 0.5))
    m = FEATURES + 1
    upper = np.triu_indices(m)

    def equations(batches):
        gram, right = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            if batch.num_rows:
                z = unfit.expand(_matrix(batch.column("x")))
                gram += z.T @ z
                right += z.T @ batch.column("y").to_numpy()
        values = np.concatenate([gram[upper], right])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["k", "v"])

    sums = (
        rows.filter(F.col("fold") != CALIBRATE)
        .mapInArrow(equations, "k int, v double")
        .groupBy("k")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    values = np.zeros(len(upper[0]) + m)
    for k, v in sums:
        values[k] = v
    gram = np.zeros((m, m))
    gram[upper] = values[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    n = gram[-1, -1]
    if not n:
        return unfit
    ridge = np.eye(m) * PENALTY * n / FEATURES
    ridge[-1, -1] = 1e-9 * n
    ready = unfit._replace(weights=np.linalg.solve(gram + ridge, values[len(upper[0]) :]))

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                at = ready.bins(_matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("y")], ["bin", "y"])

    counts, ones = np.zeros(BINS), np.zeros(BINS)
    calibrating = rows.filter(F.col("fold") == CALIBRATE).mapInArrow(binned, "bin int, y double")
    for b, c, s in calibrating.groupBy("bin").agg(F.count("*"), F.sum("y")).collect():
        counts[b], ones[b] = c, s
    return ready._replace(levels=np.clip(isotonic(ones, counts), 0, 1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def apply(model: Model, rows: DataFrame, threshold: float) -> DataFrame:
    """rows of features() with score and predicted (1 if score >= threshold); x is dropped."""
    kept = [f for f in rows.schema if f.name != "x"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = model.score(_matrix(batch.column("x")))
                more = [pa.array(score), pa.array((score >= threshold).astype("i4"), pa.int32())]
                names = [f.name for f in kept]
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), *more], [*names, "score", "predicted"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{types}, score double, predicted int")


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """key, held_out, score (0 to 1) and predicted (0/1) of each document; one row per row of docs.

    The statistics of every whole text are worked out once and kept in shared storage; only they, not the texts, are
    joined with the labels. Held-out documents (crc32 of the key as text divisible by 5, and null keys) are scored but
    never learned from. A null text is empty; keys may repeat, each row is scored, and each label of a repeated key
    counts. labels: key and a 0/1 label; null labels and keys are left out. No labels give every document 0.5.
    """
    rows = materialize(features(docs, key, text))
    model = fit(rows.join(labels.select(key, label), key), label)
    return apply(model, rows, threshold).select(
        key, (F.col("fold") == HELD_OUT).alias("held_out"), "score", F.col("predicted")
    )


def keep_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """The rows of docs, with all their columns, that score_quality would predict as 1.

    The texts are read twice, to fit and to filter, and never shuffled; each row is judged by its own text.
    """
    rows = materialize(features(docs, key, text))
    model = fit(rows.join(labels.select(key, label), key), label)

    def start():
        def each(batch: pa.RecordBatch):
            score = model.score(np.array([statistics(x) for x in texts_of(batch, text)]))
            yield batch.filter(pa.array(score >= threshold))

        return each

    return map_batches(docs, docs.schema, start)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
