"""Operator 8: held-out accuracy, what it must not see, and odd inputs."""

import zlib

import numpy as np
from llm_helpers import edge_docs, no_docs
from pyspark.sql import functions as F

from crease.llm import quality

SF = "/root/testdata/sf0.01"


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for s in np.unique(score):
        at = np.flatnonzero(score[order] == s)
        rank[order[at]] = at.mean() + 1
    ones = label == 1
    n = ones.sum()
    return (rank[ones].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op8_quality(spark, SF).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    score, label, predicted = map(np.array, zip(*held))
    assert area(score, label) > 0.9 and (predicted == label).mean() > 0.85


def test_labels_of_held_out_rows_and_other_columns_do_not_count(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    plain = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(None))
    changed = docs.withColumns({"lang": F.lit(None), "source": F.lit("x"), "n_chars": F.lit(0), "fold": F.lit(1), "x": F.lit("y")})
    again = {r.doc_id: r.score for r in quality.score_quality(changed, other).collect()}
    assert plain.keys() == again.keys() and all(abs(plain[k] - again[k]) < 1e-9 for k in plain)


def test_edges(spark, sf_dir):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(None, 1), (6, None), (4, 1)], "doc_id long, quality int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {True}
    assert all(r.score == 0.5 for r in quality.score_quality(docs, labels.limit(0)).collect())
    assert quality.score_quality(no_docs(spark), labels).count() == 0
    kept = quality.keep_quality(docs, labels)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.predicted for r in rows)


def test_isotonic_levels_are_the_least_squares_fit():
    found = quality.isotonic(np.array([1.0, 0, 3, 0, 2]), np.array([2.0, 2, 4, 0, 2]))
    assert np.allclose(found, [0.25, 0.25, 0.75, 0.875, 1.0])


def test_scores_equal_a_plain_solution(spark, sf_dir):
    """Statistics, features, normal equations, ridge and isotonic levels on one machine, by their definitions."""
    import zlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in docs}
    x = {i: np.array(quality.statistics(t)) for i, t in docs.items()}
    known = [i for i in docs if labels.get(i) is not None and fold[i] != 0]
    all_x = np.array([x[i] for i in known])
    mean, scale = all_x.mean(0), all_x.std(0)
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(quality.SEED)
    d, n = all_x.shape[1], quality.FEATURES
    omega = rng.normal(0, 1 / (quality.WIDTH * np.sqrt(d / 4)), (d, n))
    phase = rng.uniform(0, 2 * np.pi, n)

    def expand(v):
        return np.append(np.sqrt(2 / n) * np.cos(np.clip((v - mean) / scale, -8, 8) @ omega + phase), 1)

    learn = [i for i in known if fold[i] != 1]
    z, y = np.array([expand(x[i]) for i in learn]), np.array([labels[i] for i in learn], float)
    ridge = np.full(n + 1, quality.PENALTY * len(learn) / n)
    ridge[-1] = 1e-9 * len(learn)
    weights = np.linalg.solve(z.T @ z + np.diag(ridge), z.T @ y)
    place = lambda i: int(np.clip(np.round((expand(x[i]) @ weights + 0.5) * quality.BINS / 2), 0, quality.BINS - 1))
    ones, count = np.zeros(quality.BINS), np.zeros(quality.BINS)
    for i in known:
        if fold[i] == 1:
            ones[place(i)] += labels[i]
            count[place(i)] += 1
    full = np.flatnonzero(count)
    mean_of = lambda j, k: ones[full[j : k + 1]].sum() / count[full[j : k + 1]].sum()
    m = len(full)
    rates = [max(min(mean_of(j, k) for k in range(i, m)) for j in range(i + 1)) for i in range(m)]
    level = np.interp(np.arange(quality.BINS), full, rates)
    found = {r.doc_id: (r.held_out, r.score, r.predicted) for r in quality.op8_quality(spark, sf_dir).collect()}
    assert found.keys() == docs.keys()
    for i, (held_out, score, predicted) in found.items():
        assert held_out == (fold[i] == 0) and predicted == int(score >= 0.3)
        near = level[max(0, place(i) - 1) : place(i) + 2]  # rounding may move a document by one bin
        assert near.min() - 1e-6 <= score <= near.max() + 1e-6
    exact = sum(abs(found[i][1] - level[place(i)]) < 1e-6 for i in docs)
    assert exact >= 0.98 * len(docs)
