"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w x): one weight per word, shared by all ordered thresholds theta. Words are
chosen by their association with the grade over a bounded sample of labelled rows, the model is fitted on the
same rows, and documents are scored whole: expected severity is the sum over k of P(grade > k).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_bytes
from .decontaminate import words


@dataclass
class OrdinalModel:
    words: dict[bytes, float]
    thresholds: np.ndarray  # ascending; one less than grades

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -60, 60)))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_features: int, n_grades: int, l2: float = 1.0, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds maximising the penalised likelihood (Adam on the whole batch)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.fromiter((f for r in rows for f in r), np.int64, len(at))
    k = n_grades - 1
    share = np.array([(grades <= j).mean() for j in range(k)]).clip(1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(n_features), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        w, t = params[:n_features], np.cumsum(np.concatenate([params[n_features : n_features + 1], np.exp(params[n_features + 1 :])]))
        score = np.bincount(at, w[feature], minlength=len(rows))
        bounds = np.concatenate([[-np.inf], t, [np.inf]])
        upper, lower = bounds[grades + 1] - score, bounds[grades] - score
        pu, pl = np.where(np.isinf(upper), 1.0, sigmoid(upper)), np.where(np.isinf(lower), 0.0, sigmoid(lower))
        p = np.maximum(pu - pl, 1e-12)
        du, dl = pu * (1 - pu) / p, pl * (1 - pl) / p
        g_score = du - dl  # of the loss
        g_theta = np.zeros(k)
        np.add.at(g_theta, grades[grades < k], -du[grades < k])
        np.add.at(g_theta, grades[grades > 0] - 1, dl[grades > 0])
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(feature, g_score[at], minlength=n_features) + l2 * w, tail[:1], tail[1:] * np.exp(params[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:n_features], np.cumsum(np.concatenate([params[n_features : n_features + 1], np.exp(params[n_features + 1 :])]))


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", max_rows: int = 20_000, max_words: int = 2_000, least_df: int = 5, least_z: float = 5.0) -> OrdinalModel:
    """Learn from ``labels`` (doc_id and an integer grade from 0).

    The documented bound: about ``max_rows`` labelled documents, picked by a hash of doc_id, and the ``max_words``
    words whose document counts differ most from their share of positive grades (|z| >= ``least_z``). Rows with a
    null id, text or grade are left out. Without two grades the model knows no words and finds nothing.
    """
    known = labels.select("doc_id", F.col(grade).cast("int").alias("_grade")).dropna().filter("_grade >= 0")
    n = known.count()
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, max_rows / max(n, 1))))
    rows = docs.select("doc_id", "text").dropna().join(F.broadcast(picked), "doc_id").select("_grade", text_bytes())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                own = [sorted(set(words(t.as_py()))) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.binary()))], ["grade", "words"])

    bags = rows.mapInArrow(split, "grade int, words array<binary>")
    totals = {r["grade"]: r["count"] for r in bags.groupBy("grade").count().collect()}
    grades, total = max(totals, default=0) + 1, sum(totals.values())
    bad = total - totals.get(0, 0)
    if grades < 2 or not bad or bad == total:
        return OrdinalModel({}, np.array([60.0]))
    base = bad / total
    df = bags.select(F.explode("words").alias("word"), (F.col("grade") > 0).cast("int").alias("bad")).groupBy("word").agg(F.count("*").alias("n"), F.sum("bad").alias("b"))
    z = (F.col("b") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    best = df.filter(F.col("n") >= least_df).withColumn("z", z).filter(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "word").limit(max_words).collect()
    index = {bytes(r["word"]): i for i, r in enumerate(best)}

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({index[w] for w in words(t.as_py()) if w in index}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["grade", "found"])

    data = rows.mapInArrow(seen, "grade int, found array<int>").collect()
    weights, thresholds = fit_ordinal([r["found"] for r in data], np.array([r["grade"] for r in data]), len(index), grades)
    return OrdinalModel({w: float(weights[i]) for w, i in index.items()}, thresholds)


def grade_documents(docs: DataFrame, model: OrdinalModel, keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """The ``keep`` columns with severity (expected grade), grade (the most probable) and toxic.

    Whole texts are scored; a null or empty text has the severity of a text without known words. Repeated rows each
    get their row, ties between grades go to the lower. ``toxic`` means P(grade > 0) >= ``least``.
    """
    base = docs.select(*keep, text_bytes().alias("_bytes"))
    schema = base.drop("_bytes").schema.add("severity", "double").add("grade", "integer").add("toxic", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.words
        for batch in batches:
            score = [math.fsum(weights[w] for w in weights.keys() & set(words(t.as_py()))) for t in batch.column(batch.num_columns - 1)]
            above = model.above(np.array(score))
            each = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], axis=1)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            extra = [pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= least)]
            yield pa.RecordBatch.from_arrays([*columns, *extra], schema.names)

    return base.mapInArrow(run, schema)
