"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte 2- and 3-grams of its letters. Each language has several
centroids, found by spherical k-means, so that registers or scripts of one language need not share a mean. The
prediction is the language of the centroid with the highest cosine. A text whose cosine is below a threshold is
marked as rejected; the threshold is learned by leaving out one language at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Lower-cases A-Z and turns other ASCII into spaces; bytes of other letters stay.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


@dataclass
class Centroids:
    langs: list[str]  # of each centroid
    vectors: np.ndarray  # centroid x feature, unit rows
    idf: np.ndarray
    reach: np.ndarray  # the least cosine that counts as near, per centroid


def counts(text: bytes, dims: int, block: int = 1 << 20) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of a whole text, in blocks so that very long texts need little memory."""
    total = np.zeros(dims, np.float32)
    if not text:
        return total
    letters = b" " + b" ".join(text.translate(LETTERS).split()) + b" "
    for s in range(0, len(letters) - 1, block):
        b = np.frombuffer(letters[s : s + block + 2], np.uint8).astype(np.uint32)
        pair = b[:-1] * np.uint32(257) + b[1:]
        three = pair[:-1] * np.uint32(263) + b[2:]
        pair = pair[:block]
        for grams in (pair, three):
            total += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - int(dims).bit_length() + 1), minlength=dims)
    return total


def vectors(texts: list[bytes | None], dims: int, idf: np.ndarray | None) -> np.ndarray:
    m = np.zeros((len(texts), dims), np.float32)
    for i, text in enumerate(texts):
        m[i] = counts(text, dims) if text else 0
    m = np.log1p(m)
    return m if idf is None else unit(m * idf)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12, least: float = 0.01) -> np.ndarray:
    """Spherical k-means. Of several rows drawn by distance, the one that brings all rows nearest starts a cluster, so
    single odd rows seldom do; clusters below two rows or the share ``least`` are given up to the others."""
    rng = np.random.default_rng(0)
    c = unit(x.mean(axis=0, keepdims=True))
    while len(c) < min(k, len(x)):
        far = np.maximum(1 - (x @ c.T).max(axis=1), 0).astype(float)
        if far.sum() <= 1e-6 * len(x):
            break
        drawn = rng.choice(len(x), size=min(16, len(x)), p=far / far.sum())
        left = np.minimum(far[:, None], 1 - x @ x[drawn].T).sum(axis=0)
        c = np.concatenate([c, x[[drawn[int(left.argmin())]]]])
    while True:
        for _ in range(rounds):
            nearest = (x @ c.T).argmax(axis=1)
            c = unit(np.array([x[nearest == i].sum(axis=0) if (nearest == i).any() else c[i] for i in range(len(c))]))
        sizes = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
        if len(c) == 1 or sizes.min() >= max(2, least * len(x)):
            return c
        c = np.delete(c, int(sizes.argmin()), axis=0)


def threshold(x: np.ndarray, langs: np.ndarray, clusters: int, rejects: float = 0.95) -> float:
    """The cosine below which a text is rejected: the least that rejects the share ``rejects`` of the texts of a language
    that is left out, or, where languages are so alike that this loses more than it finds, the one with the largest
    difference between the shares of left-out and of learned texts rejected. Centroids come from one half of the rows,
    scores from the other, and every language counts the same. Fewer than two languages: 0, as there is none to leave out."""
    names = sorted(set(langs.tolist()))
    if len(names) < 2:
        return 0.0
    score, weight, known = [], [], []
    for half in (0, 1):
        learned = {n: cluster(own, clusters) for n in names if len(own := x[langs == n][half::2])}
        near = np.full((len(x), len(names)), -1.0, np.float32)
        for i, n in enumerate(names):
            if n in learned:
                near[:, i] = (x @ learned[n].T).max(axis=1)
        for i, n in enumerate(names):
            rows = near[langs == n][1 - half :: 2]
            others = np.delete(rows, i, axis=1).max(axis=1)
            for got, is_known in ((rows.max(axis=1), True), (others, False)):
                if len(got) and (not is_known or n in learned):
                    score.append(got)
                    weight.append(np.full(len(got), 1 / len(got)))
                    known.append(np.full(len(got), is_known))
    score, weight, known = map(np.concatenate, (score, weight, known))
    if not known.any():
        return 0.0
    order = np.argsort(score, kind="stable")
    score, weight, known = score[order], weight[order], known[order]
    lost = np.concatenate([[0], np.cumsum(weight * known)]) / (weight * known).sum()
    found = np.concatenate([[0], np.cumsum(weight * ~known)]) / (weight * ~known).sum()
    cut = min(int((found - lost).argmax()), int((found >= rejects - 1e-9).argmax()))  # so many of the lowest are rejected
    return float((score[cut - 1] + score[min(cut, len(score) - 1)]) / 2) if cut else 0.0


def fit(labelled: DataFrame, per_lang: int = 500, max_langs: int = 300, clusters: int = 3, dims: int = 4096) -> Centroids:
    """Learn from (doc_id, text, lang) rows with text and lang.

    The model is fitted on a bounded sample: about ``per_lang`` rows of each of the ``max_langs`` most frequent
    languages, picked by a hash of the row, so it costs the same at every size. Rejection: see ``threshold``.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not sizes:
        return Centroids([], np.zeros((0, dims), np.float32), np.ones(dims, np.float32), np.zeros(0))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"])))])
    u = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter(u < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = vectors([x.as_py() for x in batch.column(1)], dims, None).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in m], pa.binary())], ["lang", "v"])

    got = picked.select("lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, v binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    x = np.frombuffer(b"".join(r["v"] for r in got), np.float16).reshape(len(got), dims).astype(np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x, langs = unit(x * idf), np.array([r["lang"] for r in got])
    names, parts = [], []
    for lang in sorted(set(langs.tolist())):
        c = cluster(x[langs == lang], clusters)
        names += [lang] * len(c)
        parts.append(c)
    return Centroids(names, np.concatenate(parts).astype(np.float32), idf, np.full(len(names), threshold(x, langs, clusters)))


def predict(docs: DataFrame, model: Centroids, keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score (cosine, 0 to 1) and rejected to the ``keep`` columns (all by default).

    ``und`` with score 0, rejected, for a null text, one without a letter, or an empty model. Existing columns of
    those three names are replaced. Repeated rows each get their row; ties go to the first language by name.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    base = docs.select(*[F.col(f"`{c}`") for c in names], F.when(F.col("text").rlike("\\p{L}"), F.col("text").cast("binary")).alias("_bytes"))
    schema = base.drop("_bytes").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    dims = model.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                texts = [t.as_py() for t in part.column(part.num_columns - 1)]
                near = vectors(texts, dims, model.idf) @ model.vectors.T
                known = np.array([bool(t) and len(model.langs) > 0 for t in texts])
                best = near.argmax(axis=1) if len(model.langs) else np.zeros(len(texts), int)
                score = np.where(known, near[np.arange(len(texts)), best] if len(model.langs) else 0.0, 0.0).astype(float)
                lang = [model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
                far = ~known | (score < model.reach[best]) if len(model.langs) else ~known
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(far)], [*names, "lang_pred", "score", "rejected"])

    return base.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) whose language is known: neither ``und`` nor rejected."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = predict(docs.select(row, "text"), model, ["_row"]).filter(~F.col("rejected"))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
