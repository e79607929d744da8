"""Benchmark decontamination: which words of a document lie in a 13-word window of a benchmark item.

The benchmark's normalised windows are a hash set of word ids and window hashes that every task holds. Spark counts
the items' words and deals them into blocks of at most ``max_windows`` words; the driver and the tasks hold one block at
a time, so neither what is broadcast nor the plan grows with the benchmark. Documents are scanned whole, once per block. A window is looked up by a 64-bit rolling hash
and every hit is verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, staged, text_bytes

#: Lower-cases A-Z and turns the other ASCII characters that are no word characters into spaces.
NORMAL = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text; null has none."""
    return text.translate(NORMAL).split() if text else []


class WindowSet:
    """Windows of the items, by their length in words."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            k = min(width, len(ids))
            for s in range(len(ids) - k + 1 if k else 0):
                self.items.setdefault(tuple(ids[s : s + k]), set()).add(item)
        self.hashes = {}
        for k in {len(w) for w in self.items}:
            own = np.array([w for w in self.items if len(w) == k], dtype=np.int64)
            self.hashes[k] = np.unique(rolling(own.ravel(), k)[::k])

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, set[int]]]:
        """(position, window length, items) of every window that occurs; unknown words are -1."""
        found, unknown = [], np.concatenate([[0], np.cumsum(ids < 0)])
        for k, hashes in self.hashes.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(unknown[k:] == unknown[:-k])  # no unknown word inside
            if len(at):
                at = at[np.isin(rolling_at(ids, at, k), hashes)]
            for p in at.tolist():
                items = self.items.get(tuple(ids[p : p + k].tolist()))
                if items:
                    found.append((p, k, items))
        return found


def rolling_at(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = (out ^ (ids[at + j] + 1).astype(np.uint64)) * FACTOR
        out ^= out >> np.uint64(32)
    return out


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    return rolling_at(ids, np.arange(len(ids) - k + 1), k)


HIT_SCHEMA = "doc_id long, copy long, n_words long, hit_from array<int>, hit_to array<int>, items array<long>"
HIT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in HIT_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(HIT_TYPES)], names)


def _scan(docs: DataFrame, items: list[tuple[int, bytes]], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = None
        for batch in batches:
            windows = windows or WindowSet(items, width)
            ids_of, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, texts in chunks(batch, 2):
                yield scanned(windows, ids_of[first : first + len(texts)], copies[first : first + len(texts)], texts)

    def scanned(windows: WindowSet, doc_ids: list, copies: list, texts: list[bytes | None]) -> pa.RecordBatch:
        get, counts, ids = windows.vocabulary.get, [], []
        for text in texts:
            own = words(text)
            counts.append(len(own))
            ids += [get(w, -1) for w in own]
            ids.append(-1)  # no window crosses documents
        starts = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
        hits: dict[int, list] = {}
        for p, k, found in windows.scan(np.array(ids, dtype=np.int64)):
            d = int(np.searchsorted(starts, p, side="right")) - 1
            hits.setdefault(d, []).append((p - int(starts[d]), k, found))
        rows = []
        for d, (doc_id, copy) in enumerate(zip(doc_ids, copies, strict=True)):
            own = hits.get(d, [])
            spans = merged([(p, p + k) for p, k, _ in own])
            rows.append((doc_id, copy, counts[d], [a for a, _ in spans], [b for _, b in spans], sorted(set().union(*(x for _, _, x in own)))))
        return batch_of(rows)

    return docs.mapInArrow(run, HIT_SCHEMA)


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            spans = merged([tuple(x.values()) for part in r["spans"] for x in part])
            rows.append((r["doc_id"], r["copy"], r["n_words"], [a for a, _ in spans], [b for _, b in spans], sorted({i for part in r["items"] for i in part})))
        yield batch_of(rows)


def benchmark_blocks(benchmark: DataFrame, width: int, max_windows: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of at most ``max_windows`` + ``width`` words, one after the other; at least one, maybe empty.

    A longer item is cut with overlap. Items without an id or without words have no windows. Items are dealt by hash
    into twice as many blocks until all fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words(text.as_py())
                starts = range(0, max(len(own) - width + 1, min(len(own), 1)), max_windows)
                parts = [own[s : s + max_windows + width - 1] for s in starts]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array(list(map(len, parts)), pa.int64()), pa.array([b" ".join(p) for p in parts], pa.binary())], ["item", "start", "size", "words"]
                )

    items = benchmark.select(F.col("item_id").cast("long"), text_bytes()).dropna()
    parts = staged(items.mapInArrow(run, "item long, start long, size long, words binary"))
    n = max(1, -(-(parts.agg(F.sum("size")).first()[0] or 0) // max_windows))
    while True:
        block = F.pmod(F.xxhash64("item", "start"), F.lit(n))
        over = parts.groupBy(block.alias("b")).agg(F.sum("size").alias("size"), F.count("*").alias("parts")).filter((F.col("size") > max_windows) & (F.col("parts") > 1))
        if over.isEmpty():
            break
        n *= 2
    for b in range(n):
        yield [(r["item"], bytes(r["words"])) for r in parts.filter(block == b).select("item", "words").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 13, max_windows: int = 2_000_000) -> DataFrame:
    """Per document row: doc_id, n_words, the merged word spans [hit_from, hit_to) that windows cover, and the items.

    Null and empty texts have no words and no hits. A null ``doc_id`` stays null. Repeated rows each get their row.
    Extra columns are ignored. An empty benchmark hits nothing.
    """
    ids = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), text_bytes().alias("text"))
    blocks = benchmark_blocks(benchmark, width, max_windows)
    whole = _scan(ids, next(blocks), width)
    parts = []
    for block in blocks:
        if block:
            parts.append(staged(_scan(ids, block, width).filter(F.size("items") > 0)))
    if not parts:
        return whole.drop("copy")
    # a document hit in several blocks: at most a row per block, none of them longer than the document
    whole = staged(whole)
    hits = whole.filter(F.size("items") > 0)
    for part in parts:
        hits = hits.unionByName(part)
    spans = F.collect_list(F.arrays_zip("hit_from", "hit_to")).alias("spans")
    grouped = hits.dropDuplicates().groupBy("doc_id", "copy").agg(F.max("n_words").alias("n_words"), spans, F.collect_list("items").alias("items"))
    joined = grouped.mapInArrow(_join_blocks, HIT_SCHEMA).select(F.col("doc_id").alias("_doc"), F.col("copy").alias("_copy"), F.struct("hit_from", "hit_to", "items").alias("_hits"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy"))
    found = lambda c: F.coalesce(F.col("_hits").getField(c), F.col(c)).alias(c)
    return whole.join(joined, same, "left").select("doc_id", "n_words", found("hit_from"), found("hit_to"), found("items"))


def n_hit(df: DataFrame) -> DataFrame:
    lengths = F.zip_with("hit_from", "hit_to", lambda a, b: (b - a).cast("long"))
    return df.withColumn("n_hit", F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x))


def contaminated(least_percent: int = 5):
    """A document counts as contaminated when hits make up at least that share of its words."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= least_percent * F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", width: int = 13, least_percent: int = 5, max_windows: int = 2_000_000) -> DataFrame:
    """Remove leaks from a document table, keeping its columns and all other rows.

    ``document`` drops contaminated documents (every row of a contaminated ``doc_id``); ``span`` cuts the hit words
    out of every text, with what stands between them. Rows with a null ``doc_id`` are kept by ``document``.
    """
    if mode == "document":
        bad = n_hit(find_leaks(docs, benchmark, width, max_windows)).filter(contaminated(least_percent)).select("doc_id").distinct()
        return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
    if mode != "span":
        raise ValueError(f"unknown mode {mode}")
    leaks = find_leaks(docs, benchmark, width, max_windows).filter(F.size("hit_from") > 0).groupBy("doc_id").agg(F.max_by(F.struct("hit_from", "hit_to"), F.size("items")).alias("_spans"))
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    joined = docs.join(leaks, "doc_id", "left")
    parts = F.split(F.regexp_replace("text", f"({word})", "\u0001$1\u0001"), "\u0001")  # gap, word, gap, word, ..., gap
    inside = lambda i: F.exists(F.arrays_zip("_spans.hit_from", "_spans.hit_to"), lambda s: (i >= s["hit_from"] * 2 + 1) & (i <= s["hit_to"] * 2 - 1))
    kept = F.array_join(F.filter(parts, lambda p, i: ~inside(i)), "")
    return joined.withColumn("text", F.when(F.col("_spans").isNotNull(), kept).otherwise(F.col("text"))).select(docs.columns)
