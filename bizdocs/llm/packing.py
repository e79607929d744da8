"""Best-fit-decreasing packing of documents into token sequences.

Documents become token ids with an end id after each. One of more than ``size`` tokens is cut into pieces of
``size``; its first piece takes the remainder. Pieces are then packed by best fit in decreasing order of
length: each goes into the tightest open sequence that still holds it, found in logarithmic time in a
segment tree over remaining capacities.

Which sequence gets which *length* depends on lengths alone, so the packing runs on the histogram of lengths
(at most ``size`` numbers, whatever the corpus holds) and gives runs: "the next k pieces of length l go to
sequences s, s+1, ... at offset o". Pieces of equal length are interchangeable, so a piece needs only its rank
among those of its length: its position within its task, kept when it is written, plus the count of earlier
tasks. No task ever holds a group of pieces, and the result has exactly as many sequences as document-by-document
best-fit decreasing over the whole corpus.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Remember, staged

ADDED = {"<|endoftext|>": 50256}  # the added token of the vocabulary
NEAR_SPACE = re.compile(r"\s | \s")


class TokenBytes:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    A space between two other characters that are no white space always starts a new pre-token of the byte-level
    pattern, so a text is cut at spaces and every distinct word is encoded once per task. A text with white space
    next to a space is encoded whole. Strings of ``added`` tokens in a text are those tokens.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] = ADDED):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = lambda text: np.asarray(encoding.encode_ordinary(text), "<u4").tobytes()
        self.first = Remember(self.whole)
        self.later = Remember(lambda word: self.whole(" " + word))
        self.added = {name: np.array([i], "<u4").tobytes() for name, i in added.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, added)) + ")")

    def __call__(self, text: str) -> bytes:
        if any(name in text for name in self.added):
            return b"".join(self.added.get(part) or self.plain(part) for part in self.cuts.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or NEAR_SPACE.search(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))


def pieces(tokens: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: full pieces of ``size``, the remainder first."""
    head = tokens % size or size
    return [(0, head), *((s, size) for s in range(head, tokens, size))]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, position long"


def cut_documents(docs: DataFrame, ranks_path: str, pattern: str, size: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its position among the pieces of its length in its task.

    A null text counts as empty (one piece: the end id); a null ``doc_id`` stays null; repeated rows are packed
    as often as they occur; columns other than ``doc_id`` and ``text`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = None, np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            encode = encode or TokenBytes(ranks_path, pattern)
            out: list[list] = [[] for _ in range(8 if with_ids else 7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(pieces(len(ids) // 4, size)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = [doc_id, k, start, length, zlib.crc32(own), task, seen[length]]
                    seen[length] += 1
                    for column, value in zip(out, row + [own] if with_ids else row, strict=True):
                        column.append(value)
            arrays = [pa.array(x, t) for x, t in zip(out, [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()], strict=False)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "position", "ids"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA + ", ids binary" * with_ids)


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which have open sequences, and the tightest that is enough."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.has = bytearray(2 * self.n)

    def set(self, capacity: int, open_: bool) -> None:
        i = capacity + self.n
        self.has[i] = open_
        while i > 1:
            i >>= 1
            self.has[i] = self.has[2 * i] | self.has[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need that has open sequences."""
        i = need + self.n
        if self.has[i]:
            return need
        while i > 1:
            if not i & 1 and self.has[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.has[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return None


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, per sequence, first sequence, first offset), ordered by length and rank.

    Piece ``r`` of a length goes to sequence ``first_sequence + (r - first_rank) // per`` at offset
    ``first_offset + length * ((r - first_rank) % per)``. Open sequences are ranges of equal content, so every
    step serves a whole range; there are at most a few more ranges than lengths.
    """
    tree, ranges, runs, next_sequence = CapacityTree(size), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            ranges.setdefault(left, []).append((first, n))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, first, n = size, next_sequence, -(-todo // (size // length))
                next_sequence += n
            else:
                first, n = ranges[left].pop()
                if not ranges[left]:
                    tree.set(left, False)
            per = left // length  # a sequence just filled is now the tightest, so it takes the next piece too
            full, rest = min(n, todo // per), 0
            if full < n:
                rest = todo - full * per
                rest = rest if rest < per else 0
            runs.append((length, rank, per, first, size - left))
            put(left - per * length, first, full)
            if full < n and rest:
                put(left - rest * length, first + full, 1)
            put(left, first + full + bool(rest), n - full - bool(rest))
            rank += full * per + rest
            todo -= full * per + rest
    return sorted(runs)


def pack(docs: DataFrame, ranks_path: str, pattern: str, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``size`` tokens as best-fit decreasing finds.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ``with_ids`` the
    token ids as an array. See ``cut_documents`` for nulls, empty texts and repeated rows. An empty table gives none.
    """
    cut = staged(cut_documents(docs, ranks_path, pattern, size, end_id, with_ids))
    counts = staged(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = dict(map(tuple, counts.groupBy("length").agg(F.sum("n")).collect()))  # at most `size` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cut.join(offsets, ["task", "length"])
    runs = np.array(plan(histogram, size), dtype=np.int64).reshape(-1, 5)
    place = partial(_place, runs=runs)
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("position")).alias("rank"), *(["ids"] if with_ids else []))
    out = placed.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)
    return out.withColumn("ids", id_array("ids")) if with_ids else out


def _place(batches: Iterator[pa.RecordBatch], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (runs[:, 0] << 50) + runs[:, 1]
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        length, rank = (columns[c].to_numpy() for c in ("length", "rank"))
        _, first_rank, per, sequence, offset = runs[np.searchsorted(keys, (length << 50) + rank, side="right") - 1].T
        columns["sequence_id"] = pa.array(sequence + (rank - first_rank) // per)
        columns["offset"] = pa.array(offset + length * ((rank - first_rank) % per))
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * ("ids" in columns)
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def id_array(column: str):
    """Little-endian ids as array<int>."""
    digits = F.hex(column)
    pair = lambda i, k: F.substring(digits, (i * 8 + 1 + k).cast("int"), F.lit(2))
    count = (F.length(column) / 4).cast("int")
    one = lambda i: F.conv(F.concat(pair(i, 6), pair(i, 4), pair(i, 2), pair(i, 0)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), one)
