"""Ranked lexical search: the best documents of each query item, by a document FP-tree with branch and bound.

Each document is restricted to the terms of the items and its terms are put in order of falling document frequency,
so that documents share the beginnings of their vectors and form a trie. A node of the trie keeps what its subtree
can reach at most: the largest tf of every term and the least length norm m. A term's part of the score rises with tf
and falls with m, so these give an upper bound. Per item a depth-first search goes to the most promising children first
and leaves out subtrees that can't better the item's k-th document, ties included, so the result is exact.

Every task builds tries of the documents it reads and keeps k documents per item; these few rows are ranked at last.
Counts come from all documents. Items are dealt into blocks of bounded size, one search each.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import staged, text_bytes
from .decontaminate import words

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct item_id, term."""
    return items.select("item_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term")).distinct()


def in_blocks(terms: DataFrame, most: int) -> list[DataFrame]:
    """The items dealt into blocks of at most ``most`` terms; an item with more is a block's only one."""
    sizes = staged(terms.groupBy("item_id").agg(F.count("*").alias("size")))
    n = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // most))
    while True:
        number = lambda k: F.pmod(F.xxhash64("item_id"), F.lit(k))
        over = sizes.groupBy(number(n).alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("c")).filter((F.col("s") > most) & (F.col("c") > 1))
        if over.isEmpty():
            return [terms.filter(number(n) == b) for b in range(n)]
        n *= 2


def vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats) and the tf of the vocabulary's terms, for documents with at least one term."""
    known = [t.encode() for t in vocabulary]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(known)}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words(text.as_py())
                if own:
                    found = [(place[t], c) for t, c in Counter(own).items() if t in place]
                    for column, value in zip(out, (doc_id, len(own), [t for t, _ in found], [c for _, c in found]), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def part_of_score(weight: np.ndarray, tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


@dataclass
class Node:
    """A run of documents in the trie's order: one subtree, or neighbouring small subtrees of one parent (a leaf)."""

    lo: int
    hi: int
    children: list[int]
    terms: np.ndarray  # of the subtree, rising
    most: np.ndarray  # largest tf of each
    least_m: int
    least_id: int


class Trie:
    """The FP-tree of some documents; terms are numbered by falling document frequency."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, starts: np.ndarray, terms: np.ndarray, tf: np.ndarray, leaf: int = 32):
        rank = np.lexsort((terms, np.repeat(np.arange(len(ids)), np.diff(starts))))  # terms rise in each document
        terms, tf = terms[rank], tf[rank]
        paths = [terms[a:b].astype(">u4").tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (paths[i], ids[i]))
        self.ids, self.m = ids[order], m[order]
        sizes = np.diff(starts)[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(starts[:-1][order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.terms, self.tf = terms[at], tf[at]
        self.leaf = leaf
        self.nodes: list[Node] = []
        self.root = self.build(0, len(ids))

    def build(self, lo: int, hi: int) -> int:
        """Split runs along the trie until they are leaves, then sum up from the leaves."""
        made: list[tuple[int, int, list[int]]] = []
        todo = [(lo, hi, 0, -1)]
        while todo:
            a, b, depth, parent = todo.pop()
            own = len(made)
            made.append((a, b, []))
            if parent >= 0:
                made[parent][2].append(own)
            if b - a > self.leaf:
                todo += [(x, y, d, own) for x, y, d in self.split(a, b, depth)]
        place = len(self.nodes)
        nodes: list[Node | None] = [None] * len(made)
        for i in range(len(made) - 1, -1, -1):
            a, b, children = made[i]
            if children:
                terms = np.concatenate([nodes[c].terms for c in children])
                most = np.concatenate([nodes[c].most for c in children])
            else:
                terms, most = self.terms[self.starts[a] : self.starts[b]], self.tf[self.starts[a] : self.starts[b]]
            order = np.argsort(terms, kind="stable")
            terms, most = terms[order], most[order]
            first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
            nodes[i] = Node(a, b, children, terms[first], np.maximum.reduceat(most, first), int(self.m[a:b].min()), int(self.ids[a:b].min()))
        self.nodes += nodes
        return place

    def split(self, a: int, b: int, depth: int) -> list[tuple[int, int, int]]:
        """The children of a run that shares ``depth`` terms; neighbours that fit in a leaf stay together."""
        while True:
            at = self.starts[a:b] + depth
            ends = at >= self.starts[a + 1 : b + 1]
            key = np.where(ends, -1, self.terms[np.minimum(at, len(self.terms) - 1)])
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            if len(cuts):
                break
            if ends[0]:  # equal vectors, by id
                return [(x, min(x + self.leaf, b), depth) for x in range(a, b, self.leaf)]
            depth += 1
        edges = [a, *(a + cuts).tolist(), b]
        out: list[tuple[int, int, int]] = []
        for x, y in zip(edges, edges[1:], strict=False):
            if out and y - out[-1][0] <= self.leaf:
                out[-1] = (out[-1][0], y, depth)
            else:
                out.append((x, y, depth))
        return out

    def bounds(self, terms: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The most that any document below each node can score, per node and item."""
        size = int(max(terms.max(initial=0), self.terms.max(initial=0))) + 1
        out = np.empty((len(self.nodes), len(starts)), np.int64)
        most = np.zeros(size, np.int64)
        for i, node in enumerate(self.nodes):
            most[node.terms] = node.most
            out[i] = np.add.reduceat(part_of_score(weights, most[terms], node.least_m), starts)
            most[node.terms] = 0
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, bounds: list[int], best: list[tuple[int, int]], k: int) -> None:
        """Depth-first branch and bound for one item; ``best`` is a heap of (score, -doc_id)."""

        def hopeless(i: int) -> bool:
            return bounds[i] <= 0 or (len(best) == k and (bounds[i], -self.nodes[i].least_id) <= best[0])

        todo = [self.root]
        while todo:
            i = todo.pop()
            if hopeless(i):
                continue
            node = self.nodes[i]
            if node.children:
                todo += sorted((c for c in node.children if not hopeless(c)), key=lambda c: (bounds[c], -self.nodes[c].least_id))
                continue
            a, b = self.starts[node.lo], self.starts[node.hi]
            own = self.terms[a:b]
            at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
            hit = np.flatnonzero(terms[at] == own)
            doc = np.searchsorted(self.starts[node.lo + 1 : node.hi + 1], a + hit, side="right")
            score = np.zeros(node.hi - node.lo, np.int64)
            np.add.at(score, doc, part_of_score(weights[at[hit]], self.tf[a + hit], self.m[node.lo + doc]))
            for j in np.flatnonzero(score >= max(best[0][0] if len(best) == k else 1, 1)).tolist():
                entry = (int(score[j]), -int(self.ids[node.lo + j]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def best_of_block(found: DataFrame, items: list[list[int]], weights: list[int], place: np.ndarray, n_docs: int, n_terms: int, k: int, chunk: int) -> DataFrame:
    """item (its index in ``items``), doc_id, score: the k best of the documents of each task.

    ``place`` maps the terms of ``found`` to places by falling document frequency, which ``items`` and ``weights`` use.
    """
    starts = np.cumsum([0, *map(len, items)])[:-1]
    flat = np.array([t for own in items for t in own], np.int64)
    weight = np.array(weights, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]

        def search(part: pa.RecordBatch) -> None:
            lists = part.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            n = part.column(1).to_numpy()
            m = np.fromiter((10 + 90 * int(x) * n_docs // n_terms for x in n), np.int64, len(n))
            terms, tf = place[lists.flatten().to_numpy()], part.column(3).flatten().to_numpy().astype(np.int64)
            trie = Trie(part.column(0).to_numpy(), m, np.concatenate([[0], np.cumsum(sizes)]), terms, tf)
            limits = trie.bounds(flat, weight[flat], starts)
            for i, own in enumerate(items):
                wanted = np.array(own, np.int64)
                trie.search(wanted, weight[wanted], limits[:, i].tolist(), best[i], k)

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                search(batch.slice(at, chunk))
        rows = [(i, -doc, score) for i, own in enumerate(best) for score, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 200_000, chunk: int = 4096) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the ``k`` highest-scoring documents of each item with a score above 0.

    Null and empty texts have no terms: such documents don't count, such items find nothing. Rows that share an
    item_id are one item with the terms of all; a null item_id is an item like others. Rows that share a doc_id are
    ranked one by one; rows with a null doc_id count in the statistics and are never returned. Equal scores rank by
    ascending doc_id. Other columns are ignored; an empty table of either kind gives no rows. ``block_terms`` bounds
    what a task and the driver hold of the items; every block of items is searched in all documents.
    """
    wanted = staged(item_terms(items))
    names = StructType([StructField("item", LongType()), StructField("item_id", wanted.schema["item_id"].dataType)])
    out = []
    for block in in_blocks(wanted, block_terms):
        rows = block.orderBy("item_id", "term").collect()  # at most block_terms, or one item
        vocabulary = sorted({r["term"] for r in rows})
        found = staged(vectors(docs, vocabulary))
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")
        known = df.select("term", "df", weight).orderBy(F.desc("df"), "term").collect()  # a row per term of the block
        place = np.zeros(len(vocabulary), np.int64)
        place[[r["term"] for r in known]] = np.arange(len(known))
        occurs = {vocabulary[r["term"]] for r in known}
        number = {t: int(place[i]) for i, t in enumerate(vocabulary) if t in occurs}
        own: dict = {}
        for r in rows:
            if r["term"] in number:
                own.setdefault(r["item_id"], []).append(number[r["term"]])
        if not own:
            continue
        ranked = found.filter((F.size("terms") > 0) & F.col("doc_id").isNotNull())
        best = best_of_block(ranked, [sorted(t) for t in own.values()], [r["w"] for r in known], place, n_docs, n_terms, k, chunk)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        top = best.withColumn("rank", rank).filter(F.col("rank") <= k)
        ids = docs.sparkSession.createDataFrame(list(enumerate(own)), names)
        out.append(staged(top.join(ids, "item").select("item_id", "rank", "doc_id", "score")))
    if not out:
        return wanted.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    whole = out[0]
    for other in out[1:]:
        whole = whole.unionByName(other)
    return whole
