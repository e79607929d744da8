"""Exact n-gram Jaccard self-join by grouped prefixes, and the classes of near duplicates it gives.

Sets of word 5-grams (64-bit hashes) are put into one global order: rare grams by hash, then frequent ones by
rising frequency, so that boilerplate comes last. Two sets that reach the threshold share a gram among the first
n - ceil(t n) + 1 of their own. Documents of one set are collapsed, then sets of one size and one prefix form a
group, and only groups are posted under their prefix grams.

Pairs in a posting list are never all written. Each group is first paired with one pivot of its list and size
class (the set with the largest share of frequent grams, such as the original of a family of copies). These pairs,
as far as size and a parity bitmap allow them (both are proven bounds on the overlap), give provisional classes.
Then every pair of a list that lies in two classes is written, except those inside the list's largest class, and
filtered alike. All surviving pairs are verified on the whole sets. Should a pivot pair fail, its class falls
apart and the pairs between its parts, which were not yet written, follow. So every pair at or above the threshold
is either verified itself or lies inside a verified component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Remember, chunks, per_batch, staged, text_bytes
from .graph import components

MIX = np.uint64(0x9E3779B97F4A7C15)
LEAST_BITS = 512  # of a parity bitmap
KNOWN_WORDS = 200_000  # hashes of words that a task remembers
CHUNK = 1 << 20  # bytes of text cut into words at once


def parity_bitmap(s: np.ndarray) -> bytes:
    """Parity of the set's elements per bucket; twice as many buckets as elements, rounded up to a power of two."""
    n = max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(7)).astype(np.int64) & (n - 1), minlength=n) & 1).astype(np.uint8)).tobytes()


def bitmap_distance(x: bytes, y: bytes) -> int:
    """Places in which two bitmaps differ, at most the sets' symmetric difference; the longer one is folded."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


class Shingler:
    """Sorted distinct hashes of the word n-grams of UTF-8 texts; words are cut at white space, A-Z lower-cased."""

    def __init__(self, width: int):
        self.width = width
        self.words = Remember(xxhash.xxh64_intdigest, KNOWN_WORDS)

    def many(self, texts: list[bytes | None]) -> list[np.ndarray]:
        split = [t.lower().split() if t else [] for t in texts]
        out: list[np.ndarray] = []
        flat = np.fromiter((h for ws in split for h in map(self.words.__getitem__, ws)), np.uint64, sum(map(len, split)))
        grams, start = self.roll(flat, self.width), 0
        for ws in split:
            n = len(ws)
            if n >= self.width:
                s = np.sort(grams[start : start + n - self.width + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            else:  # a shorter text is one gram, of its own length
                out.append(self.roll(flat[start : start + n], n) if n else flat[:0])
            start += n
        return out

    @staticmethod
    def roll(words: np.ndarray, width: int) -> np.ndarray:
        n = len(words) - width + 1
        if n <= 0:
            return words[:0]
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = (h ^ words[k : k + n]) * MIX
            h ^= h >> np.uint64(29)
        return h


def repeated(grams: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur ``least`` times or more, and how often. The array is sorted in place and only ends of runs are
    numbered, so the memory beyond it is a byte an element and the runs found."""
    grams.sort()
    if least > 1:  # values alone in their run are dropped first
        same = grams[1:] == grams[:-1]
        several = np.zeros(len(grams), bool)
        several[1:] |= same
        several[:-1] |= same
        grams = grams[several]
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    df = np.diff(np.append(starts, len(grams)))
    often = df >= least
    return grams[starts[often]], df[often].astype(np.int64)


META = "doc_id long, n long, digest binary, token long, df long"


def describe(docs: DataFrame, width: int, local: int = 2, window: int = 2_000_000) -> DataFrame:
    """Set size and digest of every document, and counts of grams that occur in ``local`` or more different sets
    within a stretch of ``window`` grams (so a gram that all stretches share can't escape, and few common ones do)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, kept, size = Shingler(width), set(), [], 0

        def frequent() -> Iterator[pa.RecordBatch]:
            grams = np.concatenate(kept)
            kept.clear()
            tokens, df = repeated(grams, local)
            for i in range(0, len(df), 50_000):
                part, n = tokens[i : i + 50_000].view(np.int64), df[i : i + 50_000]
                none = [pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(part), pa.array(n)], ["doc_id", "n", "digest", "token", "df"])

        for batch in batches:
            for start, texts in chunks(batch, 1, CHUNK):
                sets = shingler.many(texts)
                digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                for s, d in zip(sets, digests, strict=True):
                    if d not in seen:
                        seen.add(d)
                        kept.append(s)
                        size += len(s)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), none, none],
                    ["doc_id", "n", "digest", "token", "df"],
                )
                if size >= window:
                    yield from frequent()
                    seen, size = set(), 0
        if kept:
            yield from frequent()

    return docs.mapInArrow(run, META)


def prefixes(docs: DataFrame, width: int, percent: int, frequent: list[tuple[int, int]]) -> DataFrame:
    """Per document with grams: digest, n, prefix grams (40 bits), their digest, share of rare grams, bitmap."""
    rows = sorted((t & (2**64 - 1), i) for i, (t, _) in enumerate(sorted(frequent, key=lambda x: (x[1], x[0]))))
    known, place = np.array([t for t, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64)

    def make():
        shingler = Shingler(width)

        def ordered(s: np.ndarray, length: int) -> tuple[np.ndarray, int]:
            if not len(known):
                return s[:length], 100
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            often = known[at] == s
            rare = s[~often]
            if len(rare) < length:
                late = s[often][np.argsort(place[at[often]])]
                return np.concatenate([rare, late[: length - len(rare)]]), 100 * len(rare) // len(s)
            return rare[:length], 100 * len(rare) // len(s)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(7)]
            for start, texts in chunks(batch, 1, CHUNK):
                for doc_id, s in zip(batch.column(0).slice(start, len(texts)).to_pylist(), shingler.many(texts), strict=True):
                    n = len(s)
                    if not n or doc_id is None:
                        continue
                    first, cold = ordered(s, n - -(-percent * n // 100) + 1)
                    own = np.sort(first)
                    row = (hashlib.blake2b(s, digest_size=16).digest(), doc_id, n, (first >> np.uint64(24)).astype(np.int64), hashlib.blake2b(own, digest_size=16).digest(), cold, parity_bitmap(s))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = [pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["digest", "doc_id", "n", "prefix", "head", "cold", "bits"])

        return fn

    return per_batch(docs, make, "digest binary, doc_id long, n int, prefix array<long>, head binary, cold int, bits binary")


def may_overlap(pairs: DataFrame, verts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow the threshold, with the bitmaps' distance.

    |x| + |y| = inter + union, so at the threshold the symmetric difference is at most (100 - p) / (100 + p) of
    |x| + |y|, and a parity bitmap differs in no more places than the sets have elements apart.
    """
    side = lambda c: verts.select(F.col("vertex").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = np.array([bitmap_distance(x.as_py(), y.as_py()) for x, y in zip(batch.column("bits_a"), batch.column("bits_b"), strict=True)], np.int64)
            sizes = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            ok = (100 + percent) * apart <= (100 - percent) * sizes
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), pa.array(apart[ok])], ["a", "b", "apart"])

    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return joined.filter(fits).select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long, apart long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the threshold."""
    side = lambda c: sets.select(F.col("vertex").alias(c), F.col("grams").alias(f"set_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    # b first: it is the member of a pivot pair, and each has one pivot
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def apart_pairs(entries: DataFrame, keys: list[str], label: str, percent: int) -> DataFrame:
    """Distinct pairs of vertices that share a list (``keys``) but not a ``label`` and whose sizes fit: every pair of
    a list except those inside one label. Only members outside the list's largest label are joined with all.

    At the first gram that two sets share, what follows it in both must be enough for the overlap that the threshold
    asks of their sizes; lists of later shared grams may drop the pair, the first one keeps it."""
    sizes = entries.groupBy(*keys, label).agg(F.count("*").alias("size"))
    lists = staged(sizes.groupBy(*keys).agg(F.count("*").alias("labels"), F.max_by(label, F.struct("size", label)).alias("most")).filter("labels > 1").drop("labels"))
    mixed = entries.join(lists, keys)
    few = staged(mixed.filter(F.col(label) != F.col("most")).select(*keys, F.col("vertex").alias("v"), F.col("n").alias("m"), F.col("at").alias("to"), F.col(label).alias("other")))
    sizes = F.col("n") + F.col("m")
    reach = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) >= percent * sizes
    met = mixed.drop("most").join(few, keys).filter(
        (F.col(label) != F.col("other")) & (F.col("vertex") != F.col("v")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & reach
    )
    return met.select(F.least("vertex", "v").alias("a"), F.greatest("vertex", "v").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, max_frequent: int = 200_000, least_df: int = 8) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links of ``percent`` or more Jaccard).

    Null and empty texts have no grams and link with nothing. Rows with a null ``doc_id`` link with nothing and have
    a null component. Rows that share a ``doc_id`` are one document: a link of any of their texts is a link of it.
    Other columns are ignored. ``max_frequent`` bounds the table of frequent grams that steers the order; it has no
    effect on results.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    meta = staged(describe(texts, width))
    often = meta.filter("token IS NOT NULL").groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= least_df)
    frequent = [tuple(r) for r in often.orderBy(F.desc("df"), "token").limit(max_frequent).collect()]
    meta = meta.filter("n IS NOT NULL").select("doc_id", "n", "digest")

    # a vertex per different set, numbered by itself: documents may share an id and have different texts
    one = F.min_by(F.struct("prefix", "head", "cold", "bits"), "doc_id").alias("s")
    verts = prefixes(texts, width, percent, frequent).groupBy("digest", "n").agg(F.min("doc_id").alias("first"), one)
    verts = staged(verts.select("digest", "n", "first", F.monotonically_increasing_id().alias("vertex"), "s.*"))

    # groups: sets of one size and one prefix
    heads = verts.groupBy("head", "n").agg(F.min("vertex").alias("group"), F.count("*").alias("size")).filter("size > 1")
    inner = staged(verts.select("vertex", "n", "head").join(heads, ["head", "n"]).filter(F.col("vertex") != F.col("group")).select("vertex", "group"))
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).alias("step")  # size class
    posted = verts.join(inner.select("vertex"), "vertex", "left_anti").select(F.posexplode("prefix").alias("at", "token"), F.col("vertex").alias("group"), "n", "cold", step)
    # sizes and pivots of the lists are aggregates, so a list of any length is counted where its postings lie
    shared = staged(posted.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1").select("token"))
    listed = staged(posted.join(shared, "token"))
    pivots = staged(listed.groupBy("token", "step").agg(F.min(F.struct("cold", "group")).getField("group").alias("pivot")))
    lists = staged(listed.join(pivots, ["token", "step"]).select("token", "group", "n", "at", "pivot"))

    # one pivot pair per group and per member of a group
    stars = lists.filter(F.col("pivot") != F.col("group")).select(F.col("group").alias("b"), F.col("pivot").alias("a")).unionByName(inner.select(F.col("vertex").alias("b"), F.col("group").alias("a"))).distinct()
    narrow = verts.select("vertex", "n", "bits")
    best = staged(may_overlap(stars, narrow, percent).groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b"))
    up = best.select(F.col("b").alias("x"), F.col("a").alias("y"))
    label = best.join(up, best["a"] == up["x"], "left").select(F.col("b").alias("vertex"), F.coalesce("y", "a").alias("class"))

    members = inner.select("group", "vertex").unionByName(lists.select("group", F.col("group").alias("vertex")).distinct()).unionByName(inner.select("group", F.col("group").alias("vertex")).distinct()).distinct()
    members = staged(members.join(label, "vertex", "left").withColumn("class", F.coalesce("class", "vertex")))
    in_group = members.join(inner.select("group").distinct(), "group").join(verts.select("vertex", "n"), "vertex").select((-F.col("group") - 1).alias("token"), "vertex", "n", F.lit(0).alias("at"), "class")
    entries = lists.select("token", "group", "n", "at").join(members, "group").select("token", "vertex", "n", "at", "class").unionByName(in_group)
    entries = staged(entries)
    cross = staged(may_overlap(apart_pairs(entries, ["token"], "class", percent), narrow, percent).select("a", "b"))

    pairs = best.unionByName(cross)
    needed = pairs.select(F.col("a").alias("vertex")).unionByName(pairs.select(F.col("b").alias("vertex"))).distinct()
    needed = staged(needed.join(verts.select("vertex", "first", "digest"), "vertex"))

    def make():
        shingler = Shingler(width)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [s for _, part in chunks(batch, 1, CHUNK) for s in shingler.many(part)]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in found]
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["digest", "grams"])

        return fn

    chosen = texts.join(needed.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    if not meta.groupBy("doc_id", "digest").count().filter("count > 1 AND doc_id IS NOT NULL").isEmpty():
        chosen = chosen.dropDuplicates(["doc_id", "text"])
    sets = per_batch(chosen, make, "digest binary, grams binary").join(needed.select("digest", "vertex"), "digest").select("vertex", "grams")
    sets = staged(sets)
    links = staged(verified(pairs, sets, percent))

    known = staged(components(links))
    # classes that fell apart: pairs between their parts
    parts = entries.join(known, "vertex", "left").withColumn("part", F.coalesce("component", "vertex")).drop("component")
    split = staged(parts.groupBy("class").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("class"))
    of = staged(meta.join(verts.select("digest", "vertex", "first"), "digest", "left"))
    # a row without grams goes with the other texts of its document
    other = of.groupBy("doc_id").agg(F.max("vertex").alias("_v"), F.max(F.col("vertex").isNull()).alias("_e")).filter("_e AND _v IS NOT NULL").select("doc_id", "_v")
    of = staged(of.join(other, "doc_id", "left").select("doc_id", "n", F.coalesce("vertex", "_v").alias("vertex"), "first"))
    several = of.groupBy("doc_id").agg(F.min("vertex").alias("a"), F.max("vertex").alias("hi")).filter("a <> hi").select("doc_id", "a")
    added = of.join(several, "doc_id").filter(F.col("a") != F.col("vertex")).select("a", F.col("vertex").alias("b"))
    if not split.isEmpty():
        more = apart_pairs(staged(parts.join(split, "class")), ["token", "class"], "part", percent)
        rest = staged(may_overlap(more, narrow, percent).select("a", "b"))
        if not rest.isEmpty():
            added = added.unionByName(verified(rest, sets, percent))
    added = staged(added)
    found = known if added.isEmpty() else staged(components(links.unionByName(added)))
    least = staged(found.join(verts.select("vertex", "first"), "vertex").groupBy("component").agg(F.min("first").alias("component_id")))
    named = staged(found.join(least, "component").select("vertex", "component_id"))
    return of.join(named, "vertex", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "first", "doc_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of near duplicates: that with the smallest doc_id; all columns stay.

    Of rows that share that doc_id the one with the least text (null first) stays. Rows with a null doc_id are all
    kept, since they link with nothing.
    """
    found = near_duplicates(docs, width, percent)
    first = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text")).alias("_row"))
    kept = kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return kept.unionByName(docs.filter("doc_id IS NULL"))
