"""A trigram index for ``browse.search``: a term reads the postings of its rarest grams, then only the documents found there.

Documents fall into ranges by a hash of their id (about ``docs_per_range`` each), ranges into folders. A posting says that
some text of a range, a document field or the JSON of a line, holds a gram. Lines find their range by the same hash, so
nothing is joined to build the index. Each ingested batch has folders of its own and appears once its ``meta`` row is
written; writing a batch again replaces it. Batches must hold different documents.

The index only narrows down what is read: the rows of the ranges left go through ``browse.search`` itself.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bizdocs.operators.browse import SEARCH_FIELDS, search
from bizdocs.session import cut

POSTING = "gram string, _part int, _range long, batch int"


def grams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text; the look-ahead finds overlapping ones in one pass."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def literal_runs(pattern: str) -> list[str]:
    """The stretches of a LIKE pattern without wildcards; a backslash makes the next character literal."""
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c in "%_":
            runs.append("")
        else:
            at += c == "\\" and at + 1 < len(pattern)
            runs[-1] += pattern[at]
        at += 1
    return [r for r in runs if r]


def _line_text(lines: DataFrame) -> Column:
    return F.to_json(F.struct(*[c for c in lines.columns if c not in ("document_id", "line_index")]))


def _placed(df: DataFrame, ranges: int, ranges_per_part: int) -> DataFrame:
    at = F.pmod(F.xxhash64("document_id"), F.lit(ranges))
    return df.withColumn("_range", at).withColumn("_part", F.floor(F.col("_range") / ranges_per_part).cast("int"))


def write_search_index(docs: DataFrame, path: str, lines: DataFrame | None = None, batch: int = 0, docs_per_range: int = 256, ranges_per_part: int = 4096) -> None:
    """Index a batch: ``path``/docs, /lines, /postings, /grams and, last, /meta.

    A document with very many lines fills its folder by several tasks; a gram of every text spreads over tasks with its
    ranges. Null texts have no grams. An empty batch can be searched and finds nothing."""
    spark = docs.sparkSession
    kept = docs.select("document_id", *[c for c in SEARCH_FIELDS if c in docs.columns])
    ranges = max(1, ceil(docs.count() / docs_per_range))
    tables, texts = {"docs": kept} | ({} if lines is None else {"lines": lines}), []
    for name, df in tables.items():
        placed = _placed(df, ranges, ranges_per_part)
        to = f"{path}/{name}/batch={batch}"
        placed.hint("rebalance", "_part").sortWithinPartitions("_part", "_range").write.mode("overwrite").partitionBy("_part").parquet(to)
        stored = spark.read.schema(placed.schema).parquet(to)
        each = F.array(*[F.col(c).cast("string") for c in kept.columns[1:]]) if name == "docs" else F.array(_line_text(lines))
        found = F.array_distinct(F.flatten(F.transform(each, lambda t: F.coalesce(grams(t), F.array().cast("array<string>")))))
        texts.append(stored.select(F.explode(found).alias("gram"), "_part", "_range"))
    postings = texts[0] if len(texts) == 1 else texts[0].unionByName(texts[1])
    to = f"{path}/postings/batch={batch}"
    postings.distinct().repartitionByRange("gram", "_range").sortWithinPartitions("gram", "_range").write.mode("overwrite").parquet(to)
    counted = spark.read.schema("gram string, _part int, _range long").parquet(to).groupBy("gram").agg(F.count("*").alias("n"))
    counted.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams/batch={batch}")
    schemas = json.dumps({name: df.schema.jsonValue() for name, df in tables.items()})
    spark.range(1).select(F.lit(schemas).alias("schemas")).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta/batch={batch}")


def indexed_search(spark: SparkSession, path: str, text: str, grams_per_term: int = 4) -> DataFrame:
    """``browse.search`` over the indexed documents: their ids and searched fields.

    Terms without three literal characters in a row narrow nothing down; a search of only such terms reads all documents.
    What the driver reads is a row per batch, a count per gram of the terms and the numbers of the folders left."""
    meta = spark.read.schema("schemas string, batch int").parquet(f"{path}/meta").collect()
    batches, schemas = [r.batch for r in meta], json.loads(meta[0].schemas)
    own = [T.StructField("_range", T.LongType()), T.StructField("batch", T.IntegerType()), T.StructField("_part", T.IntegerType())]

    def stored(name: str) -> DataFrame:
        schema = T.StructType([*T.StructType.fromJson(schemas[name]).fields, *own])
        return spark.read.schema(schema).parquet(f"{path}/{name}").filter(F.col("batch").isin(batches))

    tables = {name: stored(name) for name in schemas}
    chosen = _rarest(spark, path, batches, text.split(), grams_per_term)
    if chosen:
        postings = spark.read.schema(POSTING).parquet(f"{path}/postings").filter(F.col("batch").isin(batches) & F.col("gram").isin(chosen))
        left = cut(postings.groupBy("batch", "_part", "_range").agg(F.count("*").alias("n")).filter(F.col("n") == len(chosen)).drop("n"))
        folders = [r[0] for r in left.select("_part").distinct().collect()]
        within = F.col("_part").isin(folders) if folders else F.lit(False)
        tables = {name: df.filter(within).join(left, ["batch", "_part", "_range"], "left_semi") for name, df in tables.items()}
    tables = {name: df.drop("batch", "_part", "_range") for name, df in tables.items()}
    return search(tables["docs"], text, tables.get("lines"))


def _rarest(spark: SparkSession, path: str, batches: list[int], terms: list[str], per_term: int) -> list[str]:
    """The grams to look up: the rarest ``per_term`` of each term. Lower case is Spark's, that of ``ilike``."""
    if not terms:
        return []
    lowered = spark.range(1).select(*[F.lower(F.lit(f"%{t}%")) for t in terms]).first()
    held = [{r[i:i + 3] for r in literal_runs(p) for i in range(len(r) - 2)} for p in lowered]
    wanted = sorted(set().union(*held))
    if not wanted:
        return []
    counts = spark.read.schema("gram string, n long, batch int").parquet(f"{path}/grams").filter(F.col("batch").isin(batches) & F.col("gram").isin(wanted))
    n = {r.gram: r.n for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    return sorted({g for gs in held for g in sorted(gs, key=lambda g: (n.get(g, 0), g))[:per_term]})
