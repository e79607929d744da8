"""Learning from accepted feedback as keyed stream state.

State lives in the stream's own checkpoint (RocksDB): per (dictionary_type, canonical_value) one entry, and a map of its
aliases, one stored row each, so an entry with very many aliases is never held whole. The tables known before the
stream are its initial state. Each micro-batch puts out only entries and aliases that it changed; they are appended
through the file sink, whose log makes a replayed batch count once. ``learned`` lays these changes over the tables.
The result does not depend on how feedback is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from bizdocs.functions.text import normalize_for_type
from bizdocs.operators.dictionary import accepted
from bizdocs.operators.ordering import first_per, last_per

KEY = ["dictionary_type", "canonical_value"]
CHANGES = (
    "dictionary_type string, canonical_value string, entry_id string, normalized_value string, field string, source string, active boolean, "
    "alias_value string, normalized_alias_value string, n long")
ENTRY_STATE = "entry_id string, normalized_value string, field string, field_at long, source string, active boolean, n long"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _known(value):
    """The value, or None for the missing values of pandas."""
    return None if pd.isna(value) else value


class Learner(StatefulProcessor):
    """One dictionary entry with its aliases per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", ENTRY_STATE)
        self.alias = handle.getMapState("alias", "alias_value string", "normalized string, active boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.to_dict("records"):
            if _known(row["alias_value"]) is None:
                self.entry.update((row["entry_id"], _known(row["normalized_value"]), _known(row["field"]), None, _known(row["source"]), bool(row["active"]), 0))
            else:
                self.alias.updateValue((row["alias_value"],), (_known(row["normalized_alias_value"]), bool(row["active"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.entry.get() if self.entry.exists() else None
        entry_id, normalized, field, field_at, source, active, n = before if before is not None else (None,) * 6 + (0,)
        n, heard = n + 1, False
        change = {**dict(zip(KEY, key)), "n": n}
        for frame in rows:
            changed = []
            if not heard and len(frame):
                heard, active = True, True
                if before is None:
                    entry_id, normalized, source = frame["entry_id"].iloc[0], _known(frame["normalized_value"].iloc[0]), "accepted_suggestion"
            # what is told again in a frame changes nothing, so the state is asked once per field and per alias of a frame
            named = frame.loc[frame["field"].notna(), ["told_at", "field"]].drop_duplicates()
            for told_at, told in named.itertuples(index=False):
                if field is None or (field_at is not None and (told_at, told) < (field_at, field)):
                    field, field_at = told, int(told_at)
            for name, plain in frame[["alias_value", "normalized_alias_value"]].drop_duplicates().itertuples(index=False):
                alias, value = (name,), (_known(plain), True)
                if not self.alias.containsKey(alias) or tuple(self.alias.getValue(alias)) != value:
                    self.alias.updateValue(alias, value)
                    changed.append({**change, "entry_id": entry_id, "active": True, "alias_value": name, "normalized_alias_value": value[0]})
            if changed:
                yield pd.DataFrame(changed, columns=COLUMNS, dtype=object)
        after = (entry_id, normalized, field, field_at, source, active)
        if heard and (before is None or after != tuple(before)[:6]):
            self.entry.update((*after, n))
            yield pd.DataFrame([{**change, "entry_id": entry_id, "normalized_value": normalized, "field": field, "source": source, "active": active}], columns=COLUMNS, dtype=object)

    def close(self) -> None:
        pass


COLUMNS = [part.split()[0] for part in CHANGES.split(", ")]


def _keyed_aliases(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    ids = entries.select(F.col("entry_id").cast("string").alias("entry_id"), *KEY)
    return aliases.withColumn("entry_id", F.col("entry_id").cast("string")).join(ids, "entry_id")


def _seed(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entries (alias null) and aliases as one table of rows per key; missing ``active`` counts as off."""
    on = F.coalesce("active", F.lit(False)).alias("active")
    text = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    e = entries.filter(F.col("dictionary_type").isNotNull() & F.col("canonical_value").isNotNull())
    e = first_per(e.withColumn("entry_id", F.col("entry_id").cast("string")), [F.col(k).alias(f"_k{i}") for i, k in enumerate(KEY)], F.col("entry_id"))
    a = _keyed_aliases(e, aliases.filter("alias_value IS NOT NULL"))
    return e.select(*KEY, "entry_id", "normalized_value", "field", "source", on, *text("alias_value", "normalized_alias_value")).unionByName(
        a.select(*KEY, "entry_id", *text("normalized_value", "field", "source"), on, "alias_value", "normalized_alias_value"))


def stream_learn(feedback: DataFrame, entries: DataFrame, aliases: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Accepted feedback changes the dictionary; rows of ``out`` are changes, read with ``learned``.

    ``entries`` and ``aliases`` are read by the first micro-batch only, as initial state. The entry of a key is unique
    (of repeats the one with the least ``entry_id`` is carried on). Feedback without a field or a time names no field;
    of several the earliest counts, and a field known before the stream stays."""
    spark = feedback.sparkSession
    timed = F.col("field").isNotNull() & F.col("created_at").isNotNull()
    rows = accepted(feedback).select(
        *KEY, F.md5(F.concat_ws("\u0001", *KEY)).alias("entry_id"), normalize_for_type("dictionary_type", "canonical_value").alias("normalized_value"),
        F.when(timed, F.col("field")).alias("field"), F.when(timed, F.unix_micros(F.col("created_at").cast("timestamp"))).otherwise(F.lit(0)).alias("told_at"),
        "alias_value", normalize_for_type("dictionary_type", "alias_value").alias("normalized_alias_value"))
    changes = rows.groupBy(*KEY).transformWithStateInPandas(
        Learner(), CHANGES, "Append", "None", initialState=_seed(entries, aliases).groupBy(*KEY))
    name, wanted = PROVIDER
    found = spark.conf.get(name, None)
    spark.conf.set(name, wanted)  # read when the query starts
    try:
        return changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if found is None else spark.conf.set(name, found)


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    """All changes; the sink's log hides the files of unfinished batches."""
    return spark.read.schema(CHANGES).parquet(out)


def learned(entries: DataFrame, aliases: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, aliases) after the changes: per key the newest row, as aggregates with partial results."""
    on = F.coalesce("active", F.lit(False)).alias("active")
    old = entries.select(F.col("entry_id").cast("string").alias("entry_id"), *KEY, "normalized_value", "field", "source", on, F.lit(0).cast("long").alias("n"))
    new = changes.filter("alias_value IS NULL").select(*old.columns)
    latest = last_per(old.unionByName(new), [F.col("entry_id").alias("_k0")], F.col("n")).drop("n")
    was = aliases.select(F.col("entry_id").cast("string").alias("entry_id"), "alias_value", "normalized_alias_value", on, F.lit(0).cast("long").alias("n"))
    now = changes.filter("alias_value IS NOT NULL").select(*was.columns)
    return latest, last_per(was.unionByName(now), [F.col(c).alias(f"_k{i}") for i, c in enumerate(("entry_id", "alias_value"))], F.col("n")).drop("n")


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The entries as the stream holds them after its last finished batch, read back from its state store."""
    name, wanted = PROVIDER
    found = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        state = spark.read.format("statestore").option("stateVarName", "entry").load(checkpoint)
    finally:
        spark.conf.unset(name) if found is None else spark.conf.set(name, found)
    return state.select("key.*", "value.entry_id", "value.normalized_value", "value.field", "value.source", "value.active")
