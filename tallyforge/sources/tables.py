"""Entity tables, events and action logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint as checkpoint


def load(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    """An entity table, with its fixed schema if one is given."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def read_actions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; lines that don't parse keep their text in `malformed`."""
    return spark.read.schema(f"{schema}, malformed string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").json(path)


def action_counts(actions: DataFrame) -> DataFrame:
    """One row: lines in all, parsed and malformed."""
    bad = F.col("malformed").isNotNull()
    # a query of the malformed column alone isn't allowed on files, so that another one is read too
    other = F.to_json(F.struct(*[c for c in actions.columns if c != "malformed"]))
    return actions.agg(F.count("*").alias("total"), F.count_if(~bad & other.isNotNull()).alias("parsed"), F.count_if(bad & other.isNotNull()).alias("malformed"))


#: Columns of raw events.
EVENTS = "name string, data string, tx_signature string, slot long, block_time timestamp, tx_index int, event_ordinal int"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Raw events from Parquet files."""
    return spark.read.schema(schema).parquet(path)


def stream_events(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 100, stop_slot: int | None = None) -> DataFrame:
    """The same as a stream, so many files a batch; events of slots beyond stop_slot aren't read."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows if stop_slot is None else rows.where(F.col("slot") <= stop_slot)


def snapshot_window(table: DataFrame, start: int, cutoff: int, slot: str = "slot") -> DataFrame:
    return table.where(F.col(slot).between(start, cutoff))


def snapshot_windows(tables: dict[str, tuple[DataFrame, str]], start: int, cutoff: int) -> dict[str, DataFrame]:
    """The same range of slots of several tables, each with the name of its slot column."""
    return {name: snapshot_window(df, start, cutoff, slot) for name, (df, slot) in tables.items()}
