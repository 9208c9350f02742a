"""Sequence tables (seq_id, xs) from rows, and back.

A sequence is the rows of one key in a stated order. Building one shuffles by key, once, and carries only the key,
the order and the value. The observations of a key end in one array, so a key's rows must fit a task: that is what a
backward pass needs anyway. NULL keys and NULL observations are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def to_sequences(rows: DataFrame, key: str, order: list[str], x: Column) -> DataFrame:
    """(seq_id, xs): ARRAY<DOUBLE>, or ARRAY<ARRAY<DOUBLE>> for vector observations."""
    names = [f"o{i}" for i in range(len(order))]
    slim = rows.select(F.col(key).alias("seq_id"), *(F.col(o).alias(n) for o, n in zip(order, names, strict=True)), x.alias("x")).where("seq_id IS NOT NULL AND x IS NOT NULL")
    steps = F.sort_array(F.collect_list(F.struct(*names, "x")))
    return slim.groupBy("seq_id").agg(steps.alias("s")).select("seq_id", F.transform("s", lambda s: s["x"]).alias("xs"))


def to_steps(sequences: DataFrame) -> DataFrame:
    """(seq_id, t, x), t from 0."""
    return sequences.select("seq_id", F.posexplode("xs").alias("t", "x"))


def symbols(column: str, alphabet: list[str]) -> Column:
    """The place of a string in an alphabet, as an observation; NULL for other strings."""
    place = F.array_position(F.array(*map(F.lit, alphabet)), F.col(column)) - 1
    return F.when(place >= 0, place.cast("double"))


def _micros(time: Column) -> Column:
    """Microseconds since 1970; times without a zone are taken in that of the session."""
    return F.unix_micros(time.cast("timestamp"))


def gaps(rows: DataFrame, key: str, time: str, tie: str, name: str = "gap") -> DataFrame:
    """rows with the seconds since the key's row before; the first row of a key has none and goes."""
    before = F.lag(F.col(time)).over(Window.partitionBy(key).orderBy(time, tie))
    seconds = (_micros(F.col(time)) - _micros(before)) / F.lit(1e6)
    return rows.withColumn(name, seconds).where(F.col(name).isNotNull())


def day_angle(time: str) -> Column:
    """The time of day as an angle in (-pi, pi], midnight at pi."""
    seconds = F.pmod(_micros(F.col(time)), F.lit(86_400_000_000)) / F.lit(1e6)
    angle = seconds * (2 * math.pi / 86_400) - math.pi
    return F.when(angle <= -math.pi, F.lit(math.pi)).otherwise(angle)


#: Symbols of the event and order tables.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def event_sequences(spark: SparkSession, sf_dir: str, what: str = "log_value") -> DataFrame:
    """Sequences of the events table by user: log_value, value, type, k (from props) or vector (log value, log gap)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = {
        "log_value": F.ln(F.col("value") + 1),
        "value": F.col("value"),
        "type": symbols("event_type", EVENT_TYPES),
        "k": F.get_json_object("props", "$.k").cast("double"),
    }
    if what == "vector":
        rows = gaps(events, "user_id", "ts", "event_id")
        return to_sequences(rows, "user_id", ["ts", "event_id"], F.array(F.ln(F.col("value") + 1), F.ln(F.col("gap") + 1)))
    return to_sequences(events, "user_id", ["ts", "event_id"], x[what])


def order_sequences(spark: SparkSession, sf_dir: str, what: str = "log_price") -> DataFrame:
    """Sequences of the orders table by customer: log_price or priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x = F.ln("o_totalprice") if what == "log_price" else symbols("o_orderpriority", PRIORITIES)
    return to_sequences(orders, "o_custkey", ["o_orderdate", "o_orderkey"], x)


def read_csv_sequences(spark: SparkSession, path: str, key: str, order: str, values: list[str]) -> DataFrame:
    """Sequences from CSV files with a header line; several value columns give vectors."""
    rows = spark.read.csv(path, header=True)
    x = F.col(values[0]).cast("double") if len(values) == 1 else F.array(*(F.col(v).cast("double") for v in values))
    return to_sequences(rows.withColumn("__o", F.col(order).cast("double")), key, ["__o"], x)
