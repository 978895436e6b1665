"""Structured Streaming jobs over market events; the same functions run on any streaming source with these columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.states import keyed_scan
from lodestream.session import exists, shared_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def ticks(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream of ticks."""
    e = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet*").option("maxFilesPerTrigger", files).parquet(sf_dir).where("value > 0")
    return e.select(
        F.concat(F.lit("S"), F.col("user_id") % 8).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("trade_id"), F.col("value").alias("price"),
        (F.lit(1) + F.regexp_extract("props", "[0-9]+", 0).cast("int")).cast("double").alias("amount"),
    )


def _field(path: str) -> Column:
    """A field of a JSON message; names differ by case alone, so they are not columns of one struct."""
    return F.get_json_object("value", path)


def quotes(raw: DataFrame) -> DataFrame:
    """Quote messages (column value, JSON) to symbol, ts, bid, bid_qty, ask, ask_qty; event time, else arrival. Bad rows go."""
    ok = raw.where(_field("$.s").isNotNull() & _field("$.b").isNotNull() & _field("$.a").isNotNull())
    ts = F.coalesce(F.timestamp_millis(_field("$.E").cast("bigint")), F.timestamp_millis(_field("$.T").cast("bigint")), F.current_timestamp())
    return ok.select(_field("$.s").alias("symbol"), ts.alias("ts"), *[_field(f"$.{k}").cast("double").alias(n) for k, n in (("b", "bid"), ("B", "bid_qty"), ("a", "ask"), ("A", "ask_qty"))])


def liquidations(raw: DataFrame) -> DataFrame:
    """Nested liquidation messages to symbol, ts, side, price, qty."""
    ts = F.timestamp_millis(F.coalesce(_field("$.o.T"), _field("$.E")).cast("bigint"))
    return raw.where(_field("$.o.s").isNotNull()).select(
        _field("$.o.s").alias("symbol"), ts.alias("ts"), F.lower(_field("$.o.S")).alias("side"), _field("$.o.p").cast("double").alias("price"), _field("$.o.q").cast("double").alias("qty")
    )


def order_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Order updates as typed rows, and the rejected messages."""
    kind = _field("$.e")
    good = kind.eqNullSafe(F.lit("ORDER_TRADE_UPDATE")) & _field("$.o.i").isNotNull()
    rows = raw.where(good).select(
        F.timestamp_millis(_field("$.E").cast("bigint")).alias("ts"), _field("$.o.s").alias("symbol"), _field("$.o.i").cast("bigint").alias("order_id"), F.lower(_field("$.o.X")).alias("status"),
        _field("$.o.q").cast("double").alias("qty"), _field("$.o.z").cast("double").alias("filled"),
    )
    return rows, raw.where(~good)


def tumbling_bars(stream: DataFrame, every: str, late: str) -> DataFrame:
    """Bars in append mode: a bar comes out once the watermark has passed its end."""
    order = F.struct("ts", "trade_id")
    return (
        stream.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("amount").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def sliding_sum(stream: DataFrame, length: str, slide: str, late: str, value: str = "amount") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("symbol", F.window("ts", length, slide).alias("w")).agg(F.sum(value).alias("total")).select("symbol", F.col("w.end").alias("ts"), "total")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "amount")


def deduplicated(stream: DataFrame, late: str) -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "trade_id"])


def enriched(static: DataFrame, cols: list[str], sink: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds the last static row before each stream row and appends to a table by batch."""
    from lodestream.operators.joins import asof_join

    def write(batch: DataFrame, number: int) -> None:
        asof_join(batch, static, cols=cols, tie="seq").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return write


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table in the shared folder, and read that."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).format("parquet").start(path)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str) -> None:
    path = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(write).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()


def keyed_states(stream: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], start: Callable[[], object], step: Callable, out: Sequence[tuple[str, str]], name: str) -> DataFrame:
    """Run a state machine by key over a stream into a table, as operators.states.keyed_scan is over a table: the state is kept between batches.

    Rows of a key are taken in order within a batch, and batches as they come. Output: key, the first order column and the columns of
    out, for each row whose step gives something. Spark sorts a batch and streams it through the step, so a task holds a state and
    no series. States are rows of the batch's table; a batch that runs again starts from those of the batch before and overwrites its own.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = stream.select(key, *order, *[c for c in cols if c not in order])
    ddl = f"{key} {wanted.schema[key].dataType.simpleString()}, {order[0]} {wanted.schema[order[0]].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in out)

    def table(session: SparkSession) -> DataFrame:
        return session.read.schema(f"{ddl}, _state binary, batch bigint, _kept boolean").parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        before = table(batch.sparkSession).where(f"_kept and batch = {number - 1}").select(key, "_state") if number else batch.sparkSession.createDataFrame([], f"{key} string, _state binary")
        got = keyed_scan(batch, key, order, cols, start, step, out, before=before)
        got.withColumn("_kept", F.col("_state").isNotNull()).write.mode("overwrite").partitionBy("_kept").parquet(f"{path}/batch={number}")

    run_batches(wanted, write, name)
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    return table(spark).where("not _kept").drop("_state", "batch", "_kept")
