"""Readers and writers of market tables: fixed schemas, gated writes, upserts, journals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestream.operators.scan import numbered
from lodestream.session import exists, settle

_D, _S, _L, _TS = T.DoubleType(), T.StringType(), T.LongType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


KLINES = _schema(symbol=_S, interval=_S, ts=_TS, open=_D, high=_D, low=_D, close=_D, volume=_D)
TRADES = _schema(symbol=_S, ts=_TS, trade_id=_L, price=_D, amount=_D, side=_S)
OPEN_INTEREST = _schema(symbol=_S, ts=_TS, oi=_D)
VERDICTS = _schema(strategy=_S, symbol=_S, interval=_S, label=_S, reasons=T.ArrayType(_S), ts=_TS)
TRIALS = _schema(strategy=_S, symbol=_S, purpose=_S, n_trials=_L, score=_D, ts=_TS)


def query_parquet(spark: SparkSession, sql: str, views: Mapping[str, str], args: Mapping[str, object] | None = None) -> DataFrame:
    """Any SQL over Parquet files, given as view name -> path, with named parameters."""
    for name, path in views.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    try:
        return spark.sql(sql, args=dict(args or {}))  # resolved here, so the views can go
    finally:
        for name in views:
            spark.catalog.dropTempView(name)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order: missing ones NULL, NaN turned into NULL."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType) and f.name in df.columns:
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_klines(spark: SparkSession, root: str, symbols: Sequence[str] | None = None, interval: str | None = None) -> DataFrame:
    """Bars from a folder partitioned by symbol and interval; both prune partitions."""
    df = spark.read.parquet(root)
    if symbols:
        df = df.where(F.col("symbol").isin(list(symbols)))
    if interval:
        df = df.where(F.col("interval") == interval)
    return conform(df, KLINES)


def read_trades(spark: SparkSession, root: str) -> DataFrame:
    """Trades; rows without an id get negative ids in order of time within their symbol."""
    df = conform(spark.read.parquet(root), TRADES)
    have = df.where("trade_id is not null")
    rest = numbered(df.where("trade_id is null"), ["ts", "price", "amount", "side"]).withColumn("trade_id", (-F.col("_i") - 1).cast("bigint"))
    return have.unionByName(rest.select(*df.columns))


def read_trade_dump(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Trade dumps in CSV, with or without a header line: id, price, quantity, first id, last id, time in ms, buyer is maker."""
    raw = _schema(trade_id=_S, price=_S, amount=_S, first_id=_S, last_id=_S, transact_time=_S, is_buyer_maker=_S)
    df = spark.read.schema(raw).csv(path).where(F.expr("try_cast(trade_id as bigint)").isNotNull())
    side = F.when(F.lower("is_buyer_maker").isin("true", "1"), "sell").otherwise("buy")
    return df.select(F.lit(symbol).alias("symbol"), F.timestamp_millis(F.col("transact_time").cast("bigint")).alias("ts"), F.col("trade_id").cast("bigint").alias("trade_id"), F.col("price").cast("double").alias("price"), F.col("amount").cast("double").alias("amount"), side.alias("side"))


def write_partitioned(df: DataFrame, root: str, by: Sequence[str]) -> None:
    """Replace only the partitions that df holds."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(root)


def save_klines(df: DataFrame, root: str, strict: bool = True) -> DataFrame:
    """Write bars by symbol and interval; with strict, critical defects refuse the write. Returns the report."""
    from lodestream.operators.quality import bar_report, is_critical

    report = bar_report(df, by=["symbol", "interval"])
    if strict and not report.where(is_critical()).isEmpty():
        raise ValueError("bars with critical defects: " + str([tuple(r) for r in report.where(is_critical()).limit(5).collect()]))
    write_partitioned(df, root, ["symbol", "interval"])
    return report


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key by the order columns, NULLs first; one partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of both, the latest of each key; columns missing on one side are NULL there."""
    return latest(old.unionByName(new, allowMissingColumns=True), keys, order)


def append_days(df: DataFrame, root: str, key: Sequence[str] = ("symbol", "ts"), order: Sequence[str] = ("arrival",)) -> None:
    """Append rows to day partitions, keeping the last row of each key there."""
    spark = df.sparkSession
    df = df.withColumn("date", F.to_date("ts"))
    if not exists(spark, root):
        write_partitioned(latest(df, [*key], [*order]), root, ["date"])
        return
    old = spark.read.parquet(root).join(df.select("date").distinct(), "date", "left_semi")
    both = latest(old.unionByName(df, allowMissingColumns=True), [*key], [*order])
    write_partitioned(settle(both, "days"), root, ["date"])  # the partitions read are the ones replaced


def add_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Schema migration: missing columns with defaults."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns}) if set(defaults) - set(df.columns) else df


def read_journal(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a markdown table as arrays of trimmed cells; header and ruler lines are left out."""
    lines = spark.read.text(path).where(F.col("value").startswith("|") & ~F.col("value").rlike(r"^\|[\s:|-]+\|?$"))
    cells = F.transform(F.split(F.regexp_replace("value", r"^\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    return lines.select(cells.alias("cells"))


def read_jdbc(spark: SparkSession, url: str, name: str, low: str, high: str, partitions: int, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A database table read in parallel by ranges of ts; predicates on it are pushed down."""
    return spark.read.jdbc(url, name, column="ts", lowerBound=low, upperBound=high, numPartitions=partitions, properties=dict(properties or {}))


def symbol_stats(df: DataFrame) -> DataFrame:
    """Rows, first and last time of each symbol; no price column is read."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def inventory(df: DataFrame, now: str, fresh_hours: int = 24, stale_hours: int = 72) -> DataFrame:
    """symbol_stats with age and state: fresh, aging or stale."""
    age = F.timestamp_diff("HOUR", F.col("last_ts"), F.lit(now).cast("timestamp"))
    return symbol_stats(df).withColumn("age_hours", age).withColumn("state", F.when(age <= fresh_hours, "fresh").when(age <= stale_hours, "aging").otherwise("stale"))


def list_series(df: DataFrame) -> DataFrame:
    """Distinct (symbol, interval): partition columns only."""
    return df.select("symbol", "interval").distinct()


def file_audit(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """Rows of each file under a tree whose name fits the pattern."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(root)
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def recent(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key; a report, ranks are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def concatenated(*frames: DataFrame) -> DataFrame:
    """All rows of frames with different columns; what one lacks is NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def even_sample(df: DataFrame, n: int, by: str = "symbol") -> DataFrame:
    """n evenly spaced rows inside each series, for spot checks."""
    from lodestream.operators.scan import numbered

    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    x = numbered(df, ["ts"], by).join(counts, by)
    places = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.floor((F.col("_n") - 1) * j / (n + 1)))
    return x.where(F.array_contains(places, F.col("_i"))).drop("_i", "_n")


FUNDING = _schema(symbol=_S, ts=_TS, seq=_L, rate=_D)
INTEREST = _schema(symbol=_S, ts=_TS, oi=_D)
LIQUIDATIONS = _schema(symbol=_S, ts=_TS, side=_S, price=_D, qty=_D)
BOOK = _schema(symbol=_S, ts=_TS, seq=_L, bid=_D, ask=_D, bid_qty=_D, ask_qty=_D)
EQUITY = _schema(ts=_TS, equity=_D)


def read_series(spark: SparkSession, root: str, schema: T.StructType, symbol: str | None = None) -> DataFrame:
    """Funding, open interest, liquidations or books: the schema's columns, in a folder that may be partitioned by symbol."""
    df = spark.read.parquet(root)
    return conform(df.where(F.col("symbol") == symbol) if symbol else df, schema)


def read_liquidation_dump(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Liquidation dumps in CSV, with or without a header line: time in ms, side, price, quantity."""
    raw = _schema(time=_S, side=_S, price=_S, qty=_S)
    df = spark.read.schema(raw).csv(path).where(F.expr("try_cast(time as bigint)").isNotNull())
    return df.select(F.lit(symbol).alias("symbol"), F.timestamp_millis(F.col("time").cast("bigint")).alias("ts"), F.lower("side").alias("side"), F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"))


def save_trades(df: DataFrame, root: str, strict: bool = True) -> DataFrame:
    """Write trades by symbol; with strict, values that cannot be refuse the write. Returns the report."""
    from lodestream.operators.quality import trade_report

    report = trade_report(df)
    bad = report.where((F.col("bad") > 0) | (F.col("no_side") > 0))
    if strict and not bad.isEmpty():
        raise ValueError("trades with critical defects: " + str([tuple(r) for r in bad.limit(5).collect()]))
    write_partitioned(df, root, ["symbol"])
    return report


def save_funding(df: DataFrame, root: str, most: float, strict: bool = True) -> DataFrame:
    """Write funding by symbol; with strict, missing rates and rates beyond the limit refuse the write. Returns the report."""
    from lodestream.operators.quality import funding_report

    report = funding_report(df, most)
    bad = report.where((F.col("missing") > 0) | (F.col("beyond") > 0))
    if strict and not bad.isEmpty():
        raise ValueError("funding with critical defects: " + str([tuple(r) for r in bad.limit(5).collect()]))
    write_partitioned(df, root, ["symbol"])
    return report


def inventory_kpis(states: DataFrame) -> DataFrame:
    """Number of series by state."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.agg(F.count(F.lit(1)).alias("series"), n("fresh"), n("aging"), n("stale"))


def ensure_bars(bars: DataFrame, source: str, target: str, days: int) -> DataFrame:
    """Bars of the target interval, derived from the source where they differ, of the last days of each symbol."""
    from lodestream.operators.resample import check_target, coarsen, interval_minutes

    check_target(source, target)
    x = bars if source == target else coarsen(bars, f"{interval_minutes(target)} minutes", whole=f"{interval_minutes(source)} MINUTE")
    last = x.groupBy("symbol").agg(F.max("ts").alias("_last"))
    return x.join(last, "symbol").where(F.col("ts") > F.col("_last") - F.expr(f"INTERVAL {days} DAYS")).drop("_last")


def load_symbol(frames: Mapping[str, DataFrame], symbol: str) -> dict[str, DataFrame]:
    """Each frame's rows of one symbol, not read yet."""
    return {k: df.where(F.col("symbol") == symbol) for k, df in frames.items()}


def save_report(df: DataFrame, path: str, order: Sequence[str], top: int = 20) -> str:
    """Write a table as CSV with a header; returns its first rows in order, read from what was written, as a markdown table."""
    df.write.mode("overwrite").option("header", "true").csv(path)
    rows = df.sparkSession.read.schema(df.schema).option("header", "true").csv(path).orderBy(*order).limit(top).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header, typed by the schema."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def count_trials(ledger: DataFrame, strategy: str | None = None, symbol: str | None = None, purpose: str | None = None) -> DataFrame:
    """Trials recorded under the filters that are given."""
    for name, value in (("strategy", strategy), ("symbol", symbol), ("purpose", purpose)):
        if value is not None:
            ledger = ledger.where(F.col(name) == value)
    return ledger.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("n_trials"), F.lit(0)).alias("trials"))


def read_audits(spark: SparkSession, root: str) -> DataFrame:
    """All JSON-lines and CSV audit files under a tree, as one table of text columns; a column that a file lacks is NULL."""
    read = lambda pattern: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return read("*.json*").option("primitivesAsString", "true").json(root).unionByName(read("*.csv").option("header", "true").csv(root), allowMissingColumns=True)


def save_artefacts(root: str, run_id: str, **frames: DataFrame) -> None:
    """One table an artefact, partitioned by run_id; a run written again replaces its own rows."""
    for name, df in frames.items():
        write_partitioned(df.withColumn("run_id", F.lit(run_id)), f"{root}/{name}", ["run_id"])


def load_artefact(spark: SparkSession, root: str, name: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").where(F.col("run_id").cast("string") == run_id).drop("run_id")


def migrate(spark: SparkSession, url: str, names: Sequence[str], root: str, low: str, high: str, partitions: int) -> None:
    """Database tables to Parquet, by symbol."""
    for name in names:
        write_partitioned(read_jdbc(spark, url, name, low, high, partitions), f"{root}/{name}", ["symbol"])
