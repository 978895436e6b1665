"""As-of, nearest and range joins without nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.session import settle


def _both(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], cols: Sequence[str], right_on: str, tie: str | None, left_first: bool) -> DataFrame:
    mine, theirs = F.struct(*[F.col(c) for c in left.columns]), F.struct(F.col(right_on).alias("_at"), *[F.col(c) for c in cols])
    a = left.select(*by, F.col(on).alias("_t"), F.lit(0 if left_first else 1).alias("_side"), F.lit(None).cast("bigint").alias("_tie"), mine.alias("_left"))
    b = right.select(*by, F.col(right_on).alias("_t"), F.lit(1 if left_first else 0).alias("_side"), (F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")).alias("_tie"), theirs.alias("_right"))
    return a.unionByName(b, allowMissingColumns=True)


def _bucket(t: Column | str, bucket_seconds: int) -> Column:
    return F.floor(F.unix_micros(t) / (bucket_seconds * 1_000_000))


def _edges(x: DataFrame, by: Sequence[str], forward: bool) -> DataFrame:
    """By bucket: the last right row of all earlier buckets (or the first of all later ones). One row a bucket."""
    at = F.struct("_t", "_tie")
    right = F.when(F.col("_right").isNotNull(), at)
    own = x.groupBy(*by, "_bucket").agg((F.min_by("_right", right) if forward else F.max_by("_right", right)).alias("_own"))
    w = Window.partitionBy(*by).orderBy(F.desc("_bucket") if forward else "_bucket")
    return own.withColumn("_far", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).drop("_own")


def asof_join(
    left: DataFrame, right: DataFrame, on: str = "ts", by: Sequence[str] = ("symbol",), cols: Sequence[str] = (), right_on: str | None = None, prefix: str = "event_", tie: str | None = None, bucket_seconds: int = 86400
) -> DataFrame:
    """Each left row with the last right row at or before it; NULL where there is none.

    Rows are dealt by key and time bucket, so a hot key is as many tasks as it has buckets; one row a bucket carries the last
    right row of earlier ones. tie orders right rows of equal time. Nothing is broadcast and no pair is looked at twice.
    """
    x = _both(left, right, on, by, cols, right_on or on, tie, False).withColumn("_bucket", _bucket("_t", bucket_seconds))
    w = Window.partitionBy(*by, "_bucket").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    near = x.withColumn("_r", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    near = near.join(_edges(x, by, False), [*by, "_bucket"]).withColumn("_r", F.coalesce("_r", "_far"))
    return near.select("_left.*", *[F.col(f"_r.{c}").alias(prefix + c) for c in cols])


def nearest_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], cols: Sequence[str], right_on: str = "ts", prefix: str = "near_", bucket_seconds: int = 86400) -> DataFrame:
    """Each left row with the right row nearest in time; the earlier one of two as near. Dealt as in asof_join."""
    # frames that end at the row, in both directions: one that runs on to the end is gone through anew for every row
    w = Window.partitionBy(*by, "_bucket")
    back, on_ = w.orderBy("_t", "_side", "_tie"), w.orderBy(F.desc("_t"), F.desc("_side"), F.desc("_tie"))
    x = _both(left, right, on, by, cols, right_on, None, False).withColumn("_bucket", _bucket("_t", bucket_seconds))
    near = x.withColumn("_b", F.last("_right", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("_f", F.last("_right", ignorenulls=True).over(on_.rowsBetween(Window.unboundedPreceding, 0))).where("_left is not null")
    near = near.join(_edges(x, by, False), [*by, "_bucket"]).withColumn("_b", F.coalesce("_b", "_far")).drop("_far")
    near = near.join(_edges(x, by, True), [*by, "_bucket"]).withColumn("_f", F.coalesce("_f", "_far"))
    gap = lambda c: F.abs(F.unix_micros(F.col(f"{c}._at")) - F.unix_micros("_t"))
    pick = F.when(F.col("_b").isNull() | (gap("_f") < gap("_b")), F.col("_f")).otherwise(F.col("_b"))
    return near.withColumn("_p", pick).select("_left.*", *[F.col(f"_p.{c}").alias(prefix + c) for c in cols])


def small(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """Rows as a settled table, to be broadcast if it has at most so many rows; beyond that joins deal it out."""
    x = settle(rows, "small")
    return F.broadcast(x) if x.limit(most + 1).count() <= most else x


def last_before(rows: DataFrame, value: Column, name: str, order: Sequence[str] = ("ts",), by: str = "symbol", bucket_seconds: int = 86400) -> DataFrame:
    """Adds the last value that is not NULL among the rows before each row of its series, dealt as in asof_join."""
    x = rows.withColumn("_v", value).withColumn("_bucket", _bucket(order[0], bucket_seconds))
    w = Window.partitionBy(by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = x.where("_v is not null").groupBy(by, "_bucket").agg(F.max_by("_v", F.struct(*order)).alias("_own"))
    ends = x.select(by, "_bucket").distinct().join(ends, [by, "_bucket"], "left")
    ends = ends.withColumn("_far", F.last("_own", ignorenulls=True).over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_own")
    near = x.withColumn("_near", F.last("_v", ignorenulls=True).over(w)).join(ends, [by, "_bucket"])
    return near.withColumn(name, F.coalesce("_near", "_far")).drop("_v", "_bucket", "_near", "_far")


def trailing_sum(rows: DataFrame, value: str, seconds: float, name: str, ts: str = "ts", by: str = "symbol", buckets: int = 8) -> DataFrame:
    """Adds the sum of value over the last `seconds` (the row's own time included, the far end not).

    A row also stands as context in the next time bucket where it may still count there, so windows end at buckets of
    `buckets` times the span.
    """
    micros = round(seconds * 1_000_000)
    size = micros * buckets
    x = rows.withColumn("_u", F.unix_micros(ts)).withColumn("_bucket", F.floor(F.col("_u") / size))
    late = x.where(F.col("_u") - F.col("_bucket") * size >= size - micros).withColumn("_bucket", F.col("_bucket") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(by, "_bucket").orderBy("_u").rangeBetween(-(micros - 1), 0)
    both = x.withColumn("_own", F.lit(True)).unionByName(late)
    return both.withColumn(name, F.sum(value).over(w)).where("_own").drop("_u", "_bucket", "_own")


def range_join(spans: DataFrame, points: DataFrame, start: str, end: str, at: str = "ts", by: Sequence[str] = ("symbol",), bucket_seconds: int = 86400, how: str = "inner") -> DataFrame:
    """Spans with the points inside [start, end]: equi-join on (by, time bucket), then the exact test.

    A span is repeated once a bucket it touches; choose buckets about as long as a usual span. how: inner or left_semi
    on points (each point once that lies in some span; the spans' columns do not come back).
    """
    number = lambda c: F.floor(F.unix_seconds(c) / bucket_seconds)
    s = spans.withColumn("_b", F.explode(F.sequence(number(start), number(end)))) if how == "inner" else spans.select(*by, start, end).withColumn("_b", F.explode(F.sequence(number(start), number(end))))
    p = points.withColumn("_b", number(at))
    on = [*by, "_b"]
    inside = (F.col(f"_p.{at}") >= F.col(f"_s.{start}")) & (F.col(f"_p.{at}") <= F.col(f"_s.{end}"))
    same = [F.col(f"_p.{c}") == F.col(f"_s.{c}") for c in on]
    cond: Column = inside
    for c in same:
        cond = cond & c
    if how == "left_semi":
        return p.alias("_p").join(s.alias("_s"), cond, "left_semi").drop("_b")
    keep = [F.col(f"_s.{c}") for c in spans.columns] + [F.col(f"_p.{c}") for c in points.columns if c not in by]
    return s.alias("_s").join(p.alias("_p"), cond).select(*keep)


def overlapping(rows: DataFrame, windows: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", bucket_seconds: int = 30 * 86400, few: int = 64) -> DataFrame:
    """Rows whose [start, end] overlaps some window with the same keys, each row once.

    Of the windows that start by a row's end, only the furthest end matters, so windows are told by one step function a key, of running
    furthest ends. Up to `few` steps in all, which are counted first, they are broadcast and rows stay where they are; beyond that rows find their
    step by an as-of join. No row is repeated.
    """
    w = windows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*keys, start).agg(F.max(end).alias(end))
    w = w.withColumn("_before", F.max(end).over(Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)))
    w = w.where(F.col("_before").isNull() | (F.col(end) > F.col("_before"))).select(*keys, F.col(start).alias("_from"), F.col(end).alias("_until"))
    w = settle(w, "windows")
    asked = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    if w.limit(few + 1).count() <= few:
        same = [F.col(f"_a.{k}") == F.col(f"_w.{k}") for k in keys]
        hit = (F.col(f"_a.{end}") >= F.col("_w._from")) & (F.col(f"_a.{start}") <= F.col("_w._until"))
        for k in same:
            hit = hit & k
        return asked.alias("_a").join(F.broadcast(w.alias("_w")), hit, "left_semi")
    found = asof_join(asked, w, on=end, by=keys, cols=["_until"], right_on="_from", prefix="", bucket_seconds=bucket_seconds)
    return found.where(F.col(start) <= F.col("_until")).select(*rows.columns)


def shortfall_room(positions: DataFrame, limit: float) -> DataFrame:
    """Positions (id, legs array, size) with what is left of the limit on the legs they share: min(1, room / size)."""
    leg = positions.select("id", "size", F.explode("legs").alias("leg"))
    used = leg.groupBy("leg").agg(F.sum("size").alias("used"))
    room = leg.join(used, "leg").groupBy("id", "size").agg(F.max("used").alias("used"))
    return room.select("id", "used", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (limit - F.col("used") + F.col("size")) / F.col("size"))).alias("room"))


def not_in_journal(fills: DataFrame, journal: DataFrame, key: str, journal_key: str) -> DataFrame:
    """Fills whose key the journal does not hold."""
    return fills.join(journal.select(F.col(journal_key).alias(key)).distinct(), key, "left_anti")
