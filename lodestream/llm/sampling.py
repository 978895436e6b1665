"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model knows at most so many values: the most frequent ones, by name where they are as frequent.
MAX_VALUES = 1000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; such rows are never learned from. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_by(rows: DataFrame, by: str, most: int, max_values: int = MAX_VALUES) -> DataFrame:
    """About `most` rows at most of each of the max_values most frequent values of `by`, picked by a hash of doc_id, so that reruns agree.

    A count of each of those values goes to the driver.
    """
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.desc("count"), by).limit(max_values).collect()
    keep = F.lit(False)
    for r in counts:
        share = min(1.0, most / r["count"])
        keep = keep | ((F.col(by) == F.lit(r[by])) & (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))))
    return rows.where(keep)
