"""Windows over the last rows, or seconds, of a series that are spread over many tasks however few series there are.

A series is cut into slices that each carry what they need of the slice before, so a key that holds most rows makes no
large task. Rows that are carried are marked and left out of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Names that the slices add; a table that has columns of these names can't be sliced.
PART, OWN, PLACE = "__part", "__own", "__place"


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in names))


def by_rows(df: DataFrame, keys: list[str], order: list[str], slice_of: Column, carry: int, rows: int = 100_000) -> DataFrame:
    """df with PLACE (a row's number in its series from 1), PART and OWN: runs of `rows` rows, or `carry` if that is more, after the last `carry` rows before each.

    slice_of: a number that rises with the first column of `order`, such as the hour; only counts of slices are added up along
    a series, rows are numbered within their slice.
    """
    rows = max(rows, carry, 1)
    sliced = df.withColumn("__slice", slice_of)
    names = [*keys, "__slice"]
    counts = sliced.groupBy(*names).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*names, before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    placed = sliced.withColumn("__in", own)
    placed = placed.join(starts, _same(placed, starts, names)).select(*(placed[c] for c in df.columns), (F.col("__before") + F.col("__in")).alias(PLACE))
    part = F.floor((F.col(PLACE) - 1) / rows)
    late = (F.col(PLACE) - 1) % rows >= rows - carry
    copies = F.when(late, F.array(F.struct(part.alias("p"), F.lit(True).alias("o")), F.struct((part + 1).alias("p"), F.lit(False).alias("o")))).otherwise(F.array(F.struct(part.alias("p"), F.lit(True).alias("o"))))
    return placed.withColumn("__copy", F.explode(copies)).withColumn(PART, F.col("__copy.p")).withColumn(OWN, F.col("__copy.o")).drop("__copy")


def by_seconds(df: DataFrame, seconds: str, carry: int, length: int = 86_400) -> DataFrame:
    """df with PART and OWN: stretches of `length` seconds, or `carry` if that is more, after the last `carry` seconds before each. seconds: a column of whole seconds."""
    length = max(length, carry, 1)
    part = F.floor(F.col(seconds) / length)
    late = F.pmod(F.col(seconds), F.lit(length)) >= length - carry
    copies = F.when(late, F.array(F.struct(part.alias("p"), F.lit(True).alias("o")), F.struct((part + 1).alias("p"), F.lit(False).alias("o")))).otherwise(F.array(F.struct(part.alias("p"), F.lit(True).alias("o"))))
    return df.withColumn("__copy", F.explode(copies)).withColumn(PART, F.col("__copy.p")).withColumn(OWN, F.col("__copy.o")).drop("__copy")
