"""Folds along a key in order, and linear recurrences along a series, in linear time and bounded memory."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..sources.scratch import written
from .slices import OWN, PART, PLACE, by_rows


def keyed_fold(df: DataFrame, keys: list[str], order: list[str], takes: list[str], schema: str, begin: Any, step: Callable[..., tuple[Any, tuple | None]]) -> DataFrame:
    """(keys, order, schema): what `step` makes of each row, in the order of each key.

    step(state, *order, *takes) gives the next state and the row's values for `schema`, or None to leave the row out; a key begins with `begin`, which isn't
    changed in place. Spark deals rows out by key and sorts them, spilling where it must; a task then reads them in batches and carries one state from row
    to row, so a key's history may be of any length and takes time in proportion. Rows that `order` doesn't tell apart go by `takes`. Null keys are one key.
    """
    kept = [*keys, *order]
    out = StructType([df.schema[c] for c in kept] + StructType.fromDDL(schema).fields)
    names, kinds = out.names, [to_arrow_type(f.dataType) for f in out.fields[len(kept) :]]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state = begin
        for batch in batches:
            at, made = [], []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if row[:n] != key:
                    key, state = row[:n], begin
                state, values = step(state, *row[n:])
                if values is not None:
                    at.append(i), made.append(values)
            if at:
                rows = pa.array(at, pa.int32())
                columns = zip(*made, strict=True) if kinds else ()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(len(kept))), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    wanted = df.select(*kept, *takes)
    return wanted.repartition(*keys).sortWithinPartitions(*kept, *takes).mapInArrow(run, out)


#: How far a slice's weights may fall: 10 ** -FALL still fits a double both ways, and what lies a whole slice back can't show in one.
FALL = 150


def decayed(df: DataFrame, keys: list[str], order: list[str], slice_of: Column, keep: float, terms: dict[str, Callable[[Column, Column, Column], Column]]) -> DataFrame:
    """df with PLACE (a row's number in its series) and, for each term, its recurrence x = keep * x_before + term, under `name`, and `name`_before.

    terms: name to a function of (PLACE, the `_before` of the term ahead of it, or null), so that a later recurrence may use an earlier one. Each step is the affine map
    x -> keep * x + term, and maps compose: a slice of a series is itself one, keep ** rows and a weighted sum. So sums run within slices, side by side, and
    a slice takes in what the one before gives out, by an equi-join on its number: a long series is as many tasks as it has slices. Slices are so long that
    what lies two back weighs less than 10 ** -FALL of its value. slice_of: as in by_rows.
    """
    keep = max(keep, 1e-12)
    rows = max(2, math.floor(FALL / -math.log10(keep))) if keep < 1 else 0
    if not rows:
        raise ValueError("keep must be below 1")
    now = by_rows(df, keys, order, slice_of, 0, rows).drop(OWN)
    at = F.col(PLACE) - F.col(PART) * rows
    whole = Window.partitionBy(*keys, PART).orderBy(PLACE)
    before: Column = F.lit(None).cast("double")
    for name, term in terms.items():
        now = written(now.withColumn("__term", term(F.col(PLACE), before).cast("double")), name)
        weight = F.pow(F.lit(keep), at.cast("double"))
        share = F.col("__term") / weight
        ends = now.groupBy(*keys, PART).agg(F.sum(share).alias("__sum"), F.max(at).alias("__rows")).withColumn("__own", F.col("__sum") * F.pow(F.lit(keep), F.col("__rows").cast("double")))
        ends = written(ends.select(*keys, PART, "__own"), f"{name}-ends")
        one, two = ends.alias("one"), ends.select(*(F.col(k).alias(f"__{k}") for k in keys), (F.col(PART) + 1).alias("__next"), F.col("__own").alias("__older")).alias("two")
        same = [F.col(f"one.{k}").eqNullSafe(F.col(f"__{k}")) for k in keys]
        given = one.join(two, [F.col(f"one.{PART}") == F.col("__next"), *same], "left").select(*(F.col(f"one.{k}").alias(f"__{k}") for k in keys), (F.col(f"one.{PART}") + 1).alias("__next"), (F.col("__own") + F.coalesce("__older", F.lit(0.0)) * F.pow(F.lit(keep), F.lit(float(rows)))).alias("__in"))
        same = [now[k].eqNullSafe(given[f"__{k}"]) for k in keys]
        joined = now.join(given, [now[PART] == given["__next"], *same], "left").select(*(now[c] for c in now.columns), F.coalesce("__in", F.lit(0.0)).alias("__in"))
        upto, ahead = F.sum(share).over(whole), F.sum(share).over(whole.rowsBetween(Window.unboundedPreceding, -1))
        joined = joined.withColumn(name, weight * (upto + F.col("__in")))
        first = F.col(PLACE) == 1
        joined = joined.withColumn(f"{name}_before", F.when(~first, weight / keep * (F.coalesce(ahead, F.lit(0.0)) + F.col("__in"))))
        now, before = joined.drop("__term", "__in"), F.col(f"{name}_before")
    return now.drop(PART)
