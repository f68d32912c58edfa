"""Bands of like size along an order, and numbers and sums across them: no task holds all rows, however the values lie.

The rows are written to the shared folder once, which ends their lineage; then one pass with Spark's mergeable quantile sketch gives the borders, at most BANDS - 1 numbers that come to
the driver. By the sketch's bound a band has at most 2 / BANDS of the rows, rows of one value aside. Small tables have fewer bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.storage import stored

#: Bands at most, and rows of a band at least.
BANDS, LEAST = 1024, 4096


def axis(rows: DataFrame, column: str) -> Column:
    """A double that rises with the column (not strictly): numbers as they are, texts by their first six bytes, times by seconds."""
    kind = rows.schema[column].dataType
    if isinstance(kind, T.StringType | T.BinaryType):
        head = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.datediff(F.col(column), F.lit("1970-01-01")).cast("double")
    return F.col(column).cast("double")


def banded(rows: DataFrame, column: str, bands: int = BANDS, name: str = "__band") -> DataFrame:
    """rows, stored, with a band from 0 that rises with the column; nulls are in band -1."""
    kept = stored(rows, "bands")
    x = axis(kept, column)
    shares = ", ".join(f"{k / bands}D" for k in range(1, bands))
    sketch = F.expr(f"percentile_approx(x, array({shares}), {16 * bands})")
    n, found = kept.select(x.alias("x")).agg(F.count("x"), sketch).first()
    parts = min(bands, -(-n // LEAST)) if n else 1
    borders = sorted({found[k * bands // parts - 1] for k in range(1, parts)})
    if not borders:
        return kept.withColumn(name, F.when(x.isNull(), F.lit(-1)).otherwise(0))
    # how many borders are at or below the value: a binary search in halving steps
    listed, steps = ", ".join(f"double('{b}')" for b in borders), ", ".join(str(1 << k) for k in reversed(range(len(borders).bit_length())))
    band = F.expr(f"aggregate(array({steps}), 0, (s, step) -> s + if(get(array({listed}), s + step - 1) <= __x, step, 0))")
    return kept.withColumn("__x", x).withColumn(name, F.when(F.col("__x").isNull(), F.lit(-1)).otherwise(band)).drop("__x")


def running(rows: DataFrame, by: list[str], value: str, sums: dict[str, str], bands: int = BANDS) -> DataFrame:
    """rows (one for each group and value) with run_<name>: the sum of a column from the largest value down to this one, and all_<name>: the group's. Each band is
    ordered on its own and shifted by the sums of the bands above."""
    spread = banded(rows, value, bands)
    totals = spread.groupBy(*by, "__band").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    group = Window.partitionBy(*by)
    above = group.orderBy(F.desc("__band")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__band", *[F.coalesce(F.sum(f"__t_{n}").over(above), F.lit(0)).alias(f"__a_{n}") for n in sums], *[F.sum(f"__t_{n}").over(group).alias(f"all_{n}") for n in sums])
    totals = totals if by else F.broadcast(totals)  # without groups a row a band
    down = Window.partitionBy(*by, "__band").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    run = spread.join(totals, [*by, "__band"]).select("*", *[(F.col(f"__a_{n}") + F.sum(c).over(down)).alias(f"run_{n}") for n, c in sums.items()])
    return run.drop("__band", *[f"__a_{n}" for n in sums])


def numbered(rows: DataFrame, order: list[str], name: str = "position", by: list[str] = (), bands: int = BANDS) -> DataFrame:
    """rows with their number from 0 in order, nulls first (within a group, if by is given). Bands lie along the first column of the order; rows that share a value of it are in one band."""
    by = list(by)
    spread = banded(rows, order[0], bands)
    counts = spread.groupBy(*by, "__band").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__band", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    counts = counts if by else F.broadcast(counts)
    own = F.row_number().over(Window.partitionBy(*by, "__band").orderBy(*[F.asc_nulls_first(c) for c in order])) - 1
    return spread.join(counts, [*by, "__band"]).withColumn(name, F.col("__before") + own).drop("__band", "__before")
