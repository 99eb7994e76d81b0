"""Places in the order of a whole table, without a window over one partition.

The first column of the order, a number, is cut at its quantiles into cells; the cells'
rows are counted, and each cell is ordered by a task of its own. Equal values of that
column share a cell. The table should be cheap to read, as it is read three times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = 64


def _cell(df: DataFrame, value: str, cells: int) -> Column:
    """How many quantiles are less than the value; nulls come first."""
    cuts = sorted(set(df.where(F.col(value).isNotNull()).approxQuantile(value, [k / cells for k in range(1, cells)], 0.01)))
    less = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)
    return F.when(F.col(value).isNull(), -1).otherwise(less)


def _ahead(cells: DataFrame, n: Column) -> DataFrame:
    """(__cell, __ahead): the sum of n over lesser cells, of which there are a few dozen."""
    w = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(cells.groupBy("__cell").agg(n.alias("__n")).select("__cell", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__ahead")))


def with_place(df: DataFrame, value: str, ties: list, name: str = "rank", descending: bool = False, cells: int = CELLS) -> DataFrame:
    """Adds the row's place from 1 by `value`, then by the columns `ties`."""
    cell = _cell(df, value, cells)
    x = df.withColumn("__cell", -cell if descending else cell)
    order = F.desc(value) if descending else F.asc(value)
    here = F.row_number().over(Window.partitionBy("__cell").orderBy(order, *ties))
    return x.withColumn("__here", here).join(_ahead(x, F.count("*")), "__cell").withColumn(name, (F.col("__here") + F.col("__ahead")).cast("int")).drop("__cell", "__here", "__ahead")


def with_average_place(df: DataFrame, value: str, name: str, cells: int = CELLS) -> DataFrame:
    """Adds the mean of the places that the rows of the same value have."""
    each = df.groupBy(value).agg(F.count("*").alias("__m")).withColumn("__cell", _cell(df, value, cells))
    w = Window.partitionBy("__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("__here", F.coalesce(F.sum("__m").over(w), F.lit(0))).join(_ahead(each, F.sum("__m")), "__cell")
    place = each.select(F.col(value).alias("__value"), (F.col("__ahead") + F.col("__here") + (F.col("__m") + 1) / 2.0).alias(name))
    return df.join(place, F.col(value).eqNullSafe(F.col("__value"))).drop("__value")
