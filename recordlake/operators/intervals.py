"""Points in intervals without a range join: both meet at the nodes of a binary tree over the dates.

An interval is the union of at most two nodes a level, a point lies in one node a
level, and a point lies in an interval just if they share a node.  So the least value
of the intervals around each point is one aggregation of the intervals by
node, one equi-join on (key, level, node) and one aggregation of the points; a key with
10^5 intervals and 10^5 points costs some 10^6 rows instead of 10^10 pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .rankings import ordinals

FEW = 1 << 16  # values that one task numbers


def places(*values: tuple[DataFrame, str]) -> tuple[DataFrame, int]:
    """((value, place) from 1 in rising order of all distinct values but null, number of levels above them)."""
    each = [df.select(F.col(c).alias("value")) for df, c in values]
    distinct = cut(reduce(lambda a, b: a.union(b), each).where("value is not null").distinct())
    most = distinct.count()
    # few values (dates are few) are numbered by one task
    numbered = distinct.withColumn("place", F.row_number().over(Window.orderBy("value")).cast("long")) if most <= FEW else ordinals(distinct, [F.col("value")], "place")
    return numbered, (most + 1).bit_length()


def placed(df: DataFrame, column: str, numbered: DataFrame, name: str) -> DataFrame:
    """`df` with the place of a column's value; null without one."""
    n = numbered.select(F.col("value").alias(f"{name}_value"), F.col("place").alias(name))
    return df.join(n, F.col(column) == F.col(f"{name}_value"), "left").drop(f"{name}_value")


def cover(first: Column, last: Column, levels: int) -> Column:
    """Nodes (struct of level and node) whose union is first..last; none where last < first."""

    def at(level: Column) -> Column:
        a, b = _shift("shiftright", first + _shift("shiftleft", F.lit(1).cast("long"), level) - 1, level), _shift("shiftright", last + 1, level)
        left, right = F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1)
        return F.array(F.struct(level.alias("level"), left.alias("node")), F.struct(level.alias("level"), right.alias("node")))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda x: x["node"].isNotNull())


def _shift(which: str, value: Column, level: Column) -> Column:
    return F.call_function(which, value, level)


def around(place: Column, levels: int) -> Column:
    """The nodes that hold a place."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), _shift("shiftright", place, k).alias("node")))


def least_value(points: DataFrame, nodes: DataFrame, key: str, point: list[str]) -> DataFrame:
    """The least `value` of `nodes` (key, x: level and node, value) for every point (key, point.., x: list of nodes) that shares a node."""
    held = nodes.groupBy(key, "x.level", "x.node").agg(F.min("value").alias("value"))
    asked = points.select(key, *point, F.explode("x").alias("x")).select(key, *point, "x.level", "x.node")
    return asked.join(held, [key, "level", "node"]).groupBy(key, *point).agg(F.min("value").alias("value"))
