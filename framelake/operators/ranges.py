"""Points in intervals and boxes that touch, without nested loops: running sums over sorted ends, and cells of several sizes.

Both work on distinct places, so rows that share a place cost one, and nothing is broadcast that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running

#: Cells of one level are this many times as wide as those below.
FAN = 16
#: Levels that hold every box with sides of up to 2**31.
LEVELS = 8
BOX = ["l", "r", "t", "b"]


def covered(points: DataFrame, intervals: DataFrame, at: str, start: str, stop: str) -> DataFrame:
    """The distinct values of points[at] inside some interval, stop exclusive.

    Ends are added up where they lie; the running sum over ends and points in order, by ranges of places, is how many
    intervals are open at a point. Empty intervals and null ends hold nothing.
    """
    real = intervals.where(F.col(start) < F.col(stop))
    ends = real.select(F.col(start).alias("at"), F.lit(1).cast("long").alias("open")).unionByName(real.select(F.col(stop).alias("at"), F.lit(-1).cast("long").alias("open")))
    places = ends.groupBy("at").agg(F.sum("open").alias("open")).withColumn("point", F.lit(False))
    asked = points.select(F.col(at).alias("at"), F.lit(0).cast("long").alias("open"), F.lit(True).alias("point")).where("at IS NOT NULL").distinct()
    line = places.unionByName(asked).withColumn("line", F.lit(0))
    return running(line, ["line"], ["at", "point"], sums=["open"]).where("point AND open > 0").select(F.col("at").alias(at))


def _cells(level: Column, low: str, high: str) -> Column:
    """Cells of a level that [low, high] meets."""
    size = F.pow(F.lit(float(FAN)), level)
    return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))


def _own_level() -> Column:
    """The lowest level whose cells are as large as the box: it meets four of them at most, there and above."""
    side = F.greatest(F.col("r").cast("double") - F.col("l"), F.col("b").cast("double") - F.col("t"))
    return F.coalesce(*[F.when(side <= float(FAN**k), F.lit(k)) for k in range(LEVELS)], F.lit(LEVELS))


def _placed(boxes: DataFrame, above: int) -> DataFrame:
    """boxes(l, r, t, b) in the cells of every level from their own + above on; rank is the own level."""
    levels = boxes.withColumn("rank", _own_level()).withColumn("level", F.explode(F.sequence(F.col("rank") + above, F.greatest(F.lit(LEVELS), F.col("rank") + above))))
    return levels.withColumn("x", _cells(F.col("level"), "l", "r")).withColumn("y", _cells(F.col("level"), "t", "b"))


def touching(boxes: DataFrame, others: DataFrame) -> DataFrame:
    """The distinct boxes(l, r, t, b) that touch one of others(l, r, t, b), ends included; boxes with l > r or t > b touch nothing.

    Two boxes meet in the cells of the larger one's level. Each box goes to at most four cells of each level, and the join is on
    (level, cell); which of two is the larger is part of the key, so each pair meets in one kind of key only.
    """
    whole = F.col("l").isNotNull() & F.col("t").isNotNull() & (F.col("l") <= F.col("r")) & (F.col("t") <= F.col("b"))
    a, b = boxes.select(*BOX).where(whole).distinct(), others.select(*BOX).where(whole).distinct()
    found = None
    # the other box is as large or larger: it stays in cells of its level; or it is smaller, and this one does
    for mine, theirs in ((_placed(a, 0), _placed(b, 0).where("level = rank")), (_placed(a, 0).where("level = rank"), _placed(b, 1))):
        x, y = mine.alias("x"), theirs.alias("y")
        same = "x.level = y.level AND x.x = y.x AND x.y = y.y"
        hit = x.join(y, F.expr(f"{same} AND x.l <= y.r AND x.r >= y.l AND x.t <= y.b AND x.b >= y.t"), "left_semi").select(*BOX)
        found = hit if found is None else found.unionByName(hit)
    return found.distinct()
