"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Each source has a target in words: its weight's share of all words, at most `most` times its own words, the excess
reshared by weight (a water level over sources sorted by cap / weight). Documents have relative weights, by default a
little more for longer ones: a document is expected to be copied e = least(most, rate * weight) times, and what the capped
ones leave goes to the others of the source, so the rate is a water level too, over the classes of equal weight. floor(e)
whole copies are certain, and the fraction p = e - floor(e) is the inclusion probability in one more copy. Documents are
ranked by random odds over inclusion odds, u / (1 - u) * (1 - p) / p with u from a digest of id and seed, and the lowest
are taken until the source's missing words are met: a sample of fixed size, measured in words.

The cut of a source is found by two levels of 256 histogram bins over the rank and one exact window over the bin
that holds it, so a source with a third of all rows costs one task at most 1/65536 of its rows.

Null texts have no words, null sources are a source of their own (last in order), a source without words has target 0,
equal ranks (repeated or null ids) are taken together, and an empty table gives an empty result. Very long texts count
like others. Other columns pass; those named size, source_size, target or copies are replaced. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, text_of

BINS = 256
#: Document weights are whole numbers from 0 to this.
MOST_WEIGHT = 1000
#: Sources beyond which the table of targets is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def by_length(size: str = "size") -> Column:
    """The default weight of a document: 4, 5 from 100 words on, 6 from 1,000 on."""
    return F.lit(4) + (F.col(size) >= 100).cast("int") + (F.col(size) >= 1000).cast("int")


def _whole(weight: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(MOST_WEIGHT), F.round(weight))), F.lit(0)).cast("long")


def _uniform(key: str, seed: int) -> Column:
    """52 bits of the MD5 of id and seed, in the middle of their steps: inside (0, 1)."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """sizes(source, source_size) with target: the water level over all sources, one row each."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(most))
    everything = Window.partitionBy()
    rank = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = weighed.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    # caps fill in rank order: from the first source that isn't full on, all share its level
    water = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level")))).over(everything)["level"]
    return levelled.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * water).alias("target"))


def plan(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """sized(source, size, u, doc_weight) -> (source, source_size, target, rate, below, upto): one row a source.

    A document's extra copy is taken if its rank key is under `below` or not over `upto`. rate: copies per unit of
    relative weight.
    """
    classes = staged(sized.groupBy("source", "doc_weight").agg(F.sum("size").alias("size")), "mix-classes")
    level = targets(classes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goal = staged(level.join(_rates(classes, level, most), F.expr("source <=> s")).drop("s"), "mix-goal")

    keyed = staged(_ranked(sized, goal, most).select("source", "size", "certain", "key"), "mix-rank")
    need = keyed.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure")).withColumnRenamed("source", "s").join(goal, F.expr("s <=> source")).select("source", (F.col("target") - F.col("sure")).alias("need"))
    need = staged(need.withColumn("lo", F.lit(0)).withColumn("words", F.lit(0).cast("long")), "mix-need")

    open_rows = keyed.where(F.col("key").isNotNull())
    for level in (1, 2):
        bin_of = F.floor(F.col("key") * (BINS**level)).cast("long")
        inside = _with(open_rows, need).where(bin_of.between(F.col("lo") * BINS, F.col("lo") * BINS + BINS - 1))
        bins = inside.groupBy("source", bin_of.alias("bin")).agg(F.sum("size").alias("bin_words"))
        upto = Window.partitionBy("source").orderBy("bin")
        held = _with(bins, need).withColumn("after", F.col("words") + F.sum("bin_words").over(upto))
        first = held.where(F.col("after") > F.col("need")).groupBy("source").agg(F.min(F.struct("bin", (F.col("after") - F.col("bin_words")).alias("words"))).alias("b"))
        # without a crossing bin every row is taken: the cut lies past the last bin
        need = staged(need.select(F.col("source").alias("s"), "need").join(first, F.expr("s <=> source"), "left").select(F.col("s").alias("source"), "need", F.coalesce("b.bin", F.lit(BINS**level)).alias("lo"), F.coalesce("b.words", F.lit(0)).alias("words")), "mix-need")

    inside = _with(open_rows, need).where(F.floor(F.col("key") * BINS**2) == F.col("lo"))
    by_rank = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)  # ties are summed below
    ties = inside.groupBy("source", "key", "need", "words").agg(F.sum("size").alias("size"))
    last = ties.withColumn("before", F.col("words") + F.coalesce(F.sum("size").over(by_rank), F.lit(0))).where(F.col("before") + F.col("size") / 2.0 <= F.col("need")).groupBy("source").agg(F.max("key").alias("upto"))
    cut = need.select(F.col("source").alias("s"), (F.col("lo") / float(BINS**2)).alias("below")).join(last, F.expr("s <=> source"), "left").select("s", "below", "upto")
    return staged(goal.join(cut, F.expr("s <=> source")).drop("s"), "mix-plan")


def _rates(classes: DataFrame, level: DataFrame, most: float) -> DataFrame:
    """(s, rate) of each source: copies per unit of weight, so that all copies make the target while none passes `most`.

    The heaviest classes are capped first; the heaviest class that isn't capped has the rate of all that follow.
    """
    heaviest = Window.partitionBy("source").orderBy(F.col("doc_weight").desc())
    capped = F.coalesce(F.sum("size").over(heaviest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    rest = F.sum(F.col("size") * F.col("doc_weight")).over(heaviest.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    held = classes.withColumns({"capped": capped, "rest": rest}).withColumnRenamed("source", "s").join(level, F.expr("source <=> s"))
    held = held.withColumn("rate", F.when(F.col("rest") > 0, (F.col("target") - F.col("capped") * float(most)) / F.col("rest")))
    open_classes = F.when(F.col("rate") * F.col("doc_weight") < float(most), F.struct("doc_weight", "rate"))
    full = F.when(F.max("source_size") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    return held.groupBy("s").agg(F.coalesce(F.max(open_classes)["rate"], full).alias("rate"))


def _with(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows joined with a table of one row per source, null sources too; broadcast only if that table is small."""
    few = sources.count() <= BROADCAST_SOURCES
    other = sources.withColumnRenamed("source", "__s")
    return rows.join(F.broadcast(other) if few else other, F.expr("source <=> __s")).drop("__s")


def _ranked(rows: DataFrame, goal: DataFrame, most: float) -> DataFrame:
    """rows with certain (whole copies) and key: rank q / (1 + q) of the extra copy, null if it can't be taken."""
    expected = F.least(F.lit(float(most)), F.col("rate") * F.col("doc_weight"))
    p = F.col("expected") - F.col("certain")
    q = F.col("u") / (1 - F.col("u")) * ((1 - p) / p)
    ranked = _with(rows, goal).withColumn("expected", expected).withColumn("certain", F.floor("expected").cast("long"))
    return ranked.withColumn("key", F.when(p > 0, q / (1 + q)))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 0, key: str = "doc_id", doc_weight: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and copies (whole number, 0 to `most`). Texts are read, never shuffled.

    doc_weight: a document's relative weight inside its source, a whole number up to MOST_WEIGHT (others are rounded; null
    is 0, and such documents are not taken); by default by_length().
    """
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    weighed = docs.withColumn("__w", F.lit(None).cast("int") if doc_weight is None else doc_weight)
    # the table's own columns travel in one, so that none has the name of a column made here
    sized = weighed.select("source", F.struct(*kept).alias("__row"), "__w", word_count().alias("size"), _uniform(key, seed).alias("u"))
    own = sized.withColumn("doc_weight", by_length().cast("long") if doc_weight is None else _whole(F.col("__w"))).drop("__w")
    cuts = plan(staged(own.select("source", "size", "u", "doc_weight"), "mix-sizes"), weights, most)
    taken = (F.col("key") < F.col("below")) | (F.col("key") <= F.col("upto"))
    copies = F.col("certain") + F.coalesce(taken, F.lit(False)).cast("long")
    return _ranked(own, cuts, most).select("__row.*", "size", "source_size", "target", copies.alias("copies"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  (CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':0'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u FROM documents),
d2 AS (SELECT *, 4 + CAST(size >= 100 AS INT) + CAST(size >= 1000 AS INT) AS w FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap
  ELSE weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap > weight * level) END AS target FROM l),
cl AS (SELECT source, w, sum(size) AS n FROM d2 GROUP BY source, w),
cc AS (SELECT source, w, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS capped,
  CAST(sum(n * w) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest FROM cl),
cr AS (SELECT t.*, cc.w, CASE WHEN rest > 0 THEN (t.target - capped * 3.0::DOUBLE) / rest END AS rate FROM cc JOIN t ON cc.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, any_value(source_size) AS source_size, any_value(target) AS target,
  coalesce(arg_max(rate, w) FILTER (WHERE rate * w < 3.0::DOUBLE), CASE WHEN any_value(source_size) > 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM cr GROUP BY source),
r AS (SELECT d2.*, g.source_size, g.target, least(3.0::DOUBLE, g.rate * d2.w) AS e FROM d2 JOIN g ON d2.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, CAST(floor(e) AS BIGINT) AS certain, e - floor(e) AS pi FROM r),
k AS (SELECT *, CASE WHEN pi > 0 THEN u / (1 - u) * ((1 - pi) / pi) END AS q FROM p),
c AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before,
  target - sum(certain * size) OVER (PARTITION BY source) AS need FROM k)
SELECT doc_id, size, source_size, target,
  CAST(size * (certain + CASE WHEN q IS NOT NULL AND before + size / 2.0 <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
