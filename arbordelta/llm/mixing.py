"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of the wanted words, held at `most` times its own size; what is left over is
shared out again by weight. That fixed point is a water level, found from running sums over the sources ordered by
cap / weight, so no loop runs. Each document is then expected `copies` times (target / size of its source, spread by
the documents' own weights); the whole part of it is taken for certain. For the rest, p, documents are ranked by
Pareto's key (u / (1 - u)) / (p / (1 - p)), u a hash of doc_id and seed, and taken in that order until the source's
words reach its target; the document on the border gives only the words still wanted, so a source meets its rounded target.

The order is never built in one task: keys are cut into `bins` ranges, words are summed by source and range, and only
the range that holds the border is ordered. All joins on the source carry a salt.

Defined cases: null and empty texts have size 0 and give 0 words; a null source is a source of its own, ordered last;
sources of size 0 have target 0; repeated rows count as documents of their own with the same key (a tie that any
order of the two resolves alike); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

SALTS = 32


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target. sizes: source, source_size, a row for each source (one task orders these rows)."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = weighed.withColumns({"cap": cap, "ratio": cap / F.col("w")})
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everywhere = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    # With the sources before this one at their caps, the level that the others would share.
    level = (F.sum("source_size").over(everywhere) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = ranked.withColumns({"level": level, "place": F.row_number().over(order)})
    # The first source that the level does not fill up to its cap fixes it for all after it.
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everywhere)["level"]
    return levels.withColumn("water", water).select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("water") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 20, document_weight: Column | None = None, bins: int = 1024, key: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies. document_weight (positive) tilts the inclusion odds within a source.

    key: a column that tells rows apart; it is returned too, and documents without doc_id are drawn by it.
    """
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    drawn_by = F.col("doc_id").cast("long") if key is None else F.coalesce(F.col("doc_id").cast("long"), F.col(key))
    own = [] if key is None else [key]
    hashed = F.xxhash64(drawn_by, F.lit(seed))
    unit = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"),
        unit.alias("u"), (F.lit(1.0) if document_weight is None else document_weight.cast("double")).alias("dw"),
        F.pmod(F.xxhash64(drawn_by, F.lit(seed + 1)), F.lit(SALTS)).cast("int").alias("salt"), *own,
    )
    light = materialize(light, "mix")
    sums = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("dw") * F.col("size")).alias("tilted"))
    plan = targets(sums.select("source", "source_size"), weights, share, most)
    plan = materialize(plan.join(sums.select(F.col("source").alias("s"), "tilted"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-plan")

    by_source = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(F.col("source").alias("ps"), F.col("salt").alias("psalt"), "source_size", "target", "tilted")
    rows = light.join(by_source, F.col("source").eqNullSafe(F.col("ps")) & (F.col("salt") == F.col("psalt"))).drop("ps", "psalt")
    expected = F.least(F.lit(float(most)), F.coalesce(F.col("target") * F.col("dw") / F.when(F.col("tilted") > 0, F.col("tilted")), F.lit(0.0)))
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    # The same factor for a whole source keeps the order and spreads its keys evenly over the bins.
    even = F.col("target") / F.col("source_size")
    even = F.least(F.greatest(even - F.floor(even), F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))) * (even / (1 - even))
    # q orders as the odds do; documents without a fraction left are last.
    rows = rows.withColumn("q", F.when((F.col("p") > 0) & (F.col("whole") < most), odds / (1 + odds)).otherwise(F.when(F.col("whole") < most, 1.0)))
    rows = rows.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("q") * bins)).cast("int"))

    cells = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    per_source = W.partitionBy("source")
    cells = cells.withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.sum("certain").over(per_source)))
    running = F.sum("words").over(per_source.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    cells = cells.where("bin is not null").withColumn("to", running).where(F.col("to") >= F.col("rest"))
    border = cells.groupBy("source").agg(F.min(F.struct("bin", "rest", (F.col("to") - F.col("words")).alias("before"))).alias("b"))
    border = border.select(F.col("source").alias("bs"), F.col("b.bin").alias("border"), (F.col("b.rest") - F.col("b.before")).alias("wanted"))
    border = border.withColumn("bsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.join(border, F.col("source").eqNullSafe(F.col("bs")) & (F.col("salt") == F.col("bsalt")), "left").drop("bs", "bsalt")
    # Rows off the border range are ordered among themselves only by salt and range: their running sum is not used.
    at_border = F.col("bin") == F.col("border")
    group = W.partitionBy("source", F.when(at_border, F.lit(-1)).otherwise(F.col("salt")), F.when(at_border, F.lit(-1)).otherwise(F.col("bin")))
    ahead = F.coalesce(F.sum("size").over(group.orderBy("q", "doc_id", "size", *own).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    more = F.when(F.col("bin") < F.col("border"), F.col("size")).when(at_border, F.greatest(F.lit(0), F.least(F.col("size"), F.col("wanted") - ahead))).otherwise(F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"), F.col("whole").cast("int").alias("whole_copies"), *own)
