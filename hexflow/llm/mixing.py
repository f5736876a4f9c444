"""Mixing sources to target token weights by entropy balancing, in DataFrame operations only.

Among all rates r >= 0 with ``sum(size * r) = target`` in every source, the ones nearest to 1 in
relative entropy are exponential tilts ``exp(lambda)``; the dual is convex and its Newton step for a
source is ``lambda - 1 + target / (S * exp(lambda))``.  A source's documents share one constraint,
so ``S = sum(size)`` is all a step needs of them: documents are aggregated once, and the iterations
run over all sources at once as a column expression.

Rates become whole copies by systematic rounding: documents of a source are ranked by size, and
document k gets an extra copy where ``(k * fraction + phase)`` passes a whole number, so any stretch
of equal sizes is at most one copy off.  Of 16 phases each source takes the one nearest its target.
Ranks come from one range partitioning of all rows, so no source is gathered in one task.

A constraint on a source's words alone tilts all its documents alike, so the balance has one rate a
source, ``target / S`` in closed form, to which the iterations converge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexflow.llm.scratch import Scratch, files_for

WEIGHTS = (5, 2, 1)
CAP = 3
ITERATIONS = 200
MILLION = 1_000_000
PHASES = 16
SALTS = 16


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, sid, source_size, target, rate_ppm): one row a source of ``sized`` (source, size).

    Sources by code point, null last, take ``weights`` in turn and share the sum of all sizes by
    weight; a target stops at ``cap`` times its source's size and the excess is shared again among
    the others until none is above (a common water level per unit of weight).
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("sid", F.row_number().over(in_order)).withColumn("weight", weight.cast("double"))
    per = per.withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
    filling = W.orderBy(F.col("most") / F.col("weight"), "sid")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    full, full_weight = F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything).cast("double") - full) / (F.sum("weight").over(everything) - full_weight)
    per = per.withColumn("level", level)
    reached = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("at"), "sid", "level"))
    per = per.withColumn("level", F.min(reached).over(everything)["level"])
    per = per.withColumn("target", F.least("most", F.col("level") * F.col("weight")))
    wanted = F.col("target") / F.col("source_size")
    tilt = F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), F.lit(0.0), lambda v, _: v - 1.0 + wanted * F.exp(-v))
    rate = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.exp(tilt)).otherwise(0.0)
    return per.select("source", "sid", "source_size", "target", F.floor(rate * MILLION + 0.5).cast("long").alias("rate_ppm"))


def _passed(count: Column, ppm: Column, phase: Column) -> Column:
    """How many of the first ``count`` documents have an extra copy."""
    return F.call_function("div", count * ppm + phase, F.lit(MILLION))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of ``docs`` (doc_id, text, source).

    ``size`` counts the words of the text (null: 0), ``taken = copies * size``, and copies are never
    more than ``cap``.  A null source is a source of its own; documents without words keep one copy
    that takes nothing; with an empty table the result is empty.  Equal rows are ranked by doc_id,
    and rows that share a doc_id may get different copies.  Reruns agree where doc_id is unique.
    Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(docs.select("doc_id", "source", word_count().alias("size")), "sized")
    sources = scratch.save(source_targets(sized, weights, cap), "sources")
    rows = sized.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    ranked = _ranked(scratch, rows)

    frac, whole = F.col("rate_ppm") % F.lit(MILLION), F.call_function("div", F.col("rate_ppm"), F.lit(MILLION))
    phases = [F.lit(j * (MILLION // PHASES)).cast("long") for j in range(PHASES)]

    def extra(phase: Column) -> Column:
        return _passed(F.col("rank") + 1, frac, phase) - _passed(F.col("rank"), frac, phase)

    tried = ranked.groupBy("sid", "target").agg(*[F.sum(F.col("size") * (whole + extra(p))).alias(f"t{j}") for j, p in enumerate(phases)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("off"), p.alias("phase")) for j, p in enumerate(phases)]))
    chosen = tried.select("sid", nearest["phase"].alias("phase"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(whole + extra(F.col("phase")))
    out = ranked.join(chosen, "sid").withColumn("copies", F.least(copies, F.lit(cap)).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def _ranked(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 in their source by size (largest first), salt and doc_id.

    One range partitioning puts all rows in order; a row's place is its place in its partition, which
    monotonically_increasing_id holds, less where its source begins there, and the source's rows in
    earlier partitions.  Those counts have one row a partition and source, so no task and no broadcast
    grows with a source.
    """
    in_order = [F.col("sid"), F.col("size").desc(), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SALTS)), F.col("doc_id")]
    placed = rows.repartitionByRange(*in_order).sortWithinPartitions(*in_order).withColumn("at", F.monotonically_increasing_id())
    placed = scratch.save(placed.withColumn("part", F.shiftright("at", 33)), "placed")
    starts = placed.groupBy("sid", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("sid", "part", (before - F.col("first")).alias("shift"))
    starts = scratch.save(starts.repartition(files_for(placed.count(), 1 << 20)), "starts")
    return placed.join(starts, ["sid", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with every row repeated as often as ``mix`` takes it.

    Rows that share a doc_id, or have none, are repeated alike: as often as the one taken most.
    """
    names = docs.columns
    n = "n" + "_" * max(map(len, names))  # clashes with no column
    copies = mix(docs, weights, cap).groupBy(F.col("doc_id").alias(f"{n}id")).agg(F.max("copies").alias(n))
    out = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(f"{n}id")))
    return out.filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*names)


#: The same result in DuckDB's dialect, with the dual solved in closed form.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM sized GROUP BY source
), weighed AS (
  SELECT *, (CASE (sid - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END)::DOUBLE AS weight, ({CAP} * source_size)::DOUBLE AS most FROM per
), levels AS (
  SELECT *, most / weight AS at_level,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, sid, source_size, least(most, weight * (SELECT level FROM levels WHERE level <= at_level ORDER BY at_level, sid LIMIT 1)) AS target FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size > 0 AND target > 0 THEN floor(target / source_size * {MILLION} + 0.5)::BIGINT ELSE 0 END AS ppm FROM targets
), rows_ AS (
  SELECT s.doc_id, s.size, r.sid, r.source_size, r.target, r.ppm, ((s.doc_id % {SALTS}) + {SALTS}) % {SALTS} AS salt FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY size DESC, salt, doc_id) - 1 AS k FROM rows_
), tried AS (
  SELECT sid, target, phase, sum(size * (ppm // {MILLION} + ((k + 1) * (ppm % {MILLION}) + phase) // {MILLION} - (k * (ppm % {MILLION}) + phase) // {MILLION})) AS total
  FROM ranked, (SELECT (range * {MILLION // PHASES})::BIGINT AS phase FROM range({PHASES})) GROUP BY sid, target, phase
), chosen AS (
  SELECT sid, phase FROM tried QUALIFY row_number() OVER (PARTITION BY sid ORDER BY abs(total - target), phase) = 1
), copied AS (
  SELECT r.*, CASE WHEN size = 0 THEN 1 ELSE least({CAP}, ppm // {MILLION} + ((k + 1) * (ppm % {MILLION}) + phase) // {MILLION} - (k * (ppm % {MILLION}) + phase) // {MILLION}) END AS copies
  FROM ranked r JOIN chosen USING (sid)
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INTEGER AS copies FROM copied
"""
