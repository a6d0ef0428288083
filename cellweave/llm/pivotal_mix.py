"""Mixing sources to target weights by pivotal dependent rounding.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, Stages

#: Units that one fold of the reduction tree takes on average.
LEAF = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Target of each source of ``sizes(source, source_size, units)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes; a target
    stops at ``most`` times its source's size and the excess is reshared by weight.  The end of that resharing is
    a common level ``z``: target = min(most * size, z * weight).  Sorted by most * size / weight, the sources that
    stop come first, so running sums give ``z``.  One row per source goes through the window.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    level = (F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", level).withColumn("stops", F.col("level") > F.col("cap") / F.col("weight"))
    z = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least(F.col("cap"), z * F.col("weight")))
    return t.withColumn("target", target).select("source", "source_size", "units", "target")


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(2**53))


def _fold(units: Column, seed: int) -> Column:
    """Pairs units in turn: mass moves between two fractions, their sum of words kept, until one is 0 or 1."""
    first = F.element_at(units, 1)
    done_type = "array<struct<unit:bigint,extra:int>>"

    def merge(acc: Column, b: Column) -> Column:
        a = acc["left"]
        pa, pb, sa, sb = a["p"], b["p"], a["words"].cast("double"), b["words"].cast("double")
        up, down = F.least(1 - pa, pb * sb / sa), F.least(pa, (1 - pb) * sb / sa)
        total = up + down
        rise = F.when(total > 0, _uniform(a["unit"], b["unit"], F.lit(seed)) * total < down).otherwise(pa >= 0.5)
        a_ends = F.when(rise, 1 - pa <= pb * sb / sa).otherwise(pa <= (1 - pb) * sb / sa)
        ends = F.when(rise == a_ends, 1).otherwise(0)  # a rises to 1, or a falls and so b rises to 1
        other = (
            F.when(rise & a_ends, pb - (1 - pa) * sa / sb)
            .when(rise, pa + pb * sb / sa)
            .when(a_ends, pb + pa * sa / sb)
            .otherwise(pa - (1 - pb) * sb / sa)
        )
        other = F.least(F.greatest(other, F.lit(0.0)), F.lit(1.0))
        out = F.struct(F.when(a_ends, a["unit"]).otherwise(b["unit"]).alias("unit"), ends.cast("int").alias("extra"))
        left = F.struct(
            F.when(a_ends, b["unit"]).otherwise(a["unit"]).alias("unit"),
            F.when(a_ends, b["words"]).otherwise(a["words"]).alias("words"),
            other.alias("p"),
        )
        return F.struct(left.alias("left"), F.concat(acc["done"], F.array(out)).alias("done"))

    start = F.struct(
        F.struct(first["unit"].alias("unit"), first["words"].alias("words"), first["p"].alias("p")).alias("left"),
        F.array().cast(done_type).alias("done"),
    )
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, merge)


def copies(units: DataFrame, stages: Stages, seed: int = 17, leaf: int = LEAF) -> DataFrame:
    """Copies ``(unit, extra)``, extra 0 or 1, of ``units(source, unit, words, p)`` with expectation p.

    Leaves are hash buckets of about ``leaf`` units of one source; each is folded to at most one fractional unit,
    and every level above folds ``leaf`` of those, so no source, however large, meets in one task.  The words
    taken from a source differ from their expectation by less than one unit's words.
    """
    rows = units.where("p > 0 and words > 0")
    per_source = rows.groupBy("source").agg(F.greatest(F.ceil(F.count(F.lit(1)) / leaf), F.lit(1)).alias("buckets"))
    level = (
        rows.join(per_source, rows["source"].eqNullSafe(per_source["source"]))
        .drop(per_source["source"])
        .withColumn("bucket", F.pmod(F.xxhash64("unit", F.lit(seed)), F.col("buckets")))
    )
    out, tables = [], 0
    while True:
        grouped = level.groupBy("source", "buckets", "bucket").agg(F.sort_array(F.collect_list(F.struct("unit", "words", "p"))).alias("units"))
        folded = stages.save(grouped.select("source", "buckets", "bucket", _fold(F.col("units"), seed + tables).alias("f")), "fold")
        out.append(folded.select(F.inline("f.done")))
        most = folded.agg(F.max("buckets")).first()[0]
        tables += 1
        left = folded.select("source", "buckets", "bucket", "f.left.*")
        if most is None or most <= 1:
            break
        level = left.withColumn("bucket", F.expr(f"bucket div {leaf}")).withColumn("buckets", F.expr(f"(buckets + {leaf - 1}) div {leaf}"))
    last = left.select("unit", (_uniform(F.col("unit"), F.lit(seed + 1000)) < F.col("p")).cast("int").alias("extra"))
    for more in out:
        last = last.union(more)
    return last


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan_mix(docs: DataFrame, stages: Stages | None = None, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, source_size, target, text_hash, nth, copies`` of every row of ``docs``.

    A null text has size 0; a null source is a source of its own, last in order; a null or repeated doc_id is
    allowed: rows equal in (doc_id, source, size) form one unit, whose copies are dealt among them in the order
    of the texts' hashes.  Rows of size 0 are taken 0 times.  No row is taken more than ``most`` times.
    Extra columns are ignored.
    """
    stages = stages or Stages(docs.sparkSession, "mix")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    base = stages.save(base, "sizes")
    t = targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("units")), weights, most)
    t = stages.save(t, "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    named = t.withColumnRenamed("source", "of")
    rows = base.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of", "units").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)))
    unit = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), F.col("source"), F.col("size"))
    rows = rows.withColumn("unit", unit)
    units = rows.groupBy("source", "unit", "rate", "size").agg(F.count(F.lit(1)).alias("rows"))
    total = F.col("rate") * F.col("rows")
    units = units.withColumn("whole", F.floor(total)).withColumn("p", total - F.col("whole")).withColumn("words", F.col("size"))
    units = stages.save(units, "units")
    extra = copies(units.select("source", "unit", "words", "p"), stages, seed)
    dealt = units.join(extra, "unit", "left").select("unit", F.col("rows").alias("unit_rows"), (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("unit_copies"))
    nth = F.row_number().over(Window.partitionBy("unit").orderBy("text_hash"))
    rows = rows.join(dealt, "unit").withColumn("nth", nth)
    each = F.expr("unit_copies div unit_rows + if(nth <= unit_copies % unit_rows, 1, 0)")
    return rows.select("doc_id", "source", "size", "source_size", "target", "text_hash", "nth", F.coalesce(each, F.lit(0)).cast("long").alias("copies"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Digest: ``doc_id, size, source_size, target, taken``."""
    p = plan_mix(docs, **options)
    return p.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    cols = docs.columns
    plan = plan_mix(docs, **options)
    own = plan.groupBy(F.col("doc_id").alias("_cw_id"), F.col("source").alias("_cw_source"), F.col("text_hash").alias("_cw_hash")).agg(F.sum("copies").alias("_cw_copies"), F.count(F.lit(1)).alias("_cw_rows"))
    key = docs["doc_id"].cast("long").eqNullSafe(F.col("_cw_id")) & docs["source"].eqNullSafe(F.col("_cw_source")) & (F.xxhash64(docs["text"]) == F.col("_cw_hash"))
    rows = docs.join(own.where("_cw_copies > 0"), key)
    # rows equal in id, source and text share their copies
    nth = F.row_number().over(Window.partitionBy("_cw_id", "_cw_source", "_cw_hash").orderBy("_cw_rows"))
    each = F.when(F.col("_cw_rows") == 1, F.col("_cw_copies")).otherwise(F.expr("_cw_copies div _cw_rows") + (F.col("_cw_nth") <= F.col("_cw_copies") % F.col("_cw_rows")).cast("long"))
    rows = rows.withColumn("_cw_nth", nth).withColumn("_cw_each", F.explode(F.array_repeat(F.lit(1), each.cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in cols])
