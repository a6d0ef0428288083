"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, components

#: Neighbours that each vector is compared with in one pass.
WINDOW = 128
#: Share of pairs at the threshold that all passes together may miss.
MISS = 1e-4
#: Passes that one job runs.
BATCH = 4
#: Share of all links that may be unseen, by estimate, as the passes end.
UNSEEN = 1e-3
#: Vectors in one block of the comparison within components, and the rows of a block that are compared at once.
BLOCK, STRIP = 2048, 256
BITS = 62
#: Links, and the rows at the ends of a task.
ENDS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("task", pa.int32()), ("tail", pa.bool_()), ("pass", pa.int32()), ("part", pa.int64()), ("code", pa.int64()), ("many", pa.int64()), ("at", pa.int32()), ("cls", pa.int64()), ("embedding", pa.list_(pa.float64()))])
ENDS_SQL = "a long, b long, task int, tail boolean, pass int, part long, code long, many long, at int, cls long, embedding array<double>"


def passes_for(most: int, cosine: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes until a pair at the threshold is missed with probability ``miss``, if hyperplanes part labels evenly.

    Each random hyperplane parts such a pair with probability angle / pi.  In a pass the pair is found if its codes
    agree until fewer than ``window`` vectors share the prefix, after log2(most / window) bits.
    """
    bits = max(0.0, math.log2(max(most, 1) / window))
    found = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 / miss) / -math.log(1 - found))) if found < 1 - 1e-9 else 1


def unseen(once: int, twice: int) -> float:
    """Links that no pass has found, by Chao's estimate from those that one and two passes have found."""
    return once * (once - 1) / (2 * (twice + 1))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    size = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(size, -1) if size else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(first: int, many: int, seed: int):
    """Rows ``(part, cls, embedding)`` to one row per pass with the concatenated signs of random projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array(b.column(2).value_lengths())
            for dim in np.unique(size):
                rows = b.take(pa.array(np.flatnonzero(size == dim)))
                x = _unit(_vectors(rows.column(2)))
                for p in range(first, first + many):
                    planes = np.random.default_rng([seed, p, int(dim)]).standard_normal((int(dim), BITS))
                    code = ((x @ planes > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), rows.column(0), pa.array(code), rows.column(1), rows.column(2)], ["pass", "part", "code", "cls", "embedding"])

    return run


def _windows(cosine: float, window: int):
    """Rows sorted by (pass, part, code): links among neighbours of one pass and part, and the rows at the task's ends.

    Of its first pass and part a task gives the first ``window`` rows (``tail`` false, ``at`` 0 is the first), of its
    last the last ``window`` rows (``tail`` true, ``at`` 0 is the last), with the number of rows that it has of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last rows of the batches before, of one pass and part: key, rows so far, vectors, classes, code of the last
        head = None  # the first rows of the task, of its first pass and part: key, rows so far, vectors, classes, code of the first
        task = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            p, part, code, cls = (b.column(i).to_numpy() for i in (0, 1, 2, 3))
            cut = np.flatnonzero((p[1:] != p[:-1]) | (part[1:] != part[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(p)], strict=True):
                key = (int(p[s]), int(part[s]))
                x, c = _unit(_vectors(b.column(4).slice(s, e - s))), cls[s:e]
                if head is None:
                    head = (key, e - s, x[:window], c[:window], code[s])
                elif head[0] == key:
                    more = window - len(head[3])
                    head = (key, head[1] + e - s, np.concatenate([head[2], x[:more]]), np.concatenate([head[3], c[:more]]), head[4])
                old = many = 0
                if held is not None and held[0] == key:
                    old, many = len(held[3]), held[1]
                    x, c = np.concatenate([held[2], x]), np.concatenate([held[3], c])
                for k in range(1, min(window, len(c) - 1) + 1):
                    lo = max(0, old - k)  # pairs within the held rows were compared before
                    hit = lo + np.flatnonzero(np.einsum("ij,ij->i", x[lo : len(c) - k], x[lo + k :]) >= cosine)
                    if len(hit):
                        none = [pa.nulls(len(hit), t) for t in ENDS.types[2:]]
                        yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(c[hit + k]), *none], schema=ENDS)
                held = (key, many + e - s, x[-window:], c[-window:], code[e - 1])
        if held is not None:
            for tail, (key, many, x, c, last) in ((False, head), (True, held)):
                n = len(c)
                at = np.arange(n)[::-1] if tail else np.arange(n)
                same = [np.full(n, v, t) for v, t in ((task, np.int32), (tail, bool), (key[0], np.int32), (key[1], np.int64), (last, np.int64), (many, np.int64))]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *map(pa.array, same), pa.array(at, pa.int32()), pa.array(c), flat], schema=ENDS)

    return run


def _borders(ends: list, window: int) -> list[tuple[int, int, int]]:
    """``(task, seam, gap)``: the tails of ``task`` that reach the task ``seam``, with ``gap`` rows in between.

    ``ends`` has the first head and the last tail of each task: (task, tail, pass, part, code, many).
    """
    heads = sorted((r for r in ends if not r.tail), key=lambda r: (r["pass"], r.part, r.code))  # equal codes are in one task
    tails = {r.task: r for r in ends if r.tail}
    key = lambda r: (r["pass"], r.part)
    out = []
    for n, h in enumerate(heads):
        gap = 0
        for before in reversed(heads[max(0, n - window) : n]):
            t = tails[before.task]
            if key(t) != key(h) or gap >= window:
                break
            out.append((t.task, h.task, gap))
            gap += t.many
            if key(before) != key(t):  # the task begins with another pass or part
                break
    return out


def _seam_links(cosine: float, window: int):
    """The tails before a task and the heads of it: links within the window."""

    def run(table: pa.Table) -> pa.Table:
        tail, far, cls = (table.column(c).to_numpy() for c in ("tail", "far", "cls"))
        x = _vectors(table.column("embedding").combine_chunks())
        a, b = np.flatnonzero(tail), np.flatnonzero(~tail)
        hit = (x[a] @ x[b].T >= cosine) & (far[a][:, None] + far[b][None, :] < window)
        i, j = np.nonzero(hit)
        return pa.table({"a": cls[a][i], "b": cls[b][j]})

    return run


def _block_links(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        x = _unit(_vectors(table.column("embedding").combine_chunks()))
        block, cls, many = (table.column(c).to_numpy() for c in ("block", "cls", "many"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for lo in range(0, len(a), STRIP):
            rows = a[lo : lo + STRIP]
            link = x[rows] @ x[b].T >= cosine
            if i == j:
                link[np.arange(len(rows)), np.arange(lo, lo + len(rows))] = False
            of_a[lo : lo + STRIP] = link @ many[b]
            of_b += many[rows] @ link
        if i == j:
            return pa.table({"cls": cls[a], "links": of_a})
        return pa.table({"cls": np.concatenate([cls[a], cls[b]]), "links": np.concatenate([of_a, of_b])})

    return run


def near_duplicates(rows: DataFrame, cosine: float = 0.93, window: int = WINDOW, seed: int = 5, stages: Stages | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``rows(vec_id, embedding, label)``.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine is ``cosine`` or
    more.  Null, empty or zero vectors, and those with null or non-finite components, link with nothing.  Equal
    vectors are one class, which passes treat as one vector; repeated rows count as other vectors.

    A pass orders the vectors of each label by the concatenated signs of random projections and compares each with
    the ``window`` next in order.  There are as many passes as the largest label needs if the projections part it evenly
    (``passes_for``); in dense clouds they don't, so passes go on until the links that one and two passes have found tell
    that UNSEEN of all links or fewer are still unseen.  Links of all passes are united to components.  The window bounds partners, so within each component all blocks of vectors are
    then compared, which makes n_links exact for the components found.  The last rows before each task's range are
    compared with its first rows, however short the ranges are, so a pass compares every window.
    """
    stages = stages or Stages(rows.sparkSession, "projection")
    spark = stages.spark
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("fit", F.coalesce(fit, F.lit(False)))
    part = F.xxhash64("label", F.size("embedding"))
    named = stages.save(v.withColumn("part", part).withColumn("cls", F.when(F.col("fit"), F.xxhash64("part", "embedding"))).select("vec_id", "fit", "part", "cls", "embedding"), "vectors")
    good = named.where("fit")
    classes = stages.save(good.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("first"), F.first("embedding").alias("embedding")), "classes")
    most = classes.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    total = passes_for(most, cosine, window)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    links, p = None, 0
    while True:
        many = BATCH if p >= total else min(BATCH, total - p)
        coded = classes.select("part", "cls", "embedding").mapInArrow(_codes(p, many, seed), "pass int, part long, code long, cls long, embedding array<double>")
        # saved, since finding the ranges reads the rows a second time
        coded = stages.save(coded, "codes")
        near = coded.repartitionByRange(parts, "pass", "part", "code").sortWithinPartitions("pass", "part", "code", "cls").mapInArrow(_windows(cosine, window), ENDS_SQL)
        near = stages.save(near, "near")
        ends = near.where("task is not null")
        seams = _borders(ends.where("at = 0").select("task", "tail", "pass", "part", "code", "many").collect(), window)  # two rows a task
        found = near.where("task is null").select("a", "b")
        if seams:
            plan = F.broadcast(spark.createDataFrame(seams, "task int, seam int, gap long"))
            late = ends.where("tail").join(plan, "task").select("seam", "tail", (F.col("gap") + F.col("at")).alias("far"), "cls", "embedding").where(F.col("far") < window)
            early = ends.where("not tail").join(plan.select("seam").distinct(), F.col("task") == F.col("seam")).select("seam", "tail", F.col("at").cast("long").alias("far"), "cls", "embedding")
            found = found.union(late.union(early).groupBy("seam").applyInArrow(_seam_links(cosine, window), "a long, b long"))
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).cast("long").alias("times"))
        after = (found if links is None else found.union(links)).groupBy("a", "b").agg(F.sum("times").alias("times"))
        after = stages.save(after, "links")
        stages.drop(coded, near, links)
        links, p = after, p + many
        if p >= total:
            seen = links.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("times") == 1).alias("once"), F.count_if(F.col("times") == 2).alias("twice")).first()
            if total == 1 or unseen(seen.once, seen.twice) <= UNSEEN * seen["all"]:  # one pass compares all with all
                break
    comp = stages.save(components(stages, links), "components")
    both = comp.union(comp.select(F.col("component").alias("id"), "component").distinct())
    both = both.distinct()
    size = both.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = both.join(size, "component").join(classes.withColumnRenamed("cls", "id"), "id").withColumn("block", F.pmod(F.xxhash64("id", F.lit(11)), F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pairs = placed.select(F.col("id").alias("cls"), "component", "block", "many", "embedding", F.explode(others).alias("other"))
    pairs = pairs.select("cls", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "many", "embedding")
    counted = pairs.groupBy("component", "i", "j").applyInArrow(_block_links(cosine), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))
    first = both.join(classes.select(F.col("cls").alias("id"), "first"), "id").groupBy("component").agg(F.min("first").alias("component_id"))
    known = both.join(first, "component").select(F.col("id").alias("cls"), "component_id")
    known = classes.select("cls", "many", "first").join(known, "cls", "left").join(counted, "cls", "left")
    known = known.select("cls", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = named.select("vec_id", "cls").join(known, "cls", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
