"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, components
from .textkernel import Words, as_bytes, forget, groups, mix

#: Each side of the tensor has SIDE collections of ROWS minhashes; a table key joins one of each side, so
#: SIDE * SIDE tables of 2 * ROWS rows cost 2 * SIDE * ROWS minhashes.  At similarity 0.85 a collection agrees with
#: probability 0.614, and a pair meets in no table with probability 2 * 0.386**12 = 2.2e-5.
SIDE, ROWS = 12, 3
#: A pair's minhashes, one byte each, must agree so often before full sets are compared: 4.8 standard deviations below
#: the mean at the threshold, which loses one pair in a million there.
DEVIATIONS = 4.8
#: Minhash bytes in one long of the sketch; with 6 no sum below overflows.
PACK = 6
#: Bits of the parity map of a set: shingles are dealt to bins by hash, a bit tells whether its bin holds an odd number.
#: Bits that differ between two sets never outnumber the shingles that only one of them has, so that this filter loses
#: nothing; with few of them against the bins it is near exact.
PARITY = 512
#: Members that one task compares with a pivot before the pivot is sent to a further task.
SALT = 64
#: Members of a bucket that are heads up to the first round, and how many times more up to each later one.
HEADS, WIDER = 32, 64
#: Parts of the tables that are compared one after the other, so that few sketches are on disk at once.
SLICES = 2

_rng = np.random.default_rng(0x71E5)
_A = _rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64)
_C = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03)]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; texts with fewer words are one shingle, without words none."""
    w = Words(texts)
    h = w.hash
    n = max(len(h) - width + 1, 0)
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc = mix(acc ^ (h[k : k + n] * _C[k % 3] + np.uint64(k + 1)))
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(acc[a : b - width + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(a, b):
                one = mix(one * np.uint64(31) + h[k] + np.uint64(b - a))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """64-bit name of a shingle set."""
    return int(mix(np.add.reduce(mix(s ^ _C[1]), dtype=np.uint64, keepdims=True) ^ np.uint64(len(s)))[0])


def parity_of(s: np.ndarray) -> np.ndarray:
    """The parity map of a set as longs."""
    odd = np.bincount((s >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def collections_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 2 * SIDE collection hashes of a set; its filter: the minhashes' bytes, PACK to a long, then its parity map."""
    m = np.full(len(_A), np.uint64(2**64 - 1))
    for i in range(0, len(s), 4096):
        m = np.minimum(m, (s[i : i + 4096, None] * _A + _B).min(axis=0))
    low = (mix(m) & np.uint64(255)).reshape(-1, PACK) << (np.arange(PACK, dtype=np.uint64) * np.uint64(8))
    m = m.reshape(2 * SIDE, ROWS)
    acc = np.arange(2 * SIDE, dtype=np.uint64)
    for k in range(ROWS):
        acc = mix(acc * np.uint64(31) ^ m[:, k])
    return acc, np.concatenate([np.bitwise_or.reduce(low, axis=1), parity_of(s)])


#: Longs with packed minhashes, and all longs of a filter, with the parity map.
_PACKED = 2 * SIDE * ROWS // PACK
_LONGS = _PACKED + PARITY // 64
_LOW7 = int.from_bytes(b"\x7f" * PACK, "big")


def agreement(a: str, b: str) -> Column:
    """How many minhash bytes of two filters agree: the zero bytes of their packed longs' differences."""
    total = F.lit(0)
    for i in range(_PACKED):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        differs = ((x.bitwiseAND(F.lit(_LOW7)) + F.lit(_LOW7)).bitwiseOR(x)).bitwiseOR(F.lit(_LOW7))
        total = total + F.bit_count(F.bitwise_not(differs))
    return total - _PACKED * (64 - 8 * PACK)


def least_agreement(percent: int) -> int:
    n, p = 2 * SIDE * ROWS, percent / 100
    return max(1, int(n * p - DEVIATIONS * (n * p * (1 - p)) ** 0.5))


def may_link(a: str, b: str, size_a: str, size_b: str, percent: int) -> Column:
    """False for two filters whose sets surely differ too much, but for one pair in a million at the threshold."""
    odd = F.lit(0)
    for i in range(_PACKED, _LONGS):
        odd = odd + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    # both in (sizes - only) / 2, and 100 * both >= percent * (sizes - both)
    sizes = F.col(size_a) + F.col(size_b)
    return (odd * (100 + percent) <= sizes * (100 - percent)) & (agreement(a, b) >= least_agreement(percent))


def first_left(a: str, b: str) -> Column:
    """The first left collection that two classes share, if they share a right one too, so that they meet in a table; else null."""
    same = [F.get(a, F.lit(i)) == F.get(b, F.lit(i)) for i in range(2 * SIDE)]
    out = F.lit(None).cast("int")
    for i in reversed(range(SIDE)):
        out = F.when(same[i], F.lit(i)).otherwise(out)
    return F.when(functools.reduce(Column.__or__, same[SIDE:]), out)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            texts = as_bytes(b.column(1))
            for first, run_ in groups(texts):
                sets = shingle_sets(run_, width)
                n = np.array([len(s) for s in sets], np.int64)
                key = np.array([set_key(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                none = np.zeros(2 * SIDE, np.uint64), np.zeros(_LONGS, np.uint64)
                found = [collections_of(s) if len(s) else none for s in sets]
                lists = []
                for k, size in enumerate((2 * SIDE, _LONGS)):
                    flat = np.concatenate([x[k] for x in found]).view(np.int64)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(run_)), b.column(2).slice(first, len(run_)), pa.array(n), pa.array(key), *lists], ["doc_id", "text_hash", "n_shingles", "cls", "hashes", "sk"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, cls) and dealt by ranges, those whose key has two or more, and all of the range's first
    and last key, whose other rows may lie in the next range."""
    last = first = None  # the last row of the batch before, and whether it is given out; the first key
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(3)]
        key = cols[0]
        first = key[0] if first is None else first
        same = key[1:] == key[:-1]
        keep = key == first
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None:
            alike = last[0][0] == key[0]
            keep[0] |= alike
            if alike and not last[1]:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last[0]], ["key", "cls", "t"])
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], ["key", "cls", "t"])
        last = ([c[-1] for c in cols], bool(keep[-1]))
    if last is not None and not last[1]:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last[0]], ["key", "cls", "t"])


def _compare(width: int, percent: int):
    """Rows sorted by (pivot, salt, role), the pivot's own text first; yields the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, None
        for b in batches:
            pivot, salt, role, cls = (b.column(i).to_pylist() for i in range(4))
            out_a, out_b = [], []
            for first, run_ in groups(as_bytes(b.column(4))):
                for i, s in enumerate(shingle_sets(run_, width), first):
                    if set_key(s) != cls[i] & (2**64 - 1):
                        continue  # another text under the same doc_id
                    if role[i] == 0:
                        now, base = (pivot[i], salt[i]), s
                    elif now == (pivot[i], salt[i]):
                        both = len(np.intersect1d(base, s, assume_unique=True))
                        if 100 * both >= percent * (len(base) + len(s) - both):
                            out_a.append(cls[i])
                            out_b.append(pivot[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def verify(stages: Stages, pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among ``pairs(a, b)``: the texts of a go to b's tasks, each of which holds one pivot set at a time."""
    n = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    members = pairs.join(n, "b").select(F.col("b").alias("pivot"), F.pmod(F.xxhash64("a"), "salts").alias("salt"), F.lit(1).alias("role"), F.col("a").alias("cls"))
    heads = n.select(F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("b").alias("cls"))
    wanted = members.union(heads).join(classes.select("cls", "rep"), "cls")
    texts = wanted.join(docs.select(F.col("doc_id").alias("_id"), "text"), F.col("rep").eqNullSafe(F.col("_id")))
    rows = texts.select("pivot", "salt", "role", "cls", "text")
    parts = max(int(stages.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "pivot", "salt").sortWithinPartitions("pivot", "salt", "role").mapInArrow(_compare(width, percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85, stages: Stages | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash, component`` of every row of ``docs(doc_id, text)``.

    Rows with equal shingle sets are one class; classes whose sets have a Jaccard similarity of ``percent`` / 100 or
    more are linked; components close the links.  A null or wordless text is an empty set and links with nothing.
    Repeated doc_ids are allowed; component_id is the smallest non-null doc_id of the component, kept tells whether
    the row's doc_id is that one.  ``component`` names the component, null for an empty set.  Extra columns are ignored.

    No bucket is expanded into pairs.  The popularity of a class is the number of rows in its buckets: an original is
    more popular than its copies, which are farther from each other than from it.  First each class is compared with
    the most popular class it shares a bucket with.  Then the buckets of the tables with one left collection are taken
    as one, so that a class has SIDE rows and not SIDE * SIDE.  As long as such a bucket holds more than one component,
    its members are compared with some of them chosen by hash, with more of them, and so on, unless they share no right
    collection, are of one component or their sketches differ by too much: every pair that shares a table is in one
    component or was compared.  A pair that shares several left collections is made in the first one only.
    """
    stages = stages or Stages(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    rows = stages.save(docs.mapInArrow(_sketch(width), "doc_id long, text_hash long, n_shingles long, cls long, hashes array<long>, sk array<long>"), "sketches")
    sets = rows.where("n_shingles > 0")
    classes = stages.save(sets.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("hashes").alias("hashes"), F.first("sk").alias("sk")), "classes")

    # the tensor: a key for every pair of a left and a right collection
    tables = F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)),
        lambda t: F.xxhash64(F.get("hashes", (t / SIDE).cast("int")), F.get("hashes", (t % SIDE).cast("int") + SIDE), t),
    )).alias("t", "key")
    parts = max(int(stages.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = classes.select("cls", tables).select("key", "cls", "t").repartitionByRange(parts, "key", "cls").sortWithinPartitions("key", "cls")
    runs = stages.save(keyed.mapInArrow(_runs, "key long, cls long, t int"), "runs")
    sizes = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    buckets = stages.save(runs.join(sizes.where("n > 1"), "key"), "buckets")
    stages.drop(runs)

    popular = stages.save(buckets.groupBy("cls").agg(F.sum("n").alias("pop")), "popularity")
    place = F.struct((-F.col("pop")).alias("less"), F.col("cls").alias("cls")).alias("place")
    placed = buckets.join(popular, "cls").select("key", "cls", place)
    first = placed.groupBy("key").agg(F.min("place").alias("head"))
    pairs = placed.join(first, "key").where("head.cls <> cls").groupBy(F.col("cls").alias("a")).agg(F.min("head").alias("h")).select("a", F.col("h.cls").alias("b"))
    sk = classes.select("cls", "size", "sk")
    far = pairs.join(sk.toDF("a", "n1", "s1"), "a").join(sk.toDF("b", "n2", "s2"), "b")
    # half a hash will do to tell that two classes share a collection: one pair in 1.8e8 would be lost
    half = F.transform("hashes", lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int"))
    sk = classes.select("cls", "size", "sk", half.alias("half"))
    pairs = far.where(may_link("s1", "s2", "n1", "n2", percent)).select("a", "b")
    # a member's turn is chosen by hash: about k of the n members of a bucket have one under k / n
    turn = F.shiftrightunsigned(F.xxhash64("cls", F.lit(percent)), 11) / float(1 << 53)
    pairs = [stages.save(pairs, "pairs")]
    stages.drop(popular)
    # tables of one left collection are compared as one bucket: a row for each left collection, not for each table
    met = buckets.select("cls", F.floor(F.col("t") / SIDE).cast("int").alias("i")).distinct().join(classes.select("cls", half.alias("half")), "cls")
    met = stages.save(met.select("cls", "i", F.get("half", "i").alias("v")), "met")
    sizes = met.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    live = stages.save(met.join(sizes.where("n > 1"), ["i", "v"]), "sharing")
    stages.drop(met, buckets)
    comp, low, high = None, 0, HEADS
    while True:
        found = verify(stages, functools.reduce(DataFrame.union, pairs), classes, docs, width, percent)
        # the components so far stand for the links that made them
        found = found if comp is None else found.union(comp.select(F.col("id").alias("a"), F.col("component").alias("b")))
        after = stages.save(components(stages, found), "components")
        stages.drop(comp, *pairs)
        comp = after
        named = live.select("i", "v", "cls", "n").join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        mixed = named.groupBy("i", "v").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("n").alias("n")).where(f"x < y and n > {low}").select("i", "v")
        # heads of the rounds before were compared with all others
        after = stages.save(named.where(turn * F.col("n") >= low).join(mixed, ["i", "v"], "left_semi"), "live")
        stages.drop(live)
        live = after
        if live.isEmpty():
            break
        pairs = []
        for k in range(SLICES):
            rows_ = live.where(F.col("i") % SLICES == k).join(sk, "cls").select("i", "v", "cls", "n", "component", "size", "sk", "half", turn.alias("turn"))
            heads = rows_.where(f"turn * n < {high}").select(F.col("i").alias("_i"), F.col("v").alias("_v"), F.col("cls").alias("b"), F.col("turn").alias("at"), F.col("component").alias("of"), F.col("size").alias("n2"), F.col("sk").alias("s2"), F.col("half").alias("h2"))
            later = (F.col("turn") > F.col("at")) | ((F.col("turn") == F.col("at")) & (F.col("cls") > F.col("b")))
            near = later & (F.col("component") != F.col("of")) & (first_left("half", "h2") == F.col("i")) & may_link("sk", "s2", "size", "n2", percent)
            pairs.append(stages.save(rows_.join(heads, (F.col("i") == F.col("_i")) & (F.col("v") == F.col("_v")) & near).select(F.col("cls").alias("a"), "b"), "pairs"))
        low, high = high, WIDER * high
    # smallest doc_id of each component
    node = rows.select("doc_id", "text_hash", "n_shingles", "cls").join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = node.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = node.where("n_shingles > 0").join(first, "component").select("doc_id", "n_shingles", "component_id", "text_hash", "component")
    alone = node.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("long").alias("component"))
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "text_hash", "component")


def deduplicate(docs: DataFrame, stages: Stages | None = None, **options) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component: that with the smallest doc_id, null last, then text hash.

    Rows without words are all different and stay.  Of rows that repeat a doc_id with the same text one stays.
    """
    stages = stages or Stages(docs.sparkSession, "minhash")
    rows = near_duplicates(docs, stages=stages, **options).groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    rows = stages.save(rows, "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash", "rows")).alias("m")
    kept = rows.where("component is not null").groupBy("component").agg(first).select("m.doc_id", "m.text_hash", "m.rows")
    kept = kept.union(rows.where("component is null").select("doc_id", "text_hash", "rows"))
    kept = stages.save(kept.toDF("_cw_id", "_cw_hash", "_cw_rows"), "kept")
    key = docs["doc_id"].cast("long").eqNullSafe(F.col("_cw_id")) & (F.xxhash64(docs["text"]) == F.col("_cw_hash"))
    rows = docs.join(kept.where("_cw_rows = 1"), key, "left_semi")
    again = kept.where("_cw_rows > 1")
    if again.isEmpty():
        return rows
    repeated = docs.join(again, key, "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.unionByName(repeated)
