"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages
from .textkernel import SEP, as_bytes, forget, groups, mix, prefix_hash, span_hash

#: Hash buckets of the text view's words, and of the metadata view.
TEXT_DIM, META_DIM = 1 << 17, 1 << 12
#: Labelled rows that the first fit uses at most, and MB of their features; rows are taken in the order of their ids' hashes.
LABELLED, LABELLED_MB = 12_000, 96
#: Rounds, and how many confident documents of each class each view hands to the other per round.
ROUNDS, GROWTH = 3, 250
#: Probability that a view must give a class before it vouches for it.
CONFIDENT = 0.9
#: Labelled rows in so many that calibrate the views and are not trained on.
HELD = 5

#: A word's smoothed log odds ratio between the classes must be so many standard errors from 0 to be a feature.
SCREEN = 3.0
#: Feature numbers below this are shapes, which are not screened.
SHAPES = 1024

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CLASSES = [b"*", b"$", b"%", b"&", b"#", b"|", b"!", b"<>{}[]", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,", b"\n"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i


def text_features(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text: folded words without marks, and levels of marks and repetition."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    inside = _LETTER[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(buf) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    words = (span_hash(prefix_hash(_FOLD[buf]), start, end) % np.uint64(TEXT_DIM - SHAPES)).astype(np.int64) + SHAPES
    bounds = np.searchsorted(start, first)
    gaps = np.cumsum(np.concatenate([[0], SEP[buf]]))
    out = []
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1]) - 1
        n = max(b - a, 1)
        share = np.bincount(_CLASS[buf[a:b]], minlength=len(_CLASSES) + 1)[: len(_CLASSES)] / n
        level = np.clip(np.ceil(np.log2(np.maximum(share, 1e-9) * 1024)), 0, 10).astype(np.int64)
        own = words[bounds[i] : bounds[i + 1]]
        distinct = np.unique(own)
        kinds = int(20 * len(distinct) / max(len(own), 1))
        spread = int(min(12, (n - (gaps[b] - gaps[a])) / max(len(own), 1)))
        shape = np.concatenate([np.arange(len(_CLASSES)) * 11 + level, [200 + kinds, 280 + spread]])
        out.append(np.concatenate([shape, distinct]))
    return out


@functools.lru_cache(1 << 16)
def _bucket(part: str) -> int:
    return int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little") % META_DIM


def meta_features(lang, source, n_chars) -> list[np.ndarray]:
    """Language, source, their pair and the size's level, hashed; null is a value of its own."""
    out = []
    for x in zip(lang, source, n_chars, strict=True):
        size = -1 if x[2] is None else int(2 * np.log2(max(x[2], 0) + 1))
        parts = [f"l{x[0]!r}", f"s{x[1]!r}", f"p{x[0]!r}{x[1]!r}", f"c{size}", f"k{x[0]!r}{size}"]
        out.append(np.array([_bucket(p) for p in parts], np.int64))
    return out


@dataclass
class View:
    """Logistic regression over sets of feature numbers, scaled by Platt's two numbers."""

    weight: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, sets: list[np.ndarray]) -> np.ndarray:
        if not sets:
            return np.zeros(0)
        ends = np.cumsum([len(s) for s in sets])
        sums = np.concatenate([[0.0], np.cumsum(self.weight[np.concatenate(sets)])])
        begin = np.concatenate([[0], ends[:-1]])
        return sums[ends] - sums[begin] + self.bias

    def logit(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.slope * self.margin(sets) + self.shift


def fit(sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, dim: int, l2: float, screen: float = 0.0, prior: float = 0.0, epochs: int = 120) -> View:
    """Weighted logistic regression by Adam on the full gradient, over the features that pass the screen.

    Where all rows are of one class there is nothing to tell apart, and the view knows the prior only.
    """
    view = View(np.zeros(dim))
    if not len(y) or y.min() == y.max():
        view.bias = prior
        return view
    flat = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    ends = np.cumsum(size)
    begin = np.concatenate([[0], ends[:-1]])
    weight = weight / weight.mean()
    if screen:
        one = np.bincount(flat, (weight * y)[row], dim) + 0.5
        zero = np.bincount(flat, (weight * (1 - y))[row], dim) + 0.5
        odds = np.log(one / ((weight * y).sum() - one + 1.0)) - np.log(zero / ((weight * (1 - y)).sum() - zero + 1.0))
        passes = (np.abs(odds) >= screen * np.sqrt(1 / one + 1 / zero)) | (np.arange(dim) < SHAPES)
        keep = passes[flat]
        flat, row = flat[keep], row[keep]
        size = np.bincount(row, minlength=len(sets))
        ends = np.cumsum(size)
        begin = np.concatenate([[0], ends[:-1]])
    share = np.average(y, weights=weight)
    view.bias = float(np.log(share / (1 - share)))
    m, s, mb, sb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    for t in range(1, epochs + 1):
        sums = np.concatenate([[0.0], np.cumsum(view.weight[flat])])
        z = sums[ends] - sums[begin] + view.bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)
        grad = np.bincount(flat, g[row], dim) + l2 * view.weight / len(y)
        gb = g.sum()
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.15 * (1 - t / (epochs + 1))
        view.weight -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)
        view.bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-7)
    return view


def calibrate(view: View, sets: list[np.ndarray], y: np.ndarray) -> View:
    """Platt scaling on held-out rows, with smoothed targets; without both classes the margin is left as it is."""
    if len(y) < 10 or y.min() == y.max():
        return view
    z = view.margin(sets)
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y > 0, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    if np.isfinite([a, b]).all() and a > 0:
        view.slope, view.shift = float(a), float(b)
    return view


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, text, lang, source, n_chars)`` to ids and both views' feature numbers as packed 32-bit integers."""
    forget()
    for b in batches:
        texts = as_bytes(b.column(1))
        lang, source, n_chars = (b.column(i).to_pylist() for i in (2, 3, 4))
        for first, some in groups(texts, 1 << 20):
            k = slice(first, first + len(some))
            t = [x.astype(np.int32).tobytes() for x in text_features(some)]
            m = [x.astype(np.int32).tobytes() for x in meta_features(lang[k], source[k], n_chars[k])]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(some)), pa.array(t, pa.binary()), pa.array(m, pa.binary()), b.column(5).slice(first, len(some))], ["doc_id", "t", "m", "key"])


_sets = lambda packed: [np.frombuffer(x, np.int32) for x in packed]


def _scorer(text: View, meta: View):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [text.logit(_sets(b.column(1).to_pylist())), meta.logit(_sets(b.column(2).to_pylist()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at[0]), pa.array(at[1]), b.column(3)], ["doc_id", "text_logit", "meta_logit", "key"])

    return run


def _inputs(docs: DataFrame) -> list[Column]:
    """What the views see of a row, as the types that they take; columns that are missing are null."""
    columns = [F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return [x.alias(c) for x, c in zip(columns, ("doc_id", "text", "lang", "source", "n_chars"), strict=True)]


def _key(docs: DataFrame) -> Column:
    """Hash of what the views see of a row; a hash passes nulls over, so it is told which they are."""
    columns = _inputs(docs)
    return F.xxhash64(*columns, *[x.isNull() for x in columns])


def spark_ids(stages: Stages, ids: list[int]) -> DataFrame:
    """A bounded list of doc_ids as a table."""
    return stages.spark.createDataFrame([(i,) for i in ids], "doc_id long")


def train(docs: DataFrame, labels: DataFrame, stages: Stages, rounds: int = ROUNDS, labelled: int = LABELLED, growth: int = GROWTH) -> tuple[View, View, float, DataFrame]:
    """Both calibrated views, the prior's logit, and the table of features.

    A document is good if its quality is 1 and it is not toxic.  Each round, each view scores every unlabelled
    document, and the ``growth`` documents of each class it is surest of join the other view's training rows with the
    weight of its probability.  At most ``labelled`` rows, LABELLED_MB of features and 4 * ``growth`` documents a round
    reach the driver.  Of several rows of a labelled doc_id, the one with the least hash is learnt from.
    """
    table = stages.save(docs.select(*_inputs(docs), _key(docs).alias("key")).mapInArrow(_features, "doc_id long, t binary, m binary, key long"), "features")
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) <= 0)).cast("int")).alias("good"))
    order = F.xxhash64("doc_id", F.lit(7))
    there = good.join(table.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = stages.save(there.withColumn("_o", order).orderBy("_o", "doc_id").limit(labelled).select("doc_id", "good", "_o"), "labelled")
    # features never cross the network: the bounded samples go to them
    one = table.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good", "_o").agg(F.min_by(F.struct("t", "m"), "key").alias("x"))
    one = stages.save(one.select("doc_id", "good", "_o", "x.t", "x.m"), "known")
    sizes = one.select("doc_id", "_o", (F.length("t") + F.length("m")).alias("bytes")).toPandas().sort_values(["_o", "doc_id"])
    within = spark_ids(stages, sizes.doc_id[sizes.bytes.cumsum() <= LABELLED_MB * 1_000_000].tolist())
    known = one.join(F.broadcast(within), "doc_id", "left_semi").toPandas().sort_values("doc_id", ignore_index=True)
    y = known.good.to_numpy(float)
    ts, ms = _sets(known.t), _sets(known.m)
    held = (mix(known.doc_id.to_numpy(np.int64).view(np.uint64)) % np.uint64(HELD)) == 0
    learn, test = np.flatnonzero(~held), np.flatnonzero(held)
    pick = lambda sets, idx: [sets[i] for i in idx]
    more: list[dict[int, tuple[np.ndarray, float, float]]] = [{}, {}]  # rows that the other view vouches for: features, class, weight
    prior = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    views: list[View] = []
    for r in range(rounds + 1):
        views = []
        for k, (sets, dim, l2, screen) in enumerate(((ts, TEXT_DIM, 0.3, SCREEN), (ms, META_DIM, 10.0, 0.0))):
            x = pick(sets, learn) + [v[0] for v in more[k].values()]
            yy = np.concatenate([y[learn], [v[1] for v in more[k].values()]])
            w = np.concatenate([np.ones(len(learn)), [v[2] for v in more[k].values()]])
            views.append(calibrate(fit(x, yy, w, dim, l2, screen, prior), pick(sets, test), y[test]))
        if r == rounds or not len(y):
            break
        least = float(np.log(CONFIDENT / (1 - CONFIDENT)))
        scored = table.mapInArrow(_scorer(*views), "doc_id long, text_logit double, meta_logit double, key long").drop("key")
        scored = stages.save(scored.join(good, "doc_id", "left_anti"), "scores")
        sure = None
        for k, name in enumerate(("text_logit", "meta_logit")):
            for cls, z in ((1, F.col(name)), (0, -F.col(name))):
                top = scored.where(z >= least).orderBy(z.desc(), F.xxhash64("doc_id"), "doc_id").limit(growth).select("doc_id", F.lit(1 - k).alias("to"), F.lit(cls).alias("cls"), z.alias("z"))
                sure = top if sure is None else sure.union(top)
        sure = stages.save(sure, "sure")
        least_key = F.min_by(F.struct("z", "t", "m"), "key").alias("x")
        rows = table.join(F.broadcast(sure), "doc_id").groupBy("doc_id", "to", "cls").agg(least_key).select("doc_id", "to", "cls", "x.*").collect()  # at most 4 * growth rows
        for row in sorted(rows, key=lambda x: (x.to, x.doc_id, x.cls)):
            weight = 0.5 / (1 + np.exp(-min(row.z, 30)))
            more[row.to][row.doc_id] = (np.frombuffer(row.t if row.to == 0 else row.m, np.int32), float(row.cls), float(weight))
        stages.drop(scored, sure)
    return views[0], views[1], prior, table


def score(docs: DataFrame, labels: DataFrame, stages: Stages | None = None, **options) -> DataFrame:
    """``doc_id, text_score, meta_score, score, kept`` of every row of ``docs``.

    Scores are probabilities that the document is good; the combined logit is the sum of the views' calibrated
    logits less that of the prior, since the views are taken as independent given the class.  ``kept`` is
    score >= 0.5.  Null texts are empty, null metadata values of their own; without labels every score is 0.5.
    Repeated rows are scored alike; extra columns are ignored.  With labels of one class only, every score is the
    smoothed prior, so that all documents are kept or none.  Options: ``rounds``, ``labelled``, ``growth``.
    """
    return _score(docs, labels, stages, **options).drop("key")


def _score(docs: DataFrame, labels: DataFrame, stages: Stages | None = None, **options) -> DataFrame:
    stages = stages or Stages(docs.sparkSession, "quality")
    text, meta, prior, table = train(docs, labels, stages, **options)
    rows = table.mapInArrow(_scorer(text, meta), "doc_id long, text_logit double, meta_logit double, key long")
    p = lambda z: 1 / (1 + F.exp(-z))
    rows = rows.select("doc_id", "key", p(F.col("text_logit")).alias("text_score"), p(F.col("meta_logit")).alias("meta_score"), p(F.col("text_logit") + F.col("meta_logit") - prior).alias("score"))
    return rows.withColumn("kept", F.col("score") >= 0.5)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, each judged by itself where rows share a doc_id."""
    bad = _score(docs, labels, **options).where("not kept").select(F.col("doc_id").alias("_bad"), F.col("key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("_bad")) & (_key(docs) == F.col("_key")), "left_anti")
