"""Log-bilinear language model, trained by noise-contrastive estimation, with class-factored normalised scores."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages
from .textkernel import Words, as_bytes, groups

#: The network predicts side ** 2 words, the most frequent, in side classes of side words of neighbouring frequency, where
#: side is SPREAD times the fourth root of the distinct training words, LEAST_SIDE at least; all others are one class more.
#: As contexts, the others share side ** 2 embeddings by hash.
SPREAD, LEAST_SIDE = 1.5, 16
DIM = 16
#: Words whose counts every task holds, at most; the counts of rarer words come by a join.
HEAD = 1 << 18
#: Noise draws per batch for classes, and per class of a batch for words.
NOISE_CLASSES, NOISE_WORDS = 16, 12
BATCH = 8192
RATE = 0.1
#: Squared gradient that Adagrad starts from; gradients are means of a batch.
START = 1e-11
SMOOTH = 0.1
#: Tokens of a shard, about.  Rows are dealt to shards by hash; a shard trains in one task, in the order of the hashes.
SHARD = 4_000_000
#: Shard 0 trains first, then the others in so many rounds; after each round the shards' parameters are averaged.
ROUNDS = 3
#: Pieces in which parameters travel, and the models that one task averages.
CHUNKS, FAN = 16, 64
#: The name of the end token.
END = 0


@dataclass
class Vocabulary:
    """Head words sorted by hash with their counts and ids; id ``known`` is any other word."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    known_counts: np.ndarray  # by id
    total: int
    distinct: int
    side: int

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> Vocabulary:
        side = max(LEAST_SIDE, math.ceil(SPREAD * distinct**0.25))
        n = min(side * side, len(hashes))
        by_count = np.lexsort((hashes, -counts))
        ids = np.full(len(hashes), side * side, np.int32)
        ids[by_count[:n]] = np.arange(n)
        known = np.zeros(side * side)
        known[:n] = counts[by_count[:n]]
        order = np.argsort(hashes)
        return cls(hashes[order], counts[order].astype(np.float64), ids[order], known, total, distinct, side)

    @property
    def known(self) -> int:
        return self.side * self.side

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head, and whether the word is there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    @property
    def rest_norm(self) -> float:
        """Denominator of a rare word's share of the rest class."""
        known = int((self.known_counts > 0).sum())
        return float(self.total - self.known_counts.sum() + SMOOTH * (self.distinct - known + 1))


class Model:
    """h = T1[w1] + T2[w2] with T = R C; log P(w) = log softmax of classes + log softmax of the class's words."""

    def __init__(self, vocabulary: Vocabulary):
        rng = np.random.default_rng(20)
        self.side, known = vocabulary.side, vocabulary.known
        self.shapes = {"R": (2 * known, DIM), "C1": (DIM, DIM), "C2": (DIM, DIM), "A": (self.side + 1, DIM), "a": (self.side + 1,), "Q": (known, DIM), "b": (known,)}
        counts = vocabulary.known_counts.reshape(self.side, self.side) + SMOOTH
        rest = vocabulary.rest_norm
        per_class = np.append(counts.sum(axis=1), rest)
        self.class_noise = per_class / per_class.sum()
        self.word_noise = counts / counts.sum(axis=1, keepdims=True)
        f = np.float32
        self.R = (0.1 * rng.standard_normal((2 * known, DIM))).astype(f)
        self.C1, self.C2 = np.eye(DIM, dtype=f), np.roll(np.eye(DIM, dtype=f), 1, axis=1)
        self.A = np.zeros((self.side + 1, DIM), f)
        self.a = np.log(self.class_noise).astype(f)
        self.Q = np.zeros((known, DIM), f)
        self.b = np.log(self.word_noise).ravel().astype(f)
        self.squares = {k: np.full(shape, START, f) for k, shape in self.shapes.items()}

    def pack(self) -> np.ndarray:
        """All parameters, then the squares of their gradients so far."""
        return np.concatenate([getattr(self, k).ravel() for k in self.shapes] + [self.squares[k].ravel() for k in self.shapes])

    def unpack(self, flat: np.ndarray) -> None:
        i = 0
        for squares in (False, True):
            for k, shape in self.shapes.items():
                n = math.prod(shape)
                x = flat[i : i + n].reshape(shape).astype(np.float32)
                i += n
                if squares:
                    self.squares[k] = x
                else:
                    setattr(self, k, x)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.R @ self.C1, self.R @ self.C2

    def log_prob(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, tables) -> np.ndarray:
        """Natural log probability of each token, the rest class as one word."""
        side = self.side
        h = tables[0][w1] + tables[1][w2]
        s = _times(h, self.A.T) + self.a
        c = w // side
        out = s[np.arange(len(w)), c] - _log_sum(s)
        order = np.argsort(c, kind="stable")
        edge = np.searchsorted(c[order], np.arange(side + 1))
        for k in range(side):
            idx = order[edge[k] : edge[k + 1]]
            if len(idx):
                t = _times(h[idx], self.Q[k * side : (k + 1) * side].T) + self.b[k * side : (k + 1) * side]
                out[idx] += t[np.arange(len(idx)), w[idx] - k * side] - _log_sum(t)
        return out.astype(np.float64)


def _times(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``h @ x`` by way of double precision: in single, a row's product is rounded by its place and the number of rows."""
    return (h.astype(np.float64) @ x.astype(np.float64)).astype(np.float32)


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Logarithm of each row's sum of exponentials; overwrites ``s``."""
    top = s.max(axis=1)
    s -= top[:, None]
    np.exp(s, out=s)
    return np.log(s.sum(axis=1)) + top


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive steps with Adagrad rates, noise drawn from the word frequencies and shared by a batch."""

    def __init__(self, model: Model, seed: int = 1):
        self.m = model
        self.rng = np.random.default_rng(seed)
        self.class_cdf = np.cumsum(model.class_noise)
        self.word_cdf = np.cumsum(model.word_noise, axis=1)
        self.log_class = np.log(model.class_noise * NOISE_CLASSES).astype(np.float32)
        self.log_word = np.log(model.word_noise * NOISE_WORDS).astype(np.float32)

    def _move(self, k: str, g: np.ndarray) -> None:
        q = self.m.squares[k]
        q += g * g
        g /= np.sqrt(q)
        g *= RATE
        p = getattr(self.m, k)
        p += g

    def step(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> None:
        m, n, side = self.m, len(w), self.m.side
        order = _order(w, side * side + 1)
        w1, w2, w = w1[order], w2[order], w[order]  # by word, so by class too
        c = w // side
        t1, t2 = m.tables()
        h = t1[w1] + t2[w2]
        # classes
        true = 1 - _sigmoid((h * m.A[c]).sum(axis=1) + m.a[c] - self.log_class[c])
        noise = np.minimum(np.searchsorted(self.class_cdf, self.rng.random(NOISE_CLASSES)), side)
        fake = -_sigmoid(h @ m.A[noise].T + (m.a[noise] - self.log_class[noise]))
        dh = true[:, None] * m.A[c] + fake @ m.A[noise]
        dA, da = np.zeros_like(m.A), np.zeros_like(m.a)
        at, first = _starts(c)
        dA[at] = np.add.reduceat(true[:, None] * h, first)
        da[at] = np.add.reduceat(true, first)
        np.add.at(dA, noise, fake.T @ h)
        np.add.at(da, noise, fake.sum(axis=0))
        # words within each class
        known = int(np.searchsorted(w, side * side))
        dQ, db = np.zeros_like(m.Q), np.zeros_like(m.b)
        if known:
            hw, words = h[:known], w[:known]
            q = m.Q[words]
            good = 1 - _sigmoid((hw * q).sum(axis=1) + m.b[words] - self.log_word.ravel()[words])
            dh[:known] += good[:, None] * q
            at, first = _starts(words)
            dQ[at] = np.add.reduceat(good[:, None] * hw, first)
            db[at] = np.add.reduceat(good, first)
            edge = np.searchsorted(c[:known], np.arange(side + 1))
            draws = self.rng.random((side, NOISE_WORDS))
            for k in range(side):
                i, j = edge[k], edge[k + 1]
                if i == j:
                    continue
                noise = np.minimum(np.searchsorted(self.word_cdf[k], draws[k]), side - 1)
                at = k * side + noise
                q = m.Q[at]
                bad = -_sigmoid(h[i:j] @ q.T + (m.b[at] - self.log_word[k][noise]))
                dh[i:j] += bad @ q
                np.add.at(dQ, at, bad.T @ h[i:j])
                np.add.at(db, at, bad.sum(axis=0))
        d1, d2 = (np.zeros_like(m.R) for _ in range(2))
        for d, x in ((d1, w1), (d2, w2)):
            order = _order(x, len(m.R))
            at, first = _starts(x[order])
            d[at] = np.add.reduceat(dh[order], first)
        grads = {"R": d1 @ m.C1.T + d2 @ m.C2.T, "C1": m.R.T @ d1, "C2": m.R.T @ d2, "A": dA, "a": da, "Q": dQ, "b": db}
        for k, g in grads.items():
            self._move(k, g.astype(np.float32, copy=False) / np.float32(n))


def _order(x: np.ndarray, below: int) -> np.ndarray:
    return np.argsort(x.astype(np.uint16) if below <= 1 << 16 else x, kind="stable")


def _starts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array, and where each begins."""
    first = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    return x[first], first


def _names(texts: list[bytes], vocabulary: Vocabulary):
    """Token hashes of the texts with an end after each, their bounds, places in the head, found flags and numbers.

    A number below ``known`` is a word's that the network predicts; other words have one of ``known`` numbers above.
    """
    w = Words(texts)
    bounds = w.bounds + np.arange(len(texts) + 1)
    h = np.zeros(len(w.hash) + len(texts), np.uint64)
    inner = np.ones(len(h), bool)
    inner[bounds[1:] - 1] = False
    h[inner] = np.where(w.hash == END, np.uint64(1), w.hash)
    at, found = vocabulary.find(h)
    known = vocabulary.known
    numbers = np.where(found, vocabulary.ids[at] if len(vocabulary.ids) else known, known).astype(np.int64)
    rest = numbers == known
    numbers[rest] += (h[rest] % np.uint64(known)).astype(np.int64)
    return h, bounds, at, found, numbers


def _contexts(numbers: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words one and two places before each token; before a text stand ends."""
    w1 = np.empty_like(numbers)
    w1[1:] = numbers[:-1]
    w1[bounds[:-1]] = end
    w2 = np.empty_like(numbers)
    w2[1:] = w1[:-1]
    w2[bounds[:-1]] = end
    return w1, w2


def _end(vocabulary: Vocabulary) -> int:
    """The end token's number; its hash is the least."""
    first = int(vocabulary.ids[0]) if len(vocabulary.hashes) and vocabulary.hashes[0] == END else vocabulary.known
    return first  # outside the known words, hash 0 has the first number of the others


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of training words per task, given out before they grow large."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = docs = 0

    def merged():
        h = np.concatenate([x[0] for x in held])
        n = np.concatenate([x[1] for x in held])
        u, inverse = np.unique(h, return_inverse=True)
        return u, np.bincount(inverse, n, len(u)).astype(np.int64)

    def give(u, n):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["hash", "n"])

    for b in batches:
        learn = ~b.column(0).to_numpy(zero_copy_only=False)
        texts = [t for t, keep in zip(as_bytes(b.column(1)), learn, strict=True) if keep]
        docs += len(texts)
        for _, some in groups(texts, 1 << 20):
            h = Words(some).hash
            held.append(np.unique(np.where(h == END, np.uint64(1), h), return_counts=True))
            size += len(held[-1][0])
        if size > 2_000_000:
            u, n = merged()
            if len(u) > 1_000_000:
                yield give(u, n)
                held, size = [], 0
            else:
                held, size = [(u, n)], len(u)
    if held:
        yield give(*merged())
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.int64()), pa.array([docs], pa.int64())], ["hash", "n"])


def _numbered(shared):
    """Training rows ``(shard, h, text)`` to ``(shard, h, numbers)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        for b in batches:
            for first, some in groups(as_bytes(b.column(2)), 1 << 20):
                _, bounds, _, _, numbers = _names(some, vocabulary)
                flat = numbers.astype(np.int32)
                data = [flat[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(some)), b.column(1).slice(first, len(some)), pa.array(data, pa.binary())], ["shard", "h", "numbers"])

    return run


def _train(shared):
    """Rows ``(shard, h, numbers)`` sorted by all three to the parameters that each shard ends with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        end, known = _end(vocabulary), vocabulary.known
        now, trainer, seen, queue, waiting = None, None, 0, [], 0

        def steps(whole: int) -> None:
            x = np.concatenate(queue, axis=1)
            for i in range(0, whole, BATCH):
                trainer.step(*x[:, i : min(i + BATCH, whole)])
            queue[:] = [x[:, whole:]]

        def finish() -> Iterator[pa.RecordBatch]:
            if waiting:
                steps(waiting)
            for k, piece in enumerate(np.array_split(trainer.m.pack(), CHUNKS)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([now], pa.int64()), pa.array([float(seen)]), pa.array([piece.tobytes()], pa.binary())], ["chunk", "shard", "weight", "data"])

        for b in batches:
            shards = b.column(0).to_numpy()
            cut = np.flatnonzero(shards[1:] != shards[:-1]) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(shards)], strict=True):
                if lo == hi:
                    continue
                if shards[lo] != now:
                    if now is not None:
                        yield from finish()
                    model = Model(vocabulary)
                    if flat is not None:
                        model.unpack(flat)
                    now, trainer, seen, queue, waiting = int(shards[lo]), Trainer(model, int(shards[lo])), 0, [], 0
                for data in b.column(2).slice(lo, hi - lo).to_pylist():
                    numbers = np.frombuffer(data, np.int32).astype(np.int64)
                    w1, w2 = _contexts(numbers, np.array([0, len(numbers)]), end)
                    queue.append(np.stack([w1, w2, np.minimum(numbers, known)]))
                    waiting += len(numbers)
                    seen += len(numbers)
                    if waiting >= 16 * BATCH:
                        whole = waiting - waiting % BATCH
                        steps(whole)
                        waiting -= whole
        if now is not None:
            yield from finish()

    return run


def _average(table: pa.Table) -> pa.Table:
    table = table.sort_by("shard")  # sums don't depend on the order of arrival
    weight = table.column("weight").to_numpy()
    total = None
    for i in range(len(weight)):
        x = np.frombuffer(table.column("data")[i].as_py(), np.float32).astype(np.float64) * weight[i]
        total = x if total is None else total + x
    data = (total / weight.sum()).astype(np.float32).tobytes()
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "shard": pa.array([table.column("shard")[0].as_py() // FAN]), "weight": pa.array([weight.sum()]), "data": pa.array([data], pa.binary())})


def learn_parameters(docs: DataFrame, vocabulary: Vocabulary, stages: Stages) -> np.ndarray | None:
    """Averaged parameters after all rounds; what they are doesn't depend on how the rows are partitioned."""
    if not vocabulary.total:
        return None
    spark = stages.spark
    shards = max(1, -(-vocabulary.total // SHARD))
    h = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = docs.where("not held_out").select(F.pmod(h, F.lit(shards)).alias("shard"), h.alias("h"), "text")
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = stages.save(rows.mapInArrow(_numbered(shared), "shard long, h long, numbers binary"), "numbers")
    shared.destroy()
    schema = "chunk int, shard long, weight double, data binary"
    flat = None
    for r in range(min(ROUNDS + 1, shards)):
        turn = F.col("shard") - 1
        mine = F.col("shard") == 0 if r == 0 else (F.col("shard") > 0) & (F.pmod(turn, F.lit(ROUNDS)) == r - 1)
        many = 1 if r == 0 else min(-(-shards // ROUNDS), 100_000)
        shared = spark.sparkContext.broadcast((vocabulary, flat))
        place = F.pmod(F.floor(F.greatest(turn, F.lit(0)) / ROUNDS), F.lit(many)).cast("int")
        dealt = rows.where(mine).repartitionById(many, place).sortWithinPartitions("shard", "h", "numbers")
        pieces = stages.save(dealt.mapInArrow(_train(shared), schema), "parameters")
        left = 1 if r == 0 else shards
        while left > 1:
            pieces = pieces.groupBy("chunk", F.floor(F.col("shard") / FAN)).applyInArrow(_average, schema)
            left = -(-left // FAN)
        found = pieces.orderBy("chunk").collect()  # one model
        if found:
            flat = np.concatenate([np.frombuffer(p.data, np.float32) for p in found])
        shared.destroy()
    return flat


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        end = _end(vocabulary)
        model = Model(vocabulary)
        if flat is not None:
            model.unpack(flat)
        tables = model.tables()
        rest = math.log10(vocabulary.rest_norm) if vocabulary.rest_norm > 0 else 0.0
        log_count = np.log10(vocabulary.counts + SMOOTH)
        uid = int.from_bytes(os.urandom(7), "big")
        for b in batches:
            for first, some in groups(as_bytes(b.column(2)), 1 << 20):
                h, bounds, at, found, numbers = _names(some, vocabulary)
                ids = np.minimum(numbers, vocabulary.known)
                w1, w2 = _contexts(numbers, bounds, end)
                lp = np.concatenate([model.log_prob(w1[i : i + 32768], w2[i : i + 32768], ids[i : i + 32768], tables) for i in range(0, len(ids), 32768)]) / math.log(10)
                logs = np.zeros(len(h))
                if len(log_count):
                    logs[found] = log_count[at[found]]
                lp += np.where(ids == vocabulary.known, logs - rest, 0.0)  # a tail word's own count is added after the join
                begin = bounds[:-1]
                tails = np.flatnonzero(~found)
                doc = np.searchsorted(bounds, tails, side="right") - 1
                cut = np.searchsorted(doc, np.arange(len(some) + 1))
                uniq = [np.unique(h[tails[i:j]], return_counts=True) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(u[0]) for u in uniq])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([u[k] for u in uniq]).view(np.int64))) for k in (0, 1)]
                cols = [pa.array(np.arange(uid, uid + len(some), dtype=np.int64)), b.column(0).slice(first, len(some)), b.column(1).slice(first, len(some)), pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.add.reduceat(found.astype(np.int64), begin)), pa.array(np.add.reduceat(logs, begin)), pa.array(np.add.reduceat(lp, begin)), *lists]
                uid += len(some)
                yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "lp", "tail", "times"])

    return run


def learn_vocabulary(docs: DataFrame, stages: Stages) -> tuple[DataFrame, Vocabulary]:
    """Counts of all training words as a table, and the head for the tasks."""
    counts = docs.select("held_out", "text").mapInArrow(_count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = stages.save(counts, "counts")
    level = F.floor(F.log2("n") * 16).alias("level")
    by_level = counts.groupBy(level).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("level")).collect()  # at most 16 * 64 rows
    total, distinct = sum(r.tokens for r in by_level), sum(r.words for r in by_level)
    kept, least, share = 0, 1 << 30, 0.0
    for r in by_level:
        if kept + r.words > HEAD:
            share = (HEAD - kept) / r.words  # of the level that the head has no place for, words by hash
            least = r.level + 1
            break
        kept, least = kept + r.words, r.level
    here = F.floor(F.log2("n") * 16)
    some = (here == least - 1) & (F.shiftrightunsigned(F.xxhash64("hash"), 11) / float(1 << 53) < share)
    head = counts.where((here >= least) | some | (F.col("hash") == END)).toPandas()  # HEAD words, but for chance in the share
    return counts, Vocabulary.of(head["hash"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64), int(total), int(distinct))


def score(docs: DataFrame, stages: Stages | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs(doc_id, text)``.

    Rows with crc32(doc_id as text) mod 10 = 0 are held out; a null doc_id counts as empty text.  A null text is
    empty and has the end token alone.  All other rows are learnt from: every training token is counted and is a
    target of the network.  Shards of rows, dealt by hash, train in turn from the parameters that the rounds before
    came to on average, weighted by tokens, so scores don't depend on how the rows are partitioned.  A word outside the
    known ones has its share of the rest class by its exact count.  Repeated rows are scored, and learnt from, as
    often as they occur.
    """
    stages = stages or Stages(docs.sparkSession, "lm")
    spark = stages.spark
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(name) % 10 == 0).alias("held_out"), "text")
    counts, vocabulary = learn_vocabulary(docs, stages)
    flat = learn_parameters(docs, vocabulary, stages)
    shared = spark.sparkContext.broadcast((vocabulary, flat))
    rows = docs.mapInArrow(_score(shared), "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, lp double, tail array<long>, times array<long>")
    rows = stages.save(rows, "scores")
    tail = rows.select("uid", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("uid", F.col("t.tail").alias("hash"), F.col("t.times").alias("times"))
    n = F.coalesce(F.col("n"), F.lit(0))
    tail = tail.join(counts, "hash", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10(n + F.lit(SMOOTH))).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("seen"))
    norm = math.log10(vocabulary.total + SMOOTH * (vocabulary.distinct + 1))
    out = rows.drop("tail", "times").join(tail, "uid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("lp") + more).alias("score"),
    )
