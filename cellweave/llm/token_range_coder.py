"""Token ids as compressed binary: an adaptive context-mixing range coder over independent blocks.

Format of one segment (little endian)::

    b"CWR1" | docs u32 | ids u64 | block size u32 | blocks u32 | crc32 of the tables u32
    tables: doc_id i64 * docs | null flag u8 * docs | ids of each document u32 * docs | words of each block u32 * blocks | crc32 of each block u32 * blocks
    payload: the blocks' 16-bit words

A segment holds whole documents.  Its ids are cut into blocks of BLOCK; every block starts with a fresh coder and fresh
models, so any block is decoded by itself, and its checksum covers its words.  All blocks of a segment are coded in
step, one lane each.

Model of one id: the order-2 and order-1 contexts (the ids before it) each predict one id with a confidence.  The two
confidences, and whether the predictions agree, choose an adaptive mixture of three cases: the order-2 prediction
holds, the order-1 prediction holds, or neither.  In the last case order 0 codes the id by four adaptive nibbles, each
under those before it.

``compress``, ``expand``, ``pack`` and ``unpack`` say the format and read and write it anywhere; in Spark the classes of
``TokenCoder.java`` do the same on the executors, to the byte, and the tokenizer gets each distinct piece of a group.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages
from .textkernel import SEP, Remembered

BLOCK = 4096
#: Ids after which a segment ends at the next document's end.
SEGMENT = 4 << 20
#: Context slots of orders 1 and 2 per block; bits of the slot number.
SLOT_BITS = 11
#: Confidence stops here.
SURE = 7
#: Increments and limits of the mixture's and the nibbles' frequencies.
MIX_STEP, MIX_LIMIT, NIBBLE_STEP, NIBBLE_LIMIT = 24, 4096, 24, 2040
#: Bytes of texts whose pieces are told apart at once.
GROUP = 8 << 20
#: Pieces of one generation that a worker remembers, bytes of the longest, and pieces that the tokenizer gets as one text.
REMEMBER, LONGEST, JOINED = 700_000, 256, 512
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_U = np.uint64


def _mix_start() -> np.ndarray:
    """Frequencies (order 2, order 1, order 0) before anything is seen, per (confidence 2, confidence 1, agreement)."""
    c2, c1, _ = np.meshgrid(np.arange(SURE + 1), np.arange(SURE + 1), np.arange(2), indexing="ij")
    return np.stack([1 + 12 * c2, 1 + 6 * c1, np.full_like(c1, 24)]).reshape(3, -1).astype(np.uint16)


#: What a nibble adds to the 16 running sums of its context.
_STEPS = (np.arange(16) >= np.arange(16)[:, None]).astype(np.uint16) * np.uint16(NIBBLE_STEP)
#: Contexts of the three adaptive nibbles: none, the first, the first two.
_NIBBLES = 1 + 16 + 256


class Lanes:
    """Models and coder states of blocks coded in step.  Tables are flat; ``at_*`` holds where each lane's begins."""

    def __init__(self, lanes: int):
        self.n = lanes
        slots, cells = 1 << SLOT_BITS, 2 * (SURE + 1) ** 2
        row = np.arange(lanes)
        self.at_slot, self.at_cell, self.at_nibble = row * slots, row * cells, row * _NIBBLES
        self.pred = [np.zeros(lanes * slots, np.uint16) for _ in range(2)]
        self.conf = [np.zeros(lanes * slots, np.uint8) for _ in range(2)]
        self.mix = [np.tile(m, lanes) for m in _mix_start()]
        self.sums = np.tile(np.arange(8, 136, 8, dtype=np.uint16), (lanes * _NIBBLES, 1))
        self.prev = [np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)]
        self.low = np.zeros(lanes, _U)
        self.range = np.full(lanes, 2**64 - 1, _U)

    def keep(self, lanes: int) -> None:
        """Goes on with the first lanes only: the last block of a segment may be shorter."""
        self.n = lanes
        for name in ("at_slot", "at_cell", "at_nibble", "low", "range"):
            setattr(self, name, getattr(self, name)[:lanes])
        self.prev = [x[:lanes] for x in self.prev]

    def context(self) -> None:
        a, b = self.prev
        shift = 32 - SLOT_BITS
        x = a * 2654435761
        self.slot = [((x & 0xFFFFFFFF) >> shift) + self.at_slot, (((x + b * 2246822519) & 0xFFFFFFFF) >> shift) + self.at_slot]
        self.p = [self.pred[k].take(self.slot[k]).astype(np.int64) for k in range(2)]
        self.c = [self.conf[k].take(self.slot[k]) for k in range(2)]
        self.cell = self.at_cell + ((self.c[1].astype(np.int64) * (SURE + 1) + self.c[0]) * 2 + (self.p[0] == self.p[1]))
        f2, f1, f0 = (m.take(self.cell).astype(_U) for m in self.mix)
        self.f = (f2, f1, f0)
        self.total = f2 + f1 + f0

    def update(self, ids: np.ndarray, case: np.ndarray) -> None:
        for k in range(3):
            self.mix[k][self.cell] = self.f[k] + _U(MIX_STEP) * (case == k)
        full = np.flatnonzero(self.total > _U(MIX_LIMIT - MIX_STEP))
        if len(full):
            cell = self.cell[full]
            for m in self.mix:
                m[cell] = (m[cell] >> 1) | 1
        for k in range(2):
            c, hit = self.c[k], self.p[k] == ids
            stays = hit | (c > 1)
            self.pred[k][self.slot[k]] = np.where(stays, self.p[k], ids)
            self.conf[k][self.slot[k]] = np.where(hit, np.minimum(c + 1, SURE), np.where(stays, c - 2, 1))
        self.prev = [ids, self.prev[0]]

    def learn(self, where: np.ndarray, sums: np.ndarray, symbol: np.ndarray) -> None:
        """Adds a nibble to the running sums ``sums`` of the contexts ``where``."""
        sums = sums + _STEPS.take(symbol, axis=0)
        full = np.flatnonzero(sums[:, 15] > NIBBLE_LIMIT)
        if len(full):
            own = np.diff(sums[full].astype(np.int64), axis=1, prepend=0)
            sums[full] = np.cumsum((own >> 1) | 1, axis=1)
        self.sums[where] = sums


def _edges(sums: np.ndarray, line: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum below each symbol, and its own frequency."""
    flat = sums.ravel()
    high = flat.take(line + symbol).astype(_U)
    low = np.where(symbol > 0, flat.take(np.maximum(line + symbol - 1, 0)), 0).astype(_U)
    return low, high - low


def _find(sums: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The symbol whose interval holds t: how many of the 16 running sums are at most t."""
    bits = np.packbits(sums <= t[:, None].astype(np.uint16), axis=1)
    return np.bitwise_count(bits[:, 0]).astype(np.int64) + np.bitwise_count(bits[:, 1])


class Writer(Lanes):
    def __init__(self, lanes: int, room: int):
        super().__init__(lanes)
        self.room = room
        self.out = np.zeros(lanes * room, np.uint16)
        self.pos = np.arange(lanes) * room
        self.parts: list[bytes] = [b""] * lanes

    def put(self, low, rng, pos, unit, below, own):
        """Narrows the intervals and gives out the words that are settled."""
        low = low + unit * below
        rng = unit * own
        go = np.flatnonzero(((low ^ (low + rng)) < _TOP) | (rng < _BOT))
        while len(go):
            lo, ra = low[go], rng[go]
            apart = (lo ^ (lo + ra)) >= _TOP
            ra = np.where(apart, (_U(0) - lo) & (_BOT - _U(1)), ra)
            self.out[pos[go]] = lo >> _U(48)
            pos[go] += 1
            lo, ra = lo << _U(16), ra << _U(16)
            low[go], rng[go] = lo, ra
            go = go[((lo ^ (lo + ra)) < _TOP) | (ra < _BOT)]
        return low, rng

    def write(self, ids: np.ndarray) -> None:
        self.context()
        f2, f1, f0 = self.f
        case = np.where((ids == self.p[1]) & (self.c[1] > 0), 0, np.where((ids == self.p[0]) & (self.c[0] > 0), 1, 2))
        below = np.where(case == 0, _U(0), np.where(case == 1, f2, f2 + f1))
        own = np.where(case == 0, f2, np.where(case == 1, f1, f0))
        self.low, self.range = self.put(self.low, self.range, self.pos, self.range // self.total, below, own)
        rows = np.flatnonzero(case == 2)
        if len(rows):
            x, base, line = ids[rows], self.at_nibble[rows], np.arange(len(rows)) * 16
            low, rng, pos = self.low[rows], self.range[rows], self.pos[rows]
            a, b, c = x >> 12, (x >> 8) & 15, (x >> 4) & 15
            wa, wb, wc = base, base + 1 + a, base + 17 + (x >> 8)
            sa, sb, sc = (self.sums.take(w, axis=0) for w in (wa, wb, wc))
            la, oa = _edges(sa, line, a)
            low, rng = self.put(low, rng, pos, rng // sa[:, 15].astype(_U), la, oa)
            lb, ob = _edges(sb, line, b)
            low, rng = self.put(low, rng, pos, rng // sb[:, 15].astype(_U), lb, ob)
            lc, oc = _edges(sc, line, c)  # the last nibble is even within its 16
            low, rng = self.put(low, rng, pos, rng // (sc[:, 15].astype(_U) << _U(4)), (lc << _U(4)) + (x & 15).astype(_U) * oc, oc)
            self.low[rows], self.range[rows], self.pos[rows] = low, rng, pos
            for w, sums, symbol in ((wa, sa, a), (wb, sb, b), (wc, sc, c)):
                self.learn(w, sums, symbol)
        self.update(ids, case)

    def close(self, lane: int) -> None:
        """Ends the block of a lane."""
        first, pos, low = lane * self.room, int(self.pos[lane]), int(self.low[lane])
        tail = np.array([(low >> s) & 0xFFFF for s in (48, 32, 16, 0)], "<u2").tobytes()
        self.parts[lane] = self.out[first:pos].astype("<u2").tobytes() + tail

    def keep(self, lanes: int) -> None:
        super().keep(lanes)
        self.pos = self.pos[:lanes]


class Reader(Lanes):
    def __init__(self, parts: list[bytes]):
        super().__init__(len(parts))
        sizes = [len(p) // 2 for p in parts]
        room = max(sizes) + 8
        words = np.zeros((len(parts), room), np.uint16)
        for i, p in enumerate(parts):
            words[i, : sizes[i]] = np.frombuffer(p, "<u2")
        self.code = np.zeros(len(parts), _U)
        for k in range(4):
            self.code = (self.code << _U(16)) | words[:, k].astype(_U)
        self.words = words.ravel()
        self.pos = np.arange(len(parts)) * room + 4

    def keep(self, lanes: int) -> None:
        super().keep(lanes)
        self.code, self.pos = self.code[:lanes], self.pos[:lanes]

    def take(self, low, rng, code, pos, unit, below, own):
        low = low + unit * below
        rng = unit * own
        go = np.flatnonzero(((low ^ (low + rng)) < _TOP) | (rng < _BOT))
        while len(go):
            lo, ra = low[go], rng[go]
            apart = (lo ^ (lo + ra)) >= _TOP
            ra = np.where(apart, (_U(0) - lo) & (_BOT - _U(1)), ra)
            code[go] = (code[go] << _U(16)) | self.words[pos[go]].astype(_U)
            pos[go] += 1
            lo, ra = lo << _U(16), ra << _U(16)
            low[go], rng[go] = lo, ra
            go = go[((lo ^ (lo + ra)) < _TOP) | (ra < _BOT)]
        return low, rng

    def nibble(self, sums, line, low, rng, code):
        total = sums[:, 15].astype(_U)
        unit = rng // total
        symbol = _find(sums, np.minimum((code - low) // unit, total - _U(1)))
        return symbol, *_edges(sums, line, symbol), unit

    def read(self) -> np.ndarray:
        self.context()
        f2, f1, f0 = self.f
        unit = self.range // self.total
        t = np.minimum((self.code - self.low) // unit, self.total - _U(1))
        case = (t >= f2).astype(np.int64) + (t >= f2 + f1)
        below = np.where(case == 0, _U(0), np.where(case == 1, f2, f2 + f1))
        own = np.where(case == 0, f2, np.where(case == 1, f1, f0))
        self.low, self.range = self.take(self.low, self.range, self.code, self.pos, unit, below, own)
        ids = np.where(case == 0, self.p[1], self.p[0])
        rows = np.flatnonzero(case == 2)
        if len(rows):
            base, line = self.at_nibble[rows], np.arange(len(rows)) * 16
            low, rng, code, pos = self.low[rows], self.range[rows], self.code[rows], self.pos[rows]
            sa = self.sums.take(base, axis=0)
            a, la, oa, unit = self.nibble(sa, line, low, rng, code)
            low, rng = self.take(low, rng, code, pos, unit, la, oa)
            sb = self.sums.take(base + 1 + a, axis=0)
            b, lb, ob, unit = self.nibble(sb, line, low, rng, code)
            low, rng = self.take(low, rng, code, pos, unit, lb, ob)
            wc = base + 17 + a * 16 + b
            sc = self.sums.take(wc, axis=0)
            unit = rng // (sc[:, 15].astype(_U) << _U(4))
            t = np.minimum((code - low) // unit, (sc[:, 15].astype(_U) << _U(4)) - _U(1))
            c = _find(sc, t >> _U(4))
            lc, oc = _edges(sc, line, c)
            d = np.minimum((t - (lc << _U(4))) // oc, _U(15))
            low, rng = self.take(low, rng, code, pos, unit, (lc << _U(4)) + d * oc, oc)
            self.low[rows], self.range[rows], self.code[rows], self.pos[rows] = low, rng, code, pos
            for w, sums, symbol in ((base, sa, a), (base + 1 + a, sb, b), (wc, sc, c)):
                self.learn(w, sums, symbol)
            ids[rows] = (a << 12) | (b << 8) | (c << 4) | d.astype(np.int64)
        self.update(ids, case)
        return ids


def compress(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """Each block of ids (below 65,536) as 16-bit words."""
    n = len(ids)
    if not n:
        return []
    blocks = -(-n // block)
    grid = np.zeros(blocks * block, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(blocks, block).T)
    tail = n - (blocks - 1) * block
    length = min(n, block)
    w = Writer(blocks, 3 * length + 16)
    for t in range(length):
        if t == tail:
            w.close(blocks - 1)
            w.keep(blocks - 1)
        w.write(grid[t, : w.n])
    for lane in range(w.n):
        w.close(lane)
    return w.parts


def expand(parts: list[bytes], n: int, block: int = BLOCK) -> np.ndarray:
    if not parts:
        return np.zeros(0, np.int64)
    r = Reader(parts)
    out = np.zeros((min(n, block), len(parts)), np.int64)
    tail = n - (len(parts) - 1) * block
    for t in range(len(out)):
        if t == tail:
            r.keep(len(parts) - 1)
        out[t, : r.n] = r.read()
    return np.concatenate([out[:, :-1].T.ravel(), out[:tail, -1]])


def pack(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    parts = compress(ids, block)
    tables = b"".join([
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids), np.array(sizes, "<u4").tobytes(),
        np.array([len(p) // 2 for p in parts], "<u4").tobytes(), np.array([zlib.crc32(p) for p in parts], "<u4").tobytes(),
    ])
    return struct.pack("<4sIQIII", b"CWR1", len(doc_ids), len(ids), block, len(parts), zlib.crc32(tables)) + tables + b"".join(parts)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, sizes and all ids of a segment; raises ValueError if a checksum fails."""
    magic, docs, n, block, blocks, crc = struct.unpack_from("<4sIQIII", data)
    at = struct.calcsize("<4sIQIII")
    if magic != b"CWR1" or zlib.crc32(data[at : at + 13 * docs + 8 * blocks]) != crc:
        raise ValueError("not a segment, or its tables are damaged")
    names = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
    words = np.frombuffer(data, "<u4", blocks, at + 13 * docs).astype(np.int64)
    crcs = np.frombuffer(data, "<u4", blocks, at + 13 * docs + 4 * blocks)
    ends = at + 13 * docs + 8 * blocks + np.cumsum(2 * words)
    parts = [data[e - 2 * w : e] for e, w in zip(ends.tolist(), words.tolist(), strict=True)]
    for i, (p, c) in enumerate(zip(parts, crcs.tolist(), strict=True)):
        if zlib.crc32(p) != c:
            raise ValueError(f"block {i} is damaged")
    return [None if z else int(x) for x, z in zip(names, null, strict=True)], sizes, expand(parts, n, block)


class Tokens:
    """Encodes pieces of texts with a byte-level BPE tokenizer, each distinct one once as long as it is remembered.

    The tokenizer's pattern never joins a white-space character to a visible one before it, nor a letter to a mark or
    digit behind it, so ``TokenCoder`` cuts texts before white space that follows an ASCII character or a two-byte
    letter, and before ASCII marks and digits that follow a Latin letter; the ids of the pieces are the text's.  A text
    that holds an added token is one piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Remembered(REMEMBER)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(1 << 16, np.int64)  # a character of a name is a byte of the text
        self.bytes[list(names.values())] = np.fromiter(map(len, names), np.int64, len(names))
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids of each piece."""
        coded = self.known.find(pieces)
        new = [i for i, v in enumerate(coded) if v is None]
        for lo in range(0, len(new), 100_000):
            rows = new[lo : lo + 100_000]
            for i, ids in zip(rows, self._encode([pieces[i] for i in rows]), strict=True):
                coded[i] = ids
                if len(pieces[i]) <= LONGEST:
                    self.known.new[pieces[i]] = ids
        return coded

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces that may stand behind each other, as the pattern parts them, are encoded JOINED at a time."""
        out: list[bytes | None] = [None] * len(pieces)
        if not any(SEP[list(a)].any() for a in self.added):
            rows = [i for i, p in enumerate(pieces) if p[0] == 0x20 and 0x20 < p[-1] < 0x7F and not any(a in p for a in self.added)]
            runs = [rows[k : k + JOINED] for k in range(0, len(rows), JOINED)]
            joined = [b"".join([pieces[i] for i in run]) for run in runs]
            for run, e in zip(runs, self._batch(joined), strict=True):
                ids = np.array(e, np.uint16)
                cut = np.cumsum([len(pieces[i]) for i in run])
                ends = np.cumsum(self.bytes[ids])
                at = np.searchsorted(ends, cut)
                if at[-1] == len(ends) - 1 and (ends[at] == cut).all():  # else not as expected: each by itself
                    raw, at = ids.astype("<u2").tobytes(), (2 * (at + 1)).tolist()
                    for i, a, b in zip(run, [0, *at], at):
                        out[i] = raw[a:b]
        rest = [i for i, v in enumerate(out) if v is None]
        for i, e in zip(rest, self._batch([pieces[i] for i in rest]), strict=True):
            out[i] = np.array(e, "<u2").tobytes()
        return out

    def _batch(self, texts: list[bytes]) -> Iterator[list[int]]:
        for lo in range(0, len(texts), 20_000):
            for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[lo : lo + 20_000]], add_special_tokens=False):
                yield e.ids


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens") or ())


_coders: dict[str, JavaObject] = {}


def coder(spark: SparkSession) -> JavaObject:
    """A ``TokenCoder``, compiled by the Janino that Spark brings, its classes sent to the executors; once in an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _coders:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook((Path(__file__).parent / "TokenCoder.java").read_text("utf-8"))
        folder = tempfile.mkdtemp(prefix="cellweave-coder-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        jar = f"{folder}/cellweave-token-coder.jar"
        classes = compiler.getBytecodes()
        with zipfile.ZipFile(jar, "w") as z:
            for name in classes:
                z.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
        sc._jsc.addJar(jar)
        made = compiler.getClassLoader().loadClass("cellweave.TokenCoder").getConstructors()[0]
        _coders[sc.applicationId] = made.newInstance(sc._gateway.new_array(jvm.Object, 0))
    return _coders[sc.applicationId]


def _partitions(df: DataFrame, function: JavaObject, schema: str) -> DataFrame:
    """``df`` with the JVM's ``function`` over its partitions."""
    sql = df.sparkSession._jvm.org.apache.spark.sql
    out = sql.types.StructType.fromDDL(schema)
    return DataFrame(df._jdf.mapPartitions(function, sql.Encoders.row(out)), df.sparkSession)


def _encode(path: str):
    """Groups of pieces to groups of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = tokens(path)
        for b in batches:
            for k in range(b.num_rows):
                ends, data = (b.column(i)[k].as_buffer() for i in (4, 5))
                coded = own.encode(pa.Array.from_buffers(pa.binary(), ends.size // 4 - 1, [None, ends, data]).to_pylist())
                sizes = np.fromiter(map(len, coded), np.int32, len(coded)) // 2
                new = [pa.array([b"".join(coded)], pa.binary()), pa.array([sizes.astype("<i4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(i).slice(k, 1) for i in range(4)] + new, ["names", "none", "counts", "index", "ids", "sizes"])

    return run


def write_ids(docs: DataFrame, path: str | None = None, end: int = 0, segment: int = SEGMENT, stages: Stages | None = None, to: str | None = None) -> DataFrame:
    """Files of segments ``part, seq, start, ids, data``, in ascending doc_id order over (part, seq).

    Rows are dealt to ranges of doc_id, null first; rows with the same doc_id stand in the order of their texts.
    ``start`` counts the ids before the segment within its part.  A null text has the end id alone.  The files are a
    Parquet table in the new folder ``to``, to be kept, or else a stage's, which goes with the session.
    """
    spark = docs.sparkSession
    stages = stages or Stages(spark, "ids")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    path = path or default_tokenizer()
    added = spark._jvm.java.util.ArrayList()
    for token in added_tokens(path):
        added.add(token)
    java = coder(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"))
    groups = _partitions(rows, java.split(GROUP, added), "names binary, none binary, counts binary, index binary, ends binary, pieces binary")
    coded = groups.mapInArrow(_encode(path), "names binary, none binary, counts binary, index binary, ids binary, sizes binary")
    files = _partitions(coded, java.code(BLOCK, end, segment), "part int, seq int, start long, ids long, data binary")
    if to is None:
        return stages.save(files, "ids")
    files.write.parquet(to)
    return spark.read.parquet(to)


def read_ids(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of ``write_ids``; damaged blocks raise."""
    sizes = files.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()  # a row per part
    offsets, total = files.sparkSession._jvm.java.util.HashMap(), 0
    for r in sizes:
        offsets[r.part] = total
        total += r.ids
    return _partitions(files.select("part", "start", "data"), coder(files.sparkSession).read(offsets), "doc_id long, start long, n_tokens long, ids_crc32 long")
