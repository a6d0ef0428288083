"""SentencePiece BPE encoding by suffix-array matching, and decoding.

Pieces never join a blank (U+2581) to a character before it, so a text is cut before every run of blanks and each
distinct chunk of a batch is encoded once.  The batch's distinct chunks are one indexed text: a suffix array over its
first MAXLEN characters, in which every piece of the vocabulary is found by binary search.  The occurrences are the
edges of a lattice; sorted by the place where they end, they are relaxed from left to right.

The model merges by rank, so the best path is not the one with the largest sum of scores.  An edge is relaxed if its
piece may follow the last piece of the encoding that ends where it begins: that is so if the two, encoded together,
come out as these two.  Merges at one border depend on the pieces beside it alone, so exactly one edge into each place
passes, and the path to the end is the model's encoding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernel import Remembered, as_bytes, groups, prefix_hash, span_hash

BLANK = "▁"
#: Chunks of one generation that a worker remembers.
REMEMBER = 450_000
#: Chunks that one index holds.
INDEXED = 30_000
#: Places of a chunk that are relaxed side by side with those of the other chunks; edges that end further on come one by one.
STEPS = 48
#: Bits of the slot number in the table of pairs that are known to stand side by side or not.
PAIR_BITS = 21
_START, _UNSET, _OTHER = -1, -2, -3


class Vocabulary:
    """Pieces of a BPE model with byte fallback, identity normalisation and a blank put before each text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.score: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        self.bytes_of: list[bytes] = []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                if not model.is_unused(i):
                    self.score[piece] = (model.get_score(i), i)
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError(f"a piece joins a blank to a character before it: {piece!r}")
        self.pieces = sorted(self.score)
        self.ids = np.array([self.score[p][1] for p in self.pieces])
        self.length = np.array([len(p) for p in self.pieces])
        self.maxlen = int(self.length.max())
        self.codes = np.full((len(self.pieces), self.maxlen), -1, np.int32)
        for i, p in enumerate(self.pieces):
            self.codes[i, : len(p)] = [ord(c) for c in p]
        self.text = dict(zip(self.ids.tolist(), self.pieces, strict=True))
        self.single = np.array(sorted(ord(p) for p in self.pieces if len(p) == 1), np.int32)
        self.pair_key = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_ok = np.zeros(1 << PAIR_BITS, bool)
        self.alone = np.full(self.size, -1, np.int8)
        self.split: dict[str, tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """The model's merges: the pair with the best score first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s[0] > best):
                    best, at = s[0], i
            if at < 0:
                return parts
            if len(parts) == 2:
                self.split[text] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stand(self, pieces: np.ndarray) -> np.ndarray:
        """Whether each piece's own text is encoded as the piece."""
        for t in np.unique(pieces[self.alone[pieces] < 0]).tolist():
            self.alone[t] = self.merged(self.text[t]) == [self.text[t]]
        return self.alone[pieces] > 0

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each two pieces, encoded together, come out as these two."""
        key = a * 65536 + b
        slot = ((key * 0x9E3779B1) >> 7) & ((1 << PAIR_BITS) - 1)
        out, lost = self.pair_ok[slot], np.flatnonzero(self.pair_key[slot] != key)
        if len(lost):
            new, at = np.unique(key[lost], return_inverse=True)
            x, y = new >> 16, new & 65535
            both = self.stand(x) & self.stand(y)
            ok = np.array([z and self.border_holds(self.text[i], self.text[j]) for i, j, z in zip(x.tolist(), y.tolist(), both.tolist(), strict=True)])
            out[lost] = ok[at]
            where = ((new * 0x9E3779B1) >> 7) & ((1 << PAIR_BITS) - 1)
            where, one = np.unique(where, return_index=True)
            self.pair_key[where], self.pair_ok[where] = new[one], ok[one]
        return out

    def passes(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether an edge with ``piece`` may be taken where the encoding so far ends with ``last``."""
        out = np.ones(len(piece), bool)  # a character without a piece always stands
        first = np.flatnonzero((piece != _OTHER) & (last < 0))
        out[first] = self.stand(piece[first])
        pair = np.flatnonzero((piece != _OTHER) & (last >= 0))
        out[pair] = self.may_follow(last[pair], piece[pair])
        return out

    def border_holds(self, x: str, y: str) -> bool:
        """Whether no merge crosses the border of two standing pieces.

        Their own merges are undone from the last to the first; at each state the pair at the border must not be a
        piece that would have been merged before the merge just undone.  Ranks are unique but for runs of blanks.
        """
        if x[-1] == BLANK and y[0] == BLANK:
            return self.merged(x + y) == [x, y]
        limit = float("inf")
        while True:
            joint = self.score.get(x + y)
            if joint is not None and -joint[0] < limit:
                return False
            a = -self.score[x][0] if len(x) > 1 else -1.0
            b = -self.score[y][0] if len(y) > 1 else -1.0
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, x = a, self.halves(x)[1]
            else:
                limit, y = b + 0.5, self.halves(y)[0]

    def halves(self, piece: str) -> tuple[str, str]:
        if piece not in self.split:
            self.merged(piece)
        return self.split[piece]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their next ``depth`` codes, by doubling of ranked prefixes."""
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < depth:
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        key = (rank << 32) | (after + 1)
        order = np.argsort(key, kind="stable")
        new = np.empty(len(rank), bool)
        new[0] = True
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.cumsum(new) - 1
        step *= 2
    return order


def occurrences(v: Vocabulary, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 place in ``order`` of the suffixes that begin with each piece."""
    padded = np.concatenate([codes, np.full(v.maxlen, -2, np.int32)])
    n, cols = len(codes), np.arange(v.maxlen)
    used = cols < v.length[:, None]

    def search(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(v.pieces), np.int64), np.full(len(v.pieces), n, np.int64)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) >> 1
            have = padded[order[mid][:, None] + cols]
            differ = (have != v.codes[live]) & used[live]
            any_ = differ.any(axis=1)
            k = differ.argmax(axis=1)
            rows = np.arange(len(live))
            less = any_ & (have[rows, k] < v.codes[live][rows, k])
            right = less | ~any_ if upper else less
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)
        return lo

    return search(False), search(True)


def encode_chunks(v: Vocabulary, chunks: list[str]) -> list[bytes]:
    """Ids of each chunk (blanks then other characters), together, as little-endian 16-bit integers."""
    if not chunks:
        return []
    raw = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le"), np.int32).copy()
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    raw[begin + sizes] = 0x110000  # sorts after, and equals, no character
    order = suffix_array(raw, v.maxlen)
    lo, hi = occurrences(v, raw, order)
    count = hi - lo
    piece = np.repeat(np.arange(len(v.pieces)), count)
    at = order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    other = np.flatnonzero(~np.isin(raw, v.single) & (raw != 0x110000))
    start = np.concatenate([at, other])
    size = np.concatenate([v.length[piece], np.ones(len(other), np.int64)])
    ids = np.concatenate([v.ids[piece], np.full(len(other), _OTHER)])
    # an edge may not cross the end of a chunk: no piece holds the separator, so none does
    # place by place, all chunks side by side; among edges into one place, the one from furthest back comes first
    end = start + size
    far = end - np.repeat(begin, sizes + 1)[start]
    by_place = np.lexsort((start, end, np.minimum(far, STEPS + 1)))
    start, end, ids = start[by_place], end[by_place], ids[by_place]
    edge = np.searchsorted(far[by_place], np.arange(1, STEPS + 2)) if len(far) else np.zeros(STEPS + 1, np.int64)
    last = np.full(len(raw) + 1, _UNSET, np.int64)
    came = np.zeros(len(raw) + 1, np.int64)
    last[begin] = _START

    def take(i: int, j: int) -> None:
        live = i + np.flatnonzero(last[start[i:j]] != _UNSET)
        live = live[v.passes(last[start[live]], ids[live])][::-1]  # the first of several is written last
        last[end[live]], came[end[live]] = ids[live], start[live]

    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if i < j:
            take(i, j)
    tail = int(edge[-1])
    places = np.flatnonzero(np.concatenate([[True], end[tail + 1 :] != end[tail:-1]])) + tail if tail < len(end) else np.zeros(0, np.int64)
    for i, j in zip(places.tolist(), [*places[1:].tolist(), len(end)], strict=True) if len(places) else ():
        take(i, j)
    # back from the ends, all chunks side by side
    at, live, found = begin + sizes, np.arange(len(chunks)), []
    while len(live):
        found.append((live, last[at], came[at]))
        at = came[at]
        on = at > begin[live]
        at, live = at[on], live[on]
    chunk = np.concatenate([x[0] for x in found])
    step = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    many = np.bincount(chunk, minlength=len(chunks))
    ends = np.cumsum(many)
    place = ends[chunk] - 1 - step
    token, origin = np.empty(len(chunk), np.int64), np.empty(len(chunk), np.int64)
    token[place] = np.concatenate([x[1] for x in found])
    origin[place] = np.concatenate([x[2] for x in found])
    odd = np.flatnonzero(token == _OTHER)
    if len(odd):  # bytes stand for a character without a piece
        size = np.ones(len(token), np.int64)
        spelt = [chr(c).encode() for c in raw[origin[odd]].tolist()]
        size[odd] = [len(x) for x in spelt]
        to = np.cumsum(size) - size
        token = np.repeat(token, size)
        for i, x in zip(to[odd].tolist(), spelt, strict=True):
            token[i : i + len(x)] = [v.byte[y] for y in x]
        ends = (to + size)[ends - 1]
    flat = token.astype("<u2").tobytes()
    return [flat[2 * i : 2 * j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.known = Remembered(REMEMBER)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text."""
        blank = BLANK.encode()
        texts = [b" " + (t.replace(blank, b" ") if blank in t else t) if t else b"" for t in texts]
        data = b"".join(texts)
        if not data:
            return [b""] * len(texts)
        buf = np.frombuffer(data, np.uint8)
        space = buf == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        cut[first[:-1][first[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        uniq, index, inverse = np.unique(span_hash(prefix_hash(buf), start, end), return_index=True, return_inverse=True)
        names = uniq.tolist()
        coded = self.known.find(names)
        new = [i for i, v in enumerate(coded) if v is None]
        for lo in range(0, len(new), INDEXED):
            own = new[lo : lo + INDEXED]
            k = index[own]
            chunks = [data[a:b].decode("utf-8", "replace").replace(" ", BLANK) for a, b in zip(start[k].tolist(), end[k].tolist(), strict=True)]
            for i, ids in zip(own, encode_chunks(self.v, chunks), strict=True):
                coded[i] = self.known.new[names[i]] = ids
        each = inverse.tolist()
        bounds = np.searchsorted(start, first).tolist()
        return [b"".join([coded[k] for k in each[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of the ids; the blank put before the text is taken off."""
        table = self.v.bytes_of
        out = b"".join([table[i] for i in np.frombuffer(ids, np.uint16).tolist()])
        return out[1:] if out[:1] == b" " else out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encode(path: str, carried: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = as_bytes(b.column(carried))
            for first, some in groups(texts, 1 << 20):
                ids = e.encode(some)
                back = [e.decode(x) for x in ids]
                same = [x == (t.replace(BLANK.encode(), b" ") if BLANK.encode() in t else t) for x, t in zip(back, some, strict=True)]
                cols = [c.slice(first, len(some)) for c in b.columns[:carried]]
                cols += [pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array([zlib.crc32(np.frombuffer(x, np.uint16).astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(same)]
                names = [*b.schema.names[:carried], "n_pieces", "ids_crc32", "round_trip"]
                if with_ids:
                    flat = np.frombuffer(b"".join(ids), np.uint16).astype(np.int32)
                    ends = np.concatenate([[0], np.cumsum([len(x) // 2 for x in ids])]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                    names.append("pieces")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """``keep`` columns, ``n_pieces``, ``ids_crc32`` (of the ids as little-endian 32-bit integers), ``round_trip`` and, on request, ``pieces``.

    A null or empty text has no pieces.  Rows are independent: repeated rows give repeated results.  ``round_trip``
    tells whether decoding gives the text back (a literal U+2581 counts as the blank it becomes).
    """
    path = path or default_model()
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    extra = ", pieces array<int>" if with_ids else ""
    return docs.select(*keep, "text").mapInArrow(_encode(path, len(keep), with_ids), f"{fields}, n_pieces long, ids_crc32 long, round_trip boolean{extra}")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows(..., pieces)`` with ``text`` in place of ``pieces``."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = [e.decode(np.array(p or [], np.uint16).tobytes()).decode("utf-8", "replace") for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    others = [c for c in rows.columns if c != "pieces"]
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.select(*others, "pieces").mapInArrow(run, f"{fields}text string")
