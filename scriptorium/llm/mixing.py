"""Operator 8: language-model scoring by logistic context mixing.

A text is the sequence of its lower-cased words and one end. It is coded as running bytes, each word with
a closing blank and the end as a blank alone, each byte by binary decisions down a tree (a Huffman tree for each
preceding byte, which all contexts know). Several predictors, each a hashed context (the
last 1 to 5 bytes, which reach across blanks into the words before; the word so far; the preceding word and the
word so far) with counts of both values over every occurrence in the training texts, give their
logits; weights gated by the decision's depth and the byte's place in its word mix them, trained online by second-order
steps, and go on learning inside each text while it is scored; an adaptive probability map refines the result.
A word's probability under the bit model is then mixed with its relative frequency in the training texts, with its
share of what the text itself has said so far, and with its share of what has followed the preceding word
there, each with a weight that its past tokens have earned.
All of it is a probability distribution over texts: total bits per byte follow from the score.

Texts are dealt into chunks by their hashes, in that order, so counts, weights and scores do not depend on how Spark
deals out the rows. For the counts of words, chunks send their distinct words to buckets and buckets answer with totals.
What is trained leaves each decision's own occurrence out, so training texts don't vouch for themselves. A context table has up to
2**MAX_BITS slots, so its size is bounded; it is summed by ranges of slots. Vocabularies never leave the buckets.
"""

from __future__ import annotations

import functools
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import common, exchange
from scriptorium.llm.bytehash import Windows

ORDERS = (1, 2, 3, 4, 5)  # bytes; after them the word so far, and the preceding word with it
PREDICTORS = len(ORDERS) + 2
MIN_BITS, MAX_BITS = 16, 22  # of a context table
RANGE_BITS = 18  # slots of a table that are summed in one group
CHUNK, SMALL_CHUNK = 4 << 20, 1 << 20
COUNTED = 64 << 20  # text per set of tables, and sets at least and at most
SETS = 4, 256
BUCKET_TEXT = 16 << 20  # text per bucket of words; small inputs have up to 8 buckets of SMALL_TEXT or more
SMALL_TEXT = 4 << 20
BATCH = 6000  # bytes modelled at once: arrays that stay in the processor's cache
TRAIN_BATCH = 12_000  # bytes between two steps of training at most
BLOCK, RATE = 256, 0.002  # bytes of a text between two steps of its weights, and the size of a step
COUNT_BATCH = 1 << 20  # bytes counted at once
PLACES, DEPTHS = 4, 8
COUNTS = 0.3, 20.0  # weight of relative frequencies at a text's beginning, and the tokens that this is worth
CACHE = 0.05, 20.0  # the same for what the text has said so far
_U = np.uint64


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2 if doc_id is not None else False


# -- chunks ----------------------------------------------------------------


class Chunk:
    """Distinct words of a chunk in the order of their buckets, and the texts as their numbers; the end is the empty word."""

    def __init__(self, blob: np.ndarray, lens: np.ndarray, ids: list, n_buckets: int):
        self.blob, self.lens = blob, lens
        seen: dict[bytes, int] = {b"": 0}
        number = seen.setdefault
        raw, at, parts = blob.tobytes(), 0, []
        for n in lens.tolist():
            words = raw[at : at + n].lower().split()
            words.append(b"")
            parts.append(np.array([number(u, len(seen)) for u in words], np.int64))
            at += n
        self.sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.train = np.array([not held_out(i) for i in ids], bool)
        counts = np.bincount(flat, np.repeat(self.train, self.sizes), minlength=len(seen)).astype(np.int64)
        names = list(seen)
        keys = np.fromiter((xxhash.xxh64_intdigest(u) for u in names), np.uint64, len(names))
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.flat = place[flat]
        self.names = [names[k] for k in order.tolist()]
        self.counts = counts[order]
        self.which, self.at = exchange.split(exchange.bucket_of(keys[order], n_buckets))

    def messages(self) -> list[tuple[int, bytes]]:
        out = []
        for k, w in enumerate(self.which.tolist()):
            a, b = self.at[k], self.at[k + 1]
            own = self.names[a:b]
            lens = np.fromiter(map(len, own), np.int32, b - a)
            out.append((w, np.array([b - a], np.int64).tobytes() + self.counts[a:b].tobytes() + lens.tobytes() + b"".join(own)))
        return out


def _parse(message: bytes) -> tuple[np.ndarray, list[bytes]]:
    n = int(np.frombuffer(message, np.int64, 1)[0])
    counts = np.frombuffer(message, np.int64, n, 8)
    ends = np.cumsum(np.frombuffer(message, np.int32, n, 8 + 8 * n)).tolist()
    body = message[8 + 12 * n :]
    return counts, [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def pair_times(blob: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each byte follows each other: of words with their closing blanks, as a blank precedes every word."""
    pair = blob.astype(np.int64)
    pair[1:] |= pair[:-1] << 8
    pair[:1] |= 32 << 8
    out = np.zeros(1 << 16, np.int64)
    np.add.at(out, pair, counts)
    return out


def _merge(group: pa.Table) -> pa.Table:
    """The vocabulary of a bucket: words, each with a closing blank, and training counts."""
    total: dict[bytes, int] = {}
    get = total.get
    for m in group.column("message").to_pylist():
        counts, names = _parse(m)
        for u, c in zip(names, counts.tolist(), strict=True):
            total[u] = get(u, 0) + c
    names, counts = list(total), np.fromiter(total.values(), np.int64, len(total))
    lens = np.fromiter(map(len, names), np.int32, len(names)) + np.int32(1)
    blob = b" ".join([*names, b""])
    times = pair_times(np.frombuffer(blob, np.uint8), np.repeat(counts, lens))
    pair = np.flatnonzero(times)
    return pa.table(
        {
            "bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()),
            "blob": pa.array([blob], pa.binary()),
            "lens": pa.array([lens.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
            "tokens": pa.array([int(counts.sum())], pa.int64()),
            "types": pa.array([int(np.count_nonzero(counts))], pa.int64()),
            "pairs": pa.array([pair.tolist()], pa.list_(pa.int32())),
            "times": pa.array([times[pair].tolist()], pa.list_(pa.int64())),
        }
    )


_VOCAB = "bucket int, blob binary, lens binary, counts binary, tokens long, types long, pairs array<int>, times array<long>"


# -- the bit model ---------------------------------------------------------


def coded(blob: np.ndarray, lens: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Texts (those of ``keep``) as the bytes to be predicted, and their lengths."""
    raw, at, out = blob.tobytes(), 0, []
    for k, n in enumerate(lens.tolist()):
        if keep is None or keep[k]:
            out.append(b" ".join([*raw[at : at + n].lower().split(), b" "]))
        at += n
    return np.frombuffer(b"".join(out), np.uint8), np.fromiter(map(len, out), np.int64, len(out))


class Stream:
    """Coded texts: the token and the place of each byte, and where its contexts begin."""

    def __init__(self, blob: np.ndarray, lens: np.ndarray):
        n = len(blob)
        self.blob, self.lens = blob, lens
        self.begins = np.cumsum(lens) - lens
        blank = np.flatnonzero(blob == 32)  # each text ends with one
        self.tokens = np.concatenate(([0], blank[:-1] + 1))
        first = np.searchsorted(self.tokens, self.begins)
        before = np.concatenate(([0], self.tokens[:-1]))
        before[first[first < len(before)]] = self.begins[first < len(before)]
        self.sizes = np.diff(np.append(self.tokens, n))
        self.word = np.repeat(self.tokens.astype(np.int32), self.sizes)
        self.both = np.repeat(before.astype(np.int32), self.sizes)
        self.place = np.minimum(np.arange(n, dtype=np.int32) - self.word, PLACES - 1).astype(np.uint8)
        self.hashes = Windows(blob)
        two = np.zeros(n + 1, np.uint16)  # the bytes before, the nearest one lowest; before a text lies a blank, as before a word
        two[1:] = blob
        two[0] = 32
        self.pair = two[:-1] << np.uint16(8) | blob
        two[1:] |= two[:-1] << np.uint16(8)
        self.last = two[:-1].astype(np.uint32)
        self.last[2:] |= self.last[:-2] << np.uint32(16)
        self.fifth = np.zeros(n, np.uint8)
        self.fifth[5:] = blob[: max(0, n - 5)]
        self.fifth[4:5] = 32
        for k in range(ORDERS[-1] - 1):
            near = self.begins[self.lens > k] + k
            self.fifth[near] = 0
            self.last[near] &= np.uint32((1 << 8 * k + 8) - 1)

    @property
    def token(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def contexts(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """A hash per predictor of what precedes the bytes at ``at``."""
        last, odd = self.last.take(at, mode="clip"), np.uint32(0x9E3779B1)
        for k in ORDERS[:4]:
            yield (last & np.uint32((1 << 8 * k) - 1)) * odd
        yield last * odd ^ (self.fifth.take(at, mode="clip") + np.uint32(1)) * np.uint32(0x85EBCA6B)
        end = self.hashes.sums.take(at, mode="clip")
        for start in (self.word.take(at, mode="clip"), self.both.take(at, mode="clip")):
            yield ((end - self.hashes.sums.take(start, mode="clip")) * self.hashes.down.take(start, mode="clip") >> _U(32)).astype(np.uint32)


class Code:
    """The binary decisions that tell a byte after another: of each pair (256 times the preceding byte, and the byte) how
    many there are and their values, first one highest. Every byte has a path, and the paths after a byte are a whole tree,
    so that chances of decisions make a distribution over bytes."""

    def __init__(self, length: np.ndarray, path: np.ndarray):
        self.length, self.path = length.astype(np.int64), path
        n = self.length
        self.start = np.cumsum(n) - n
        own = np.repeat(np.arange(len(n)), n)
        d = np.arange(n.sum()) - self.start[own]
        left, whole = n[own] - d, path[own]
        above = d & ~3  # four decisions in a row share a line of 16 slots
        self.bit = (whole >> (left - 1) & 1).astype(np.int8)
        node = (1 << (d & 3)) | (whole >> left & (1 << (d & 3)) - 1)
        # those further down lie in one of the 255 lines about the context's own, so that a look at them isn't far
        line = np.where(above > 0, 1 + ((whole >> (left + (d & 3))) * 157 + above * 89 + (own >> 8) * 59) % 255, 0)
        self.slot = line * 16 | node
        self.count = self.slot * 2 | self.bit
        self.depth = np.minimum(d, DEPTHS - 1)

    def __reduce__(self):
        return Code, (self.length, self.path)

    def steps(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each decision of some bytes: the number of its byte, and its own in this code."""
        n = self.length.take(pair, mode="clip")
        begins = np.cumsum(n) - n
        own = np.repeat(np.arange(len(pair)), n)
        step = (self.start.take(pair, mode="clip") - begins).take(own, mode="clip")
        step += np.arange(len(own))
        return own, step

    @classmethod
    def plain(cls) -> Code:
        """The eight bits of a byte."""
        return cls(np.full(1 << 16, 8, np.int8), np.arange(1 << 16) & 255)

    @classmethod
    def short(cls, times: np.ndarray) -> Code:
        """Huffman trees, one for each preceding byte, of how often the pairs occur: frequent bytes take few decisions.
        After a byte that never came before another they are its bits."""
        length, path = np.full(1 << 16, 8, np.int8), np.arange(1 << 16) & 255
        for first in np.flatnonzero(times.reshape(256, 256).any(1)).tolist():
            row = times[first << 8 : (first + 1) << 8].tolist()
            length[first << 8 : (first + 1) << 8] = path[first << 8 : (first + 1) << 8] = 0
            least = sum(row) / 4096 + 1  # bytes that never occurred get a path as well, of bounded length
            heap = [(c + least, k, (k,)) for k, c in enumerate(row)]
            heapq.heapify(heap)
            base = first << 8
            while len(heap) > 1:
                (a, i, low), (b, j, high) = heapq.heappop(heap), heapq.heappop(heap)
                for bit, side in enumerate((low, high)):
                    at = base + np.array(side)
                    path[at] |= bit << length[at].astype(np.int64)
                    length[at] += 1
                heapq.heappush(heap, (a + b, min(i, j), low + high))
        return cls(length, path)


@functools.cache
def _plain() -> Code:
    return Code.plain()


def _line(base: np.ndarray, bits: int, size: int) -> np.ndarray:
    """Where a context's line begins, 16 slots of a table, each of ``size`` counts."""
    return (base >> np.uint32(36 - bits)).astype(np.int64) * (16 * size)


class Batch:
    """The decisions of some bytes: table slots of every predictor, weights they take, and their values."""

    def __init__(self, blob: np.ndarray, lens: np.ndarray, bits: int):
        s = Stream(blob, lens)
        self._fill(s, np.arange(len(blob)), s.place, bits, _plain(), False)

    @classmethod
    def of(cls, s: Stream, at: np.ndarray, row: np.ndarray, bits: int, code: Code | None = None, sort: bool = False) -> Batch:
        """``row``: which weights the byte takes, PLACES rows a set. ``sort``: by the weights that decisions take."""
        out = cls.__new__(cls)
        out._fill(s, at, row, bits, code or _plain(), sort)
        return out

    def _fill(self, s: Stream, at: np.ndarray, row: np.ndarray, bits: int, code: Code, sort: bool) -> None:
        self.at, self.n_bits, self.stream, self.code = at, bits, s, code
        self.own, self.step = code.steps(s.pair.take(at, mode="clip"))
        self.shape = (-1, 8) if code is _plain() and not sort else (-1,)
        self.cell = (row * np.int64(DEPTHS)).take(self.own, mode="clip")
        self.cell += code.depth.take(self.step, mode="clip")
        if sort:
            most = self.cell.max()  # narrow keys are sorted in a pass or two
            order = np.argsort(self.cell.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64), kind="stable")
            self.own, self.step, self.cell = (x.take(order, mode="clip") for x in (self.own, self.step, self.cell))
            self.first = np.flatnonzero(np.diff(self.cell, prepend=-1))
        self.bits = code.bit.take(self.step, mode="clip")

    @property
    def word(self) -> np.ndarray:
        return self.stream.token.take(self.at)

    def _placed(self, pairs: bool) -> Iterator[np.ndarray]:
        within = (self.code.count if pairs else self.code.slot).take(self.step, mode="clip")
        for base in self.stream.contexts(self.at):
            out = _line(base, self.n_bits, 1 + pairs).take(self.own, mode="clip")
            out ^= within
            yield out

    @property
    def slots(self) -> list[np.ndarray]:
        return [x.reshape(self.shape) for x in self._placed(False)]

    def pairs(self) -> Iterator[np.ndarray]:
        """Of each predictor the numbers of the decisions' own counts: twice the slot, and the value."""
        return (x.reshape(self.shape) for x in self._placed(True))

    def sum(self, x: np.ndarray) -> np.ndarray:
        """Per word, of what each decision has."""
        return np.bincount(self.word.take(self.own), x.ravel(), minlength=len(self.stream.tokens))


def _ranges(bits: int) -> int:
    return 1 << max(0, bits - RANGE_BITS)


def _training(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Stream]]:
    """The training texts of each chunk."""
    for rb in rows:
        for k in range(rb.num_rows):
            ids = rb.column("ids")[k].as_py()
            blob = np.frombuffer(rb.column("blob")[k].as_buffer() or b"", np.uint8)
            keep = np.array([not held_out(i) for i in ids], bool)
            yield rb.column("chunk")[k].as_py(), Stream(*coded(blob, np.frombuffer(rb.column("lens")[k].as_py(), np.int64), keep))


def count(s: Stream, out: np.ndarray, bits: int, code: Code | None = None) -> None:
    """Adds the decisions of a stream to the counts of each predictor's slots, those of zeros beside those of ones. What a
    context and a byte have in common is worked out once for all their occurrences."""
    code = code or _plain()
    for a in range(0, len(s.blob), COUNT_BATCH):
        at = np.arange(a, min(a + COUNT_BATCH, len(s.blob)))
        pair = s.pair.take(at).astype(_U)
        for x, base in zip(out, s.contexts(at), strict=True):
            key = base.astype(_U) << _U(16) | pair
            key.sort()
            first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            times, key = np.diff(np.append(first, len(key))).astype(np.int32), key[first]
            for k in range(0, len(key), 4 * BATCH):
                part = key[k : k + 4 * BATCH]
                own, step = code.steps((part & _U(0xFFFF)).astype(np.int64))
                line = _line((part >> _U(16)).astype(np.uint32), bits, 2).take(own)
                np.add.at(x, line ^ code.count.take(step), times[k : k + 4 * BATCH].take(own))


def _tables(rows: Iterator[pa.RecordBatch], bits: int, code) -> Iterator[pa.RecordBatch]:
    """Counts of both values in each slot over all decisions of the training texts; a row per range of slots of a predictor."""
    out = np.zeros((PREDICTORS, 2 << bits), np.int32)
    for _, s in _training(rows):
        count(s, out, bits, code.value)
    for part, x in enumerate(out.reshape(PREDICTORS * _ranges(bits), -1)):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["part", "counts"])


def _fitting(total: np.ndarray, most: int = (1 << 31) - 1) -> np.ndarray:
    """Pairs of counts, both scaled alike where one is above ``most``; what occurred keeps a count."""
    pair = total.reshape(-1, 2)
    over = pair.max(1) > most
    if over.any():
        pair[over] = np.ceil(pair[over] * (most / pair[over].max(1))[:, None]).astype(np.int64)
    return pair.ravel()


def _logit(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    add = np.float32(0.4)
    return np.log(np.maximum(ones, 0).astype(np.float32) + add) - np.log(np.maximum(zeros, 0).astype(np.float32) + add)


def _add(group: pa.Table) -> pa.Table:
    total = np.int64(0)
    for c in group.column("counts"):
        total = total + np.frombuffer(zlib.decompress(c.as_py()), np.int32)
    total = _fitting(total).astype(np.int32)
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


class Model:
    """The code of bytes, context tables, the trained mixing weights (predictors and a constant, places, depths) and the probability map."""

    def __init__(self, parts: dict[int, bytes], bits: int, code: Code | None = None):
        self.parts, self.bits, self.code = parts, bits, code
        self.weights = np.full((PREDICTORS + 1, PLACES, DEPTHS), 0.3, np.float32)
        self.weights[-1] = 0
        self.map = None
        self.ready: bool | None = None

    def open(self, scoring: bool = False) -> None:
        """Logits of the slots, once a process; for training those with a zero or a one left out."""
        if self.ready is scoring:
            return
        n, size = _ranges(self.bits), (1 << self.bits) // _ranges(self.bits)
        shape = (1 << self.bits,) if scoring else (1 << self.bits, 2)
        self.logits = [np.zeros(shape, np.float32) for _ in range(PREDICTORS)]
        for part, data in self.parts.items():
            zeros, ones = np.frombuffer(zlib.decompress(data), np.int32).reshape(-1, 2).T
            out = self.logits[part // n][part % n * size : (part % n + 1) * size]
            if scoring:
                out[:] = _logit(ones, zeros)
            else:
                out[:, 0], out[:, 1] = _logit(ones, zeros - 1), _logit(ones - 1, zeros)
        self.ready = scoring

    def inputs(self, b: Batch) -> list[np.ndarray]:
        """Logits of the predictors."""
        return [t.take(s, mode="clip").reshape(b.shape) for t, s in zip(self.logits, b._placed(False), strict=True)]

    def inputs_without(self, b: Batch) -> list[np.ndarray]:
        """Logits of the predictors, each decision's own occurrence left out of the counts."""
        return [t.take(s, mode="clip").reshape(b.shape) for t, s in zip(self.logits, b.pairs(), strict=True)]

    def matrix(self, b: Batch, pairs: bool) -> np.ndarray:
        """The same as rows, and a row of ones."""
        x = np.ones((PREDICTORS + 1, len(b.own)), np.float32)
        for row, t, at in zip(x, self.logits, b._placed(pairs), strict=False):
            t.take(at, mode="clip", out=row)
        return x

    def mixed(self, b: Batch, x: list[np.ndarray], weights: np.ndarray | None = None) -> np.ndarray:
        w = (self.weights if weights is None else weights).reshape(PREDICTORS + 1, -1)
        z = w[-1].take(b.cell, mode="clip").reshape(b.shape)
        for k, xk in enumerate(x):
            part = w[k].take(b.cell, mode="clip").reshape(b.shape)
            part *= xk
            z += part
        return z

    def log_bits(self, b: Batch, z: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each decision."""
        return np.log(self.chances(b, z))

    def chances(self, b: Batch, z: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
        """The probability of each decision (``p``: what z stands for)."""
        p = _chance(z) if p is None else p
        if self.map is not None:
            p = p + self.map.take(_cell(b, z.ravel()), mode="clip").reshape(b.shape)
            p *= np.float32(0.5)
        return np.abs(1 - b.bits.reshape(b.shape) - p)


def _chance(z: np.ndarray) -> np.ndarray:
    p = np.clip(z, -12, 12)
    np.negative(p, out=p)
    np.exp(p, out=p)
    p += 1
    return np.reciprocal(p, out=p)


def _cell(b: Batch, z: np.ndarray) -> np.ndarray:
    """Of the probability map."""
    out = np.clip(z, -8, 8)
    out *= 2
    out = np.rint(out, out=out).astype(np.int64)
    out += b.cell % (PLACES * DEPTHS) * 33 + 16
    return out


_CELLS = PLACES * DEPTHS * 33


def learned(own: Model, s: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Online pass over texts by second-order steps: weights, and how often each cell of the map was met and had a one."""
    k = PREDICTORS + 1
    w = own.weights.reshape(k, -1).T.astype(np.float64)  # place and depth, predictor
    curve = np.zeros((PLACES * DEPTHS, k, k)) + np.eye(k) * 50.0
    seen, ones = np.zeros(_CELLS), np.zeros(_CELLS)
    a = 0
    while a < len(s.blob):
        at = np.arange(a, min(a + min(TRAIN_BATCH, max(500, a // 4)), len(s.blob)))  # a step from few bytes that rests on many would overshoot
        a += len(at)
        b = Batch.of(s, at, s.place.take(at), own.bits, own.code, True)
        x = own.matrix(b, True)
        now = w.astype(np.float32)
        cuts = np.append(b.first, len(b.own)).tolist()
        parts = [(q, slice(i, j)) for q, i, j in zip(b.cell[b.first].tolist(), cuts[:-1], cuts[1:], strict=True)]
        z = np.concatenate([now[q] @ x[:, part] for q, part in parts])
        cell = _cell(b, z)
        seen += np.bincount(cell, minlength=_CELLS)
        ones += np.bincount(cell[b.bits > 0], minlength=_CELLS)
        p = _chance(z)
        left, bend = b.bits - p, p * (1 - p)
        slope = np.zeros_like(w)
        for q, part in parts:
            xs = x[:, part]
            curve[q] += (xs * bend[part]) @ xs.T
            slope[q] = xs @ left[part]
        w += np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
    return w.T.reshape(own.weights.shape), seen, ones


def _train(rows: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own: Model = model.value
    own.open()
    for chunk, s in _training(rows):
        weights, seen, ones = learned(own, s)
        state = [weights * len(s.blob), seen, ones, np.array([len(s.blob)])]
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([zlib.compress(np.concatenate([a.ravel() for a in state]).tobytes(), 1)], pa.binary())], names=["chunk", "state"])


def _sum(group: pa.Table) -> pa.Table:
    """The states of some chunks, in the order of the chunks, as one."""
    total = 0
    for s in group.sort_by("chunk").column("state"):
        total = total + np.frombuffer(zlib.decompress(s.as_py()))
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int64()), "state": pa.array([np.asarray(total).tobytes()], pa.binary())})


def _finish(model: Model, states: list[bytes]) -> Model:
    """The mean of the passes' weights, and the map."""
    size = model.weights.size
    total = np.zeros(size + 2 * _CELLS + 1)
    for s in states:
        total += np.frombuffer(s)
    if total[-1]:
        model.weights = (total[:size] / total[-1]).reshape(model.weights.shape).astype(np.float32)
    seen, ones = total[size : size + _CELLS], total[size + _CELLS : -1]
    middle = 1 / (1 + np.exp(-(np.arange(_CELLS) % 33 - 16) / 2.0))
    model.map = np.clip((ones + 20 * middle) / (seen + 20), 1e-5, 1 - 1e-5).astype(np.float32)
    return model


def _waves(s: Stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, their next BLOCK bytes' beginnings and sizes, some texts at a time; what precedes comes first."""
    texts, done = np.arange(len(s.lens)), 0
    while len(texts):
        sizes = np.minimum(s.lens[texts] - done, BLOCK)
        group = np.cumsum(sizes) // BATCH
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield texts[a:b], s.begins[texts[a:b]] + done, sizes[a:b]
        done += BLOCK
        texts = texts[s.lens[texts] > done]


def spelled(model: Model, s: Stream) -> np.ndarray:
    """log10 probability of each token by the bit model. A text begins with the trained weights; after each BLOCK bytes they
    take a step along what these bytes have taught."""
    logs = np.empty(len(s.blob))
    on = s.lens > BLOCK
    number = np.cumsum(on) - 1
    trained = model.weights.reshape(PREDICTORS + 1, 1, -1)
    w = np.repeat(trained, int(on.sum()), axis=1)  # those of texts with more than a block
    for texts, at, sizes in _waves(s):
        own = on[texts]
        sets = number[texts[own]]
        now = np.concatenate((trained, w.take(sets, axis=1)), axis=1).reshape(PREDICTORS + 1, -1)
        at = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        b = Batch.of(s, at, np.repeat(np.cumsum(own) * own * PLACES, sizes) + s.place.take(at, mode="clip"), model.bits, model.code, True)
        x = model.matrix(b, False)
        cells, times = b.cell[b.first], np.diff(np.append(b.first, len(b.own)))
        mixed = np.repeat(now.take(cells, axis=1), times, axis=1)
        mixed *= x
        z = mixed.sum(0)
        p = _chance(z)
        logs[at] = np.bincount(b.own, np.log(model.chances(b, z, p)), minlength=len(at))
        if len(sets):
            x *= (b.bits - p) * np.float32(RATE)
            now[:, cells] += np.add.reduceat(x, b.first, axis=1)
            w[:, sets] = now.reshape(PREDICTORS + 1, len(sets) + 1, -1)[:, 1:]
    return np.add.reduceat(logs, s.tokens) / np.log(10) if len(logs) else logs


def _answer(messages: pa.Table, vocabulary: pa.Table) -> pa.Table:
    row = {c: vocabulary.column(c)[0].as_py() for c in ("blob", "lens", "counts")}
    ends = np.cumsum(np.frombuffer(row["lens"], np.int32)).tolist()
    number = {row["blob"][a : b - 1]: k for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))}
    known = np.frombuffer(row["counts"], np.int64)
    bits = [known[np.fromiter(map(number.__getitem__, _parse(m)[1]), np.int64)].tobytes() for m in messages.column("message").to_pylist()]
    return pa.table({"bucket": messages.column("bucket"), "chunk": messages.column("chunk"), "bits": pa.array(bits, pa.binary())})


def _protocol(blob, lens, ids, n_buckets: int, ask: bool = True):
    c = Chunk(blob, lens, ids, n_buckets)
    got = yield c.messages() if ask else None
    return c, np.frombuffer(got, np.int64)


def _earned(plain: np.ndarray, own: np.ndarray, speaks: np.ndarray, text: np.ndarray, begins: np.ndarray, start: tuple[float, float] = CACHE) -> np.ndarray:
    """log10 probabilities ``plain`` mixed with a predictor's ``own`` where it ``speaks``, weighed by what it has earned there
    so far in the text."""
    w, worth = start
    static = 10**plain  # may be below the smallest number's log
    said = own > 0
    credit = np.zeros(len(plain))
    credit[said] = w * own[said] / (w * own[said] + (1 - w) * static[said])
    total = np.concatenate(([0.0], np.cumsum(credit)))
    spoken = np.concatenate(([0], np.cumsum(speaks)))
    at = begins[text]
    weight = np.where(speaks, (w * worth + total[:-1] - total[at]) / (worth + spoken[:-1] - spoken[at]), 0.0)
    out = plain + np.log10(1 - weight)
    out[said] = np.log10((1 - weight[said]) * static[said] + weight[said] * own[said])
    return out


def _before(key: np.ndarray, most: int) -> np.ndarray:
    """For each entry, how many entries before it have its key (0..most)."""
    n = len(key)
    bits = max(1, n.bit_length())
    if int(most).bit_length() + bits < 63:
        both = np.sort((key << bits) | np.arange(n))
        order, key = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    out = np.empty(n, np.int64)
    out[order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return out


def counted(c: Chunk, logs: np.ndarray, known: np.ndarray, n_tokens: int, begins: np.ndarray) -> np.ndarray:
    """log10 probability of each token, mixed with its relative frequency in the training texts."""
    text = np.repeat(np.arange(len(c.sizes)), c.sizes)
    return _earned(logs, known[c.flat] / max(1, n_tokens), np.full(len(c.flat), n_tokens > 0), text, begins, COUNTS)


def refined(c: Chunk, logs: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """``with_past`` of words that have the same probability wherever they stand."""
    return with_past(c, logs[c.flat], begins)


def with_past(c: Chunk, logs: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """log10 probability of each token, mixed with its share of the tokens before it in its text, then with its share of those
    that have followed its preceding token there."""
    n, k = len(c.flat), len(c.names)
    text = np.repeat(np.arange(len(c.sizes)), c.sizes)
    place = np.arange(n) - begins[text]
    word = text * k + c.flat
    before = _before(word, len(c.sizes) * k)
    out = _earned(logs, before / np.maximum(place, 1), place > 0, text, begins)
    led = np.concatenate(([0], before[:-1])) * (place > 0)
    pair = np.concatenate(([0], word[:-1])) * k + c.flat if len(c.sizes) * k < (1 << 62) // max(1, k) else _numbered(word) * k + c.flat
    follows = np.where(place > 0, _before(pair, len(c.sizes) * k * k), 0)
    return _earned(out, follows / np.maximum(led, 1), led > 0, text, begins)


def _numbered(word: np.ndarray) -> np.ndarray:
    """The words before each, numbered from 0: keys that stay small."""
    return np.concatenate(([0], np.unique(word, return_inverse=True)[1][:-1]))


def _scores(rows: Iterator[pa.RecordBatch], protocol, model, n_tokens: int, n_types: int) -> Iterator[pa.RecordBatch]:
    base = np.log10(n_tokens + n_types + 1)
    own: Model = model.value
    own.open(scoring=True)
    for _, ids, (c, known) in exchange.replay(rows, protocol, 1):
        begins = np.cumsum(c.sizes) - c.sizes
        add = lambda x: np.add.reduceat(x, begins)  # noqa: E731  (each text has a token at least)
        logs = counted(c, spelled(own, Stream(*coded(c.blob, c.lens))), known, n_tokens, begins)
        cols = [
            pa.array(ids, pa.int64()),
            pa.array(~c.train),
            pa.array(c.sizes),
            pa.array(add((known > 0).astype(np.int64)[c.flat])),
            pa.array(np.full(len(ids), n_tokens)),
            pa.array(add((np.log10(known + 1) - base)[c.flat])),
            pa.array(add(with_past(c, logs, begins))),
            pa.array(add(np.fromiter(map(len, c.names), np.int64, len(c.names))[c.flat] + 1)),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])


def score(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes (of the words with their closing blanks), bits_per_byte. Learned from the documents with crc32(doc_id as text) mod 7 other than 2.

    Null texts are empty: one token, their end. A null doc_id counts as training. Repeated rows train and are scored each;
    without training documents counts are zero and spelling costs one bit a bit; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    one = {"spark__sql__execution__arrow__maxRecordsPerBatch": 1}
    docs = common.id_text(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunk_bytes = min(CHUNK, max(SMALL_CHUNK, size // 16))
    dealt = docs.withColumn("h", F.xxhash64("doc_id", "text")).repartition(max(1, math.ceil(size / (4 * chunk_bytes))), "h").sortWithinPartitions("h")
    table = exchange.Table.write(dealt, chunk_bytes)
    n = max(1, math.ceil(table.n_bytes / BUCKET_TEXT), min(8, math.ceil(table.n_bytes / SMALL_TEXT)))
    protocol = lambda blob, lens, ids: _protocol(blob, lens, ids, n)
    answered = lambda blob, lens, ids: _protocol(blob, lens, ids, n, False)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, request in exchange.replay(rows, protocol, 0):
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in request], pa.int32()), pa.array([chunk] * len(request), pa.int64()), pa.array([m for _, m in request], pa.binary())], names=["bucket", "chunk", "message"]
            )

    with common.settings(spark, **one):
        messages = common.stored(spark, table.rows([]).mapInArrow(send, "bucket int, chunk long, message binary").repartition(n, "bucket"), "units")
        vocab = common.stored(spark, messages.groupBy("bucket").applyInArrow(_merge, _VOCAB), "vocabulary")
        common.free(spark)
        got = vocab.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types"))).first()
        tokens, n_types = got[0], got[1]
        bits = min(MAX_BITS, max(MIN_BITS, (2 * table.n_bytes).bit_length()))
        sets = min(SETS[1], max(SETS[0], math.ceil(table.n_bytes / COUNTED)))
        pairs = vocab.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy("x.pairs").agg(F.sum("x.times")).collect()  # 2**16 at most
        times = np.zeros(1 << 16, np.int64)
        for pair, n_times in pairs:
            times[pair] = n_times
        code = Code.short(times)
        shared = spark.sparkContext.broadcast(code)
        texts = table.rows([])
        parts = texts.coalesce(sets).mapInArrow(lambda it: _tables(it, bits, shared), "part int, counts binary").groupBy("part").applyInArrow(_add, "part int, counts binary")
        model = Model({r[0]: r[1] for r in parts.collect()}, bits, code)  # bounded: a table of 2**(MAX_BITS + 1) counts per predictor
        common.free(spark)
        first = spark.sparkContext.broadcast(model)
        states = common.stored(spark, texts.mapInArrow(lambda it: _train(it, first), "chunk long, state binary"), "states")
        # the chunks of 16 partitions first, then these sums: the same sums in the same order however the rows lie
        states = states.withColumn("part", F.shiftright("chunk", 36)).groupBy("part").applyInArrow(_sum, "part long, state binary")
        model = _finish(model, [r[1] for r in states.orderBy("part").collect()])
        first.unpersist()
        final = spark.sparkContext.broadcast(model)
        answers = messages.groupBy("bucket").cogroup(vocab.select("bucket", "blob", "lens", "counts").groupBy("bucket")).applyInArrow(_answer, "bucket int, chunk long, bits binary")
        answers = common.stored(spark, answers, "answers")
        common.free(spark)
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
        out = table.rows([answers]).mapInArrow(lambda it: _scores(it, answered, final, tokens, n_types), schema)
        out = common.stored(spark, out, "scores")
    return out.withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1)))
