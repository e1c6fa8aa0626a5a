"""Hierarchical Pitman-Yor language model over words.

Restaurants: one for each whole word before, below them one for each ending (last two bytes) of the word before, below these
one for each last byte, below these one for all words, above a uniform base over the known words and one unknown. A context
restaurant sends a customer to its parent for every table.

The dishes (words) are dealt into buckets by hash, and all restaurants' customers of a word are in its bucket. Totals of the
restaurants of endings are a bounded table that is sent out. Those of whole words grow with the corpus: a bucket sends what
its contexts have to slices of contexts, which add up and answer each bucket with the totals of its own contexts. A bucket's
contexts include those that only held-out documents have beside its words, so that it can score every token it is asked for.

Seating is sampled by blocked Gibbs. All customers of a word in a restaurant leave and are seated anew, given what its
parent gives the word without them: with c customers and weight a of a new table, the number of tables is t with a
probability in proportion to S(c, t) a^t, S being generalised Stirling numbers that sum over all seatings with t tables.
Predictive probabilities need no more of a seating than c and t, so a frequent word costs no more than a rare one. Up to
EXACT customers t is drawn from these weights; beyond, tables are a Poisson number of sizes of a tilted Sibuya law that add
up to c, and t is drawn by its saddle point (the mean is off by less than 0.3 %). Buckets are sampled side by side under the
totals of the round before and totals are summed between rounds. The samples' predictive probabilities, each with its own
totals, are averaged.

Words are known by 64-bit hashes, words before by 48 bits of these and their ending. Tokens travel as packed arrays (a row
for each block of documents and bucket), a part of the buckets after the other, so that a token costs a few bytes and not
all are on disk at a time. A bucket with many tokens is scored in several tasks, each with a copy of its model.
A block must hold the same documents in order when its task is repeated, as scans of files do; a table that comes out of a
shuffle is therefore written first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from .common import chunks, fold, from_planes, pack, pack_sorted, planes, reused, rows_of, span_hashes, stored, sweep, text_of, tidy, unpack, unpack_sorted, utf8, word_spans

#: Tokens of a bucket; the strength parameter of all restaurants; sweeps of a round before its samples, samples, rounds before.
BUCKET, THETA, BURN, SAMPLES, ROUNDS = 1_200_000, 1.0, 3, 2, 1
#: Buckets for a slice of contexts; turns in which buckets are scored.
WIDE, TURNS = 8, 3
#: Customers up to which tables are drawn from exact weights.
EXACT = 512
HOLD_MOD, HOLD, HOT_LIST = 7, 2, 1 << 20
END = np.uint64(0x5851F42D4C957F2D)


def held_out(ids: list) -> np.ndarray:
    """Whether crc32 of the id as text leaves HOLD; a null id is empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % HOLD_MOD == HOLD for i in ids], bool)


class Tokens(NamedTuple):
    hashes: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    sizes: np.ndarray


def tokens(raw: np.ndarray, at: np.ndarray) -> Tokens:
    """All tokens of the documents in order: words in lower case, then an end. Context: the word before, 48 bits of its hash and its last two bytes; 0 for a first token."""
    raw, docs = fold(raw), len(at) - 1
    starts, ends, doc = word_spans(raw, at)
    words = np.bincount(doc, minlength=docs)
    place = np.arange(len(starts)) + doc
    h = np.full(len(starts) + docs, END, np.uint64)
    x = np.zeros(len(h), np.uint64)
    if len(starts):
        h[place] = span_hashes(raw, starts, ends)
        before = np.where(ends - starts > 1, raw[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        x[place + 1] = (h[place] & ~np.uint64(0xFFFF)) | (before << np.uint64(8)) | raw[ends - 1]
    return Tokens(h, x, np.repeat(np.arange(docs), words + 1), words + 1)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the hash, so that sorted hashes are sorted by bucket."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def grouped(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of the weights."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], *(np.add.reduceat(w[order], first) if len(first) else w[:0] for w in weights)


def typed(h: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, how many contexts each has, the contexts and their counts."""
    words, inv = np.unique(h, return_inverse=True)
    contexts, at = np.unique(x, return_inverse=True)
    keys, counts = grouped((inv.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64), n)
    return words, np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(words)).astype(np.uint32), contexts[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)], counts


#: Rows that buckets and slices of contexts send one another: kind, where to, from where, and arrays as bytes.
MESSAGE = "kind int, to int, part int, a binary, b binary, c binary, d binary, e binary"
STATE, SEATS, ANSWER, CONTEXTS, SUMS = range(5)
_TYPES, _FIELDS = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5), ["kind", "to", "part", *"abcde"]


def messages(rows: list[tuple]) -> pa.RecordBatch:
    full = [(*r, *[b""] * (8 - len(r))) for r in rows]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*full), _TYPES)], _FIELDS)


def by_target(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each target, which are sorted by it."""
    now, held = None, []
    for b in batches:
        for kind, to, *rest in rows_of(b):
            if to != now:
                if held:
                    yield now, held
                now, held = to, []
            held.append((kind, *rest))
    if held:
        yield now, held


def sliced(rows: DataFrame) -> DataFrame:
    return rows.repartition("to").sortWithinPartitions("to", "kind", "part")


def runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each run of equal numbers."""
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(0, np.int64)
    for a, z in zip(edges.tolist(), edges[1:].tolist()):
        yield int(x[a]), a, z


def counted(docs: DataFrame, buckets: int) -> DataFrame:
    """Counts of (word, context) in the training documents, one row for each bucket: contexts, words, how many contexts each word has, these, n.

    The contexts are all that the bucket's words have in any document, as totals are asked for by them.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=1 << 22):
            t = tokens(*utf8(b.column(1)))
            words, many, x, n = typed(t.hashes, t.context, (~held_out(b.column(0).to_pylist()))[t.doc].astype(np.uint32))
            at = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
            yield messages([(STATE, k, 0, pack_sorted(words[a:z]), pack(many[a:z]), planes(x[at[a] : at[z]]), pack(n[at[a] : at[z]])) for k, a, z in runs(bucket_of(words, buckets))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def folded() -> tuple:
            return typed(*(np.concatenate(v) for v in zip(*held)))

        def row() -> pa.RecordBatch:
            words, many, x, n = folded()
            contexts, at = np.unique(x, return_inverse=True)
            many = np.bincount(np.repeat(np.arange(len(words)), many)[n > 0], minlength=len(words))
            return messages([(STATE, now, 0, pack_sorted(contexts), pack_sorted(words[many > 0]), pack(many[many > 0]), planes(at[n > 0].astype(np.uint32)), pack(n[n > 0]))])

        for b in batches:
            for _, own, _, words, many, x, n, _ in rows_of(b):
                if own != now:
                    if held:
                        yield row()
                        tidy()
                    now, held, size = own, [], 0
                held.append((np.repeat(unpack_sorted(words), unpack(many)), from_planes(x, np.uint64), unpack(n)))
                size += len(held[-1][0])
                if size > 1_500_000 and len(held) > 1:
                    words, many, x, n = folded()
                    held = [(np.repeat(words, many), x, n)]
                    size = len(x) // 2
        if held:
            yield row()

    rows = docs.select("doc_id", text_of().alias("text")).mapInArrow(block, MESSAGE)
    return rows.repartition("to").sortWithinPartitions("to").mapInArrow(merge, MESSAGE)


class Totals(NamedTuple):
    """Customers and tables of the restaurants: two[x], one[y], root; discounts by level (two, one, root, whole words); words known."""

    c2: np.ndarray
    t2: np.ndarray
    t1: np.ndarray
    t0: float
    d: tuple[float, ...]
    known: int

    @property
    def c1(self) -> np.ndarray:
        return self.t2.reshape(256, 256).sum(axis=0)

    @property
    def c0(self) -> float:
        return float(self.t1.sum())


class Dishes:
    """The words of a bucket with their customers in all restaurants."""

    def __init__(self, words: bytes, many: bytes, context: bytes, n: bytes) -> None:
        self.words = np.frombuffer(words, np.uint64)
        w = np.repeat(np.arange(len(self.words)), np.frombuffer(many, np.uint32))
        x, c = np.frombuffer(context, np.uint16).astype(np.int64), np.frombuffer(n, np.int64)
        self.key = (w << 16) | ((x & 0xFF) << 8) | (x >> 8)  # by word, last byte, byte before
        order = np.argsort(self.key, kind="stable")
        self.key, self.x, self.c2, self.w = self.key[order], x[order], c[order], w[order]
        one, self.of = np.unique(self.key >> 8, return_inverse=True)
        self.key1, self.w1, self.y = one, one >> 8, one & 0xFF
        self.count = np.bincount(self.w, self.c2, len(self.words)).astype(np.int64)

    @property
    def sizes(self) -> tuple[int, int, int]:
        """Pairs with a restaurant of each level."""
        return len(self.c2), len(self.key1), len(self.words)

    def p0(self, c0: np.ndarray, t0: np.ndarray, t: Totals) -> np.ndarray:
        return (c0 - t.d[2] * t0 + (THETA + t.d[2] * t.t0) / (t.known + 1)) / (THETA + t.c0)

    def p1(self, c1: np.ndarray, t1: np.ndarray, p0: np.ndarray, t: Totals) -> np.ndarray:
        return (c1 - t.d[1] * t1 + (THETA + t.d[1] * t.t1[self.y]) * p0[self.w1]) / (THETA + t.c1[self.y])


class Pairs:
    """The customers of a bucket's words in the restaurants of whole words before, and the dishes that their tables are customers of."""

    def __init__(self, contexts: bytes, words: bytes, many: bytes, at: bytes, n: bytes) -> None:
        self.contexts, words, many = unpack_sorted(contexts), unpack_sorted(words), unpack(many)
        self.at, self.c3 = from_planes(at, np.uint32).astype(np.int64), unpack(n)
        w, x = np.repeat(np.arange(len(words)), many), (self.contexts & np.uint64(0xFFFF)).astype(np.int64)[self.at]
        self.key = (w << 32) | self.at
        code, self.of = np.unique((w << 16) | ((x & 0xFF) << 8) | (x >> 8), return_inverse=True)  # as dishes are sorted
        ending = ((code & 0xFF) << 8) | ((code >> 8) & 0xFF)
        each = np.bincount(code >> 16, minlength=len(words)).astype(np.uint32)
        self.dishes = Dishes(words.tobytes(), each.tobytes(), ending.astype(np.uint16).tobytes(), self.customers(np.ones(len(self.at), np.int64), len(code)).tobytes())
        self.count = np.bincount(w, self.c3, len(words)).astype(np.int64)

    def customers(self, t3: np.ndarray, n: int | None = None) -> np.ndarray:
        """Customers of the dishes, from the tables of whole words."""
        return np.bincount(self.of, t3, len(self.dishes.c2) if n is None else n).astype(np.int64)

    def of_contexts(self, n: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, n, len(self.contexts)).astype(np.int64)


@lru_cache(8)
def stirling(d: float, most: int = EXACT) -> list[np.ndarray]:
    """Logarithms of the generalised Stirling numbers S(c, 1 .. c) for c up to `most`."""
    out = [np.zeros(0), np.zeros(1)]
    for c in range(1, most):
        k = np.arange(1, c + 1)
        stay, new = np.full(c + 1, -np.inf), np.full(c + 1, -np.inf)
        stay[:c] = out[c] + np.log(c - d * k)
        new[1:] = out[c]
        out.append(np.logaddexp(stay, new))
    return out


def tables(c: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """The numbers of tables of c customers each, where a new table has this weight."""
    out, log_w = np.ones(len(c), np.int64), np.log(np.maximum(weight, 1e-300))
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    some = some[np.argsort(c[some], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], np.diff(c[some]) != 0])) if len(some) else np.zeros(0, np.int64)
    for a, z in zip(first, [*first[1:], len(some)]):
        n = int(c[some[a]])
        numbers, k = stirling(round(d, 6))[n], np.arange(1, n + 1)
        for b in range(a, z, max(1, (1 << 18) // n)):
            own = some[b : min(b + max(1, (1 << 18) // n), z)]
            w = numbers + log_w[own, None] * k
            up = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[own] = 1 + (up < rng.random(len(own))[:, None] * up[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        n, w = c[many].astype(float), np.exp(log_w[many])
        low, high = np.full(len(many), -690.0), np.zeros(len(many))  # of the logarithm of 1 - x, x being the tilt that makes sizes add up to c
        for _ in range(60):
            u = (low + high) / 2
            over = np.log(w) + np.log1p(-np.exp(np.minimum(u, -1e-12))) + (d - 1) * u > np.log(n)
            low, high = np.where(over, u, low), np.where(over, high, u)
        u = np.exp((low + high) / 2)
        mean = w / d * (1 - u**d)
        spread = w * (1 - u) * u ** (d - 2) * (1 - d * (1 - u))
        var = np.maximum(mean - n * (n / np.maximum(spread, 1e-300)), 0.0)
        # Where the tilt is weak, one table holds nearly all customers and the others are free.
        drawn = np.where(n * u < 10, 1 + rng.poisson(np.minimum(mean, 1e15)), np.rint(rng.normal(mean + 0.5, np.sqrt(var))))
        out[many] = np.clip(drawn, 1, n)
    return out


def without(c: np.ndarray, t: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables once `own` customers have left; tables empty in proportion."""
    left = c - own
    return left, np.where(left > 0, np.clip(np.rint(t * (left / np.maximum(c, 1))), 1, np.maximum(left, 1)), 0).astype(np.int64)


def sampled(dishes: Dishes, totals: Totals, seed: int, samples: int = SAMPLES, below: Pairs | None = None, tables3: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
    """Tables of the three levels in each sample. With the pairs below, whose contexts have `tables3` tables in all, those of their level first."""
    rng = np.random.default_rng(seed)
    k, d, total2, total1, total0 = dishes, totals.d, totals.c2, totals.c1, totals.c0
    c2 = k.c2
    t2 = np.ones(len(k.c2), np.int64)
    c1 = np.bincount(k.of, t2, len(k.key1)).astype(np.int64)
    t1 = np.ones(len(c1), np.int64)
    c0 = np.bincount(k.w1, t1, len(k.words)).astype(np.int64)
    t0 = np.ones(len(c0), np.int64)
    t3 = np.ones(len(below.at) if below else 0, np.int64)
    out = []

    def root(c: np.ndarray, t: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Probability of words of which c customers at t tables are left."""
        return (c - d[2] * t + (THETA + d[2] * totals.t0) / (totals.known + 1)) / (THETA + np.maximum(total0 - gone, c))

    def one(of: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Probability by last bytes, once `own` customers have left."""
        left, tables1 = without(c1[of], t1[of], own)
        gone, w, y = t1[of] - tables1, k.w1[of], k.y[of]
        p0 = root(*without(c0[w], t0[w], gone), gone)
        return (left - d[1] * tables1 + (THETA + d[1] * np.maximum(totals.t1[y] - gone, 0)) * p0) / (THETA + np.maximum(total1[y] - own, left))

    for sweep in range(BURN + samples):
        # Each pair of the lowest level without its own tables further up.
        if below:
            left, tables2 = without(c2[below.of], t2[below.of], t3)
            gone, x = t2[below.of] - tables2, k.x[below.of]
            p2 = (left - d[0] * tables2 + (THETA + d[0] * np.maximum(totals.t2[x] - gone, 0)) * one(k.of[below.of], gone)) / (THETA + np.maximum(total2[x] - t3, left))
            t3 = tables(below.c3, (THETA + d[3] * np.maximum(tables3[below.at] - t3, 0)) * p2, d[3], rng)
            c2 = below.customers(t3)
        t2 = tables(c2, (THETA + d[0] * np.maximum(totals.t2[k.x] - t2, 0)) * one(k.of, t2), d[0], rng)
        c1 = np.bincount(k.of, t2, len(k.key1)).astype(np.int64)
        p0 = root(*without(c0[k.w1], t0[k.w1], t1), t1)
        t1 = tables(c1, (THETA + d[1] * np.maximum(totals.t1[k.y] - t1, 0)) * p0, d[1], rng)
        c0 = np.bincount(k.w1, t1, len(k.words)).astype(np.int64)
        t0 = tables(c0, np.full(len(c0), (THETA + d[2] * totals.t0) / (totals.known + 1)), d[2], rng)
        if sweep >= BURN:
            out.append((t3, t2, t1, t0) if below else (t2, t1, t0))
    return out


def discount(n: np.ndarray) -> float:
    return float(min(max(n[1] / max(n[1] + 2 * n[2], 1), 0.1), 0.95))


#: Kinds of sums: customers and tables by ending, tables by last byte and of the root; counts of counts by level; training tokens.
_SIZES = (1 << 16, 1 << 16, 256, 1, 4, 4, 4, 4, 1)


def passed(rows: DataFrame, totals: Totals | None, round_: int, samples: int, slices: int) -> DataFrame:
    """A pass over all buckets: sums, what their contexts have (to the slices of contexts) and, after a round, their seats. Without totals: a table for every pair."""
    given = rows.sparkSession.sparkContext.broadcast(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in by_target(batches):
            k = Pairs(*held[0][2:])
            d = k.dishes
            if given.value is None:
                got = [tuple(np.ones(n, np.int64) for n in (len(k.at), len(d.c2), len(d.key1), len(d.words)))]
            else:
                tables3 = answered(held, len(k.contexts), 1)[1][0]
                got = sampled(d, given.value, 1000 * round_ + bucket, samples, k, tables3)
            sums = [v for t3, t2, t1, t0 in got for v in (np.bincount(d.x, k.customers(t3), 1 << 16), np.bincount(d.x, t2, 1 << 16), np.bincount(d.y, t1, 256), np.array([t0.sum()]))]
            if given.value is None:
                sums += [np.bincount(np.minimum(c, 3), minlength=4) for c in (d.c2, np.bincount(d.of), np.bincount(d.w1), k.c3)] + [np.array([k.c3.sum()])]
            at = [np.flatnonzero(v) for v in sums]
            out = [(SUMS, bucket, i, a.astype(np.int32).tobytes(), v[a].astype(np.float64).tobytes()) for i, (a, v) in enumerate(zip(at, sums))]
            n, t = k.of_contexts(k.c3), np.stack([k.of_contexts(s[0]) for s in got])
            out += [(CONTEXTS, to, bucket, pack_sorted(k.contexts[a:z]), pack(n[a:z]), pack(t[:, a:z].ravel())) for to, a, z in runs(bucket_of(k.contexts, slices))]
            if given.value is not None:
                out.append((SEATS, bucket, 0, *(pack(np.concatenate([s[level] for s in got])) for level in range(4))))
            yield messages(out)
            del k, d, got, sums
            tidy()

    return (rows if totals is None else sliced(rows)).mapInArrow(run, MESSAGE)


def answered(held: list[tuple], n: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Customers of a bucket's contexts, and their tables in each sample: the slices' answers in order, as contexts are sorted by slice."""
    own = [r for r in held if r[0] == ANSWER]
    if not own:
        return np.zeros(n, np.int64), np.zeros((samples, n), np.int64)
    return np.concatenate([unpack(r[2]) for r in own]), np.concatenate([unpack(r[3]).reshape(samples, -1) for r in own], axis=1)


def answers(out: DataFrame, samples: int) -> DataFrame:
    """The customers and tables of contexts over all buckets, to each bucket that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, held in by_target(batches):
            each = [unpack_sorted(r[2]) for r in held]
            edges = np.cumsum([0, *map(len, each)])
            contexts, of = np.unique(np.concatenate(each), return_inverse=True)
            n = np.bincount(of, np.concatenate([unpack(r[3]) for r in held]), len(contexts)).astype(np.int64)
            t = [np.bincount(of, np.concatenate([unpack(r[4]).reshape(samples, -1)[i] for r in held]), len(contexts)).astype(np.int64) for i in range(samples)]
            yield messages([(ANSWER, r[1], k, pack(n[of[a:z]]), pack(np.concatenate([v[of[a:z]] for v in t]))) for r, a, z in zip(held, edges, edges[1:])])
            tidy()

    return sliced(out.where(F.col("kind") == CONTEXTS)).mapInArrow(run, MESSAGE)


def summed(out: DataFrame) -> list[np.ndarray]:
    """The sums over all buckets, of each sample in turn: a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, i, at, v, *_ in rows_of(b):
                at = np.frombuffer(at, np.int32)
                yield pa.record_batch([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(np.frombuffer(v))], ["i", "at", "v"])

    found = out.where(F.col("kind") == SUMS).mapInArrow(run, "i int, at int, v double").groupBy("i", "at").agg(F.sum("v").alias("v")).collect()  # at most 2 * 65,536 rows for each sample
    sums: dict[int, np.ndarray] = {}
    for i, at, x in found:
        sums.setdefault(i, np.zeros(1 << 16))[at] = x
    return [sums.get(i, np.zeros(1 << 16)) for i in range(max(sums, default=0) + 1)]


def state_totals(sums: list[np.ndarray]) -> tuple[Totals, int]:
    """Totals with a table for every pair, discounts from the counts of counts, and the number of training tokens."""
    v = [(sums[i] if i < len(sums) else np.zeros(1 << 16))[:n] for i, n in enumerate(_SIZES)]
    return Totals(v[0], v[1], v[2], float(v[3][0]), tuple(discount(n) for n in v[4:8]), int(v[3][0])), int(v[8][0])


class Predictive:
    """Probabilities of a bucket's words in any context, averaged over the samples; with their customers of each sample, if these differ."""

    def __init__(self, k: Dishes, tables: list[tuple[np.ndarray, ...]], totals: list[Totals], customers: list[np.ndarray] | None = None) -> None:
        self.k, self.samples = k, []
        for (t2, t1, t0), t, c2 in zip(tables, totals, customers or [k.c2] * len(totals)):
            c1, c0 = np.bincount(k.of, t2, len(k.key1)), np.bincount(k.w1, t1, len(k.words))
            unknown = (THETA + t.d[2] * t.t0) / (t.known + 1) / (THETA + t.c0)
            p0 = np.append(k.p0(c0, t0, t), unknown)  # the last is that of the word -1
            back1, back2 = (THETA + t.d[1] * t.t1) / (THETA + t.c1), (THETA + t.d[0] * t.t2) / (THETA + t.c2)
            own1 = np.append((c1 - t.d[1] * t1) / (THETA + t.c1[k.y]), 0.0)
            own2 = np.append((c2 - t.d[0] * t2) / (THETA + t.c2[k.x]), 0.0)
            self.samples.append((p0, back1, own1, back2, own2))

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Place of each wanted key, -1 without."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(known & (keys[at] == wanted), at, -1)

    def each(self, word: np.ndarray, x: np.ndarray) -> Iterator[np.ndarray]:
        """By each sample, of tokens (number of the word in the bucket or -1, context)."""
        x, known = x.astype(np.int64), word >= 0
        y, w = x & 0xFF, np.maximum(word, 0)
        at1 = self.find(self.k.key1, (w << 8) | y, known)
        at2 = self.find(self.k.key, (w << 16) | (y << 8) | (x >> 8), known)
        return (own2[at2] + back2[x] * (own1[at1] + back1[y] * p0[word]) for p0, back1, own1, back2, own2 in self.samples)

    def __call__(self, word: np.ndarray, x: np.ndarray) -> np.ndarray:
        return sum(self.each(word, x)) / len(self.samples)


class Whole:
    """Probabilities of a bucket's words behind whole words, averaged over the samples."""

    def __init__(self, k: Pairs, tables: list[tuple[np.ndarray, ...]], totals: list[Totals], customers: np.ndarray, tables3: np.ndarray) -> None:
        """customers, tables3: of the bucket's contexts in all, the latter in each sample."""
        self.k, self.above = k, Predictive(k.dishes, [s[1:] for s in tables], totals, [k.customers(s[0]) for s in tables])
        self.samples = []
        for (t3, *_), t, all3 in zip(tables, totals, tables3):
            back = np.append((THETA + t.d[3] * all3) / (THETA + customers), 1.0)  # the last is that of a context that no training document has
            self.samples.append((back, np.append((k.c3 - t.d[3] * t3) / (THETA + customers[k.at]), 0.0)))

    def __call__(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of tokens (number of the word in the bucket or -1, context)."""
        at = Predictive.find(self.k.contexts, context, np.ones(len(context), bool))
        pair = Predictive.find(self.k.key, (np.maximum(word, 0) << 32) | np.maximum(at, 0), (word >= 0) & (at >= 0))
        above = self.above.each(word, context & np.uint64(0xFFFF))
        return sum(own[pair] + back[at] * p for (back, own), p in zip(self.samples, above)) / len(self.samples)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null text: empty, its only token is the end. Null id: trains, as empty text. Repeated rows train and are scored as
    often as they stand. An empty table gives an empty frame. Without training documents every word is unknown. Other
    columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_of().alias("text"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = stored(docs, "scored")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(6, math.ceil(chars / 6 / BUCKET))
    slices, folders = -(-buckets // WIDE), []

    def swept(df: DataFrame, name: str) -> DataFrame:
        df = stored(df, name, paths=folders)
        sweep(spark)
        return df

    def dropped(i: int) -> None:
        shared.drop(spark, folders[i])  # not read again

    state = swept(counted(docs, buckets), "counts")
    out = swept(passed(state, None, 0, 1, slices), "start")
    totals, n_train = state_totals(summed(out))
    known = swept(answers(out, 1), "answers")
    dropped(-2)
    for i in range(ROUNDS + 1):
        many = SAMPLES if i == ROUNDS else 1
        out = swept(passed(state.unionByName(known), totals, i, many, slices), "seating")
        dropped(-2)
        sums = summed(out)
        sums += [np.zeros(1 << 16)] * (4 * many - len(sums))
        samples = [Totals(a, b, c[:256], float(t[0]), totals.d, totals.known) for a, b, c, t in zip(*[iter(sums)] * 4)]
        totals, known = samples[0], swept(answers(out, many), "answers")
        if i < ROUNDS:
            dropped(-2)
    seats = out.where(F.col("kind") == SEATS)
    shared_samples = spark.sparkContext.broadcast(samples)

    # Buckets of many tokens are scored in several tasks. They are few; their list is sent out if it is of checked size.
    weigh = lambda it: (pa.record_batch([b.column(0), pa.array([round(int(unpack(n).sum()) / BUCKET) for _, n in rows_of(b)], pa.int32())], ["bucket", "parts"]) for b in it)
    hot = reused(state.select("to", "e").mapInArrow(weigh, "bucket int, parts int").where("parts > 1"))
    n_hot, n_parts = hot.agg(F.count("*"), F.coalesce(F.sum("parts"), F.lit(0))).first()
    hot = F.broadcast(hot) if n_hot <= HOT_LIST else hot
    tasks = 3 * (buckets + n_parts)

    def block(now: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, seq = TaskContext.get().partitionId(), 0
            for b in chunks(batches, limit=1 << 22):
                ids = b.column(0).to_pylist()
                t = tokens(*utf8(b.column(1)))
                name = (part << 32) | seq
                seq += 1
                own = bucket_of(t.hashes, buckets)
                mine = np.flatnonzero(own % TURNS == now)
                order = mine[np.argsort(t.hashes[mine], kind="stable")]
                h, x, doc, own = t.hashes[order], t.context[order], t.doc[order].astype(np.uint32), own[order]
                starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                many = np.diff(np.concatenate([starts, [len(h)]]))
                rows = []
                if now == 0:
                    rows.append((-1, name, np.array([-(1 << 63) if i is None else i for i in ids], np.int64).tobytes(), held_out(ids).tobytes(), t.sizes.astype(np.int64).tobytes(), np.array([i is None for i in ids], bool).tobytes()))
                for k, a, z in runs(own):
                    p, q = np.searchsorted(starts, (a, z))
                    rows.append((k, name, pack_sorted(h[starts[p:q]]), pack(many[p:q]), planes(x[a:z]), planes(doc[a:z].astype(np.uint16 if len(ids) < 65536 else np.uint32))))
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], ["bucket", "block", "a", "b", "c", "d"])

        return run

    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("part")
    model = state.unionByName(seats).unionByName(known).withColumnRenamed("part", "slice").withColumnRenamed("to", "bucket").join(hot, "bucket", "left")
    model = model.select("bucket", copies, "kind", F.col("slice").cast("long").alias("block"), *"abcde")

    def rows_of_turn(i: int) -> DataFrame:
        packed = docs.mapInArrow(block(i), "bucket int, block long, a binary, b binary, c binary, d binary").join(hot, "bucket", "left")
        part = F.when(F.col("bucket") < 0, F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.coalesce("parts", F.lit(1)))).alias("part")
        asked = packed.select("bucket", part, F.lit(SUMS).alias("kind"), "block", *"abcd", F.lit(b"").alias("e"))
        both = model.where(F.col("bucket") % TURNS == i).unionByName(asked)
        return both.repartition(-(-tasks // TURNS), "bucket", "part").sortWithinPartitions("bucket", "part", "kind", "block")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, p_of = None, [], None
        floor = math.log10(n_train + totals.known + 1)
        for b in batches:
            rows = []
            for bucket, part, kind, name, *data in rows_of(b):
                if bucket < 0:
                    rows.append((name, 0, *map(bytes, data[:4])))
                    continue
                if now != (bucket, part):
                    now, held, p_of = (bucket, part), [], None
                    tidy()
                if kind != SUMS:
                    held.append((kind, name, *data))
                    continue
                if p_of is None:
                    k = Pairs(*held[0][2:])
                    levels = [unpack(x).reshape(SAMPLES, -1) for x in held[1][2:6]]
                    p_of = Whole(k, [tuple(x[s] for x in levels) for s in range(SAMPLES)], shared_samples.value, *answered(held, len(k.contexts), SAMPLES))
                    held = []
                words, many, x = unpack_sorted(data[0]), unpack(data[1]), from_planes(data[2], np.uint64)
                doc = from_planes(data[3], np.uint16 if data[3].size == 2 * len(x) else np.uint32).astype(np.int64)
                at = Predictive.find(k.dishes.words, words, np.ones(len(words), bool))
                c = np.where(at >= 0, np.append(k.count, 0)[at], 0)
                w = np.repeat(at, many)
                p = np.log10(p_of(w, x))
                base = np.repeat(np.log10(c + 1.0) - floor, many)
                docs_in, inv = np.unique(doc, return_inverse=True)
                rows.append((name, 1, docs_in.astype(np.uint32).tobytes(), np.bincount(inv, base).tobytes(), np.bincount(inv, p).tobytes(), np.bincount(inv, w >= 0).astype(np.uint32).tobytes()))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.binary()] * 4))], ["block", "kind", "a", "b", "c", "d"])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []

        def out() -> pa.RecordBatch:
            ids, held, sizes, gone, base, p, known = now[1:]
            ids = pa.array(ids, mask=gone)
            return pa.record_batch([ids, pa.array(held), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n_train)), pa.array(base), pa.array(p)], names)

        for b in batches:
            for name, kind, *data in rows_of(b):
                if kind == 0:
                    if now:
                        yield out()
                    sizes = np.frombuffer(data[2], np.int64)
                    now = [name, np.frombuffer(data[0], np.int64), np.frombuffer(data[1], bool), sizes, np.frombuffer(data[3], bool), np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)]
                else:
                    at = np.frombuffer(data[0], np.uint32)
                    now[5][at] += np.frombuffer(data[1])
                    now[6][at] += np.frombuffer(data[2])
                    now[7][at] += np.frombuffer(data[3], np.uint32)
        if now:
            yield out()

    sums = reduce(DataFrame.unionByName, [swept(rows_of_turn(i).mapInArrow(scored, "block long, kind int, a binary, b binary, c binary, d binary"), "scores") for i in range(min(TURNS, buckets))])
    return sums.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(whole, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
