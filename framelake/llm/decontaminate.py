"""Benchmark decontamination: BM25 over an inverted index of the test items, block-max WAND, then a check of overlaps.

Texts are words (runs of letters and digits) without case: one folding serves items and documents. Items of similar length
form a class, up to 64 words, then up to 256 and so on. For each class a training document is cut into passages of twice the
words of the class's longest item, half overlapping, so that any copy of an item lies within one and a very long item doesn't
widen the passages of the others. Every passage is a query. Scores are BM25 sums divided by the item's own sum, so one
threshold holds for all items; what lies above it is all retrieved. Document frequencies and the mean length are those of all
items. A passage whose terms could not reach the threshold for any item, each at its best, is settled by that bound at once. A
retrieved item counts if the five-word shingles of its question and of its answer each stand in the passage to 0.8 or more.

Items go to the executors in blocks of bounded size; further blocks take further passes over the documents. Only a block is
ever on the driver.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mixed, row_and_text, row_struct, span_hashes, utf8

K1, B = 1.2, 0.75
THRESHOLD, SHINGLE, OVERLAP = 0.6, 5, 0.8
BLOCK = 32  # items of a block with maxima of its own
ITEM_BYTES = 32 << 20
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
#: Letters that lower case leaves apart though upper case does not tell them apart.
FOLDS = (("\u03c2", "\u03c3"), ("\u0131", "i"), ("i\u0307", "i"), ("\u00df", "ss"))
SPLIT = re.compile(r"(?is)^(.*?\banswer\s*:)(.*)$|^(.*\?)(.*\w.*)$")


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each document's begin and end among them."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = _WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = at[1:-1][at[1:-1] < len(raw)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts = np.flatnonzero(first)
    return span_hashes(raw, starts, np.flatnonzero(last) + 1), np.searchsorted(starts, at)


def folded(texts: pa.Array) -> pa.Array:
    """Texts without case."""
    texts = pc.utf8_lower(texts)
    for a, b in FOLDS:
        texts = pc.replace_substring(texts, a, b)
    return texts


def hashed(text: str) -> np.ndarray:
    return word_hashes(*utf8(folded(pa.array([text], pa.string()))))[0]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    if not len(h) or len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1]
    for i in range(1, k):
        out = mixed(out) + h[i : len(h) - k + 1 + i]
    return mixed(out)


def halves(text: str) -> tuple[str, str]:
    """Question and answer: around `Answer:`, else behind the last question mark, else the halves of the words."""
    if m := SPLIT.match(text):
        parts = (m[1], m[2]) if m[1] is not None else (m[3], m[4])
        if all(re.search(r"\w", p) for p in parts):
            return parts
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


class Item(NamedTuple):
    item_id: int | None
    parts: tuple[tuple[int, np.ndarray], ...]  # shingle length and distinct shingles, of the question and of the answer


def ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges behind one another, and which range each is of."""
    of = np.repeat(np.arange(len(starts)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of], of


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inv = np.unique(keys, return_inverse=True)
    return found, np.bincount(inv, values, len(found))


def length_class(words: int) -> int:
    """0 up to 64 words, 1 up to 256, and so on."""
    return max(0, -(-((words - 1).bit_length() - 6) // 2)) if words > 1 else 0


class Index:
    """Postings of a block of items by term, and by term and item block the largest weight; weights are shares of the item's own score."""

    def __init__(self, rows: list[tuple[int | None, str, dict[int, int]]], n_items: int, mean: float) -> None:
        """rows: item_id, text, and how many of all items have each of its terms."""
        self.items: list[Item] = []
        self.longest = 0
        found: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, (item_id, text, df) in enumerate(rows):
            parts = [hashed(p) for p in halves(text)]
            self.items.append(Item(item_id, tuple((k, np.unique(shingles(p, k))) for p in parts if len(p) for k in [min(SHINGLE, len(p))])))
            terms, counts = np.unique(hashed(text), return_counts=True)
            n = int(counts.sum())
            self.longest = max(self.longest, n)
            own = {t: math.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for t, f in zip(terms.tolist(), counts.tolist())}
            whole = sum(own.values())
            for t, w in own.items():
                found[t].append((i, w / whole))
        self.terms = np.array(sorted(found), np.uint64)
        lists = [found[t] for t in self.terms.tolist()]
        self.item_n = np.array([len(x) for x in lists], np.int64)
        self.item_at = np.cumsum(self.item_n) - self.item_n
        self.item = np.array([i for x in lists for i, _ in x], np.int64)
        self.weight = np.array([w for x in lists for _, w in x])
        self.best = np.maximum.reduceat(self.weight, self.item_at) if len(lists) else np.zeros(0)
        self.blocks = len(self.items) // BLOCK + 1
        owner = np.repeat(np.arange(len(lists)), self.item_n)
        key = owner * self.blocks + self.item // BLOCK  # postings are in order of item, so keys are sorted
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.block = key[first] % self.blocks
        self.block_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.block_n = np.bincount(owner[first], minlength=len(lists))
        self.block_at = np.cumsum(self.block_n) - self.block_n
        self.part_at, self.part_n = first, np.diff(np.concatenate([first, [len(key)]]))  # the postings of a term in a block
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 without."""
        out = np.full(len(h), -1, np.int64)
        if len(self.terms):
            maybe = np.flatnonzero(self.gate[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
            hit = self.terms[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def wand(self, query: np.ndarray, term: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) of all items that reach the threshold, for many queries at once.

        query and term: the distinct terms of each query, sorted by query. A query's terms in order of their best weight
        split at the pivot: those before it cannot reach the threshold together, so an item needs one behind it. Blocks
        that these open are bounded by the sum of all terms' block maxima; the postings of others are skipped.
        """
        slack = threshold - 1e-9
        best = self.best[term]
        order = np.lexsort((best, query))
        query, term, best = query[order], term[order], best[order]
        up = np.cumsum(best)
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([first, [len(query)]]))
        up -= np.repeat((up - best)[first], n)
        able = np.repeat(up[first + n - 1] >= slack, n)
        behind = able & (up >= slack)

        at, of = ranges(self.block_at[term[behind]], self.block_n[term[behind]])
        opened = np.unique(query[behind][of] * self.blocks + self.block[at])
        live = np.isin(query, np.unique(opened // self.blocks))
        at, of = ranges(self.block_at[term[live]], self.block_n[term[live]])
        q = query[live][of]
        key = q * self.blocks + self.block[at]
        among, bound = summed(key, self.block_max[at])
        opened = np.intersect1d(opened, among[bound >= slack], assume_unique=True)
        own = np.isin(key, opened)
        at, q = at[own], q[own]
        at, of = ranges(self.part_at[at], self.part_n[at])
        q, i = q[of], self.item[at]
        size = max(len(self.items), 1)
        key, score = summed(q * size + i, self.weight[at])
        hit = score >= slack
        return key[hit] // size, key[hit] % size, score[hit]

    def search(self, h: np.ndarray, at: np.ndarray) -> list[dict[int, tuple[float, float, float]]]:
        """Verified items of each document's words: score, overlap of the question, overlap of the answer; the best passage of each."""
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in at[1:]]
        if not len(h) or not self.items:
            return out
        term = self.look_up(h)
        bound = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, self.best[term], 0.0))])
        size = np.diff(at)
        many = np.where(size > 0, np.maximum(-(-size // self.longest) - 1, 1), 0)  # the last two halves share a passage
        step, doc = ranges(np.zeros(len(many), np.int64), many)
        a = at[doc] + step * self.longest
        z = np.minimum(a + 2 * self.longest, at[doc + 1])
        able = bound[z] - bound[a] >= THRESHOLD - 1e-9
        a, z, doc = a[able], z[able], doc[able]
        word, q = ranges(a, z - a)
        t = term[word]
        pairs = np.unique(q[t >= 0] * len(self.terms) + t[t >= 0])
        for q, i, score in zip(*(x.tolist() for x in self.wand(pairs // len(self.terms), pairs % len(self.terms)))):
            overlaps = [float(np.isin(own, shingles(h[a[q] : z[q]], k)).mean()) for k, own in self.items[i].parts]
            if min(overlaps) >= OVERLAP:
                d = out[doc[q]]
                d[i] = max(d.get(i, (0.0,)), (score, overlaps[0], overlaps[-1]))
        return out


def weighed(items: DataFrame) -> tuple[DataFrame, int, float]:
    """(item_id, text, class, terms, df) of all items with words, how many they are, and their mean number of words."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            h, at = word_hashes(*utf8(folded(b.column(1))))
            each = [h[a:z] for a, z in zip(at, at[1:])]
            yield pa.record_batch([*b.columns, pa.array([len(x) for x in each], pa.int64()), pa.array([np.unique(x).view(np.int64) for x in each], pa.list_(pa.int64()))], ["item_id", "text", "n", "terms"])

    bag = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    bag = cut(bag.mapInArrow(bags, f"item_id {dict(items.dtypes)['item_id']}, text string, n long, terms array<long>").where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    each = bag.select("row", F.explode("terms").alias("term"))
    own = each.join(each.groupBy("term").agg(F.count("*").alias("df")), "term").groupBy("row").agg(F.collect_list(F.struct("term", "df")).alias("pairs"))
    n, mean = bag.agg(F.count("*"), F.avg("n")).first()
    return bag.drop("terms").join(own, "row").drop("row"), n, mean or 1.0


def indexes(items: DataFrame) -> Iterator[list[Index]]:
    """Indexes of all items, one for each class of length, in blocks of at most ITEM_BYTES of text (or one item)."""
    rows, n_items, mean = weighed(items)
    built: list[Index] = []
    block: list[tuple] = []
    size, now = 0, None
    for row in rows.orderBy("n", "item_id", "text").toLocalIterator():
        kind, more = length_class(row["n"]), len(row["text"])
        if block and (kind != now or size + more > ITEM_BYTES):
            built.append(Index(block, n_items, mean))
            block = []
        if built and size + more > ITEM_BYTES:
            yield built
            built, size = [], 0
        now, size = kind, size + more
        block.append((row["item_id"], row["text"], {p["term"] % (1 << 64): p["df"] for p in row["pairs"]}))
    if block:
        built.append(Index(block, n_items, mean))
    if built:
        yield built


def lower(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    return utf8(folded(batch.column(i)))


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question, answer): a row for every document and every item that it holds.

    Null text: empty, holds nothing. Items without words are in no document. Equal items are each found. Repeated
    documents have rows of their own. Empty tables give an empty frame. Other columns are not read.
    """
    schema = "doc_id long, item_id long, score double, question double, answer double"
    out = docs.sparkSession.createDataFrame([], schema)
    for built in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(built)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, limit=1 << 20):
                h, at = word_hashes(*lower(b, 1))
                ids, rows = b.column(0).to_pylist(), []
                for index in shared.value:
                    rows += [(doc, index.items[i].item_id, *v) for doc, found in zip(ids, index.search(h, at)) for i, v in sorted(found.items())]
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), *[pa.float64()] * 3))], ["doc_id", "item_id", "score", "question", "answer"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    columns = docs.columns
    for built in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(built)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in chunks(row_and_text(batches, columns), limit=1 << 20):
                h, at = word_hashes(*lower(b, 1))
                dirty = np.zeros(b.num_rows, bool)
                for index in shared.value:
                    dirty |= np.array([bool(found) for found in index.search(h, at)], bool)
                yield pa.record_batch([b.column(0).filter(pa.array(~dirty))], ["row"])

        inner = row_struct(docs, columns)
        out = inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}")
        docs = out.select(*(F.col("row").getField(c).alias(c) for c in columns))
    return docs
