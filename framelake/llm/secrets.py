"""Secret scans: fixed patterns, and a battery of randomness tests on other strings.

Base kinds come from regular expressions. Beyond them, every long run of key characters is tested as follows. Its encoding
is inferred (hex, base32, base58, base64, base64url: the smallest alphabet that holds it). Against that alphabet it
must pass three tests that a random string passes: chi-squared uniformity of its symbols, runs above and below the middle
symbol, and serial correlation of neighbours, none rejected at a level that is shared between the tests.

How rarely ordinary text looks that random is measured by the same three statistics, whose distribution for text follows from
the corpus's own counts of neighbouring characters, and by the likelihood ratio of the random model to those counts (by
Markov's inequality exp(-ratio) is a p-value). The four p-values are combined by the Cauchy rule, which holds whatever their
dependence, and go, weighted by length (long strings have more to show), through Benjamini and Hochberg's step-up rule over the
candidates of the whole corpus, so that false discoveries stay at the rate asked for. The rule needs the p-values' counts in
fine bins, each rounded up, and so one pass over the texts; counting neighbours takes another.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, row_and_text, row_struct, utf8

#: Fixed patterns of the base kinds, and the lengths that their matches need.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Alphabets in order of size; the first that holds a string is its encoding.
ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
RATE, LEVEL = 0.01, 0.001
_RANK = {k: np.array([max(v.find(chr(c)), 0) for c in range(256)]) for k, v in ALPHABETS.items()}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
#: What is known of text before a corpus is counted, as so many pairs of neighbours: the next character is of the same class as
#: the one before with this probability, and by these shares within its class.
PRIOR, _STAY = 1_000.0, 0.95
_LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.15, 0.15, 0.1, 0.07)))
_KEY = np.zeros(256, bool)
_KEY[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
#: Bins of a decade of p-values.
FINE = 50


def encoding(text: str) -> str | None:
    """The smallest alphabet that holds the string; None for strings of letters alone or digits alone."""
    body = text.rstrip("=")
    if not re.search("[0-9]", body) or not re.search("[A-Za-z]", body):
        return None
    chars = set(body)
    return next((k for k, v in _SETS.items() if chars <= v), None)


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def statistics(text: str, kind: str) -> tuple[int, int, int, float, int, float]:
    """Symbols, size of the alphabet, cells, chi-squared over the cells, changes between the halves of the alphabet, and serial correlation."""
    body, letters = text.rstrip("="), ALPHABETS[kind]
    x = _RANK[kind][np.frombuffer(body.encode(), np.uint8)].astype(float)
    n, k = len(x), len(letters)
    bins = min(k, max(2, n // 5))  # so many cells that each expects five symbols
    seen = np.bincount((x * bins // k).astype(int), minlength=bins)
    share = np.bincount(np.arange(k) * bins // k, minlength=bins) / k
    chi = float(((seen - n * share) ** 2 / (n * share)).sum())
    high = x >= k / 2
    c = x - x.mean()
    total = float((c * c).sum())
    return n, k, bins, chi, int((high[1:] != high[:-1]).sum()), float((c[1:] * c[:-1]).sum()) / total if total > 0 else 1.0


def battery(text: str, kind: str) -> tuple[float, float, float]:
    """P-values of uniformity, runs and serial correlation under the random model."""
    n, k, bins, chi, changes, r = statistics(text, kind)
    df = bins - 1
    uniform = 0.5 * math.erfc((((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))) / math.sqrt(2))  # Wilson and Hilferty
    rank = _RANK[kind][np.frombuffer(text.rstrip("=").encode(), np.uint8)]
    a = int((rank >= k / 2).sum())
    b = n - a
    runs = 0.0
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = normal_tail((changes + 1 - mean) / math.sqrt(var)) if var > 0 else 1.0
    return uniform, runs, normal_tail((r + 1 / n) * math.sqrt(n))


def prior_pairs() -> np.ndarray:
    """Counts of neighbouring key characters that the prior stands for, (256, 256)."""
    groups = {"l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "d": "0123456789", "s": "+/_-"}
    own, size = np.zeros((4, 256)), np.array([0.80, 0.06, 0.08, 0.06])
    for g, members in enumerate(groups.values()):
        for c in members:
            own[g, ord(c)] = _LETTERS.get(c.lower(), 1.0)
        own[g] /= own[g].sum()
    turn = np.full((4, 4), (1 - _STAY) / 3) + np.eye(4) * (_STAY - (1 - _STAY) / 3)
    return PRIOR * sum(size[a] * turn[a, b] * np.outer(own[a], own[b]) for a in range(4) for b in range(4))


class Text:
    """What ordinary text is like: the next character's probabilities, and for each encoding how its symbols and their neighbours are spread."""

    def __init__(self, pairs: np.ndarray) -> None:
        """pairs: counts of neighbouring bytes, both of them key characters."""
        prior = prior_pairs()
        n = pairs + prior
        smooth = prior / np.maximum(prior.sum(axis=1, keepdims=True), 1e-300)
        self.log_next = np.log(np.maximum((pairs + 50 * smooth) / (pairs.sum(axis=1, keepdims=True) + 50), 1e-9))
        self.log_first = np.log(np.maximum(n.sum(axis=1) / n.sum(), 1e-9))
        self.kinds = {}
        for kind, letters in ALPHABETS.items():
            at = np.array([ord(c) for c in letters])
            m = n[np.ix_(at, at)]
            m = m / m.sum()
            share, rank = (m.sum(axis=0) + m.sum(axis=1)) / 2, np.arange(len(at))
            mean = (share * rank).sum()
            var = (share * (rank - mean) ** 2).sum()
            high = rank >= len(at) / 2
            switch = m[np.ix_(high, ~high)].sum() + m[np.ix_(~high, high)].sum()
            self.kinds[kind] = share, float(switch), float(((rank - mean)[:, None] * (rank - mean)[None] * m).sum() / var)

    def ratio(self, text: str, kind: str) -> float:
        """Log likelihood ratio of the random model to the text model."""
        x = np.frombuffer(text.rstrip("=").encode(), np.uint8)
        return float(-len(x) * math.log(len(ALPHABETS[kind])) - self.log_first[x[0]] - self.log_next[x[:-1], x[1:]].sum())

    def p_values(self, text: str, kind: str) -> tuple[float, float, float, float]:
        """How rarely text is as uniform, as unsteady and as uncorrelated as this string, and as unlikely as text."""
        share, switch, serial = self.kinds[kind]
        n, k, bins, chi, changes, r = statistics(text, kind)
        cell, p = np.arange(k) * bins // k, np.bincount(np.arange(k) * bins // k, share, bins)
        even = np.bincount(cell, minlength=bins) / k
        far = n * ((p - even) ** 2 / even).sum()
        mean, var = (p * (1 - p) / even).sum() + far, 2 * (bins - 1) + 4 * far
        uniform = 0.5 * math.erfc((mean - chi) / math.sqrt(2 * var))
        toward = 1 if switch < 0.5 else -1
        runs = 0.5 * math.erfc(toward * (changes - (n - 1) * switch) / math.sqrt(max(2 * (n - 1) * switch * (1 - switch), 1e-9)))
        toward = 1 if serial > 0 else -1
        flat = 0.5 * math.erfc(toward * (serial - 1 / n - r) * math.sqrt(n / 2))
        return uniform, runs, flat, math.exp(-max(0.0, self.ratio(text, kind)))


def cauchy(p: tuple[float, ...]) -> float:
    """One p-value of several, whatever their dependence."""
    t = sum(1 / (x * math.pi) if x < 1e-8 else math.tan((0.5 - min(x, 1 - 1e-12)) * math.pi) for x in (max(v, 1e-300) for v in p)) / len(p)
    return 1 / (t * math.pi) if t > 1e8 else 0.5 - math.atan(t) / math.pi


def tested(text: str, like: Text, level: float = LEVEL) -> tuple[float, float] | None:
    """P-value and length in bits of a candidate; None where it has no encoding. What the battery rejects as random has p-value 1."""
    kind = encoding(text)
    if kind is None:
        return None
    p = cauchy(like.p_values(text, kind)) if min(battery(text, kind)) >= level / 3 else 1.0
    return max(p, 1e-290), math.log2(len(ALPHABETS[kind])) * len(text)


def bin_of(p: float, bits: float) -> int:
    """The bin of a p-value by weight, rounded up."""
    return math.ceil(math.log10(p / bits) * FINE)


def step_up(counts: dict[int, int], bits: float, *, rate: float = RATE) -> int | None:
    """The last bin that Benjamini and Hochberg's rule takes, for counts by bin and the candidates' bits in all; None if it takes none."""
    m, below, last = sum(counts.values()), 0, None
    for b in sorted(counts):
        below += counts[b]
        if 10 ** (b / FINE) * bits / m <= rate * below / m:
            last = b
    return last


def scan(text: str, like: Text | None = None, last: int | None | str = "own") -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings in order of start, then of KINDS; code points, the end exclusive.

    like and last: the corpus's text model and its last bin; by default the prior, and the rule over this text alone.
    """
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found = [] if last is None else candidates(text, like or _prior())
    if last == "own":
        last = step_up(Counter(b for *_, b, _ in found), sum(x for *_, x in found)) if found else None
    taken = [(s, e) for s, e, b, _ in found if last is not None and b <= last]
    if taken:
        base, reach, far = sorted((s, e) for s, e, _ in out), [], 0
        for s, e in base:
            far = max(far, e)
            reach.append(far)
        starts = [s for s, _ in base]
        for s, e in taken:
            i = bisect_right(starts, s) - 1
            if i < 0 or reach[i] < e:
                out.append((s, e, "random"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


@lru_cache(1)
def _prior() -> Text:
    return Text(np.zeros((256, 256)))


def candidates(text: str, like: Text) -> list[tuple[int, int, int, float]]:
    """(start, end, bin, bits) of all strings that are tested."""
    out = []
    for m in CANDIDATE.finditer(text):
        if t := tested(m[0], like):
            out.append((m.start(), m.end(), bin_of(*t), t[1]))
    return out


def text_model(docs: DataFrame) -> Text:
    """The model of all texts, from their counts of neighbouring key characters: at most 65,536 sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(1 << 16, np.int64)
        for b in chunks(batches):
            raw, at = utf8(b.column(0))
            both = _KEY[raw[:-1]] & _KEY[raw[1:]]
            inner = at[1:-1]
            both[inner[(inner > 0) & (inner < len(raw))] - 1] = False
            pairs += np.bincount((raw[:-1][both].astype(np.int64) << 8) | raw[1:][both], minlength=1 << 16)
        some = np.flatnonzero(pairs)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(pairs[some])], ["pair", "n"])

    rows = docs.select("text").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(1 << 16)
    for pair, n in rows:
        pairs[pair] = n
    return Text(pairs.reshape(256, 256))


def control(docs: DataFrame) -> tuple[Text, int | None]:
    """The text model and the last bin of the step-up rule over all candidates of the corpus; what reaches the driver is a count for each bin."""
    like = text_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(like)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        bits = 0.0
        for b in chunks(batches):
            for t in b.column(0).to_pylist():
                for *_, at, x in candidates(t, shared.value):
                    counts[at] += 1
                    bits += x
        rows = [*counts.items()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([bits / max(len(rows), 1)] * len(rows), pa.float64())], ["bin", "n", "bits"])

    rows = docs.select("text").mapInArrow(weigh, "bin int, n long, bits double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("bits").alias("bits")).collect()
    return like, step_up({r["bin"]: r["n"] for r in rows}, sum(r["bits"] for r in rows)) if rows else None


def find(docs: DataFrame, *, keep: list[str]) -> DataFrame:
    """The columns `keep` and `found`, an array of (start, end, kind), for every row.

    Null text: empty, nothing found. Repeated rows are scanned alike, and count as often in the control of false
    discoveries. An empty table gives an empty frame.
    """
    name = fresh("found", keep)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    like, last = control(docs)
    shared = docs.sparkSession.sparkContext.broadcast(like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(row_and_text(batches, keep)):
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t, shared.value, last)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, kind)], ["row", "found"])

    inner = row_struct(docs, keep)
    out = inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}, found array<struct<start:long,end:long,kind:string>>")
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("found").alias(name))


def digest(found: DataFrame) -> DataFrame:
    """doc_id with counts of the base kinds and the spans as text, from find(..., keep=["doc_id"])."""
    of = lambda kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    told = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    return found.select("doc_id", *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(told(of(KINDS[:3])), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every finding replaced by a mark of its kind; n_chars follows the new text where it is a column."""
    name = fresh("redacted", docs.columns)
    like, last = control(docs)
    shared = docs.sparkSession.sparkContext.broadcast(like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                if t:
                    parts, at = [], 0
                    for s, e, k in scan(t, shared.value, last):
                        if e > at:
                            parts += [t[at : max(s, at)], f"[{k.upper()}]" if s >= at else ""]
                            at = e
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["row", "text"])

    inner = docs.select(F.struct(*(c for c in docs.columns if c != "text"), F.lit(1).alias(name)).alias("row"), F.col("text").alias("text"))
    out = inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}, text string")
    length = lambda c: F.when(F.col("text").isNull(), F.col(f"row.{c}")).otherwise(F.char_length("text")).cast(docs.schema[c].dataType)
    return out.select(*(F.col("text") if c == "text" else (length(c) if c == "n_chars" else F.col("row").getField(c)).alias(c) for c in docs.columns))
