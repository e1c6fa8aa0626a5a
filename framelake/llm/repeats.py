"""Repeated strings: every byte covered by a 400-byte string that starts anywhere else is removed.

Passages of over 50 words that repeat may have fewer bytes. They are reported beside: runs covered by repeated 240-byte
strings, of more than 50 words. Both come from the same common prefixes.

Inserting one symbol of every document a round, over whole documents, takes as many rounds as the longest document has
bytes, each with a pass over the whole transform. The same column-wise construction is made here over strings of bounded
length instead, so that it has a fixed number of rounds:

1. Each 240-byte window names the least hash of its 32-byte strings as its anchor. Equal windows name equal anchors at
   the same distance, so only windows of anchors that stand in two places or more can repeat.
2. The surroundings of such an anchor (all 400-byte windows whose first 240 bytes could name it) are a string of at most 608
   bytes. Strings of the same anchor form a collection, aligned at the anchor.
3. Column by column from the right, one symbol of each string is put before its suffix: the order of the suffixes is
   updated by a stable sort on the new symbols (the positional Burrows-Wheeler transform), the common prefixes of
   neighbours with it. Where a neighbour shares 400 (or 240) bytes, the window that starts in this column repeats.

Each text is one document, so matches never cross documents. Copies of a whole text are found by digest and their
strings enter once, as do equal strings of a text. An anchor with very many strings would make its collection unbounded. The
starts of its windows are then taken in runs of STEP. A run whose bytes stand elsewhere as a whole repeats, one of which not
even what all its windows have in common does so doesn't; both are found by a grouped count of 128-bit hashes. Only the
runs between have their windows hashed and counted one by one. All of it is spread over the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mixed, reused, stored, text_of, utf8

LENGTH, GRAM = 400, 32
#: Bytes of a window of a passage, and the words that a passage has more than.
PASSAGE, WORDS = 240, 50
#: Strings of a collection (equal ones of a text fall together); strings that are worked on at once.
COLLECTION, BATCH = 100_000, 4_096
#: Starts of windows that are tried at once.
STEP = 16
_BITS = 20


def grams(raw: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings."""
    n = len(raw) - GRAM + 1
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(np.uint64).ravel()
    h = mixed(words[:n])
    for i in range(8, GRAM, 8):
        h = mixed(h + words[i : n + i])
    return h


def anchors(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows of one document; the leftmost of equals."""
    width, windows = length - GRAM + 1, len(raw) - length + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    low = np.uint64((1 << _BITS) - 1)
    for a in range(0, max(windows, 0), (1 << _BITS) - width):
        part = raw[a : min(a + (1 << _BITS) - width, windows) + length - 1]
        h = grams(part)
        n = len(h)
        block = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
        block[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
        block = block.reshape(-1, width)
        before = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - width + 1], before[width - 1 : n])
        at = np.unique(least[np.concatenate([[True], least[1:] != least[:-1]])] & low).astype(np.int64)
        found.append((at + a, h[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
    return at, np.concatenate([h for _, h in found])[first]


def repeated(strings: np.ndarray, group: np.ndarray, lengths: tuple[int, ...], starts: int) -> list[np.ndarray]:
    """For each length, which windows of aligned strings stand in another string of the group too: (strings, starts).

    strings: a row of symbols each, group: in order. One column a round, from the right.
    """
    order = np.arange(len(strings))
    shared = np.zeros(len(strings) + 1, np.int32)  # with the neighbour before; a closing zero
    out = [np.zeros((len(strings), starts), bool) for _ in lengths]
    columns = np.ascontiguousarray(strings.T)
    group = group.astype(np.int64) * 512
    for q in range(strings.shape[1] - 1, -1, -1):
        key = group[order] + columns[q][order].astype(np.int64)
        if (key[1:] < key[:-1]).any():
            to = np.argsort(key, kind="stable")
            same = np.flatnonzero(key[to[1:]] == key[to[:-1]])
            a, z = to[same] + 1, to[same + 1] + 1
            least = np.minimum.reduceat(shared, np.stack([a, z], axis=1).ravel())[::2] if len(same) else np.zeros(0, np.int32)
            shared = np.zeros(len(shared), np.int32)
            shared[same + 1] = least + 1
            order = to if q == strings.shape[1] - 1 else order[to]
        else:
            shared[1:-1] = np.where(key[1:] == key[:-1], shared[1:-1] + 1, 0)
            shared[0] = 0
        if q < starts:
            for length, flags in zip(lengths, out):
                enough = shared >= length
                flags[order[enough[:-1] | enough[1:]], q] = True
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values in each row."""
    edge = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    d = np.diff(edge, axis=1)
    row, first = np.nonzero(d == 1)
    return row, first, np.nonzero(d == -1)[1] - 1


def key_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's MD5, the same plan wherever it is used, so that texts are shuffled once for all joins by key."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return keyed.withColumn("key", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")))


def removals(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """(key, copies, spans) of each distinct text, key being its MD5; spans: (kind, start, end), unmerged.

    Kind 0 is covered by repeated strings of `length` bytes, kind 1 by those of `passage` bytes. A text with copies is not
    given spans if it is to go as a whole.
    """
    keyed, near = key_of(docs), min(passage, length)
    lengths, left = (length, near), near - GRAM

    def surroundings(raw: np.ndarray, p: int) -> tuple[int, int, bytes]:
        start, end = max(p - left, 0), min(p + length, len(raw))
        return p - start, end - start, hashlib.blake2b(raw[start:end], digest_size=16).digest()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            raw, at = utf8(b.column(1))
            columns: list[list] = [[], [], []]
            for a, z in zip(at, at[1:]):
                text = raw[a:z]
                p, h = anchors(text, near)
                hashes, inv, n = np.unique(h, return_inverse=True, return_counts=True)
                again = n[inv] > 1
                kinds: dict[int, set] = {}
                for i, q in zip(inv[again].tolist(), p[again].tolist()):
                    kinds.setdefault(i, set()).add(surroundings(text, q))
                columns[0].append(hashes[n == 1].view(np.int64))
                columns[1].append(hashes[n > 1].view(np.int64))
                columns[2].append([max(len(kinds[i]), 2) for i in np.flatnonzero(n > 1).tolist()])
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in columns)], ["key", "once", "often", "times"])

    marked = keyed.select("key", "text").mapInArrow(mark, "key binary, once array<long>, often array<long>, times array<long>")
    texts = reused(marked.groupBy("key").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("once", "often", "times"))))
    more = texts.select("key", F.explode(F.arrays_zip("often", "times")).alias("s")).select("key", F.col("s.often").alias("hash"), "s.times")
    places = texts.select("key", F.explode("once").alias("hash"), F.lit(1).cast("long").alias("times")).unionByName(more)
    shared = reused(places.groupBy("hash").agg(F.sum("times").alias("n")).where("n > 1"))
    wanted = places.select("key", "hash").join(shared, "hash").groupBy("key").agg(F.collect_list(F.struct("hash", (F.col("n") > COLLECTION).alias("many"))).alias("anchors"))
    found = keyed.join(wanted.hint("merge"), "key").select("doc_id", "key", "text", "anchors")
    names = ["hash", "key", "at", "string", "end"]

    def texts_of(batches: Iterator[pa.RecordBatch], many: bool) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """Key, bytes, and the wanted anchors' positions and hashes of each text; copies that follow one another once."""
        last = None
        for b in chunks(batches):
            raw, at = utf8(b.column(2))
            for key, a, z, own in zip(b.column(1).to_pylist(), at, at[1:], b.column(3)):
                if key != last:
                    last = key
                    v = own.values
                    mine = v.field("hash").to_numpy()[v.field("many").to_numpy(zero_copy_only=False) == many]
                    if len(mine):
                        p, h = anchors(raw[a:z], near)
                        some = np.isin(h.view(np.int64), mine)
                        yield key, raw[a:z], p[some], h[some].view(np.int64)

    def once_each(raw: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
        """(hash, position, start, size, known) of the surroundings of a text's anchors; known ones stand earlier in it."""
        seen: dict[tuple, int] = {}
        for p, h in zip(at.tolist(), hashes.tolist()):
            before, size, digest = surroundings(raw, p)
            name = (h, before, digest)
            if name not in seen:
                seen[name] = p
                yield h, p, p - before, size, False
            elif size >= near:  # all its windows stand twice in this text; the first goes on for the others
                yield h, p, p - before, size, True
                if (q := seen[name]) >= 0:
                    yield h, q, q - before, size, True
                    seen[name] = -1

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()))], names)

        for key, raw, at, hashes in texts_of(batches, False):
            for h, p, start, size, known in once_each(raw, at, hashes):
                rows.append((p, key, start, None, start + size) if known else (h, key, p, raw[start : start + size].tobytes(), None))
                if len(rows) >= BATCH:
                    yield made()
                    rows = []
        if rows:
            yield made()

    types = (pa.binary(), pa.int32(), pa.int64(), pa.int64())
    spans_named = ["key", "kind", "start", "end"]

    def collection(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        x = np.full((len(rows), left + length), 255, np.uint8)  # a byte that no text has
        at = np.array([r[2] for r in rows], np.int64)
        inside = [np.zeros((len(rows), left + 1), bool) for _ in lengths]
        for i, r in enumerate(rows):
            first = max(left - r[2], 0)
            x[i, first : first + len(r[3])] = np.frombuffer(r[3], np.uint8)
            for n, flags in zip(lengths, inside):
                flags[i, first : max(first + len(r[3]) - n + 1, 0)] = True
        hashes = np.array([r[0] for r in rows], np.int64)
        group = np.concatenate([[0], np.cumsum(hashes[1:] != hashes[:-1])])
        for kind, (n, flags) in enumerate(zip(lengths, repeated(x, group, lengths, left + 1))):
            row, first, last = runs(flags & inside[kind])
            key = [rows[i][1] for i in row.tolist()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip((key, np.full(len(row), kind), at[row] - left + first, at[row] - left + last + n), types)], spans_named)

    def collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            known = []
            for r in zip(*(b.column(i).to_pylist() for i in range(5))):
                if r[3] is None:
                    known += [(r[1], kind, r[2], r[4]) for kind, n in enumerate(lengths) if r[4] - r[2] >= n]
                    continue
                if len(held) >= BATCH and r[0] != held[-1][0]:
                    yield from collection(held)
                    held = []
                held.append(r[:4])
            if known:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*known), types)], spans_named)
        if held:
            yield from collection(held)

    dealt = found.mapInArrow(strings, "hash long, key binary, at long, string binary, end long").repartition("hash").sortWithinPartitions("hash")
    spans = dealt.mapInArrow(collections, "key binary, kind int, start long, end long")

    if not shared.where(F.col("n") > COLLECTION).isEmpty():
        digest = lambda raw: hashlib.blake2b(raw, digest_size=16).digest()

        def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Runs of starts: what their windows have in common, and all their bytes for either length; strings that are known to repeat have an end instead."""
            for key, raw, at, hashes in texts_of(batches, True):
                rows = []
                for h, p, start, size, known in once_each(raw, at, hashes):
                    if known:
                        rows.append((h, key, start, start + size, None, None, None))
                        continue
                    for a in range(p - left, p + 1, STEP):  # runs lie alike around equal anchors
                        first, last = max(a, 0), min(a + STEP - 1, p, len(raw) - near)
                        if last < first:
                            continue
                        place = (p - first).to_bytes(4, "little")
                        ends = [min(last, len(raw) - n) + n for n in lengths]  # of the last window that fits
                        whole = [digest(place + raw[first:z].tobytes()) if z >= first + n else None for z, n in zip(ends, lengths)]
                        core = digest((p - a).to_bytes(4, "little") + raw[a + STEP - 1 : a + near].tobytes())  # every window of the run holds it
                        rows.append((h, key, first, last, core, *whole))
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 3))], ["hash", "key", "start", "last", "core", "whole0", "whole1"])

        each = stored(found.mapInArrow(cores, "hash long, key binary, start long, last long, core binary, whole0 binary, whole1 binary"), "cores")
        known = each.where("core is null").select("key", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"), "start", F.col("last").alias("end"))
        long = F.when(F.col("kind") == 0, lengths[0]).otherwise(lengths[1])
        spans = spans.unionByName(known.where(F.col("end") - F.col("start") >= long))
        each = each.where("core is not null")
        again = lambda c: each.where(F.col(c).isNotNull()).groupBy("hash", c).agg(F.count("*").alias("n")).where("n > 1").select("hash", c, F.lit(True).alias(f"{c}_again"))
        for c in ("whole0", "whole1", "core"):
            each = each.join(again(c), ["hash", c], "left")
        each = stored(each.select("hash", "key", "start", "last", "core", "whole0", "whole1", *(f"{c}_again" for c in ("whole0", "whole1", "core"))), "runs")
        fits = keyed.select("key", F.octet_length("text").alias("size")).distinct()
        for kind, n in enumerate(lengths):
            run = each.where(F.col(f"whole{kind}_again")).join(fits, "key")
            spans = spans.unionByName(run.select("key", F.lit(kind).alias("kind"), "start", F.least(F.col("last") + n, F.col("size").cast("long")).alias("end")))
        settled = F.col("whole1_again").isNotNull() & (F.col("whole0").isNull() | F.col("whole0_again").isNotNull())
        parts = each.where("core_again").withColumn("settled", settled)
        loose = parts.where("not settled")
        # A settled run may hold windows of a loose one: one of each kind is taken along.
        beside = parts.where("settled").join(loose.select("hash", "core").distinct(), ["hash", "core"], "left_semi")
        beside = beside.groupBy("hash", "core", "whole0", "whole1").agg(F.min(F.struct("key", "start", "last")).alias("one")).select("hash", "one.*")
        open_ = loose.select("hash", "key", "start", "last").unionByName(beside).groupBy("key").agg(F.collect_set(F.struct("hash", "start", "last")).alias("runs"))

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = None
            for b in chunks(batches):
                raw, at = utf8(b.column(2))
                for key, a, z, own in zip(b.column(1).to_pylist(), at, at[1:], b.column(3).to_pylist()):
                    if key == before:
                        continue
                    before, text = key, raw[a:z].tobytes()
                    starts = sorted({(r["hash"], q) for r in own for q in range(r["start"], r["last"] + 1)})
                    for c in range(0, len(starts), BATCH):
                        rows = [(h, digest(text[q : q + n]), key, kind, q) for h, q in starts[c : c + BATCH] for kind, n in enumerate(lengths) if q + n <= len(text)]
                        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()))], ["hash", "window", "key", "kind", "start"])

        wide = keyed.join(open_.hint("merge"), "key").select("doc_id", "key", "text", "runs")
        each = stored(wide.mapInArrow(windows, "hash long, window binary, key binary, kind int, start long"), "windows")
        twice = each.groupBy("hash", "kind", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        spans = spans.unionByName(each.join(twice, ["hash", "kind", "window"], "left_semi").select("key", "kind", "start", (F.col("start") + long).alias("end")))

    each = spans.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("spans"))
    return texts.select("key", "copies").join(each, "key", "left").where("copies > 1 or spans is not null")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def cleaned(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes, `removed` and `passages` of every row.

    removed: the byte spans that go; passages: maximal runs, of more than `words` words, that strings of `passage` bytes
    which start elsewhere too cover (min(passage, length) bytes, in fact). Null text: empty. Texts under the length lose
    nothing. Repeated rows lose everything from that length on. An empty table gives an empty frame. Other columns are not read.
    """
    kind, near = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), min(passage, length)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), kind, kind)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes", "removed", "passages"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            rows = []
            for text, copies, spans in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                raw = text.encode()
                if (copies or 1) > 1:
                    gone, again = ([(0, len(raw))] if len(raw) >= n else [] for n in (length, near))
                else:
                    gone, again = (merged([(r["start"], r["end"]) for r in spans or [] if r["kind"] == k]) for k in (0, 1))
                again = [(s, e) for s, e in again if len(raw[s:e].split()) > words]
                kept, at = hashlib.sha256(), 0
                for s, e in gone:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                rows.append((len(raw), sum(e - s for s, e in gone), len(gone), kept.hexdigest(), len(again), sum(e - s for s, e in again), *([{"start": s, "end": e} for s, e in x] for x in (gone, again))))
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    both = key_of(docs).join(removals(docs, length, passage), "key", "left").select("doc_id", "text", "copies", "spans")
    span = "array<struct<start:long,end:long>>"
    return both.mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long, removed {span}, passages {span}")
