"""Substring deduplication by super-k-mer partitioning.

A window is `width` consecutive words of a document. Every word is removed that some window covers whose words, in that
order, are also a window of a document with a smaller doc_id. Windows are judged on the input.

A window's minimiser is the least hash of its runs of `run` words; equal windows have equal minimisers. Consecutive
windows of a document that share their minimiser make a super-k-mer.

1. Minimisers with their doc_ids are counted. Only those that documents of two doc_ids have can belong to a window to
   remove; for text without repeats that is almost none, and nothing else of it travels.
2. Super-k-mers of those minimisers travel as one packed string to their minimiser's bucket. There all windows are
   sorted by hash, equal hashes are compared word by word, and the least doc_id of each window is known exactly.
3. A minimiser with more than `most` super-k-mers gets no bucket of its own: its windows travel one by one as keys of an
   aggregation that combines before the shuffle, and the least doc_ids are joined back. The result is the same.

Defined cases: null and empty texts have no words. Rows that share a doc_id are documents of their own, and never remove words
from each other; repeated rows are such rows. Rows without a doc_id are left as they are and remove nothing. A text counts whole,
however long; its super-k-mers are cut at LONGEST windows, and texts are taken in runs of bounded size, one at least. An empty
table gives no rows. Columns but doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

WIDTH, RUN = 50, 16
#: Super-k-mers of one minimiser that one task sorts at once; windows in one super-k-mer.
MOST, LONGEST = 20_000, 256
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def _spans(n: int) -> list[int]:
    """Lengths and steps that double up to n: 1, 2, 4 and so on, then what is missing."""
    out, have = [], 1
    while have < n:
        step = min(have, n - have)
        out.append(step)
        have += step
    return out


def run_hashes(words: np.ndarray, run: int) -> np.ndarray:
    """The hash of each run of `run` words, by halves."""
    h = words
    for step in _spans(run):
        n = len(h) - step
        h = _mixed(h[: max(n, 0)] * _M1 + h[step:]) if n > 0 else h[:0]
    return h


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    for step in _spans(n):
        size = len(values) - step
        values = np.minimum(values[: max(size, 0)], values[step:]) if size > 0 else values[:0]
    return values


class Words:
    """The words of some texts: hashes, and one buffer where each word is followed by one space."""

    def __init__(self, texts: pa.Array):
        self.offsets, codes, found = _shared.words_of(texts)
        self.codes = codes
        strings = found.to_pylist()
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))[codes]
        spaced = pc.binary_join_element_wise(found, "", " ").cast(pa.large_string())
        taken = spaced.take(pa.array(codes))
        taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
        self.at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
        self.data = memoryview(taken.buffers()[2]) if len(taken) and taken.buffers()[2] else memoryview(b"")

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, each but the last followed by a space."""
        return bytes(self.data[self.at[a] : max(self.at[a], self.at[b] - 1)])

    def super_kmers(self, width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """row, first word (of all), windows and minimiser of each super-k-mer."""
        least = sliding_least(run_hashes(self.hashes, run), width - run + 1)
        counts = np.maximum(0, np.diff(self.offsets) - width + 1)
        first = _shared.ranges(self.offsets[:-1], counts)
        row = np.repeat(np.arange(len(counts)), counts)
        value = least[first]
        new = np.ones(len(first), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(first)))
        if len(sizes) and sizes.max() > LONGEST:
            parts = -(-sizes // LONGEST)
            nth = _shared.ranges(np.zeros(len(parts), np.int64), parts)
            starts, left = np.repeat(starts, parts) + nth * LONGEST, np.repeat(sizes, parts) - nth * LONGEST
            sizes = np.minimum(left, LONGEST)
        return row[starts], first[starts], sizes, value[starts].view(np.int64)


def _batches(batches: Iterable[pa.RecordBatch], column: int, unzip: bool = False) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        for at, n in _shared.slices(b.column(column), 2 << 20 if unzip else 8 << 20):
            part = b.slice(at, n)
            texts = part.column(column)
            yield part, pa.array([z.decompress(t.as_py()).decode() for t in texts], pa.string()) if unzip else texts


def minimisers(docs: DataFrame, width: int, run: int) -> DataFrame:
    """(m, doc_id) of each super-k-mer of docs (doc_id, text)."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches, 1):
            row, _, _, m = Words(texts).super_kmers(width, run)
            yield pa.record_batch({"m": pa.array(m), "doc_id": part.column(0).take(pa.array(row))})

    return _shared.arrow(docs, find, "m long, doc_id long")


def packed(docs: DataFrame, width: int, run: int) -> DataFrame:
    """docs: (doc_id, row, text as zstd, wanted array<long>, common array<long>). Super-k-mers of the wanted minimisers.

    (m, doc_id, row, at, words): at is the document's word where it begins, words the packed string. For the minimisers
    in common, which are wanted too, each window is a row of its own, and m is null.
    """
    names = ("m", "doc_id", "row", "at", "words")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches, 2, unzip=True):
            words = Words(texts)
            row, first, sizes, m = words.super_kmers(width, run)
            wanted, common = (np.zeros(len(m), bool) for _ in range(2))
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            for k in range(len(texts)):
                here = slice(bounds[k], bounds[k + 1])
                for column, mask in ((3, wanted), (4, common)):
                    values = part.column(column)[k].values
                    if values is not None and len(values):
                        mask[here] = np.isin(m[here], values.to_numpy(zero_copy_only=False))
            doc_ids, rows = part.column(0), part.column(1)
            for each, keep in ((False, wanted & ~common), (True, common)):
                r, a, n, v = row[keep], first[keep], sizes[keep], m[keep]
                if each:
                    r, a, n = np.repeat(r, n), _shared.ranges(a, n), np.ones(int(n.sum()), np.int64)
                for k in range(0, len(r), 8192):
                    here = slice(k, k + 8192)
                    strings = [words.text(x, x + y + width - 1) for x, y in zip(a[here].tolist(), n[here].tolist(), strict=True)]
                    place = pa.array(r[here])
                    keys = pa.nulls(len(strings), pa.int64()) if each else pa.array(v[here])
                    columns = [keys, doc_ids.take(place), rows.take(place), pa.array(a[here] - words.offsets[r[here]]), pa.array(strings, pa.binary())]
                    yield pa.record_batch([c.cast(t) for c, t in zip(columns, types, strict=True)], names=names)

    return _shared.arrow(docs, pack, "m long, doc_id long, row long, at long, words binary")


def _window_keys(words: Words, first: np.ndarray, width: int) -> np.ndarray:
    """A number for each window that begins at a word of `first`: equal numbers if and only if the words are equal."""
    hashes = run_hashes(words.hashes, width)[first]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    a, b = first[order][1:][same], first[order][:-1][same]
    codes = words.codes
    for k in range(0, len(a), 1 << 16):
        x, y = a[k : k + (1 << 16), None] + np.arange(width), b[k : k + (1 << 16), None] + np.arange(width)
        if (codes[x] != codes[y]).any():  # a collision: number the windows by their text
            return np.unique([words.text(int(f), int(f) + width) for f in first], return_inverse=True)[1].astype(np.uint64)
    return hashes


def bucket_ranges(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, a, b) ranges of words to remove, from super-k-mers (m, doc_id, row, at, words), bucket by bucket.

    Reads sorted rows as a stream and holds whole buckets of one batch at a time: at most a batch and one bucket.
    """

    def judge(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        doc_id, row, at = (table.column(k).to_numpy() for k in (1, 2, 3))
        words = Words(pa.concat_arrays(table.column(4).chunks).cast(pa.string()))
        counts = np.diff(words.offsets) - width + 1
        first = _shared.ranges(words.offsets[:-1], counts)
        who = np.repeat(np.arange(len(counts)), counts)
        keys = _window_keys(words, first, width)
        order = np.lexsort((doc_id[who], keys))
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        least = doc_id[who[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = np.zeros(len(order), bool)
        gone[order] = doc_id[who[order]] > least
        # neighbouring windows to remove make one range of words
        edge = np.ones(len(gone), bool)
        edge[1:] = (who[1:] != who[:-1]) | (gone[1:] != gone[:-1])
        starts = np.flatnonzero(edge & gone)
        ends = np.append(np.flatnonzero(edge)[1:], len(gone))[np.searchsorted(np.flatnonzero(edge), starts)]
        k = who[starts]
        begin = at[k] + first[starts] - words.offsets[k]
        return pa.record_batch({"doc_id": pa.array(doc_id[k]), "row": pa.array(row[k]), "a": pa.array(begin), "b": pa.array(begin + (ends - starts) + width - 1)})

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(m != m[-1]).max(initial=-1)) + 1
            goes_on = bool(held) and m[0] == held[-1].column(0)[held[-1].num_rows - 1].as_py()
            if cut or (held and not goes_on):  # what is held ends here, or at the cut
                yield judge(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield judge(pa.Table.from_batches(held))

    rows = rows.repartition("m").sortWithinPartitions("m").select("m", "doc_id", "row", "at", "words")
    return _shared.arrow(rows, stream, "doc_id long, row long, a long, b long")


def common_ranges(rows: DataFrame, width: int) -> DataFrame:
    """The same from single windows (doc_id, row, at, words): the aggregation combines before its shuffle."""
    key = F.sha2("words", 256).alias("key")
    windows = rows.select(key, "doc_id", "row", "at")
    least = windows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last")
    least = _shared.written(least, "least")  # a table of its own, so that the join can split a key that very many have
    return windows.join(least, "key").where("doc_id > least").select("doc_id", "row", F.col("at").alias("a"), (F.col("at") + width).alias("b"))


def _squeezed(docs: DataFrame) -> DataFrame:
    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for at, n in _shared.slices(b.column(2)):
                part = b.slice(at, n)
                yield pa.record_batch([part.column(0), part.column(1), pa.array([z.compress(t.as_buffer()) for t in part.column(2)], pa.binary())], names=("doc_id", "row", "text"))

    return _shared.arrow(docs, squeeze, "doc_id long, row long, text binary")


def removed_ranges(docs: DataFrame, *, width: int = WIDTH, run: int = RUN, most: int = MOST) -> DataFrame:
    """(doc_id, row, ranges array<struct<a, b>>) of the rows of docs (doc_id, row, text) that lose words; row tells rows of one doc_id apart."""
    if not 0 < run <= width:
        raise ValueError("a run must not be longer than a window")
    docs = docs.where("doc_id is not null")
    found = _shared.written(minimisers(docs.select("doc_id", "text"), width, run), "minimisers")
    counted = found.groupBy("m").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    twice = counted.where("least < last").select("m", (F.col("n") > most).alias("common"))
    wanted = found.join(twice, "m").groupBy("doc_id").agg(F.collect_set("m").alias("wanted"), F.collect_set(F.when(F.col("common"), F.col("m"))).alias("common"))
    wanted = _shared.written(wanted, "wanted")
    rows = _squeezed(docs.select("doc_id", "row", "text")).join(wanted, "doc_id").select("doc_id", "row", "text", "wanted", "common")
    rows = packed(rows, width, run)
    if not wanted.where(F.size("common") > 0).isEmpty():
        rows = _shared.written(rows, "packed")
        ranges = bucket_ranges(rows.where("m is not null"), width).union(common_ranges(rows.where("m is null"), width))
    else:
        ranges = bucket_ranges(rows, width)
    return ranges.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"))


def deduplicated(docs: DataFrame, *, width: int = WIDTH, run: int = RUN, most: int = MOST, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by single spaces) of every row of docs (doc_id, text).

    With texts, also `kept`, those words.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _shared.text_or_empty(docs).alias("text")).withColumn("row", F.xxhash64("text"))
    ranges = _shared.written(removed_ranges(rows, width=width, run=run, most=most), "ranges")
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * texts

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _batches(batches, 1, unzip=True):
            words = Words(held)
            out: list[tuple] = []
            for k, (a, b) in enumerate(zip(words.offsets.tolist(), words.offsets[1:].tolist(), strict=False)):
                gone, at, pieces = 0, a, []
                for r in part.column(2)[k].as_py() or ():
                    x, y = max(at, a + r["a"]), a + r["b"]
                    if y > at:
                        if x > at:
                            pieces.append(words.text(at, x))
                        gone, at = gone + y - x, y
                if b > at:
                    pieces.append(words.text(at, b))
                kept = b" ".join(pieces)
                out.append((part.column(0)[k].as_py(), b - a, gone, hashlib.sha256(kept).hexdigest(), *[kept.decode()] * texts))
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    text = _squeezed(rows.select("doc_id", "row", "text"))
    joined = text.join(ranges, ["doc_id", "row"], "left").select("doc_id", "text", "ranges")
    return _shared.arrow(joined, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
