"""Token ids in bit planes: fixed-size blocks of ids, transposed, each plane compressed by itself.

A shard is one file of records, each ended by TERMINATOR, which Spark's committed text writer puts there; so a lost
executor's half-written shard never shows, and any file system that Spark reaches will do.

    header   b"BPLN", version u8, planes per byte group u8 (1 bit planes, 8 byte planes), ids in a block u32
    chunk    b"C", ids u32, planes u8, length u32 of each compressed plane, the planes
    docs     b"D", documents u32, length u32, zstd of: doc_id i64 each, null u8 each, ids u32 each
    index    b"I", chunks u32, docs records u32, offset u64 of each chunk, first id u64 of each chunk,
             offset u64 of each docs record, ids u64, then the offset of the index u64 and b"BPLX"

All numbers are little-endian. Plane p of bit planes holds bit p of each id, eight ids to a byte, first id highest.
Planes above the highest set bit of a block are left out.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared
from .id_store import IdStore

TERMINATOR = b"\n"
MAGIC, END_MAGIC = b"BPLN", b"BPLX"
BLOCK_IDS = 65_536
DOCS_IN_RECORD = 65_536


def to_planes(ids: np.ndarray, bits: int = 1) -> list[bytes]:
    """The planes of one block: bits 1 gives bit planes, 8 byte planes."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if bits == 8:
        return [((ids >> s) & 255).astype(np.uint8).tobytes() for s in range(0, top, 8)]
    return [np.packbits(((ids >> s) & 1).astype(np.uint8)).tobytes() for s in range(top)]


def from_planes(planes: list[bytes], n: int, bits: int = 1) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        ids |= (raw if bits == 8 else np.unpackbits(raw, count=n)).astype(np.uint32) << np.uint32(k * bits)
    return ids


class ShardWriter:
    """Gives the records of a shard, without their terminators, from documents in order."""

    def __init__(self, bits: int = 1, level: int = 3, block: int = BLOCK_IDS):
        self.bits, self.block, self.zip = bits, block, zstandard.ZstdCompressor(level=level)
        self.at = self.ids = 0
        self.chunks: list[tuple[int, int]] = []
        self.doc_records: list[int] = []
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_docs = 0

    def _put(self, record: bytes) -> bytes:
        self.at += len(record) + len(TERMINATOR)
        return record

    def header(self) -> bytes:
        return self._put(MAGIC + struct.pack("<BBI", 1, self.bits, self.block))

    def _chunk(self, ids: np.ndarray) -> bytes:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.chunks.append((self.at, self.ids))
        self.ids += len(ids)
        head = struct.pack(f"<cIB{len(planes)}I", b"C", len(ids), len(planes), *map(len, planes))
        return self._put(head + b"".join(planes))

    def _doc_record(self) -> bytes:
        ids, nulls, counts = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        body = self.zip.compress(ids.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + counts.astype("<u4").tobytes())
        self.doc_records.append(self.at)
        self.docs, self.n_docs = [], 0
        return self._put(struct.pack("<cII", b"D", len(ids), len(body)) + body)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        self.docs.append((doc_ids, nulls, counts))
        self.n_docs += len(doc_ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            joined = np.concatenate(self.rest)
            whole = len(joined) // self.block * self.block
            for k in range(0, whole, self.block):
                yield self._chunk(joined[k : k + self.block])
            self.rest, self.waiting = [joined[whole:].copy()], len(joined) - whole
        if self.n_docs >= DOCS_IN_RECORD:
            yield self._doc_record()

    def close(self) -> Iterator[bytes]:
        if self.waiting:
            yield self._chunk(np.concatenate(self.rest))
        if self.n_docs:
            yield self._doc_record()
        at = self.at
        places = [x[0] for x in self.chunks] + [x[1] for x in self.chunks] + self.doc_records
        head = struct.pack("<cII", b"I", len(self.chunks), len(self.doc_records))
        yield self._put(head + struct.pack(f"<{len(places)}QQQ", *places, self.ids, at) + END_MAGIC)


class ShardReader:
    """Random access to a shard's bytes through its index."""

    def __init__(self, data: bytes):
        self.data, self.unzip = memoryview(data), zstandard.ZstdDecompressor()
        end = len(data) - len(TERMINATOR)
        if bytes(self.data[:4]) != MAGIC or bytes(self.data[end - 4 : end]) != END_MAGIC:
            raise ValueError("not a whole shard of planes")
        version, self.bits, self.block = struct.unpack_from("<BBI", data, 4)
        if version != 1:
            raise ValueError(f"shard version {version} is unknown")
        (at,) = struct.unpack_from("<Q", data, end - 12)
        tag, chunks, docs = struct.unpack_from("<cII", data, at)
        if tag != b"I":
            raise ValueError("the shard's index is not where its end says")
        places = struct.unpack_from(f"<{2 * chunks + docs + 1}Q", data, at + 9)
        self.chunk_at, self.first_id = places[:chunks], places[chunks : 2 * chunks]
        self.docs_at, self.n_ids = places[2 * chunks : -1], places[-1]

    def chunk(self, k: int) -> np.ndarray:
        at = self.chunk_at[k]
        tag, n, planes = struct.unpack_from("<cIB", self.data, at)
        if tag != b"C":
            raise ValueError(f"chunk {k} is damaged")
        lengths = struct.unpack_from(f"<{planes}I", self.data, at + 6)
        at += 6 + 4 * planes
        out = []
        for length in lengths:
            out.append(self.unzip.decompress(self.data[at : at + length]))
            at += length
        return from_planes(out, n, self.bits)

    def docs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """doc_id, null flag and number of ids of each document, by record."""
        for at in self.docs_at:
            _, n, length = struct.unpack_from("<cII", self.data, at)
            body = self.unzip.decompress(self.data[at + 9 : at + 9 + length])
            yield np.frombuffer(body, "<i8", n), np.frombuffer(body, np.uint8, n, 8 * n).astype(bool), np.frombuffer(body, "<u4", n, 9 * n)

    def read(self, first: int, n: int) -> np.ndarray:
        """n ids from place `first` on: only the chunks that hold them are unpacked."""
        if first < 0 or n < 0 or first + n > self.n_ids:
            raise IndexError(f"ids {first} to {first + n} of {self.n_ids}")
        k, out, need = first // self.block, [], n
        skip = first - k * self.block
        while need > 0:
            part = self.chunk(k)[skip : skip + need]
            out.append(part)
            need, skip, k = need - len(part), 0, k + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


#: Fixed value: the pattern of pre-tokens of word_bpe_49k.json. None holds white space, and none goes on over a full stop or comma after a letter or digit.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(tokenizer) -> bool:
    """Whether a text's ids are its words' ids, and folding ASCII words to lower case leaves them: from the tokenizer's own description."""
    spec = json.loads(tokenizer.to_str())
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    removed = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and split.get("pattern") == {"Regex": PRE_TOKENS}
    return removed and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])


class WordTokens:
    """Ids of whole texts from those of their words, each distinct word encoded once and kept.

    Right for tokenizers that by_words() knows; texts go whole to any other. A word that ends in full stops or commas after
    an ASCII letter or digit is encoded as its stem and that end: normalisation leaves such a letter and what follows it
    apart, and no pre-token goes on over the place. All other words are encoded whole, as a letter like the dotted capital I
    may become one that ends in a mark, which would join the full stop.
    The store is emptied at `most` strings or most_bytes of them, but for words found again, so its memory is bounded; the
    ids do not depend on it.
    """

    #: Between the words of one call; a word that holds it goes alone.
    BETWEEN = "<|endoftext|>"

    def __init__(self, path: str, most: int = 400_000, most_bytes: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.store = Tokenizer.from_file(path), IdStore(most, most_bytes, keep_found=True)
        self.between, self.by_words = self.tokenizer.token_to_id(self.BETWEEN), by_words(self.tokenizer)

    def _learn(self, words: list[str], at_once: int = 256, joins: int = 16) -> None:
        plain = [w for w in words if w and self.BETWEEN not in w]
        for at in range(0, len(plain), joins * at_once):  # the library's encodings take far more than their ids, so few are held
            part = plain[at : at + joins * at_once]
            joined = [self.BETWEEN.join(part[k : k + at_once]) for k in range(0, len(part), at_once)]
            flat = np.concatenate([np.array([*x.ids, self.between], np.uint32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            stop = flat == self.between
            self.store.keep(part, np.diff(np.flatnonzero(stop), prepend=-1) - 1, flat[~stop])
        if odd := [w for w in words if not w or self.BETWEEN in w]:
            coded = [x.ids for x in self.tokenizer.encode_batch(odd, add_special_tokens=False)]
            self.store.keep(odd, np.array([len(x) for x in coded], np.int64), np.array([i for x in coded for i in x], np.uint32))

    def _whole(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        coded = [x.ids + [end_id] * (end_id is not None) for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.array([len(x) for x in coded], np.int64), np.array([i for x in coded for i in x], np.uint32)

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids; end_id follows each text."""
        if not self.by_words:
            return self._whole(texts, end_id)
        offsets, codes, words = _shared.words_of(texts)
        # special tokens are found before case is folded, so words that may hold one stay as they are
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        words = pc.if_else(plain, pc.ascii_lower(words), words)
        stems = pc.utf8_rtrim(words, characters=".,")
        stems = pc.if_else(pc.match_substring_regex(stems, "[A-Za-z0-9]$"), stems, words)
        cut = pc.subtract(pc.utf8_length(words), pc.utf8_length(stems)).to_numpy(zero_copy_only=False)
        ends = np.full(len(words), "", object)
        for n in np.unique(cut[cut > 0]).tolist():
            at = np.flatnonzero(cut == n)
            ends[at] = pc.utf8_slice_codeunits(words.take(pa.array(at)), -n).to_pylist()
        ends = ends.tolist()
        self.store.make_room(len(words) + len(set(ends)))
        pairs = np.stack([self.store.places(x.dictionary_encode(), self._learn) for x in (stems, pa.array(ends, pa.string()))], axis=1)
        lengths, word_ids = self.store.gather(pairs.ravel())
        word_lengths = lengths.reshape(-1, 2).sum(axis=1)
        word_starts = np.cumsum(word_lengths) - word_lengths
        if end_id is not None:  # as one more word after each text
            word_starts, word_lengths = np.append(word_starts, len(word_ids)), np.append(word_lengths, 1)
            word_ids = np.append(word_ids, np.uint32(end_id))
            codes = np.insert(codes, offsets[1:], len(word_lengths) - 1)
            offsets = offsets + np.arange(len(offsets))
        lengths = word_lengths[codes]
        ids = word_ids[_shared.ranges(word_starts[codes], lengths)]
        return np.diff(np.concatenate([[0], np.cumsum(lengths)])[offsets]), ids


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """This worker's WordTokens for path: tasks that follow each other in a worker share it."""
    if path not in _tokens:
        _tokens.clear()
        _tokens[path] = WordTokens(path)
    return _tokens[path]


#: Bytes of text that a worker encodes at once: what is held beside the store grows with it.
RUN_BYTES = 2 << 20


def shard_records(batches: Iterable[pa.RecordBatch], tokenizer: str, end_id: int | None, bits: int) -> Iterator[pa.RecordBatch]:
    """The records of one shard from batches of doc_id and text, in order."""
    words, shard = word_tokens(tokenizer), None
    batch = lambda records: pa.record_batch({"record": pa.array(records, pa.binary())})
    for b in batches:
        texts = b.column(1)
        for at, n in _shared.slices(texts, RUN_BYTES):
            if shard is None:
                shard = ShardWriter(bits)
                yield batch([shard.header()])
            counts, ids = words.encode(texts.slice(at, n), end_id)
            keys = b.column(0).slice(at, n)
            records = list(shard.add(keys.fill_null(0).to_numpy(), np.asarray(keys.is_null()), counts, ids))
            if records:
                yield batch(records)
        del b, texts, keys  # else it stays while the next one is read
    if shard is not None:
        yield batch(list(shard.close()))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int | None = 1, bits: int = 1, shards: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes them in ascending doc_id order, one shard a partition, into folder.

    Shard k holds smaller doc_ids than shard k + 1. Null doc_ids come first, null texts count as empty, rows of one
    doc_id stand in the order of their texts' hashes. Other columns are ignored. An empty table gives no shard.
    shards: by default as many as the input has splits, so a shard holds about one split's bytes.
    """

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _shared.text_or_empty(docs).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(shards or _shared.input_splits(rows), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    records = _shared.arrow(rows, lambda batches: shard_records(batches, tokenizer, end_id, bits), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", TERMINATOR.decode()).option("compression", "none").text(folder)


def read_shards(spark: SparkSession, folder: str, *, with_ids: bool = True) -> DataFrame:
    """Reads every shard of folder: shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long, and ids array<int> unless with_ids is off."""
    types = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))][: 5 + with_ids])

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                number = int(re.search(r"part-(\d+)", path.rpartition("/")[2])[1])
                shard, start, chunk = ShardReader(data.as_buffer()), 0, 0
                ids = np.zeros(0, np.uint32)
                for doc_ids, nulls, counts in shard.docs():
                    for k in range(0, len(doc_ids), 2048):
                        n = counts[k : k + 2048].astype(np.int64)
                        parts = [ids]
                        have = len(ids)
                        while have < n.sum():
                            parts.append(shard.chunk(chunk))
                            have, chunk = have + len(parts[-1]), chunk + 1
                        ids = np.concatenate(parts)
                        ends = np.cumsum(n)
                        here, ids = ids[: ends[-1]], ids[ends[-1] :]
                        raw = memoryview(here.astype("<u4").tobytes())
                        crcs = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                        columns = [pa.array(np.full(len(n), number), pa.int32()), pa.array(doc_ids[k : k + 2048], mask=nulls[k : k + 2048]), pa.array(start + ends - n), pa.array(n), pa.array(crcs, pa.int64())]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(here.view(np.int32))))
                        yield pa.record_batch(columns, schema=types)
                        start += int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return _shared.arrow(files, decode, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_index(docs: DataFrame, tokenizer: str, *, end_id: int | None = 1, bits: int = 1) -> DataFrame:
    """Writes docs as shards into the shared folder, reads them back, and gives each document's place among all ids.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian u32), shard. One row a
    row of docs, those without doc_id first, null texts as empty ones, rows of one doc_id in the order of their texts' hashes;
    an empty table gives no rows. A text of any length is encoded whole, and columns but doc_id and text are ignored.
    The result's lineage begins at the written table of digests, so no shard is read twice.
    """
    spark = docs.sparkSession
    folder = f"{_shared.shared_folder(spark)}/planes"
    write_shards(docs, folder, tokenizer, end_id=end_id, bits=bits)
    digests = _shared.written(read_shards(spark, folder, with_ids=False), "digests")
    totals = digests.groupBy("shard").agg(F.sum("n_tokens").alias("shard_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard, not a document
    offsets = totals.select("shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("shard_start"))
    return digests.join(offsets, "shard").select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard")
