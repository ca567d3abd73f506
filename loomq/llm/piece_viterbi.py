"""SentencePiece encoding and decoding: a batched Viterbi search over the pieces of a model file, in numpy.

The segmentation of a text is the one whose pieces' scores add up to the most, which is what the SentencePiece library
gives for a unigram model of these pieces and scores; ties go to the longer last piece, as there. A file of the BPE kind
stores minus the merge's rank as score: its segmentation here is the best-scored one, not the one of its merges in turn.

A unit is a run of spaces with what follows up to the next space; no piece goes past its end, so units are searched
apart, and each distinct unit once. A unit is cut further wherever no piece holds the two characters side by side, which
leaves text without spaces in short parts, too. Parts of one length advance together, longer ones padded to a few lengths: at
each end, the rolling hashes of the substrings before it are looked up among the sorted hashes of the pieces of that
length, hits are compared with the piece, and the best sum and its piece are kept. A very long part is searched by itself:
its hits are found for all places at once, and only the sums go place by place. Characters without a piece become the bytes of
their UTF-8 form, or <unk> in a model without byte pieces.

Defined cases: null text gives null ids and null text; an empty text gives no ids. Decoding gives the text back, but for
U+2581, which the format cannot tell from a space. One row comes out for each that goes in, repeated rows among them; an empty
table gives none. Texts of any length are encoded whole, in runs of bounded size, one text at least. Columns but doc_id and
text (or ids) are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from .id_store import IdStore

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Cells of the search that are held at a time; places of a long part that are searched at once, and the length from which one is long.
CELLS, WINDOW, LONG = 1 << 20, 1 << 16, 64
#: Fills up a part to its class's length; no code point.
PAD = np.uint32(0xFFFFFFFF)
UNKNOWN_PENALTY = 10.0


class Pieces:
    """A model file's pieces, ready for search."""

    def __init__(self, path: str, most: int = 500_000):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        kinds = type(model.pieces[0])
        self.dummy_prefix = spec.add_dummy_prefix
        self.bytes_at = np.full(256, -1, np.int64)
        surface, self.unknown, pieces = [], 0, []
        for i, p in enumerate(model.pieces):
            text = b""
            if p.type == kinds.BYTE:
                self.bytes_at[int(p.piece[1:-1], 16)] = i
                text = bytes([int(p.piece[1:-1], 16)])
            elif p.type == kinds.UNKNOWN:
                self.unknown, text = i, " ⁇ ".encode()
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                text = p.piece.replace(SPACE, " ").encode()
                pieces.append((p.piece, i, p.score))
            surface.append(text)
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
            raise ValueError("pieces that go on after a space are not supported")
        lengths = np.array([len(x) for x in surface])
        self.surface, self.surface_at, self.surface_len = np.frombuffer(b"".join(surface), np.uint8), np.cumsum(lengths) - lengths, lengths
        self.with_bytes = bool((self.bytes_at >= 0).all())
        self.unknown_score = min(s for _, _, s in pieces) - UNKNOWN_PENALTY
        self.newline_apart = not any("\n" in p for p, _, _ in pieces)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        pairs = {x[k : k + 2] for x, _, _ in pieces for k in range(len(x) - 1)}
        flat = np.frombuffer("".join(pairs).encode("utf-32-le"), np.uint32).astype(np.uint64)
        #: the pairs of characters that some piece holds side by side
        self.pairs = np.sort(flat[::2] << np.uint64(32) | flat[1::2])
        for n in sorted({len(p) for p, _, _ in pieces}):
            same = [x for x in pieces if len(x[0]) == n]
            codes = np.frombuffer("".join(p for p, _, _ in same).encode("utf-32-le"), np.uint32).reshape(-1, n)
            keys = prefix_hashes(codes)[:, n]
            order = np.argsort(keys)
            if (np.diff(keys[order].astype(object)) == 0).any():
                raise ValueError("two pieces share a hash")
            self.tables[n] = keys[order], np.array([i for _, i, _ in same])[order], np.array([s for _, _, s in same])[order], codes[order]
        self.store = IdStore(most)

    def search(self, codes: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of codes (code points, filled up with PAD after sizes, if given): number in each row, and all."""
        n, size = codes.shape
        hashes = prefix_hashes(codes)
        powers = BASE ** np.arange(size + 1, dtype=np.uint64)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0.0
        ids, steps = np.zeros((size + 1, n), np.int64), np.ones((size + 1, n), np.int64)
        lengths = sorted((m for m in self.tables if m <= size), reverse=True)  # the longest first: it keeps a tie
        for end in range(1, size + 1):
            single = np.zeros(n, bool)
            for m in lengths:
                if m > end:
                    continue
                keys, piece, score, letters = self.tables[m]
                key = hashes[:, end] - hashes[:, end - m] * powers[m]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                rows = np.flatnonzero(keys[at] == key)
                if len(rows):  # equal hashes may be of different strings
                    rows = rows[(codes[rows, end - m : end] == letters[at[rows]]).all(axis=1)]
                if m == 1:
                    single[rows] = True
                total = best[end - m, rows] + score[at[rows]]
                better = total > best[end, rows]
                rows = rows[better]
                best[end, rows], ids[end, rows], steps[end, rows] = total[better], piece[at[rows]], m
            rows = np.flatnonzero(~single)
            total = best[end - 1, rows] + self.unknown_score
            better = total > best[end, rows]
            rows = rows[better]
            best[end, rows], ids[end, rows], steps[end, rows] = total[better], -1 - codes[rows, end - 1].astype(np.int64), 1
        out, place, who = np.full((n, size), np.iinfo(np.int64).min), np.full(n, size) if sizes is None else sizes.copy(), np.arange(n)
        for column in range(size - 1, -1, -1):
            out[who, column] = ids[place[who], who]
            place[who] -= steps[place[who], who]
            who = who[place[who] > 0]
            if not len(who):
                break
        used = out != np.iinfo(np.int64).min
        return used.sum(axis=1), out[used]

    def search_long(self, codes: np.ndarray) -> np.ndarray:
        """The ids of one part, however long: a window of places at a time."""
        size, most = len(codes), max(self.tables)
        ids, steps = np.zeros(size + 1, np.int64), np.ones(size + 1, np.uint8)
        best = [0.0]  # the sums up to the last `most` places
        for at in range(0, size, WINDOW):
            to = min(size, at + WINDOW)
            low = max(0, at - most)
            part = codes[low:to].astype(np.uint64) + np.uint64(1)
            hash_, found = np.zeros(len(part), np.uint64), []
            single = np.zeros(to - at, bool)
            for m in range(1, most + 1):  # hash_[k]: of the m characters from low + k on
                if len(part) < m:
                    break
                hash_ = hash_[: len(part) - m + 1] * BASE + part[m - 1 :]
                if m not in self.tables:
                    continue
                keys, piece, score, letters = self.tables[m]
                place = np.minimum(np.searchsorted(keys, hash_), len(keys) - 1)
                begin = np.flatnonzero((keys[place] == hash_) & (np.arange(len(hash_)) + low + m > at))
                begin = begin[(codes[low + begin[:, None] + np.arange(m)] == letters[place[begin]]).all(axis=1)]
                found.append((begin + low + m, np.full(len(begin), m), score[place[begin]], piece[place[begin]]))
                if m == 1:
                    single[begin + low + 1 - at - 1] = True
            alone = np.flatnonzero(~single)
            found.append((alone + at + 1, np.zeros(len(alone), np.int64), np.full(len(alone), self.unknown_score), -1 - codes[at + alone].astype(np.int64)))
            ends, lengths, scores, marks = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((-lengths, ends))  # the longest first: it keeps a tie
            first = len(best) - 1 - at  # best[first + e]: the best sum up to place e
            place, top = at, -np.inf
            chosen_id, chosen_step = [], []
            for e, m, score, mark in zip(ends[order].tolist(), np.maximum(lengths[order], 1).tolist(), scores[order].tolist(), marks[order].tolist(), strict=True):
                if e != place:
                    place, top = e, -np.inf
                    best.append(top)
                    chosen_id.append(0)
                    chosen_step.append(1)
                total = best[first + e - m] + score
                if total > top:
                    top = best[-1] = total
                    chosen_id[-1], chosen_step[-1] = mark, m
            ids[at + 1 : to + 1], steps[at + 1 : to + 1] = chosen_id, chosen_step
            best = best[-most - 1 :]
        out, place = [], size
        while place:
            out.append(place)
            place -= int(steps[place])
        return ids[out[::-1]]

    def _as_bytes(self, counts: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece, marked by negative numbers, as byte pieces or <unk>."""
        if not (flat < 0).any():
            return counts, flat
        values, at = np.unique(flat, return_inverse=True)
        runs = [[v] if v >= 0 else [int(self.bytes_at[b]) for b in chr(-1 - v).encode()] if self.with_bytes else [self.unknown] for v in values.tolist()]
        n = np.array([len(x) for x in runs])
        ends = np.concatenate([[0], np.cumsum(n[at])])
        flat = np.array([i for x in runs for i in x])[_shared.ranges((np.cumsum(n) - n)[at], n[at])]
        return np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]), flat

    def _distinct(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of parts: each one's place among the distinct ones, and those' numbers of ids and ids."""
        keys = np.ascontiguousarray(codes).view(np.dtype((np.void, 4 * codes.shape[1]))).ravel()
        _, first, place = np.unique(keys, return_index=True, return_inverse=True)
        step = max(1, CELLS // codes.shape[1])
        found = [self._as_bytes(*self.search(codes[first[k : k + step]], sizes[first[k : k + step]])) for k in range(0, len(first), step)]
        return place.ravel(), np.concatenate([c for c, _ in found]), np.concatenate([i for _, i in found])

    def _learn(self, units: list[str]) -> None:
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        flat = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        unit_at = np.cumsum(sizes) - sizes
        cut = np.ones(len(flat), bool)
        key = flat[:-1].astype(np.uint64) << np.uint64(32) | flat[1:]
        cut[1:] = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] != key
        cut[unit_at[sizes > 0]] = True
        at = np.flatnonzero(cut)
        length = np.diff(np.append(at, len(flat)))
        width = np.where(length <= 16, length, -(-length // 8) * 8)
        counts, starts, results, used = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), [], 0
        for w in np.unique(width[length <= LONG]).tolist():
            here = np.flatnonzero((width == w) & (length <= LONG))
            places = at[here, None] + np.arange(w)
            codes = np.where(np.arange(w) < length[here, None], flat[np.minimum(places, len(flat) - 1)], PAD)
            place, n, ids = self._distinct(codes, length[here])
            counts[here], starts[here] = n[place], (used + np.cumsum(n) - n)[place]
            results.append(ids)
            used += len(ids)
        for k in np.flatnonzero(length > LONG).tolist():
            ids = self.search_long(flat[at[k] : at[k] + length[k]])
            n, ids = self._as_bytes(np.array([len(ids)]), ids)
            counts[k], starts[k] = n[0], used
            results.append(ids)
            used += len(ids)
        ids = np.concatenate(results)[_shared.ranges(starts, counts)] if results else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        first = np.searchsorted(at, np.append(unit_at, len(flat)))  # each unit's first part
        self.store.keep(units, np.diff(ends[first]), ids.astype(np.uint32))

    def units(self, text: str) -> list[str]:
        """The units of a normalised text."""
        return re.findall(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if self.newline_apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text (no nulls), and all ids."""
        if self.newline_apart:
            lines = pc.split_pattern(texts, "\n")
            line_at, lines = lines.offsets.to_numpy().astype(np.int64), lines.flatten()
            line_at -= line_at[0]
        else:
            line_at, lines = np.arange(len(texts) + 1), texts
        first = np.zeros(len(lines), bool)
        first[line_at[:-1][np.diff(line_at) > 0]] = True
        parts = pc.split_pattern(lines, " ")
        part_at, parts = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
        part_at -= part_at[0]
        # each part stands after a space, but for the first of a line: there is none but the dummy prefix of a text
        bare = np.zeros(len(parts), bool)
        bare[part_at[:-1]] = ~first | (not self.dummy_prefix)
        odd = pc.or_(pc.match_substring(lines, SPACE), pc.or_(pc.match_substring(lines, "  "), pc.or_(pc.starts_with(lines, " "), pc.ends_with(lines, " "))))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False) | (first & pc.equal(lines, "").to_numpy(zero_copy_only=False)))
        units = pc.binary_join_element_wise(pc.if_else(pa.array(bare), "", SPACE), parts, "").dictionary_encode()
        self.store.make_room(len(units.dictionary) + len(odd))
        counts, ids = self.store.gather(self.store.places(units, self._learn))
        line_counts = np.diff(np.concatenate([[0], np.cumsum(counts)])[part_at])
        if len(odd):  # lines with runs of spaces: their units one by one
            ends = np.cumsum(line_counts)
            chunks, at = [], 0
            empty_text = set(line_at[:-1][np.diff(line_at) == 1].tolist())
            for k in odd.tolist():
                line = lines[k].as_py()
                if first[k] and line == "" and k in empty_text:
                    found: list[str] = []  # an empty text has not even a dummy prefix
                else:
                    found = self.units((SPACE if first[k] and self.dummy_prefix else "") + line.replace(" ", SPACE))
                new = [u for u in dict.fromkeys(found) if u not in self.store.place]
                if new:
                    self._learn(new)
                chunks.append(ids[at : ends[k] - line_counts[k]])
                chunks.append(self.store.gather(np.array([self.store.place[u] for u in found], np.int64))[1])
                at, line_counts[k] = ends[k], len(chunks[-1])
            ids = np.concatenate([*chunks, ids[at:]])
        ends = np.concatenate([[0], np.cumsum(line_counts)])
        if self.newline_apart:  # a newline's ids between the lines of a text
            if "\n" not in self.store.place:
                self._learn(["\n"])
            mark = self.store.gather(np.array([self.store.place["\n"]]))[1]
            inner = np.ones(len(lines), bool)
            inner[line_at[:-1][np.diff(line_at) > 0]] = False
            ids = np.insert(ids, np.repeat(ends[:-1][inner], len(mark)), np.tile(mark, int(inner.sum())))
            ends = ends + np.concatenate([[0], np.cumsum(inner * len(mark))])
        return np.diff(ends[line_at]), ids

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> list[str]:
        ids = ids.astype(np.int64)
        raw = self.surface[_shared.ranges(self.surface_at[ids], self.surface_len[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.surface_len[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = [raw[a:b].decode(errors="replace") for a, b in zip(ends, ends[1:], strict=False)]
        return [x.removeprefix(" ") for x in out] if self.dummy_prefix else out


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Column k: the rolling hash, modulo 2**64, of the first k code points of each row."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * BASE + (codes[:, k].astype(np.uint64) + np.uint64(1))
    return out


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """This worker's Pieces of a model file: tasks that follow each other in a worker share them."""
    if path not in _pieces:
        _pieces.clear()
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _lists(counts: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> pa.Array:
    mask = None if valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)), mask=mask)


def encoded(docs: DataFrame, model: str, *, check: bool = False) -> DataFrame:
    """doc_id and ids array<int> of every row of docs (doc_id, text). With check, also the SHA-256 of the ids decoded again, as decoded_sha256, and their number, n_ids."""
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("n_ids", pa.int64()), ("decoded_sha256", pa.string())] * check

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pieces(model)
        for b in batches:
            for at, n in _shared.slices(b.column(1)):
                texts = b.column(1).slice(at, n)
                valid = np.asarray(texts.is_valid())
                counts, ids = held.encode(texts.fill_null(""))
                columns = [b.column(0).slice(at, n), _lists(counts, ids, valid)]
                if check:
                    digests = [hashlib.sha256(x.encode()).hexdigest() for x in held.decode(counts, ids)]
                    columns += [pa.array(counts, mask=~valid), pa.array(digests, pa.string(), mask=~valid)]
                yield pa.record_batch(columns, schema=pa.schema(fields))
        held.store.clear()  # a worker that waits for other work holds the pieces only

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return _shared.arrow(rows, encode, "doc_id long, ids array<int>" + ", n_ids long, decoded_sha256 string" * check)


def decoded(coded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of coded (doc_id, ids array<int>); null ids give null text, null elements <unk>."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pieces(model)
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:  # runs of a million ids or one row
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
                lists = b.column(1).slice(at, to - at)
                valid = np.asarray(lists.is_valid())
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = lists.flatten().fill_null(held.unknown).to_numpy(zero_copy_only=False)
                yield pa.record_batch({"doc_id": b.column(0).slice(at, to - at), "text": pa.array(held.decode(counts, ids), pa.string(), mask=~valid)})
                at = to

    rows = coded.select(coded["doc_id"].cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return _shared.arrow(rows, decode, "doc_id long, text string")
