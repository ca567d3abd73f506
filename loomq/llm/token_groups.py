"""N-gram Jaccard join with a token-group matrix.

Two documents link if their sets of distinct word shingles have a Jaccard similarity of `percent` hundredths or more; the
result is exact, up to equal 64-bit hashes of different shingles.

1. A fixed-size table of counters, filled over all documents, says how common shingles are. It only sets the order in
   which shingles are taken: common ones last.
2. Of each set's shingles in that order, the first few (n - ceil(percent * n) + 1 of n) are its prefix. Linked sets share
   a prefix shingle. Equal sets are one class from here on.
3. Prefix shingles that only one class has are dropped. A class that has an eighth of the others in common with one pivot, the
   first class of about its size that has them, joins that pivot's group.
4. In a group too large for one block, every class is compared with a new pivot P first: the shingles that most of some of
   its members have. They are a bounded number, of the least hashes; the result does not depend on P, only the work does. With k(A) = |A and P| the overlap of two
   members is at least k(A) + k(B) - |P|, so A and B surely link if s(A) + s(B) >= (100 + percent) * |P|, where s(A) =
   (100 + percent) * k(A) - percent * |A|. The group is cut into cells by s. Pairs of cells that surely link are counted by their
   weights and never opened: a family of close copies costs its size, not its square.
5. The matrix holds, for each cell, the union of its members' prefix shingles. Two cells can only hold a linked pair if
   their unions share at least as many as linked sets of their sizes must; only such pairs are opened, block by block, a
   block being a bounded part of a cell.
6. Opening a pair of blocks compares the full sets of their members at once. It gives each member's number of links
   and one link to its local component, never all pairs.
7. Components of those links are components of all links.

Defined cases: with fewer words than a shingle has, the whole sequence is one shingle; without words, or with null text,
a set is empty and links with nothing. Rows that share a doc_id are compared each with its own text. Rows without a
doc_id are not compared: their component_id and n_links are null. A text counts whole, however long. An empty table gives no
rows. Columns but doc_id and text are ignored, whatever their names, and kept by one_of_each().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared
from .components import components

#: Counters of the table of common shingles (a power of two; up to four times as many for large inputs) and the pieces it travels in.
COUNTER_BITS, PIECES = 20, 16
#: The table that says which documents may be wanted has 16 bits for each, within these powers of two; beyond, the join alone sorts them out.
WANTED_BITS = 15, 27
#: Classes and shingles of a block; cells of a group by what its members share with the pivot.
BLOCK, BLOCK_SHINGLES, CELLS = 128, 1 << 20, 64
#: Members of a group, about, whose common shingles make its pivot: fewer where they are long.
SAMPLE, LEAST_SAMPLE = 64, 8
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _fold(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M2 + more
    return h


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M3
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text (no nulls). Words are folded to lower case in A-Z only."""
    offsets, codes, found = _shared.words_of(pc.ascii_lower(texts))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found.to_pylist()), np.uint64, len(found))[codes]
    n = max(0, len(hashes) - words + 1)
    h = hashes[:n] * _M1
    for k in range(1, words):
        h = _fold(h, hashes[k : k + n])
    h = _finish(h)
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        if b - a >= words:
            yield np.unique(h[a : b - words + 1])
        elif b > a:
            one = hashes[a : a + 1] * _M1
            for k in range(a + 1, b):
                one = _fold(one, hashes[k : k + 1])
            yield _finish(one + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def class_id(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set must share with any it links with, of its own n: also how many are not in its prefix, plus 1."""
    return -(-percent * n // 100)


def _batches(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for b in batches:
        for at, n in _shared.slices(b.column(column), 4 << 20):
            part = b.slice(at, n)
            yield part, part.column(column)


def counter_bits(splits: int) -> int:
    return COUNTER_BITS + min(2, (splits.bit_length() - 1) // 8)


def measured(docs: DataFrame, words: int, bits: int = COUNTER_BITS) -> DataFrame:
    """doc_id, c (class of its set), n (shingles) of every document; and, with null n, the counters' pieces of each task."""
    schema = pa.schema([("doc_id", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("piece", pa.int32()), ("counts", pa.binary())])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for part, texts in _batches(batches, 1):
            sets = list(shingle_sets(texts, words))
            counts += np.bincount(np.concatenate(sets) >> np.uint64(64 - bits), minlength=1 << bits) if sets else 0
            rows = [part.column(0), pa.array([class_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            yield pa.record_batch([*rows, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=schema)
        if counts.any():
            squeeze = zstandard.ZstdCompressor()
            blobs = [squeeze.compress(p.astype("<i8").tobytes()) for p in np.split(counts, PIECES)]
            yield pa.record_batch([pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.int32()), pa.array(range(PIECES), pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    return _shared.arrow(docs, measure, "doc_id long, c long, n int, piece int, counts binary")


def common_ranks(pieces: DataFrame, bits: int = COUNTER_BITS) -> np.ndarray:
    """For each counter a rank from 0 to 63: how full it is, in quarters of a standard deviation, in powers of two at the top.

    Most shingles are in one document only and fill all counters alike; one that d documents share lifts its counter by
    d, so that sets take their prefixes from the shingles that few others have. The pieces of all tasks are added up
    piece by piece; the driver gets one table of counters, whatever the input.
    """

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for piece, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(unzip.decompress(blob), "<i8")
                sums[piece] = sums[piece] + part if piece in sums else part
        yield pa.record_batch({"piece": pa.array(sums, pa.int32()), "counts": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    rows = _shared.arrow(pieces.select("piece", "counts").repartition(PIECES, "piece"), add, "piece int, counts binary")
    counts = np.zeros((PIECES, (1 << bits) // PIECES))
    for r in rows.collect():
        counts[r.piece] += np.frombuffer(r.counts, "<i8")
    counts = counts.ravel()
    off = (counts - counts.mean()) / max(1.0, np.sqrt(counts.mean()))
    near, far = 24 + 4 * off, 40 + 3 * np.log2(np.maximum(off, 4) / 4)
    return np.clip(np.where(off < 4, near, far), 0, 63).astype(np.uint8)


def prefix(members: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, rare before common, each kind by hash: enough that linked sets share one."""
    key = (ranks[members >> np.uint64(65 - len(ranks).bit_length())].astype(np.uint64) << np.uint64(58)) | (members >> np.uint64(6))
    size = len(members) - least_overlap(len(members), percent) + 1
    return members[np.argsort(key, kind="stable")[:size]]  # members are in order, so equal keys fall alike in every set


def postings(docs: DataFrame, ranks: np.ndarray, words: int, percent: int) -> DataFrame:
    """(token, c, n) for each prefix shingle of each class; a class comes once from each task that holds it."""

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # of a task's documents, so bounded by its input
        for _, texts in _batches(batches, 0):
            seen: dict[int, tuple[int, np.ndarray]] = {}
            for s in shingle_sets(texts, words):
                if len(s) and (c := class_id(s)) not in given:
                    given.add(c)
                    seen[c] = len(s), prefix(s, ranks, percent)
            sizes = [len(p) for _, p in seen.values()]
            tokens = np.concatenate([p for _, p in seen.values()]) if seen else np.zeros(0, np.uint64)
            cs, ns = np.repeat(np.array(list(seen), np.int64), sizes), np.repeat(np.array([n for n, _ in seen.values()], np.int32), sizes)
            yield pa.record_batch({"token": pa.array(tokens.view(np.int64)), "c": pa.array(cs), "n": pa.array(ns)})

    return _shared.arrow(docs, post, "token long, c long, n int")


def shared_postings(posted: DataFrame, percent: int) -> DataFrame:
    """Of postings, each (token, c) once, those whose token two classes or more have, with `pivot`: the first class of
    the token's run of about this size. Reads sorted rows as a stream, holding one batch, however long a run is."""
    step = np.log(100 / percent)

    def share(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: token, n, c, pivot, whether the row before has its token
        for b in batches:
            if not b.num_rows:
                continue
            token, n, c = (b.column(k).to_numpy() for k in range(3))
            if held:
                token, n, c = np.append(held[0], token), np.append(held[1], n), np.append(held[2], c)
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
            token, n, c = token[fresh], n[fresh], c[fresh]
            size = np.floor(np.log(n) / step)
            same = np.zeros(len(token), bool)
            same[1:] = token[1:] == token[:-1]
            starts = np.ones(len(token), bool)
            starts[1:] = ~same[1:] | (size[1:] != size[:-1])
            run = np.cumsum(starts) - 1
            pivots = c[starts]
            if held:
                pivots[0], same[0] = held[3], held[4]
            pivot = pivots[run]
            keep = same.copy()
            keep[:-1] |= same[1:]
            keep[-1] = False
            held = token[-1], n[-1], c[-1], pivot[-1], same[-1]
            yield pa.record_batch({"token": pa.array(token[keep]), "c": pa.array(c[keep]), "n": pa.array(n[keep]), "pivot": pa.array(pivot[keep])})
        if held and held[4]:
            yield pa.record_batch({"token": pa.array([held[0]], pa.int64()), "c": pa.array([held[2]], pa.int64()), "n": pa.array([held[1]], pa.int32()), "pivot": pa.array([held[3]], pa.int64())})

    rows = posted.repartition("token").sortWithinPartitions("token", "n", "c").select("token", "n", "c")
    return _shared.arrow(rows, share, "token long, c long, n int, pivot long")


def blocks_of(shared: DataFrame, score: Callable[[DataFrame], DataFrame], percent: int, block: int = BLOCK) -> DataFrame:
    """c, n, g, s, cell, block of every class in shared: groups of classes that share an eighth of what they share with one pivot, cut.

    score: gives c, s and whole (what two s must add up to) of the members (c, n, g) of groups that are too large for one block.
    """
    with_pivot = shared.groupBy("c", "n", "pivot").agg(F.count(F.lit(1)).alias("k"))
    best = with_pivot.groupBy("c", "n").agg(F.sum("k").alias("all"), F.max(F.when(F.col("pivot") != F.col("c"), F.struct("k", "pivot"))).alias("best"))
    strong = (F.col("best.k") > 1) & (8 * F.col("best.k") >= F.col("all"))
    grouped = _shared.written(best.select("c", "n", F.when(strong, F.col("best.pivot")).otherwise(F.col("c")).alias("g")), "groups")
    large = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > block).select("g")
    members = _shared.written(grouped.join(large, "g").select("c", "n", "g"), "large")
    if members.isEmpty():
        scored = grouped.select("c", "n", "g", F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("whole"))
    else:
        scored = grouped.join(score(members), "c", "left").select("c", "n", "g", "s", "whole")
    # cells by s, finer where links begin to be sure: from half of what two must add up to
    step = F.floor((2 * F.col("s") - F.col("whole")) * CELLS / F.col("whole")).cast("int")
    celled = scored.withColumn("cell", F.xxhash64("g", F.when(F.col("s").isNotNull(), F.greatest(F.lit(-CELLS), step))))
    parts = celled.groupBy("cell").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    return celled.join(parts, "cell").select("c", "n", "g", "s", "whole", "cell", "parts", F.pmod(F.xxhash64("c"), F.col("parts")).alias("part"))


def cells_of(blocks: DataFrame) -> DataFrame:
    """A row a cell: what its members have in common."""
    return blocks.groupBy("cell").agg(F.first("g").alias("g"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("members"), F.max("parts").alias("parts"), F.min("s").alias("s"), F.first("whole").alias("whole"), F.min("c").alias("least"))


def _surely(a: str, b: str) -> F.Column:
    return F.coalesce((F.col(f"{a}_g") == F.col(f"{b}_g")) & (F.col(f"{a}_s") + F.col(f"{b}_s") >= F.col(f"{a}_whole")), F.lit(False))


def _side(cells: DataFrame, x: str) -> DataFrame:
    return cells.select(F.col("cell").alias(x), *[F.col(k).alias(f"{x}_{k}") for k in cells.columns if k != "cell"])


def sure_links(blocks: DataFrame, cells: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, root, links) of the members of cells that surely link with others: root is a member that all of them are connected with.

    The cell of the greatest s links surely with every cell that does with any, so its least member will do as root. A
    group has a bounded number of cells, so their pairs are few.
    """
    weights = blocks.where("s is not null").join(classes, "c").groupBy("cell").agg(F.sum("weight").alias("weight"))
    held = cells.where("s is not null").join(weights, "cell")
    pairs = _side(held, "a").join(_side(held, "b"), F.col("a_g") == F.col("b_g")).where(_surely("a", "b"))
    counted = pairs.groupBy("a").agg(F.sum("b_weight").alias("links"), F.max(F.when(F.col("a") == F.col("b"), F.lit(1)).otherwise(0)).alias("own"), F.max(F.struct("b_s", "b_least")).alias("top"))
    found = blocks.join(counted.select(F.col("a").alias("cell"), "links", "own", F.col("top.b_least").alias("root")), "cell").join(classes, "c")
    links = F.col("links") - F.col("own") * F.col("weight")
    return found.where(links > 0).select("c", "root", links.alias("links"))


def pairs_to_open(shared: DataFrame, blocks: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks that may hold linked classes which sure_links() does not tell of.

    With sizes x <= y, linked sets share at least percent / (100 + percent) * (x + y); what lies behind the prefix of the
    one whose prefix ends first is at most least_overlap - 1, so their prefixes share the rest. The bound takes the least
    such number over all sizes in the two cells.
    """
    matrix = shared.select("token", "c").join(blocks.select("c", "cell"), "c").select("token", "cell").distinct()
    other = matrix.select("token", F.col("cell").alias("b"))
    counted = matrix.withColumnRenamed("cell", "a").join(other, "token").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    share, rest = percent / (100 + percent), percent / 100
    need = lambda x, y: F.floor(share * F.col(f"{x}_lo") - (rest - share) * F.col(f"{y}_hi") - 1e-6)
    near = (100 * F.col("a_hi") >= percent * F.col("b_lo")) & (100 * F.col("b_hi") >= percent * F.col("a_lo"))
    between = counted.join(_side(cells, "a"), "a").join(_side(cells, "b"), "b").where(near & (F.col("k") >= F.least(need("a", "b"), need("b", "a"))) & ~_surely("a", "b"))
    within = cells.where("members > 1")
    within = within.where(~F.coalesce(2 * F.col("s") >= F.col("whole"), F.lit(False)))
    wide = between.select("a", "b", "a_parts", "b_parts").union(within.select("cell", "cell", "parts", "parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    wide = wide.withColumn("i", each("a_parts")).withColumn("j", each("b_parts")).where("a <> b OR i <= j")
    x, y = F.xxhash64("a", "i"), F.xxhash64("b", "j")
    return wide.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _compare(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets link: a matrix left x right, or left x left without its diagonal and what is under it."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        overlap = np.array([[len(np.intersect1d(*sets, assume_unique=True))]], np.int64)
        if right is None:
            overlap = np.array([[0, overlap[0, 0]], [0, 0]])
    else:
        tokens, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, who = tokens[order], who[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        columns, who = np.unique(column[shared], return_inverse=True)[1], who[shared]
        width = int(columns.max()) + 1 if len(columns) else 0
        overlap = np.zeros((len(left), len(right or left)), np.int64)
        for at in range(0, width, 8192):
            here = (columns >= at) & (columns < at + 8192)
            held = np.zeros((len(sets), min(8192, width - at)), np.float32)
            held[who[here], columns[here] - at] = 1
            overlap += (held[: len(left)] @ (held[len(left) :] if right is not None else held).T).astype(np.int64)
    rows, cols = sizes[: len(left)], sizes[len(left) :] if right is not None else sizes
    linked = (100 + percent) * overlap >= percent * (rows[:, None] + cols[None, :])
    linked &= overlap > 0
    return np.triu(linked, 1) if right is None else linked


def _sets(classes: list[int], texts: list[bytes], words: int, unzip: zstandard.ZstdDecompressor) -> dict[int, np.ndarray]:
    """The shingle set of each class, from texts as zstd: a text of another class, which a shared doc_id may bring, counts for nothing."""
    out: dict[int, np.ndarray] = {}
    at = 0
    while at < len(texts):
        plain, size, first = [], 0, at
        while at < len(texts) and (not plain or size < 4 << 20):
            plain.append(unzip.decompress(texts[at]))
            size, at = size + len(plain[-1]), at + 1
        for c, members in zip(classes[first:at], shingle_sets(pa.array([x.decode() for x in plain], pa.string()), words), strict=True):
            if class_id(members) == c:
                out[c] = members
    return out


def centres(members: DataFrame, words: int) -> DataFrame:
    """members: (g, c, text as zstd), a bounded number of each group. (g, centre): the shingles that more than half of them have."""

    def centre(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        at, held = None, {}

        def done() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(list(held.values())), return_counts=True)
            return pa.record_batch({"g": pa.array([at], pa.int64()), "centre": pa.array([squeeze.compress(tokens[2 * counts > len(held)].tobytes())], pa.binary())})

        for b in batches:
            for g, c, text in zip(*(b.column(k) for k in range(3)), strict=True):
                if g.as_py() != at:
                    if held:
                        yield done()
                    at, held = g.as_py(), {}
                held |= _sets([c.as_py()], [text.as_py()], words, unzip)
        if held:
            yield done()

    rows = members.repartition("g").sortWithinPartitions("g").select("g", "c", "text")
    return _shared.arrow(rows, centre, "g long, centre binary")


def pivot_overlaps(members: DataFrame, words: int, percent: int) -> DataFrame:
    """members: (g, part, c, text as zstd), and in each part, without c, the pivot's shingles as zstd. (c, s, whole) of each member.

    Reads sorted rows as a stream: one pivot's set and some megabytes of members are held.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        at, pivot = None, None
        for b in batches:
            g, part = (b.column(k).to_numpy() for k in range(2))
            edges = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (part[1:] != part[:-1])]).tolist() if len(g) else []
            for x, y in zip(edges, [*edges[1:], len(g)], strict=True):
                if at != (at := (int(g[x]), int(part[x]))):
                    pivot = None
                if not b.column(2)[x].is_valid:
                    pivot, x = np.frombuffer(unzip.decompress(b.column(3)[x].as_py()), np.uint64), x + 1
                if pivot is None or not len(pivot):  # the group has no such shingles: none of its links is sure
                    continue
                for k, n in _shared.slices(b.column(3).slice(x, y - x), 1 << 20):  # packed bytes
                    rows = range(x + k, x + k + n)
                    found = _sets([b.column(2)[r].as_py() for r in rows], [b.column(3)[r].as_py() for r in rows], words, unzip)
                    s = [(100 + percent) * int(np.isin(m, pivot, assume_unique=True).sum()) - percent * len(m) for m in found.values()]
                    yield pa.record_batch({"c": pa.array(list(found), pa.int64()), "s": pa.array(s, pa.int64()), "whole": pa.array([(100 + percent) * len(pivot)] * len(s), pa.int64())})

    rows = members.repartition("g", "part").sortWithinPartitions("g", "part", F.col("c").isNotNull()).select("g", "part", "c", "text")
    return _shared.arrow(rows, compare, "c long, s long, whole long").distinct()


def opened(members: DataFrame, words: int, percent: int) -> DataFrame:
    """members: (a, b, block, c, weight, text as zstd) of each pair of blocks to open. (c, root, links) of each class that links.

    root: the least class of its component within the pair. links: documents linked with c through this pair. Pairs are
    opened one by one, and the sets of the first block stay while it does: two blocks are held unpacked at most.
    """
    names = ("c", "root", "links")

    def open_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        kept: dict[str, object] = {"a": None, "sets": {}}

        def side(rows: pa.Table, of: np.ndarray) -> tuple[list[int], list[int], list[np.ndarray]]:
            """Class, weight and set of the rows `of`, each class once."""
            held = rows.take(pa.array(of))
            classes = held.column(3).to_pylist()
            sets = _sets(classes, held.column(5).to_pylist(), words, unzip)
            weights = dict(zip(classes, held.column(4).to_pylist(), strict=True))
            return list(sets), [weights[c] for c in sets], list(sets.values())

        def results(rows: pa.Table) -> list[tuple[int, int, int]]:
            a, b, block = rows.column(0)[0].as_py(), rows.column(1)[0].as_py(), rows.column(2).to_numpy()
            if kept["a"] != a:
                kept["a"], kept["sets"] = a, side(rows, np.flatnonzero(block == a))
            c, weight, left = kept["sets"]
            right = None
            if a != b:
                more, more_weight, right = side(rows, np.flatnonzero(block == b))
                c, weight = c + more, weight + more_weight
            if not left or right == []:
                return []
            i, j = np.nonzero(_compare(left, right, percent))
            j = j if right is None else j + len(left)
            root = {k: k for k in set(i.tolist()) | set(j.tolist())}

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            links = dict.fromkeys(root, 0)
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                links[x] += weight[y]
                links[y] += weight[x]
                rx, ry = find(x), find(y)
                if rx != ry:
                    root[max(rx, ry, key=lambda k: c[k])] = min(rx, ry, key=lambda k: c[k])
            return [(c[k], c[find(k)], links[k]) for k in root]

        def batch(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=names)

        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            part = pa.Table.from_batches([b])
            part = pa.concat_tables([held, part]).combine_chunks() if held is not None else part
            x, y = part.column(0).to_numpy(), part.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]).tolist()
            out = []
            for s, e in zip(edges, edges[1:], strict=False):
                out += results(part.slice(s, e - s))
            if out:
                yield batch(out)
            held = part.slice(edges[-1])
        if held is not None and held.num_rows:
            yield batch(results(held))

    rows = members.repartition("a", "b").sortWithinPartitions("a", "b").select("a", "b", "block", "c", "weight", "text")
    return _shared.arrow(rows, open_all, "c long, root long, links long")


def wanted_bits(ids: DataFrame) -> np.ndarray | None:
    """Which residues of the hashes of ids.doc_id occur, as bits, 16 for each id. The driver gets 4 KB for each 2**15 of them.

    None where that would pass the greatest size: then most texts travel anyway, and the join sorts them out.
    """
    low, high = WANTED_BITS
    power = max(low, (16 * ids.count()).bit_length())
    if power > high:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << power)) + 1  # Spark counts these bits from 1
    rows = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros((1 << power - 15, 1 << 12), np.uint8)
    for r in rows:
        out[r.b - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def squeezed(docs: DataFrame, bits: np.ndarray | None) -> DataFrame:
    """doc_id and text, as zstd, of those docs (doc_id, text) that bits leave in: all that are wanted, and few others."""
    size = 1 if bits is None else 8 * len(bits)

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            place = b.column(2).to_numpy()
            if bits is not None:
                b = b.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            for at, n in _shared.slices(b.column(1)):
                texts = [z.compress(t.as_buffer()) for t in b.column(1).slice(at, n)]
                yield pa.record_batch({"doc_id": b.column(0).slice(at, n), "text": pa.array(texts, pa.binary())})

    return _shared.arrow(docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("p")), squeeze, "doc_id long, text binary")


def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and n_links of every row of docs (doc_id, text)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _shared.text_or_empty(docs).alias("text"))
    bits = counter_bits(_shared.input_splits(rows))
    measures = _shared.written(measured(rows, words, bits), "measured")
    sized = measures.where("n is not null").select("doc_id", "c", "n")
    ranks = common_ranks(measures.where("n is null"), bits)
    classes = sized.where("doc_id is not null and n > 0").groupBy("c").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    classes = _shared.written(classes, "classes")

    held = rows.where("doc_id is not null")
    shared = _shared.written(shared_postings(postings(held.select("text"), ranks, words, percent), percent), "shared")

    def score(members: DataFrame) -> DataFrame:
        """Members' overlaps with their pivots: each member's text travels once, some of a group's twice, a pivot once for each 1024 members."""
        parts = members.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
        sample = F.greatest(F.lit(LEAST_SAMPLE), F.least(F.lit(SAMPLE), F.floor(4 * BLOCK_SHINGLES * F.col("size") / F.col("total"))))  # fewer of long texts
        sampled = F.pmod(F.xxhash64("c", "g"), F.ceil(F.col("size") / sample)) == 0
        dealt = members.join(parts, "g").select("g", "c", F.pmod(F.xxhash64("c"), F.ceil(F.col("size") / 1024)).cast("int").alias("part"), sampled.alias("sampled"))
        asked = _shared.written(dealt.join(classes.select("c", F.col("first").alias("doc_id")), "c"), "asked")
        texts = squeezed(held, wanted_bits(asked))
        mine = _shared.written(asked.join(texts, "doc_id").select("g", "part", "c", "sampled", "text"), "members")
        pivots = _shared.written(centres(mine.where("sampled").select("g", "c", "text"), words), "pivots")
        dealt = pivots.join(parts, "g").select("g", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / 1024).cast("int") - 1)).alias("part"), F.lit(None).cast("long").alias("c"), F.col("centre").alias("text"))
        found = pivot_overlaps(mine.select("g", "part", "c", "text").union(dealt), words, percent)
        return _shared.written(found, "scored")

    blocks = _shared.written(blocks_of(shared, score, percent), "blocks")
    cells = _shared.written(cells_of(blocks), "cells")
    pairs = _shared.written(pairs_to_open(shared, blocks, cells, percent), "pairs")

    live = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).distinct()
    placed = blocks.select("c", F.xxhash64("cell", F.col("part").cast("int")).alias("block"))
    wanted = placed.join(live, "block").join(classes, "c").select("block", "c", "weight", F.col("first").alias("doc_id"))
    wanted = _shared.written(wanted, "wanted")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).join(wanted, "block")
    texts = squeezed(held, wanted_bits(wanted))
    links = opened(sides.join(texts, "doc_id"), words, percent).union(sure_links(blocks, cells, classes))
    links = _shared.written(links, "opened")

    labels = components(links.select(F.col("c").alias("a"), F.col("root").alias("b")))
    found = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    # a table of its own, so that the join below can split a component that holds many classes
    least = _shared.written(found.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    counted = links.groupBy("c").agg(F.sum("links").alias("links"))
    by_class = found.join(least, "label").join(counted, "c", "left").select("c", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    by_class = _shared.written(by_class, "by_class")
    alone = F.col("doc_id").isNotNull()
    return sized.join(by_class, "c", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(alone, F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs that are the first, by doc_id, of their component, with the columns of docs.

    Of rows that share a doc_id the one of the least text hash stays; rows without a doc_id all stay.
    """
    gone, nth = _shared.fresh(docs, "_gone"), _shared.fresh(docs, "_nth")
    found = jaccard_components(docs, words=words, percent=percent)
    drop = found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    held = docs.where("doc_id is not null")
    left = held.join(drop, held["doc_id"] == drop[gone], "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(F.coalesce("text", F.lit("")))))
    kept = left.withColumn(nth, first).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null"))  # which may be many, and need no grouping
