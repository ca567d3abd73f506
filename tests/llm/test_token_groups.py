import random

import numpy as np
import pytest

from loomq.llm import token_groups as g
from loomq.llm.components import components

from llm_cases import SCHEMA, WORD, invented

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, words, percent):
    """doc_id -> (shingles, component, links), for rows of distinct doc_ids."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    near = {i: [j for j, b in sets.items() if j != i and a and b and 100 * len(a & b) >= percent * len(a | b)] for i, a in sets.items()}
    label = {i: i for i in sets}
    for i in sorted(sets):
        todo, seen = [i], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                label[x] = min(label[x], i)
                todo += near[x]
    return {i: (len(sets[i]), label[i], len(near[i])) for i in sets}


def family(rng, n, edits, size=120):
    base = invented(rng, size, 5000).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w[rng.randrange(3) :]))
    return out


@pytest.mark.parametrize(("seed", "words", "percent", "block"), [(1, 5, 75, 128), (2, 5, 75, 4), (3, 2, 50, 8), (4, 1, 90, 128), (5, 5, 60, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, words, percent, block):
    monkeypatch.setattr(g.blocks_of, "__defaults__", (block,))
    rng = random.Random(seed)
    texts = family(rng, 60, 4) + family(rng, 40, 6, 60) + family(rng, 5, 1, 30) + ["The same Text here now"] * 9 + ["the SAME text here now", "short one", "Short ONE", "x", "", None]
    passage = invented(rng, 60, 5000)
    texts += [f"{invented(rng, rng.randrange(5, 200), 5000)} {passage}" for _ in range(40)] + [passage] * 3 + [invented(rng, 40, 30) for _ in range(30)]
    rng.shuffle(texts)
    rows = [(7 * k + 3, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in g.jaccard_components(df, words=words, percent=percent).collect()}
    assert got == plain(rows, words, percent)


def test_the_border_of_the_threshold(spark):
    a = [f"a{k}" for k in range(11)]  # 7 shingles; 6 of 8 is 0.75, 5 of 7 is less
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1] + ["q"])), (3, " ".join(a[1:] + ["r"])), (4, " ".join(["s", *a[1:]]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in g.jaccard_components(df).collect()}
    assert got == plain(rows, 5, 75) and got[3] == (7, 1, 2)


def test_odd_rows(odd, none):
    got = g.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.n_links))
    assert by[1] == by[2] == by[3] == [(0, by[1][0][1], 0)] or (by[1], by[2], by[3]) == ([(0, 1, 0)], [(0, 2, 0)], [(0, 3, 0)])
    assert by[4] == [(1, 4, 2)] and sorted(by[5]) == [(1, 4, 2), (1, 4, 2), (2, 5, 0)]
    assert by[None] == [(1, None, None)] * 2 and by[8] == [(1, 8, 0)]
    assert g.jaccard_components(none).count() == 0
    one = g.one_of_each(odd)
    assert one.columns == odd.columns and g.one_of_each(none).count() == 0
    ids = [r.doc_id for r in one.collect()]
    assert ids.count(None) == 2 and sorted(i for i in ids if i is not None) == [-9, 1, 2, 3, 4, 6, 7, 8, 2**62]


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(0)
    for _ in range(300):
        ranks = rng.integers(0, 64, 1 << g.COUNTER_BITS).astype(np.uint8)
        pool = rng.integers(0, 2**64, 60, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(5, 55))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * len(np.union1d(a, b)):
            assert len(np.intersect1d(g.prefix(a, ranks, 75), g.prefix(b, ranks, 75)))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 99), (99, 98), (7, 7), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {98: 98, 99: 98, 100: 98}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_schema_is_that_of_documents(spark):
    assert g.one_of_each(spark.createDataFrame([(1, "a b", "en", "s")], SCHEMA)).collect()[0].asDict() == {"doc_id": 1, "text": "a b", "lang": "en", "source": "s"}


def test_a_family_of_close_copies_is_not_opened_pair_by_pair(spark, monkeypatch):
    """500 copies with up to three changed words, and some looser ones: links are exact, though few pairs of blocks are opened."""
    monkeypatch.setattr(g.blocks_of, "__defaults__", (8,))
    rng = random.Random(6)
    texts = family(rng, 500, 3, 200) + family(rng, 60, 9, 150)
    rows = list(enumerate(texts))
    seen = []
    pairs_to_open = g.pairs_to_open
    monkeypatch.setattr(g, "pairs_to_open", lambda *a: seen.append(pairs_to_open(*a).distinct()) or seen[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in g.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == plain(rows, 5, 75)
    assert seen[0].count() < 0.25 * (560 / 8) ** 2 / 2
