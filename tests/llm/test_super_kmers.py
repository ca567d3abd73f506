import hashlib
import random
from collections import defaultdict

import pytest

from loomq.llm import super_kmers as s

from llm_cases import WORD, invented


def plain(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k + o for k in range(len(w) - width + 1) if i is not None and least[tuple(w[k : k + width])] < i for o in range(width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def run(spark, rows, width, run, most):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted(map(tuple, s.deduplicated(df, width=width, run=run, most=most, texts=True).collect()), key=str)


def corpus(seed, n, width):
    rng = random.Random(seed)
    passages = [invented(rng, width + rng.randrange(-1, 30)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [invented(rng, rng.randrange(0, 2 * width))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), invented(rng, rng.randrange(0, width))]
        rows.append((rng.randrange(n), rng.choice([" ", "\n", " \t"]).join(parts)))
    return rows + [(n + k, rows[0][1]) for k in range(4)] + [(n + 9, "same " * 400), (n + 10, "same " * 300), (None, rows[0][1])]


@pytest.mark.parametrize(("width", "run_", "most"), [(50, 16, 20_000), (50, 16, 3), (12, 5, 20_000), (12, 12, 2), (7, 1, 5), (1, 1, 20_000)])
def test_equals_brute_force(spark, width, run_, most):
    rows = corpus(width + most, 40, width)
    assert run(spark, rows, width, run_, most) == plain(rows, width)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(map(tuple, s.deduplicated(odd, width=3, run=2, texts=True).collect()), key=str)
    assert got == plain(rows, 3)
    assert s.deduplicated(none).count() == 0
    with pytest.raises(ValueError, match="longer"):
        s.deduplicated(none, width=3, run=4)


def test_equal_windows_have_equal_minimisers():
    import pyarrow as pa

    rng = random.Random(2)
    text = invented(rng, 300, 30)
    other = invented(rng, 40, 30) + " " + text + " " + invented(rng, 700, 3)
    seen = defaultdict(set)
    for t in (text, other):
        w = s.Words(pa.array([t]))
        _, first, n, m = w.super_kmers(50, 16)
        assert n.max() <= s.LONGEST and n.sum() == len(w.hashes) - 49
        for a, k, v in zip(first.tolist(), n.tolist(), m.tolist(), strict=True):
            for x in range(a, a + k):
                seen[w.text(x, x + 50)].add(v)
    assert all(len(v) == 1 for v in seen.values())


def test_hash_collisions_are_found(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(s, "run_hashes", lambda words, run: np.zeros(max(0, len(words) - run + 1), np.uint64))
    w = s.Words(pa.array(["a b c d", "a b x d"]))
    keys = s._window_keys(w, np.array([0, 1, 2, 4, 5, 6]), 2)
    assert keys[0] == keys[3] and len(set(keys.tolist())) == 5
