import math

import numpy as np
import pytest

from loomq.llm.vantage_points import Tree, nearest


def plain(ids, x, k, asked):
    out = []
    for i, q in zip(ids, x, strict=True):
        if i in asked:
            s = (x * q).sum(1)
            out += [(i, r + 1, ids[j]) for r, j in enumerate([j for j in np.lexsort((ids, -s)) if ids[j] != i][:k])]
    return set(out)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")


def test_factor_one_is_exact_with_ties_and_all_norms(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6)) * rng.uniform(0.1, 4, (900, 1))
    x[100:160] = x[99]  # a vector with many copies
    ids = rng.permutation(900)
    df = frame(spark, ids, x)
    asked = {int(i) for i in ids if i % 20 == 0} | {int(ids[120])}
    got = nearest(df, df.where(df.vec_id.isin(sorted(asked))), k=20, factor=1.0, shard_rows=250, query_rows=10).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == plain(ids, x, 20, asked)
    at = {int(i): v for i, v in zip(ids, x, strict=True)}
    assert all(r.score == pytest.approx(float(at[r.query_id] @ at[r.vec_id]), abs=1e-12) for r in got)


def test_recall_of_the_production_factor(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    asked = {int(i) for i in ids if i % 20 == 0}
    got = {(r.query_id, r.vec_id) for r in nearest(df, df.where("vec_id % 20 = 0"), shard_rows=700).collect()}
    want = {(q, v) for q, _, v in plain(ids, x, 20, asked)}
    assert len(got & want) / len(want) >= 0.9


def test_pruning_only_grows_with_the_factor():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 2))
    t = Tree(np.arange(20_000), x, float(np.linalg.norm(x, axis=1).max()))
    back = Tree.load(t.dump())
    opened = []
    for factor in (1.0, 2.0, 50.0):
        back.visits = 0
        visit = back._visit
        back._visit = lambda *a, visit=visit: (setattr(back, "visits", back.visits + 1), visit(*a))[1]
        list(back.answer(np.arange(5), x[:5], 3, factor))
        opened.append(back.visits)
        back._visit = visit
    assert opened[0] >= opened[1] >= opened[2]


def test_odd_vectors_take_no_part(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, -0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (40, None), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()
    assert {r.vec_id for r in got} == {0, 1, 20} and {r.query_id for r in got} == {0, 20}
    empty = df.limit(0)
    assert nearest(empty, empty).count() == 0 and nearest(df, empty).count() == 0 and nearest(empty, df).count() == 0
    with pytest.raises(ValueError, match="factor"):
        nearest(df, df, factor=0.5)


def clouds(n):
    """Vectors that trees do prune, and such that they hardly can: tied, Gaussian, of few dimensions, of varying lengths, in clusters."""
    rng = np.random.default_rng(1)
    low = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 32))
    tied = rng.integers(-1, 2, (n, 8)).astype(float)
    tied[(tied == 0).all(axis=1), 0] = 1
    return {
        "gaussian": rng.normal(size=(n, 32)), "lengths": low * rng.uniform(0.1, 3, (n, 1)), "unit": low / np.linalg.norm(low, axis=1, keepdims=True),
        "clusters": rng.normal(size=(40, 32))[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, 32)), "tied": tied,
    }


@pytest.mark.parametrize("name", ["gaussian", "lengths", "unit", "clusters", "tied"])
def test_chosen_factors_hold_recall_where_trees_prune(name, record_property):
    x, k = clouds(6000)[name], 20
    ids = np.random.default_rng(2).permutation(6000)
    t = Tree(ids, x, float(np.linalg.norm(x, axis=1).max()))
    place = {int(i): p for p, i in enumerate(ids)}
    own = np.arange(0, 6000, 20)
    q = x[[place[int(i)] for i in own]]
    want = {(o, v) for o, _, v in plain(ids, x, k, set(own.tolist()))}
    who, found, _ = t.answer(own, q, k, 1.0)
    assert [(int(own[w]), int(f)) for w, f in zip(who, found, strict=True)] == [(o, v) for o, _, v in sorted(plain(ids, x, k, set(own.tolist())))]
    t.seen = t.asked = 0
    factor = t.factor_for(k)
    who, found, _ = t.answer(own, q, k, factor)
    recall = len(want & {(int(own[w]), int(f)) for w, f in zip(who, found, strict=True)}) / len(want)
    record_property("points seen", t.seen / t.asked)
    assert recall >= 0.9 and (name not in ("lengths", "unit") or t.seen < 0.5 * t.asked), (factor, recall, t.seen / t.asked)


def test_own_copies_and_ties_push_nothing_out(spark):
    rows = [(20, [1.0, 0.0])] * 30 + [(41, [1.0, 0.0]), (42, [0.1, 0.0]), (43, [1.0, 5.0]), (44, [1.0, -5.0])] + [(100 + k, [0.5, float(k)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for shard_rows in (50, 1000):
        got = nearest(df, df.where("vec_id = 20"), k=3, shard_rows=shard_rows).orderBy("rank").collect()
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(20, 1, 41, 1.0), (20, 2, 43, 1.0), (20, 3, 44, 1.0)]


def test_exact_over_shards_with_whole_numbers_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 2, (400, 6)).astype(float)
    x[(x == 0).all(axis=1), 0] = 1
    ids = rng.permutation(400)
    df = frame(spark, ids, x).selectExpr("*", "1 AS dim", "2 AS shard", "3 AS block", "4 AS ids", "5 AS vectors")
    asked = {int(i) for i in ids if i % 20 == 0}
    got = nearest(df, df.where("vec_id % 20 = 0"), k=20, factor=1.0, shard_rows=90, query_rows=7).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == plain(ids, x, 20, asked)
