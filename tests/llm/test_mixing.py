import random
from collections import defaultdict
from fractions import Fraction

import numpy as np

from evidentia.llm import mixing


def water_level(sizes, weights, share=1.5, most=2):
    """Targets by bisection: min(most x size, level x weight), with the level at which they add up to the share."""
    low, high = 0.0, most * sum(sizes) + 1.0
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(most * s, level * w) for s, w in zip(sizes, weights)) < share * sum(sizes):
            low = level
        else:
            high = level
    return [min(most * s, high * w) for s, w in zip(sizes, weights)]


def test_targets_against_bisection():
    r = random.Random(8)
    for n in (1, 2, 7, 40):
        for _ in range(20):
            sizes, weights = [r.choice([0, 1, 10, r.randrange(10**6)]) for _ in range(n)], [(3, 1, 2)[k % 3] for k in range(n)]
            for a, b in zip(mixing.targets(sizes, weights), water_level(sizes, weights)):
                assert abs(float(a) - b) <= 1e-6 * max(1, b)


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200, Fraction(250, 3), Fraction(500, 3)]
    assert mixing.targets([0, 50], [3, 1]) == [0, 75]
    assert mixing.targets([], []) == [] and mixing.targets([0], [3]) == [0]
    for t, s in zip(mixing.targets([5, 1000, 7, 90], [3, 1, 2, 3]), [5, 1000, 7, 90]):
        assert t <= 2 * s
    assert sum(mixing.targets([5, 1000, 7, 90], [3, 1, 2, 3])) == Fraction(3, 2) * 1102


def test_splitting_tree_is_exact_and_fair():
    q = np.array([1000, 0, 37, 4000])
    tree = mixing.splitting_tree(q, 7, np.random.default_rng(1))
    assert tree.shape == (7, 4) and (tree.sum(axis=0) == q).all()
    assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 3
    mean = np.mean([mixing.splitting_tree(q, 7, np.random.default_rng(k)) for k in range(300)], axis=0)
    assert np.allclose(mean, q / 7, rtol=0.1, atol=0.5)


def test_near_subset():
    r = np.random.default_rng(5)
    assert mixing.near_subset(np.array([9000, 10, 500, 40]), 520).tolist() == [False, True, True, False]
    assert mixing.near_subset(np.array([700, 300, 600]), 900).tolist() == [False, True, True]
    assert mixing.near_subset(np.array([100]), 60).tolist() == [True] and mixing.near_subset(np.array([100]), 40).tolist() == [False]
    assert mixing.near_subset(np.zeros(0, np.int64), 5).tolist() == [] and mixing.near_subset(np.array([0, 5]), 0).tolist() == [True, False]
    for _ in range(50):
        w = r.integers(0, 3000, 60)
        rest = int(w.sum() * r.random())
        assert abs(int(w[mixing.near_subset(w, rest)].sum()) - rest) <= 30
    import itertools

    for _ in range(30):
        w = r.integers(0, 900, 8)
        rest = int(w.sum() * r.random())
        best = min(abs(sum(x for x, t in zip(w, p) if t) - rest) for p in itertools.product((0, 1), repeat=8))
        assert abs(int(w[mixing.near_subset(w, rest)].sum()) - rest) == best


def fixture(n=9000):
    r = random.Random(2)
    rows = [(k, "w " * r.choice([1, 5, 20, 300]), r.choice(["src0"] * 5 + ["src1", "é", "Z", None])) for k in range(n)]
    return [*rows, (None, "a b", "src1"), (5, None, "src0"), (5, None, "src0"), (6, "", None), (7, "one two", "only"), (7, "one two", "only"), (8, "", "nothing")]


def test_query(spark, tmp_path, monkeypatch):
    rows = fixture()
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and len(r.places) <= 2
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for s, t in zip(names, water_level([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])):
        assert abs(target[s] - t) < 1e-4
        assert abs(taken[s] - t) <= max(4, 0.002 * t), s
    assert {r.source_size for r in got if r.source == "src0"} == {size["src0"]}
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.query(spark, str(tmp_path)).collect()))
    assert len({p.out_shard for r in got for p in r.places}) == mixing.OUTPUT_SHARDS
    # levels: a source cut into parts as well
    monkeypatch.setattr(mixing, "FEW", 4)
    monkeypatch.setattr(mixing, "BLOCKS", 32)
    plan = mixing.plan_mixture(spark.read.parquet(f"{tmp_path}/documents.parquet")).selectExpr("source", "size * size(places) AS w").groupBy("source").sum("w").collect()
    for r in plan:
        assert abs(r[1] - target[r.source]) <= max(600, 0.01 * target[r.source])


def test_mix_repeats_rows(spark):
    rows = fixture(500)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, places string")
    plan = {(r.doc_id, r.source, r.size): len(r.places) for r in mixing.plan_mixture(df).collect()}
    got = defaultdict(int)
    out = mixing.mix(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r.doc_id, r.source, len((r.text or "").split())] += 1
    want = defaultdict(int)
    for i, t, s in rows:
        want[i, s, len((t or "").split())] += plan[i, s, len((t or "").split())]
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_small_sources_are_cut_into_blocks(spark):
    r = random.Random(4)
    rows = [(k, "w " * r.choice([1, 5, 20, 300]), f"s{k % 3}") for k in range(900)]
    plan = mixing.plan_mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    shards, units = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    taken, target = defaultdict(int), {}
    for x in plan:
        taken[x.source] += x.size * len(x.places)
        target[x.source] = x.target
        for p, place in enumerate(x.places):
            shards[x.source, p][place.out_shard] += 1
            units[place.out_shard] += 1
    for s in target:  # 300 documents a source: each full pass reaches all shards, in even parts
        assert abs(taken[s] - target[s]) <= max(4, 0.002 * target[s])
        assert len(shards[s, 0]) == mixing.OUTPUT_SHARDS and max(shards[s, 0].values()) < 300 / 4
    assert max(units.values()) <= 2 * min(units.values())


def test_more_sources_than_are_broadcast(spark):
    rows = [(k, "w " * (1 + k % 7), f"site{k % 1203:04}" if k % 1203 else None) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mixture(df).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for x in plan:
        size[x.source] += x.size
        taken[x.source] += x.size * len(x.places)
        target[x.source] = x.target
    assert len(plan) == len(rows) and len(size) == 1203
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])
    for s, t in zip(names, want):
        assert abs(target[s] - float(t)) < 1e-6 and abs(taken[s] - float(t)) <= 7
    assert mixing.mix(df).count() == sum(len(x.places) for x in plan)
    assert len({p.out_shard for x in plan for p in x.places}) == mixing.OUTPUT_SHARDS
