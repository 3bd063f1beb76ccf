"""Boosted trees and forests against plain ones on small data."""
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from orderlens.operators import trees
from orderlens.operators.trees import Block, Boost, Forest, Layout


def data(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(r.randrange(8)), float(r.randrange(5)), float(r.random() < 0.4), float(r.random() < 0.2)]
        y = float((x[0] > 3) != (x[2] > 0) if r.random() < 0.9 else r.random() < 0.5)
        rows.append((i, x, y, r.choice([1.0, 1.0, 2.0])))
    return rows


def layout():
    return Layout([np.arange(7.0), np.arange(4.0), np.array([0.5]), np.array([0.5])])


def block(rows):
    x = np.array([r[1] for r in rows])
    return Block(layout().codes(x), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]),
                 np.array([r[0] for r in rows], dtype=np.uint64), np.zeros(len(rows), np.int32))


def plain_tree(x, g, h, how, rows, depth):
    """Every split of every slot, by loops: nested (slot, cut, left, right) or a leaf's weight."""
    G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
    best = (1e-9, None)
    if depth:
        for slot in range(4):
            for cut in sorted({x[i][slot] for i in rows} | {0.0})[:-1] if slot < 2 else [0.0]:
                a, b = [i for i in rows if x[i][slot] <= cut], [i for i in rows if x[i][slot] > cut]
                gl, hl, gr, hr = (sum(v[i] for i in part) for part in (a, b) for v in (g, h))
                if not a or not b or min(hl, hr) < how.min_child_weight:
                    continue
                gain = gl * gl / (hl + how.l2) + gr * gr / (hr + how.l2) - G * G / (H + how.l2)
                if gain > best[0] + 1e-9:
                    best = (gain, (slot, cut, a, b))
    if best[1] is None:
        return -how.rate * G / (H + how.l2)
    slot, cut, a, b = best[1]
    return slot, cut, plain_tree(x, g, h, how, a, depth - 1), plain_tree(x, g, h, how, b, depth - 1)


def value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("how", [Boost(5, 0.3, 3, 1.0, 1.0, 1.0, 1.0), Boost(4, 0.1, 4, 1.0, 1.0, 5.0, 2.0, 3.0), Boost(3, 0.5, 2, 1.0, 1.0, 0.0, 5.0)])
def test_boosting_equals_every_split(how):
    rows = data()
    found, start = trees.boost_rows(block(rows), layout(), how)
    x, y = [r[1] for r in rows], [r[2] for r in rows]
    w = [r[3] * (how.positive_weight if r[2] else 1) for r in rows]
    p = sum(a for a, b in zip(w, y) if b) / sum(w)
    assert math.isclose(start, math.log(p / (1 - p)))
    margin, codes = [start] * len(rows), layout().codes(np.array(x))
    for tree in found:
        q = [1 / (1 + math.exp(-m)) for m in margin]
        plain = plain_tree(x, [(a - b) * c for a, b, c in zip(q, y, w)], [a * (1 - a) * c for a, c in zip(q, w)], how, range(len(rows)), how.depth)
        got = tree.value[tree.nodes(codes)]
        assert np.allclose(got, [value(plain, v) for v in x])
        margin = [m + v for m, v in zip(margin, got)]


def test_no_child_below_its_least_hessian():
    rows = data()
    how = Boost(6, 0.3, 5, 0.8, 0.5, 7.0, 1.0)
    found, start = trees.boost_rows(block(rows), layout(), how)
    b, margin = block(rows), np.full(len(rows), start)
    for number, tree in enumerate(found):
        p = 1 / (1 + np.exp(-margin))
        some = trees.draw(b.key, how.seed, number, 0) < how.subsample
        ends = tree.nodes(b.codes)
        if tree.slot[0] >= 0:
            assert np.bincount(ends[some], (p * (1 - p) * b.w)[some], len(tree.slot))[np.unique(ends[some])].min() >= 7.0 - 1e-9
            assert set(tree.slot[tree.slot >= 0].tolist()) <= set(np.flatnonzero(how.columns(number, 4)[0]).tolist())
        margin = margin + tree.value[ends]


def frame(spark, rows, parts):
    named = [(i, Vectors.dense(x), y, w) for i, x, y, w in rows]
    return spark.createDataFrame(named, ["order_id", "features", "label", "weight"]).repartition(parts)


def test_distributed_trees_equal_those_of_one_block(spark, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK_ROWS", 90)
    monkeypatch.setattr(trees, "STORED_EVERY", 2)
    rows = data()
    df = frame(spark, rows, 5)
    lay = trees.layout_of(df, "features", 32)
    x = np.array([r[1] for r in rows])
    want = [np.unique(np.percentile(x[:, k], [100 * q / 32 for q in range(1, 32)])) for k in range(4)]
    assert all(np.allclose(a, b) for a, b in zip(lay.cuts, want))
    held = trees.blocks_of(df, lay, "features", "label", "weight", "order_id")
    assert held.getNumPartitions() == 5
    whole = held.collect()
    one = Block(*(np.concatenate([getattr(b, c) for b in whole]) for c in ("codes", "y", "w", "key", "fold")))
    how = Boost(7, 0.3, 3, 0.8, 0.75, 1.0, 1.0)
    (a, sa), (b, sb) = trees.boost_blocks(held, lay, how), trees.boost_rows(one, lay, how)
    assert math.isclose(sa, sb) and len(a) == len(b) == 7
    for x, y in zip(a, b):
        assert x.slot.tolist() == y.slot.tolist() and x.cut.tolist() == y.cut.tolist() and np.allclose(x.value, y.value)
    deep = Forest(6, 5, 2, "sqrt")
    for x, y in zip(trees.forest_blocks(held, lay, deep), trees.forest_rows(one, lay, deep)):
        assert x.slot.tolist() == y.slot.tolist() and x.cut.tolist() == y.cut.tolist() and np.allclose(x.value, y.value)


def test_forest_leaves_hold_their_rows():
    rows = data()
    b, how = block(rows), Forest(8, 6, 3, "all")
    for number, tree in enumerate(trees.forest_rows(b, layout(), how)):
        times = trees.poisson(b.key, how.seed, number)
        ends = tree.nodes(b.codes)
        count, every, one = (np.bincount(ends, v, len(tree.slot)) for v in (times, times * b.w, times * b.w * b.y))
        leaves = np.flatnonzero(count)
        assert count[leaves].min() >= 3
        assert np.allclose(tree.value[leaves], one[leaves] / every[leaves])


def test_draws_have_their_distributions():
    keys = np.arange(200_000, dtype=np.uint64)
    u, v = trees.draw(keys, 42, 1), trees.draw(keys, 42, 2)
    assert abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u, v)[0, 1]) < 0.01
    k = trees.poisson(keys, 7, 3)
    for n in range(5):
        assert abs((k == n).mean() - math.exp(-1) / math.factorial(n)) < 0.005


def test_models_learn_score_and_survive_storage(spark, tmp_path):
    from orderlens.operators.models import feature_importance
    rows = data(1500, 3)
    df = frame(spark, rows, 3)
    for estimator in (trees.BoostedTrees(Boost(30, 0.3, 3)), trees.RandomForest(Forest(30, 6))):
        model = estimator.fit(df)
        out = model.transform(df).select("label", "prediction", "tree_probability").collect()
        assert sum(r[0] == r[1] for r in out) / len(out) > 0.9
        assert all(abs(sum(r[2]) - 1) < 1e-9 and (r[2][1] > 0.5) == (r[1] == 1.0) for r in out)
        share = model.importances()
        assert abs(share.sum() - 1) < 1e-9 and share[0] + share[2] > 0.9
        path = str(tmp_path / type(estimator).__name__)
        model.write().save(path)
        again = trees.TreeModel.load(path).transform(df).select("label", "prediction", "tree_probability").collect()
        assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert feature_importance is not None
    with pytest.raises(ValueError):
        trees.RandomForest().fit(df.limit(0))


def ends(forest, codes):
    return [t.value[t.nodes(codes)].tolist() for t in forest]


def test_forest_grows_small_nodes_in_one_task(spark, monkeypatch):
    """Levels of large nodes are jobs, what is under the others grows in one; blocks and numbers on the way change nothing."""
    rows = [(*r[:3], 1.0) for r in data(900, 5)]
    df = frame(spark, rows, 4)
    lay = trees.layout_of(df)
    whole = block(rows)
    whole.key = np.array(trees.blocks_of(df.coalesce(1).orderBy("order_id"), lay, "features", "label", None, "order_id").collect()[0].key)
    how = Forest(7, 9, 2, "sqrt")
    sc = spark.sparkContext

    def jobs(name, *args):
        sc.setJobGroup(name, name)
        found = trees.forest_blocks(*args)
        sc.setLocalProperty("spark.jobGroup.id", None)
        return found, len(sc.statusTracker().getJobIdsForGroup(name))
    monkeypatch.setattr(trees, "BLOCK_ROWS", 250)
    four = trees.blocks_of(df, lay, "features", "label", None, "order_id")
    found, n = jobs("small-forest", four, lay, how)
    assert n <= 3  # the rows' number, the trees
    # the stand-in rows have the codes of layout(); cuts that no value reaches are left out of lay
    assert ends(found, lay.codes(np.array([r[1] for r in rows]))) == ends(trees.forest_rows(
        Block(lay.codes(np.array([r[1] for r in rows])), whole.y, np.ones(900), whole.key, whole.fold), lay, how), lay.codes(np.array([r[1] for r in rows])))
    monkeypatch.setattr(trees, "SMALL_ROWS", 120)
    codes = lay.codes(np.array([r[1] for r in rows]))
    cut, n = jobs("cut-forest", four, lay, how)
    assert n <= 3 + 8
    one = sc.parallelize([Block(codes, whole.y, np.ones(900), whole.key, whole.fold)], 1)
    assert ends(cut, codes) == ends(trees.forest_blocks(one, lay, how), codes)
    monkeypatch.setattr(trees, "ON_THE_WAY", 2000)  # two trees at once
    assert ends(cut, codes) == ends(trees.forest_blocks(one, lay, how), codes)
    for t, tree in enumerate(cut):
        times = trees.poisson(whole.key, how.seed, t)
        at = tree.nodes(codes)
        count, positive = (np.bincount(at, v, len(tree.slot)) for v in (times, times * whole.y))
        leaves = np.flatnonzero(count)
        assert (tree.slot[at] < 0).all() and count[leaves].min() >= 2 and np.allclose(tree.value[leaves], positive[leaves] / count[leaves])
    # where a node may split at every slot, no draw depends on how it is reached
    every = Forest(3, 9, 1, "all")
    assert ends(trees.forest_blocks(four, lay, every), codes) == ends(trees.forest_rows(one.first(), lay, every), codes)


class Held:
    """Blocks held here in place of Spark."""

    def __init__(self, items):
        self.items = items

    def map(self, f):
        return Held([f(x) for x in self.items])

    def reduce(self, f):
        out = self.items[0]
        for x in self.items[1:]:
            out = f(out, x)
        return out

    treeReduce = reduce

    def persist(self, *_):
        return self

    def unpersist(self):
        return self

    def checkpoint(self):
        pass

    def count(self):
        return len(self.items)


def test_no_level_goes_through_earlier_trees(monkeypatch):
    rows = data()
    some, margins, how = [], trees.margins, Boost(12, 0.3, 3, 0.8, 0.75, 1.0, 1.0)
    monkeypatch.setattr(trees, "margins", lambda b, later, start: some.append(len(later)) or margins(b, later, start))
    found, _ = trees.boost_blocks(Held([block(rows[:250]), block(rows[250:])]), layout(), how)
    assert max(some) == 1 and sum(some) == 2 * 11
    same, _ = trees.boost_rows(block(rows), layout(), how)
    assert all(a.slot.tolist() == b.slot.tolist() and np.allclose(a.value, b.value) for a, b in zip(found, same))


def wide(n=3000, seed=2, weights=(1.0,)):
    """Two numbers and two groups of one-hot slots, some rows without one; the layout and a block."""
    r = np.random.default_rng(seed)
    lay = Layout([np.arange(31.0), np.arange(5.0), *[np.array([0.5])] * 40])
    codes = np.zeros((n, 42), dtype=np.uint8)
    codes[:, 0], codes[:, 1] = r.integers(0, 32, n), r.integers(0, 6, n)
    for low, many in ((2, 10), (12, 30)):
        some = np.flatnonzero(r.random(n) < 0.9)
        codes[some, low + r.integers(0, many, len(some))] = 1
    y = (codes[:, 0] + 9 * codes[:, 3] + r.integers(0, 12, n) > 20).astype(float)
    return lay, Block(codes, y, r.choice(weights, n), r.integers(0, 2 ** 63, n).astype(np.uint64), np.zeros(n, np.int32))


@pytest.mark.parametrize("weights,at_once", [((1.0,), 1 << 17), ((1.0,), 50), ((0.5, 1.7), 1 << 17), ((0.5, 1.7), 50)])
def test_splits_of_the_allowed_slots_are_the_best(monkeypatch, weights, at_once):
    monkeypatch.setattr(trees, "ROWS_AT_ONCE", at_once)
    lay, b = wide(weights=weights)
    how, node = Forest(1, 6, 2, 0.3), np.sort(np.arange(3000) % 7)
    part = trees.drawn(b, trees.Part.of(b, lay), None, how, 0, trees.Tree.stump(), np.zeros(1, np.int64))
    own = np.flatnonzero(trees.poisson(b.key, how.seed, 0))
    times, node = trees.poisson(b.key, how.seed, 0)[own], node[own]
    allowed = how.allowed(0, np.arange(7), 42)
    (gain, counter, left, right), total = trees.node_splits(part, np.bincount(node), lay, how, allowed)
    sums = np.zeros((3, 7, lay.size + 1))
    for c, v in enumerate((times * b.w[own] * b.y[own], times * b.w[own], times)):
        for slot in range(42):
            np.add.at(sums[c], (node, lay.offsets[slot] + b.codes[own, slot]), v)
        sums[c, :, -1] = np.bincount(node, v)
    want = trees.best_splits(sums, lay, how.gain, allowed)
    assert np.allclose(gain, want[0]) and np.allclose(total, sums[:, :, -1])
    assert counter.tolist() == want[1].tolist() and np.allclose(left, want[2]) and np.allclose(right, want[3])


def test_boosting_reads_small_rows():
    """Each level's job reads every row: it has the codes of numbers and the few one-hot slots present, not all slots."""
    import pickle
    lay, b = wide()
    lean = trees.Lean.of(b, lay)
    b.present(lay)
    assert len(pickle.dumps(lean)) < len(pickle.dumps(b)) / 3
    assert (lean.columns() == b.codes.T).all()
    for tree in trees.forest_rows(b, lay, Forest(3, 7, 1, "sqrt")):
        assert (tree.ends(lean.columns()) == tree.nodes(b.codes)).all()
        inner = np.flatnonzero(tree.slot >= 0)
        leaves = np.flatnonzero(tree.slot < 0)
        inside = np.stack(list(trees.inside_of(lean.columns(), tree, leaves)))
        assert len(inner) and (leaves[inside.argmax(axis=0)] == tree.nodes(b.codes)).all() and (inside.sum(axis=0) == 1).all()
