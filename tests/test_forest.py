"""Forests of all cells against a plain tree builder with the same draws."""

import numpy as np
import pandas as pd
import pytest

from panelsmith.design import Design
from panelsmith.operators.models import forest


def plain_tree(x, positive, times, seed, weights, share):
    """Leaf share of every query row, by recursion over explicit rows."""
    def weight(rows):
        p = sum(times[i] for i in rows if positive[i]) * weights[1]
        return p, sum(times[i] for i in rows if not positive[i]) * weights[0]

    def build(rows, seed):
        p, q = weight(rows)
        value = p / (p + q) if p + q else 0.5
        if not p or not q:
            return value
        order = forest.feature_order(np.array([seed], np.uint64), x.shape[1])[0]
        tries = max(1, int(np.sqrt(x.shape[1])))
        best = None
        for done in range(0, x.shape[1], tries):
            for f in order[done : done + tries]:
                values = sorted({x[i, f] for i in rows})
                for a, b in zip(values, values[1:]):
                    lp, lq = weight([i for i in rows if x[i, f] <= a])
                    rp, rq = p - lp, q - lq
                    gain = (lp * lp + lq * lq) / (lp + lq) + (rp * rp + rq * rq) / (rp + rq)
                    if best is None or gain > best[0]:
                        best = gain, f, (a + b) / 2
            if best:
                break
        if best is None:
            return value
        _, f, cut = best
        sides = [build([i for i in rows if (x[i, f] > cut) == side], forest.child_seeds(np.array([seed], np.uint64), side)[0]) for side in (0, 1)]
        return f, cut, sides

    tree = build([i for i in range(len(x)) if times[i]], seed)

    def descend(row):
        node = tree
        while isinstance(node, tuple):
            node = node[2][int(row[node[0]] > node[1])]
        return node

    return [descend(row) for row in share]


CASES = [(40, 5, False), (40, 5, True), (25, 1, False), (30, 10, True)]


def table(n, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, p)).astype(float)
    x[:, 0] = 1.0  # nothing to cut
    return x, (x[:, -1] + rng.normal(0, 2, n) > 5)


@pytest.mark.parametrize("n,p,balanced", CASES)
def test_trees_equal_plain_ones(n, p, balanced):
    x, positive = table(n, p, n + p)
    query = np.random.default_rng(1).uniform(0, 9, (20, p))
    seeds = forest.tree_seeds(3, 10, 0, 12)
    drawn = forest.bootstrap(seeds, np.arange(n))
    weights = forest.class_weights(positive, balanced)
    got = forest.Trees(x, positive, drawn, seeds, weights).shares(query)
    want = np.sum([plain_tree(x, positive, drawn[t].tolist(), seeds[t], weights, query) for t in range(12)], axis=0)
    assert np.allclose(got, want, atol=1e-12)


def test_bootstraps_are_draws_of_mean_one():
    drawn = forest.bootstrap(forest.tree_seeds(0, 3, 0, 400), np.arange(500))
    assert abs(drawn.mean() - 1) < 0.01 and abs((drawn == 0).mean() - np.exp(-1)) < 0.005 and abs(drawn.var() - 1) < 0.03


def test_cells_are_fitted_together_and_large_ones_spread(spark):
    rows, tests = [], []
    for slot, n in ((0, 40), (1, 25), (2, 30)):
        x, positive = table(n, 4, slot)
        rows += [(slot, 4, i, bool(positive[i]), x[i].tolist()) for i in range(n)]
        tests += [(slot, 4, 100 + i, "Cancer", x[i].tolist()) for i in range(10)]
    train = spark.createDataFrame(rows, "slot int, K int, sample_ix long, is_pos boolean, x array<double>").repartition(5)
    test = spark.createDataFrame(tests, "slot int, K int, sample_ix long, class string, x array<double>").repartition(2)
    out = {(r.slot, r.sample_ix): r.p_pos for r in forest.predict(train, test, Design(n_splits=3), trees=30).collect()}
    assert len(out) == 30
    for slot, n in ((0, 40), (1, 25), (2, 30)):
        x, positive = table(n, 4, slot)
        seeds = forest.tree_seeds(slot, 4, 0, 30)
        drawn = forest.bootstrap(seeds, np.arange(n))
        want = np.mean([plain_tree(x, positive, drawn[t].tolist(), seeds[t], (1.0, 1.0), x[:10]) for t in range(30)], axis=0)
        assert np.allclose([out[slot, 100 + i] for i in range(10)], want, atol=1e-9)
    # a cell beyond the limit goes the other way, the others stay as they are
    mixed = {(r.slot, r.sample_ix): r.p_pos for r in forest.predict(train, test, Design(n_splits=3), trees=30, local_rows=45).collect()}
    assert len(mixed) == 30 and all(mixed[k] == pytest.approx(out[k]) for k in out if k[0] > 0)
    assert all(0 <= p <= 1 for p in mixed.values())


def test_a_cell_of_many_rows_gets_whole_trees(spark):
    rng = np.random.default_rng(4)
    n = 110_000
    x = rng.integers(0, 40, (n, 2)).astype(float)
    positive = (x.sum(axis=1) + rng.integers(0, 3, n)) % 5 < 2
    query = x[:200] + 0.25
    train = pd.DataFrame({"slot": 0, "K": 2, "sample_ix": np.arange(n), "is_pos": positive, "x": x.tolist()})
    test = pd.DataFrame({"slot": 0, "K": 2, "sample_ix": n + np.arange(200), "class": "Cancer", "x": query.tolist()})
    train = spark.createDataFrame(train, "slot int, K int, sample_ix long, is_pos boolean, x array<double>")
    test = spark.createDataFrame(test, "slot int, K int, sample_ix long, class string, x array<double>")
    out = {r.sample_ix: r.p_pos for r in forest.predict(train, test, Design(n_splits=1), trees=21).collect()}
    seeds = forest.tree_seeds(0, 2, 0, 21)
    want = forest.Trees(x, positive, forest.bootstrap(seeds, np.arange(n)), seeds, (1.0, 1.0)).shares(query) / 21
    assert np.allclose([out[n + i] for i in range(200)], want, atol=1e-9)
