"""Operators against brute force on small inputs, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelsmith.design import Design
from panelsmith.functions.special import digamma, trigamma, trigamma_inverse
from panelsmith.operators import metrics, neighbours, ranking, resample, runtime, selection
from panelsmith.operators.models import knn, lda, linear, solver, svm


def test_special_functions(spark):
    row = spark.createDataFrame([(0.5, 1.0, 7.25)], "h double, o double, z double").select(
        digamma(F.col("h")), digamma(F.col("o")), trigamma(F.col("h")), trigamma(F.col("o")),
        trigamma_inverse(trigamma(F.col("z"))),
    ).first()
    euler = 0.5772156649015329
    want = [-euler - 2 * math.log(2), -euler, math.pi**2 / 2, math.pi**2 / 6, 7.25]
    assert np.allclose(list(row), want, rtol=0, atol=1e-9)


def test_order_statistics_match_a_sort(spark):
    rng = np.random.default_rng(3)
    data = [(int(k), int(v)) for k, v in zip(rng.integers(0, 3, 900), rng.permutation(10_000)[:900])]
    rows = spark.createDataFrame(data, "k int, v long").withColumn("b", F.floor(F.col("v") / 500))
    wanted = spark.createDataFrame([(k, r) for k in range(3) for r in (1, 2, 57, 200)], "k int, rank long")
    got = {(r["k"], r["rank"]): r["v"] for r in ranking.order_statistics(rows, wanted, ["k"], "v", "b").collect()}
    for (k, r), v in got.items():
        assert sorted(x for g, x in data if g == k)[r - 1] == v
    assert len(got) == 12
    no = ranking.numbered(rows.drop("b"), ["k"], "v", F.floor(F.col("v") / 500), "no").collect()
    for k in range(3):
        mine = sorted((r["v"], r["no"]) for r in no if r["k"] == k)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_quantiles_and_empty_groups(spark):
    data = [("a", float(v)) for v in (1, 1, 1, 4, 9, 10)] + [("b", 2.0), ("b", None)]
    got = ranking.count_quantiles(
        spark.createDataFrame(data, "g string, v double"), ["g"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    ).orderBy("g").collect()
    assert np.allclose([got[0]["q1"], got[0]["q2"], got[0]["q3"]], np.quantile([1, 1, 1, 4, 9, 10], [0.25, 0.5, 0.75]))
    assert (got[1]["n"], got[1]["q1"], got[1]["q3"]) == (1, 2.0, 2.0)


def test_quotas_break_ties_by_class(spark):
    counts = spark.createDataFrame([("B", 10), ("A", 10), ("C", 1)], "class string, n long")
    got = {r["class"]: r["quota"] for r in resample.train_quotas(counts, 0.33).collect()}
    # 21 rows, 7 test, 14 train: shares 6.67, 6.67, 0.67; all three remainders tie
    assert got == {"A": 7, "B": 7, "C": 0}
    with pytest.raises(Exception, match="two classes"):
        resample.require_two_classes(spark.createDataFrame([(1, "A"), (2, "A")], "sample_ix long, class string")).collect()


def frame(spark, rng, n, width, slots, pos_share=0.5):
    x = rng.normal(size=(n, width))
    data = [
        (int(i), "Cancer" if i < n * pos_share else "Control", [float(v) for v in x[i]]) for i in range(n)
    ]
    return spark.createDataFrame(data, "sample_ix long, class string, features array<double>"), x


def test_moderated_t_matches_numpy(spark):
    rng = np.random.default_rng(5)
    samples, x = frame(spark, rng, 40, 30, 1)
    scale = np.exp(rng.normal(size=30))
    samples = samples.withColumn(
        "features", F.zip_with("features", F.array(*[F.lit(float(s)) for s in scale]), lambda a, b: a * b + 1000)
    )
    x = x * scale + 1000
    design = Design(n_splits=3)
    roles = resample.with_roles(samples, resample.split_cuts(samples, design), design)
    fit = selection.pooled_variance(selection.group_moments(roles, design, list(x[0])))
    prior = selection.variance_prior(fit)
    got = {(r["slot"], r["gene_ix"]): r["t"] for r in selection.moderated_t(fit, prior).collect()}
    d0 = {r["slot"]: (r["d0"], r["s0sq"]) for r in prior.collect()}
    train = {r["sample_ix"]: r["train"] for r in roles.collect()}
    for slot in range(3):
        use = np.array([train[i][slot] for i in range(40)])
        pos = np.arange(40) < 20
        a, b = x[use & pos], x[use & ~pos]
        assert (len(a), len(b)) == (13, 13)
        df = len(a) + len(b) - 2
        s2 = ((len(a) - 1) * a.var(axis=0, ddof=1) + (len(b) - 1) * b.var(axis=0, ddof=1)) / df
        assert d0[slot][0] is not None and d0[slot][0] > 0
        post = (d0[slot][0] * d0[slot][1] + df * s2) / (d0[slot][0] + df)
        t = (a.mean(axis=0) - b.mean(axis=0)) / np.sqrt(post * (1 / len(a) + 1 / len(b)))
        assert np.allclose([got[slot, g] for g in range(30)], t, rtol=1e-7)


def test_prior_is_infinite_for_equal_variances(spark):
    fit = spark.createDataFrame([(0, g, 20.0, 2.0) for g in range(10)], "slot int, gene_ix int, df double, s2 double")
    row = selection.variance_prior(fit).first()
    assert row["d0"] is None and row["s0sq"] == pytest.approx(2.0)


def test_folds_match_the_definition(spark):
    rng = np.random.default_rng(11)
    samples, _ = frame(spark, rng, 83, 2, 1, 0.3)
    samples = samples.withColumn("class", F.when(F.col("sample_ix") % 4 == 1, "Cancer").otherwise("Control"))
    design = Design(n_splits=4)
    roles = resample.with_roles(samples, resample.split_cuts(samples, design), design)
    folded = resample.with_folds(roles, resample.fold_ends(roles)).orderBy("sample_ix").collect()
    for slot in range(4):
        rows = [(r["class"], r["fold"][slot]) for r in folded if r["train"][slot]]
        assert all(r["fold"][slot] == -1 for r in folded if not r["train"][slot])
        seen = list(dict.fromkeys(c for c, _ in rows))
        codes = sorted(seen.index(c) for c, _ in rows)
        for i, c in enumerate(seen):
            alloc = [codes[f::5].count(i) for f in range(5)]
            want = [f for f in range(5) for _ in range(alloc[f])]
            assert [f for k, f in rows if k == c] == want


def test_nearest_is_exact_with_ties_and_small_blocks(spark):
    rng = np.random.default_rng(2)
    pts = np.round(rng.normal(size=(300, 3)), 1)
    pts[100:200] = pts[100]  # a third of all rows are the same point
    data = [(0, 4, int(i), bool(i % 2), [float(v) for v in pts[i]]) for i in range(300)]
    rows = spark.createDataFrame(data, "slot int, K int, sample_ix long, is_pos boolean, x array<double>")
    blocks = neighbours.pack_blocks(rows, block_rows=37)
    got = {}
    for r in neighbours.nearest(blocks, blocks, 3, same_rows=True).collect():
        got.setdefault(r["sample_ix"], []).append((r["d2"], r["near_ix"]))
    for i in range(300):
        d2 = ((pts[i] - pts) ** 2).sum(axis=1)
        want = sorted((d2[j], j) for j in range(300) if j != i)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
        assert np.allclose([d for d, _ in sorted(got[i])], [d for d, _ in want])


@pytest.mark.parametrize("k, offset, tile_values", [(4, 0.0, 10**6), (4, 0.0, 200), (30, 1e6, 10**6), (30, 0.0, 3000)])
def test_nearest_over_tiles_and_rounding(spark, k, offset, tile_values):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(700, k)) + offset
    pts[300:420] = pts[0]
    data = [(i % 2, k, i, bool(i % 3), [float(v) for v in pts[i]]) for i in range(700)]
    rows = spark.createDataFrame(data, "slot int, K int, sample_ix long, is_pos boolean, x array<double>")
    asked, given = (neighbours.pack_blocks(rows.where(f"sample_ix % 5 {sign} 0"), block_rows=16) for sign in ("=", "<>"))
    found = neighbours.nearest(asked, given, 3, tile_values=tile_values).collect()
    got = {}
    for r in found:
        assert r["near_pos"] == bool(r["near_ix"] % 3) and r["slot"] == r["near_ix"] % 2
        got.setdefault(r["sample_ix"], []).append((r["nth"], r["near_ix"], r["d2"]))
    for i in range(0, 700, 5):
        d2 = ((pts[i] - pts) ** 2).sum(axis=1)
        want = sorted((d2[j], j) for j in range(700) if j % 5 and j % 2 == i % 2)[:3]
        assert [j for _, j, _ in sorted(got[i])] == [j for _, j in want]
        assert np.allclose([d for _, _, d in sorted(got[i])], [d for d, _ in want])


def test_blocks_are_not_stored_in_pairs(spark):
    rng = np.random.default_rng(6)
    data = [(slot, 8, i, True, [float(v) for v in rng.normal(size=8)]) for slot in range(40) for i in range(120)]
    rows = spark.createDataFrame(data, "slot int, K int, sample_ix long, is_pos boolean, x array<double>")
    blocks = neighbours.pack_blocks(rows, block_rows=8)
    n = blocks.count()
    assert neighbours.dealt(blocks, blocks).count() == 2 * n


def test_votes(spark):
    near = spark.createDataFrame(
        [(0, 3, 1, True, 0.0), (0, 3, 1, False, 4.0), (0, 3, 1, False, 4.0),
         (0, 3, 2, True, 1.0), (0, 3, 2, False, 4.0), (0, 3, 2, False, 4.0)],
        "slot int, K int, sample_ix long, near_pos boolean, d2 double",
    )
    got = {r["sample_ix"]: r["p_pos"] for r in knn.votes(near).collect()}
    assert got == {1: 1.0, 2: 0.5}


def test_discriminant_matches_pooled_covariance():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(30, 4)) + 1, rng.normal(size=(20, 4)) @ rng.normal(size=(4, 4))
    centred = np.vstack([a - a.mean(0), b - b.mean(0)])
    coef, intercept = lda.discriminant(centred.T @ centred, a.mean(0), b.mean(0), 30, 20)
    cov = centred.T @ centred / 48
    want = np.linalg.solve(cov, a.mean(0) - b.mean(0))
    assert np.allclose(coef, want)
    assert intercept == pytest.approx(math.log(1.5) - want @ (a.mean(0) + b.mean(0)) / 2)
    # more features than rows: the empty directions are left out
    wide = rng.normal(size=(10, 25))
    wide[:5] -= wide[:5].mean(0)
    wide[5:] -= wide[5:].mean(0)
    coef, _ = lda.discriminant(wide.T @ wide, np.ones(25), np.zeros(25), 5, 5)
    assert np.isfinite(coef).all()


def test_scatter_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3)) + 500
    data = [(0, 3, bool(i < 20), [float(v) for v in x[i]]) for i in range(50)]
    train = spark.createDataFrame(data, "slot int, K int, is_pos boolean, x array<double>")
    row = linear.within_scatter(train, linear.cell_means(train)).first()
    centred = np.vstack([x[:20] - x[:20].mean(0), x[20:] - x[20:].mean(0)])
    assert np.allclose(linear.unpacked(np.array(row["ss"])), centred.T @ centred)


@pytest.fixture(scope="module")
def coded(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 6))
    y = x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=120) > 0
    data = [(0, 6, [int(i % 5)], bool(y[i]), [float(v) for v in x[i]]) for i in range(120)]
    return spark.createDataFrame(data, "slot int, K int, codes array<int>, is_pos boolean, x array<double>").repartition(4), x, y


def test_lasso_directions_are_exact_where_the_curvature_is_ill_conditioned():
    rng = np.random.default_rng(12)
    h, g, w = [], [], []
    for spread in (1.0, 1e-4):
        a = rng.normal(size=(200, 12)) * spread + rng.normal(size=(200, 1))
        h.append(1e4 * a.T @ a)
        w.append(np.where(rng.random(12) < 0.5, rng.normal(size=12) * 50, 0.0))
        g.append(h[-1] @ rng.normal(size=12))
    h, g, w = map(np.array, (h, g, w))
    u = w + solver.lasso_directions(h, g, w, 1.0)
    for n in range(2):
        r = g[n] + h[n] @ (u[n] - w[n])
        assert np.abs(r + np.sign(u[n]))[u[n] != 0].max(initial=0) < 1e-4
        assert (np.abs(r) <= 1 + 1e-4)[u[n] == 0].all()


def test_lasso_meets_its_optimality_conditions(coded):
    rows, x, y = coded
    fits = [solver.Fit(0, 6, 6, C=c, held=h) for c in (0.03, 0.3, 3.0) for h in (-1, 2)]
    solver.solve(rows, fits, solver.Problem("logistic", lasso=1.0))
    s = np.where(y, 1.0, -1.0)
    for f in fits:
        use = np.arange(120) % 5 != f.held
        m = x[use] @ f.coef
        g = -f.C * x[use].T @ (s[use] / (1 + np.exp(s[use] * m)))
        on = f.coef != 0
        assert np.all(np.abs(g[~on]) <= 1 + 1e-4)
        assert np.allclose(g[on], -np.sign(f.coef[on]), atol=1e-4)
    assert sum(np.count_nonzero(f.coef) for f in fits[:2]) < sum(np.count_nonzero(f.coef) for f in fits[4:])


def test_working_set_reaches_the_same_solution(coded, monkeypatch):
    rows, _, _ = coded
    full = solver.solve(rows, [solver.Fit(0, 6, 6, C=0.5)], solver.Problem("logistic", lasso=1.0))[0]
    monkeypatch.setattr(solver, "WORKING_SET", 4)
    part = solver.solve(rows, [solver.Fit(0, 6, 6, C=0.5)], solver.Problem("logistic", lasso=1.0))[0]
    assert np.allclose(full.coef, part.coef, atol=1e-5)


def test_lasso_on_unscaled_wide_rows_meets_its_optimality_conditions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 300)) * 50
    y = x[:, 0] - x[:, 1] + 50 * rng.normal(size=100) > 0
    data = [(0, 300, [0], bool(y[i]), [float(v) for v in x[i]]) for i in range(100)]
    rows = spark.createDataFrame(data, "slot int, K int, codes array<int>, is_pos boolean, x array<double>").repartition(4).cache()
    fits = [solver.Fit(0, 300, 300, C=c) for c in (1.0, 10.0)]
    solver.solve(rows, fits, solver.Problem("logistic", lasso=1.0))
    s = np.where(y, 1.0, -1.0)
    for f in fits:
        g = -f.C * x.T @ (s * np.exp(-np.logaddexp(0.0, s * (x @ f.coef))))
        on = f.coef != 0
        assert np.all(np.abs(g[~on]) <= 1 + 1e-4)
        assert np.allclose(g[on], -np.sign(f.coef[on]), atol=1e-4)
    with pytest.raises(RuntimeError, match="not converged"):
        solver.solve(rows, [solver.Fit(0, 300, 300)], solver.Problem("logistic", lasso=1.0), max_steps=2)


def test_svm_gradient_vanishes(coded):
    rows, x, y = coded
    f = solver.solve(rows, [solver.Fit(0, 6, 6)], solver.Problem("squared_hinge", ridge=1.0, bias=True))[0]
    xb, w = np.hstack([x, np.ones((120, 1))]), np.append(f.coef, f.intercept)
    s = np.where(y, 1.0, -1.0)
    z = np.maximum(0, 1 - s * (xb @ w))
    assert np.allclose(w - 2 * xb.T @ (s * z), 0, atol=1e-5)


def test_metrics_and_nulls(spark):
    rows = [("m", 1, "Cancer", "Cancer"), ("m", 1, "Control", "Cancer"), ("m", 1, "odd", "Control"),
            ("m", 2, "Control", "Control")]
    p = spark.createDataFrame(rows, "model string, split int, class string, predicted string")
    got = {r["split"]: r for r in metrics.split_metrics(metrics.confusion(p, ["model", "split"], "Cancer", "Control")).collect()}
    assert got[1]["MCE"] == pytest.approx(2 / 3)
    assert (got[1]["Sensitivity"], got[1]["Specificity"]) == (1.0, 0.0)
    assert got[2]["Sensitivity"] is None and got[2]["MCE"] == 0.0
    table = spark.createDataFrame([("m", 3, 0.1, 0.5, None), ("m", 3, 0.3, None, None)],
                                  "model string, K int, MCE double, Sensitivity double, Specificity double")
    row = metrics.summary(table).first()
    assert row["MCE_se"] == pytest.approx(np.std([0.1, 0.3], ddof=1) / math.sqrt(2))
    assert row["Sens_mean"] == 0.5 and row["Sens_se"] is None and row["Spec_mean"] is None


def test_frozen_ties(spark):
    freq = spark.createDataFrame([(2, g, 5) for g in ("10", "2", "9")], "K int, gene string, count long")
    got = selection.frozen_panels(freq).orderBy("rank").collect()
    assert [r["gene"] for r in got] == ["2", "9"]
    mixed = spark.createDataFrame([(2, g, 5) for g in ("10", "2", "a")], "K int, gene string, count long")
    assert [r["gene"] for r in selection.frozen_panels(mixed).orderBy("rank").collect()] == ["10", "2"]


def test_jaccard_and_stability(spark):
    lists = spark.createDataFrame(
        [(3, 1, ["a", "b"]), (3, 2, ["a", "b"]), (3, 3, ["c"]), (5, 1, ["a"])], "K int, id int, genes array<string>"
    )
    got = {(r["a"], r["b"]): r["jaccard"] for r in metrics.pair_similarity(lists).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.0, (2, 3): 0.0}
    empty = spark.createDataFrame([(3, 1, []), (3, 2, [])], "K int, id int, genes array<string>")
    assert metrics.pair_similarity(empty).first()["jaccard"] == 0.0
    table = {(r["K"], r["Metric"]): r["Value"] for r in metrics.stability(lists, lists).collect()}
    assert table[3, "Original_Jaccard_Mean"] == pytest.approx(1 / 3)
    assert table[3, "Original_Jaccard_Std"] == pytest.approx(np.std([1, 0, 0]))
    assert table[5, "Aggregated_Jaccard_Mean"] is None


def test_highest_weight_ties_and_zero_fill(spark):
    w = spark.createDataFrame([(3, 1, "svm", 0.5), (3, 1, "rf", 0.5), (3, 2, "svm", 0.1), (5, 1, "svm", 0.2)],
                              "K int, split int, model string, weight double")
    order = F.array_position(F.array(F.lit("rf"), F.lit("svm")), F.col("model"))
    counts = metrics.highest_counts(w, order)
    assert {(r["model"], r["K"]): r["count"] for r in metrics.zero_filled(counts).collect()} == {
        ("rf", 3): 1, ("svm", 3): 1, ("svm", 5): 1, ("rf", 5): 0,
    }


def test_speed_up_ignores_unknown_cores(spark):
    clock = spark.createDataFrame([(None, 50.0), (4, 5.0), (1, 20.0)], "cores int, wall_clock_s double")
    got = {r["cores"]: r["speed_up"] for r in runtime.speed_up(clock).collect()}
    assert got == {None: 0.4, 4: 4.0, 1: 1.0}
    assert all(r["speed_up"] is None for r in runtime.speed_up(clock.withColumn("wall_clock_s", F.lit(0.0))).collect())


def test_folds_of_oversampled_rows(spark):
    from panelsmith.operators.cells import fold_rows

    ids = [*range(30), *range(-1, -13, -1)]
    labels = ["Cancer" if i < 0 or i % 5 == 2 else "Control" for i in ids]
    rows = spark.createDataFrame([(0, 3, i, c) for i, c in zip(ids, labels)], "slot int, K int, sample_ix long, class string")
    got = {r["sample_ix"]: r["fold"] for r in fold_rows(rows).collect()}
    seen = list(dict.fromkeys(labels))
    codes = sorted(seen.index(c) for c in labels)
    for k, c in enumerate(seen):
        alloc = [codes[f::5].count(k) for f in range(5)]
        assert [got[i] for i, l in zip(ids, labels) if l == c] == [f for f in range(5) for _ in range(alloc[f])]


def test_sigmoid_fits_read_stored_margins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(0, 2, i % 5, bool(rng.random() < 0.5), rng.normal(size=2).tolist()) for i in range(60)]
    rows = spark.createDataFrame(data, "slot int, K int, fold int, is_pos boolean, x array<double>")
    read, solve = [], svm.solve

    def recorded(rows, fits, problem):
        read.append(rows.inputFiles())
        return solve(rows, fits, problem)

    monkeypatch.setattr(svm, "solve", recorded)
    assert len(svm.fit_models(rows)) == 5
    assert read[1] and all("margins" in f for f in read[1])
