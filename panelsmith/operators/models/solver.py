"""Many linear fits at once, by Newton steps on sums over the samples.

Fits differ by cell, inner fold, penalty and class weights but read the same
rows. One Spark job per step evaluates objective, gradient and curvature of
every unfinished fit where the rows are, adds them up, and turns each fit's
sums into its next direction on the executors. The driver keeps coefficients
and step sizes only, like any iterative estimator; fits go in groups so that
their sums have a fixed bound. A lost executor costs the tasks of one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from panelsmith.operators.models.linear import cell_groups, rows_of

# Doubles of running sums one task keeps for a group of fits.
_GROUP_DOUBLES = 8_000_000
# Curvature is kept for this many features of a fit; wider fits work on a subset.
WORKING_SET = 200
# What a gradient's terms leave undecided when they cancel, as a share of the penalty's tolerance.
ROUNDING = 1e-7
# Sweeps of coordinate descent between two exact solutions over the features that take part.
_SWEEPS = 5
# A fit that has not converged after so many steps is an error.
MAX_STEPS = 1000


@dataclass
class Fit:
    """One fit: which rows it trains on and its penalty.

    Rows belong to a cell (slot, K) and carry one fold code per lane, below 0
    for rows that are not in the lane's training part. `held` leaves one fold
    out; with `inside` the fit trains on that fold only.
    """

    slot: int
    K: int
    width: int
    C: float = 1.0
    lane: int = 0
    held: int = -1
    inside: bool = False
    targets: tuple[float, float] = (1.0, 0.0)
    weights: tuple[float, float] = (1.0, 1.0)
    scale: np.ndarray | None = None
    tag: dict = field(default_factory=dict)
    # result, in the scale of the rows
    coef: np.ndarray | None = None
    intercept: float = 0.0


@dataclass(frozen=True)
class Problem:
    """C * sum of losses + lasso * |w|_1 + ridge / 2 * |w|^2; a bias column is penalised alike."""

    loss: str  # "logistic" or "squared_hinge"
    lasso: float = 0.0
    ridge: float = 0.0
    bias: bool = False


def _groups(fits: list[Fit]) -> Iterator[list[int]]:
    group, held = [], 0
    for i, f in enumerate(fits):
        a = min(f.width, WORKING_SET) + 1
        size = 2 * f.width + a * (a + 1) // 2
        if group and held + size > _GROUP_DOUBLES:
            yield group
            group, held = [], 0
        group.append(i)
        held += size
    if group:
        yield group


def _row_terms(loss: str, m: np.ndarray, pos: np.ndarray, f: Fit):
    """Loss, slope and curvature per row, weighted."""
    s = f.C * np.where(pos, f.weights[0], f.weights[1])
    if loss == "logistic":
        t = np.where(pos, f.targets[0], f.targets[1])
        p = np.exp(-np.logaddexp(0.0, -m))
        return s * (np.logaddexp(0.0, m) - t * m), s * (p - t), s * p * (1 - p)
    y = np.where(pos, 1.0, -1.0)
    z = np.maximum(0.0, 1.0 - y * m)
    return s * z * z, -2 * s * y * z, 2 * s * (z > 0)


def _training_rows(codes: np.ndarray, f: Fit) -> np.ndarray:
    code = codes[:, f.lane]
    return np.flatnonzero(code == f.held if f.inside else (code >= 0) & (code != f.held))


def _design_matrix(x: np.ndarray, f: Fit, bias: bool) -> np.ndarray:
    if f.scale is not None:
        x = x / f.scale
    return np.hstack([x, np.ones((len(x), 1))]) if bias else x


def _sums(rows: DataFrame, problem: Problem, fits: dict[int, Fit], w: dict[int, np.ndarray], active: dict[int, np.ndarray]) -> DataFrame:
    """(fit, sums): objective without penalty, gradient, the sizes of its terms, and curvature on the active features."""
    by_cell: dict[tuple, list[int]] = {}
    for i, f in fits.items():
        by_cell.setdefault((f.slot, f.K), []).append(i)
    for members in by_cell.values():
        members.sort(key=lambda i: (fits[i].lane, fits[i].held))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            all_pos = batch["is_pos"].to_numpy(zero_copy_only=False).astype(bool)
            for key, at in cell_groups(batch, "slot", "K"):
                if key not in by_cell:
                    continue
                x, codes, pos = rows_of(batch["x"], at), rows_of(batch["codes"], at), all_pos[at]
                shared, xs, ps = None, None, None
                for i in by_cell[key]:
                    f = fits[i]
                    rows_key = (f.lane, f.held, f.inside, id(f.scale))
                    if rows_key != shared:
                        use = _training_rows(codes, f)
                        xs, ps, shared = _design_matrix(x[use], f, problem.bias), pos[use], rows_key
                    if not len(xs):
                        continue
                    value, slope, bend = _row_terms(problem.loss, xs @ w[i], ps, f)
                    xa = xs if len(active[i]) == xs.shape[1] else xs[:, active[i]]
                    h = (xa * bend[:, None]).T @ xa
                    packed = np.concatenate([[value.sum()], xs.T @ slope, np.abs(xs).T @ np.abs(slope), h[np.triu_indices(len(h))]])
                    if i in sums:
                        sums[i] += packed
                    else:
                        sums[i] = packed
        if sums:
            yield pa.RecordBatch.from_pydict({
                "fit": pa.array(list(sums), pa.int32()), "sums": pa.array(list(sums.values()), pa.list_(pa.float64())),
            })

    return (
        rows.mapInArrow(partial, "fit int, sums array<double>")
        .groupBy("fit")
        .agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("sums"))
    )


def lasso_directions(h: np.ndarray, g: np.ndarray, w: np.ndarray, lam: float, sweeps: int = 200) -> np.ndarray:
    """Minimiser of the quadratic model plus lam * |w|_1, for many fits.

    Sweeps of coordinate descent over all fits at once find which features take part; between them each fit is solved
    exactly over those. Sweeps alone stall where the curvature is ill conditioned, as it gets with more rows of separable classes.
    """
    u, r = w.copy(), g.copy()
    left = np.arange(len(w))
    for _ in range(0, sweeps, _SWEEPS):
        hl, ul, rl = h[left], u[left], r[left]
        diag = np.maximum(np.einsum("fjj->fj", hl), 1e-12)
        for _ in range(_SWEEPS):
            moved = np.zeros(len(left))
            for j in range(w.shape[1]):
                z = ul[:, j] - rl[:, j] / diag[:, j]
                new = np.sign(z) * np.maximum(np.abs(z) - lam / diag[:, j], 0.0)
                d = new - ul[:, j]
                rl += hl[:, :, j] * d[:, None]
                ul[:, j] = new
                moved = np.maximum(moved, np.abs(d) * np.sqrt(diag[:, j]))
        done = moved < 1e-9
        for n in np.flatnonzero(~done):
            done[n] = _solved_on_support(hl[n], rl[n], ul[n], lam)
        u[left], r[left] = ul, rl
        left = left[~done]
        if not len(left):
            break
    return u - w


def _solved_on_support(h: np.ndarray, r: np.ndarray, u: np.ndarray, lam: float) -> bool:
    """Move `u` and its gradient `r` in place to the minimum over its nonzero features; True if no other one wants to enter.

    Where the way there leads through zero, it ends there and the feature drops out. The model falls all along.
    """
    for _ in range(len(u)):
        on = np.flatnonzero(u)
        if not len(on):
            break
        sign = np.sign(u[on])
        try:
            step = np.linalg.solve(h[np.ix_(on, on)], -(r[on] + lam * sign))
        except np.linalg.LinAlgError:
            return False
        if not np.isfinite(step).all():
            return False
        crossing = np.flatnonzero((u[on] + step) * sign <= 0)
        ways = -u[on[crossing]] / step[crossing]
        way = ways.min(initial=1.0)
        u[on] += way * step
        r += h[:, on] @ (way * step)
        if not len(crossing):
            break
        u[on[crossing[ways == way]]] = 0.0
    return bool((np.abs(r) <= lam * (1 + 1e-9))[u == 0].all())


def _next_directions(problem: Problem, w: dict[int, np.ndarray], active: dict[int, np.ndarray]):
    """Turn summed terms into (fit, objective, violation, direction, next active set)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["fit"].to_pylist()
            todo: dict[int, list] = {}
            for n, i in enumerate(ids):
                todo.setdefault(len(active[i]), []).append((i, batch["sums"][n].values.to_numpy()))
            for a, items in todo.items():
                p = [len(w[i]) for i, _ in items]
                full = [s[1:1 + q] + problem.ridge * w[i] for (i, s), q in zip(items, p)]
                h = np.zeros((len(items), a, a))
                upper = np.triu_indices(a)
                for n, (i, s) in enumerate(items):
                    h[n][upper] = s[1 + 2 * p[n]:]
                h = h + np.transpose(np.triu(h, 1), (0, 2, 1)) + (problem.ridge + 1e-10) * np.eye(a)
                g = np.array([full[n][active[i]] for n, (i, _) in enumerate(items)]).reshape(len(items), a)
                wa = np.array([w[i][active[i]] for i, _ in items]).reshape(len(items), a)
                if a == 0:
                    d = np.zeros((len(items), 0))
                elif problem.lasso:
                    d = lasso_directions(h, g, wa, problem.lasso)
                else:
                    d = -np.linalg.solve(h, g[:, :, None])[:, :, 0]
                out = {"fit": [], "objective": [], "violation": [], "direction": [], "next": []}
                for n, (i, s) in enumerate(items):
                    v, lam = w[i], problem.lasso
                    gap = np.where(v != 0, np.abs(full[n] + lam * np.sign(v)), np.maximum(np.abs(full[n]) - lam, 0.0))
                    # against the penalty; without one, against what the gradient cancels
                    terms = s[1 + p[n]:1 + 2 * p[n]] + problem.ridge * np.abs(v)
                    gap = gap / np.maximum(lam + (ROUNDING if lam else 1.0) * terms, np.finfo(float).tiny)
                    move = np.zeros(len(v))
                    move[active[i]] = d[n]
                    if len(v) <= WORKING_SET + 1:
                        follow = np.arange(len(v))
                    else:
                        order = np.lexsort((-np.abs(full[n]), (v + move) == 0))
                        # always room for features that want to enter
                        room = int(np.count_nonzero(v + move)) + WORKING_SET // 2
                        follow = np.sort(order[:max(WORKING_SET, room)])
                    out["fit"].append(i)
                    out["objective"].append(s[0] + lam * np.abs(v).sum() + problem.ridge / 2 * (v * v).sum())
                    out["violation"].append(gap.max())
                    out["direction"].append(move)
                    out["next"].append(follow)
                yield pa.RecordBatch.from_pydict({
                    "fit": pa.array(out["fit"], pa.int32()),
                    "objective": pa.array(out["objective"], pa.float64()),
                    "violation": pa.array(out["violation"], pa.float64()),
                    "direction": pa.array(out["direction"], pa.list_(pa.float64())),
                    "next": pa.array(out["next"], pa.list_(pa.int64())),
                })

    return step


def solve(rows: DataFrame, fits: list[Fit], problem: Problem, max_steps: int = MAX_STEPS, tolerance: float = 1e-6) -> list[Fit]:
    """Fill in `coef` and `intercept` of every fit. Rows: slot, K, codes, is_pos, x.

    A fit has converged when its optimality conditions hold to `tolerance` of the lasso penalty, or without one, of the
    terms that make up its gradient. Fits that do not get there are an error.
    """
    rows = rows.select("slot", "K", "codes", "is_pos", "x")
    for group in _groups(fits):
        _solve_group(rows, {i: fits[i] for i in group}, problem, max_steps, tolerance)
    return fits


def _solve_group(rows: DataFrame, fits: dict[int, Fit], problem: Problem, max_steps: int, tolerance: float) -> None:
    width = {i: f.width + problem.bias for i, f in fits.items()}
    w = {i: np.zeros(width[i]) for i in fits}
    d = {i: np.zeros(width[i]) for i in fits}
    active = {i: np.arange(width[i]) if width[i] <= WORKING_SET + 1 else np.arange(0) for i in fits}
    size = dict.fromkeys(fits, 1.0)
    best: dict[int, float] = {}
    open_fits = set(fits)
    for _ in range(max_steps):
        if not open_fits:
            break
        trial = {i: w[i] + size[i] * d[i] for i in open_fits}
        sets = {i: active[i] for i in open_fits}
        sums = _sums(rows, problem, {i: fits[i] for i in open_fits}, trial, sets)
        result = sums.mapInArrow(
            _next_directions(problem, trial, sets),
            "fit int, objective double, violation double, direction array<double>, next array<bigint>",
        ).toArrow()
        seen = set()
        for i, objective, gap, move, follow in zip(*(result[c].to_pylist() for c in ("fit", "objective", "violation", "direction", "next"))):
            seen.add(i)
            if i not in best or objective <= best[i] + 1e-12 * abs(best[i]):
                w[i], best[i] = trial[i], objective
                d[i], active[i], size[i] = np.array(move), np.array(follow, dtype=np.int64), 1.0
                if gap <= tolerance:
                    open_fits.discard(i)
            else:
                size[i] *= 0.5
        # a fit without any training row stays at zero
        open_fits &= seen
    if open_fits:
        left = [(fits[i].slot, fits[i].K, fits[i].C) for i in sorted(open_fits)[:5]]
        raise RuntimeError(f"{len(open_fits)} fits have not converged after {max_steps} steps, first (slot, K, C): {left}")
    for i, f in fits.items():
        coef = w[i][:f.width]
        f.coef = coef / f.scale if f.scale is not None else coef
        f.intercept = float(w[i][f.width]) if problem.bias else 0.0


def held_losses(rows: DataFrame, fits: list[Fit]) -> np.ndarray:
    """Mean logistic loss of each fit on its held-out fold, one pass per group of fits."""
    rows = rows.select("slot", "K", "codes", "is_pos", "x")
    out = np.full(len(fits), np.inf)
    for group in _groups(fits):
        for row in _held_sums(rows, {i: fits[i] for i in group}).collect():
            out[row["fit"]] = row["loss"]
    return out


def _held_sums(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    by_cell: dict[tuple, list[int]] = {}
    for i, f in fits.items():
        by_cell.setdefault((f.slot, f.K), []).append(i)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            all_pos = batch["is_pos"].to_numpy(zero_copy_only=False).astype(bool)
            for key, at in cell_groups(batch, "slot", "K"):
                if key not in by_cell:
                    continue
                x, codes, pos = rows_of(batch["x"], at), rows_of(batch["codes"], at), all_pos[at]
                for i in by_cell[key]:
                    f = fits[i]
                    use = np.flatnonzero(codes[:, f.lane] == f.held)
                    m = x[use] @ f.coef + f.intercept
                    loss = np.logaddexp(0.0, np.where(pos[use], -m, m))
                    sums[i] = sums.get(i, 0.0) + np.array([loss.sum(), len(use)])
        if sums:
            yield pa.RecordBatch.from_pydict({
                "fit": pa.array(list(sums), pa.int32()),
                "loss": pa.array([v[0] for v in sums.values()]), "n": pa.array([v[1] for v in sums.values()]),
            })

    totals = rows.mapInArrow(partial, "fit int, loss double, n double").groupBy("fit")
    return totals.agg(F.try_divide(F.sum("loss"), F.sum("n")).alias("loss")).where("loss is not null")
