"""Random forests of all cells together: every task grows trees of some cells, level by level, for many trees at once.

A tree depends on its seed, the rows and their numbers alone, so cells of any size have the same trees however rows are laid out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelsmith.design import Design
from panelsmith.operators.cells import decided
from panelsmith.session import settle

# Fixed values of the study: trees, seed.
TREES = 500
SEED = 1
# Rows up to which a cell's trees are grown in tasks that hold its rows (about 500 MB at 64 features, 80 MB at 10); larger cells get
# the same trees from spread rows.
LOCAL_ROWS = 640_000
# Rows times trees that one task holds at once; it goes on to its next trees after them.
ENTRIES = 1_000_000
# Drawn rows worked on at once, so that what is made of them stays in the processor's cache.
CACHED = 65_536
# Rows times features times trees that a cell with spread rows has on the way at once.
SPREAD_VALUES = 250_000_000
_TOTALS = "slot int, K int, sample_ix bigint, class string, total double"
_ODD = np.uint64(0x9E3779B97F4A7C15)
# Chance that a row is drawn so many times or fewer, for bootstraps by independent draws of mean 1.
_DRAWN = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(16)])


def hashed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_seeds(slot: int, k: int, first: int, stop: int) -> np.ndarray:
    """Seeds of the trees first..stop-1 of a cell."""
    cell = hashed(np.array([(slot << 20) + k], np.uint64) + np.uint64(SEED) * _ODD)
    return hashed(cell + np.arange(first, stop, dtype=np.uint64) * _ODD)


def bootstrap(seeds: np.ndarray, sample_ix: np.ndarray) -> np.ndarray:
    """How often each tree draws each row: (tree, row). It depends on the tree and the row's number alone, not on the layout."""
    rows = hashed(sample_ix.astype(np.int64).view(np.uint64) + _ODD)
    u = (hashed(seeds[:, None] ^ rows[None, :]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(_DRAWN, u.ravel()).reshape(u.shape)


def feature_order(seeds: np.ndarray, n_features: int) -> np.ndarray:
    """The order in which nodes try features: (node, place)."""
    return np.argsort(hashed(seeds[:, None] + np.arange(1, n_features + 1, dtype=np.uint64)[None, :] * _ODD), axis=1, kind="stable")


def child_seeds(seeds: np.ndarray, side: int) -> np.ndarray:
    return hashed(seeds * np.uint64(2) + np.uint64(side + 1))


def coded(x: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Every value's place among the distinct values of its feature (feature, row), and those values, of a matrix in pieces."""
    codes, values = np.empty((x[0].shape[1], sum(map(len, x))), np.int32), []
    for f in range(len(codes)):
        distinct, codes[f] = np.unique(np.concatenate([piece[:, f] for piece in x]), return_inverse=True)
        values.append(distinct)
    return codes, values


class Trees:
    """Trees of one cell as flat arrays: feature (-1 for a leaf), threshold, children, share of positive weight. Roots come first."""

    def __init__(
        self, x: np.ndarray | None, positive: np.ndarray, drawn: np.ndarray, seeds: np.ndarray, weights: tuple[float, float],
        codes: tuple[np.ndarray, list[np.ndarray]] | None = None,
    ):
        """Grow a tree for every row of `drawn` until nodes are pure or their rows equal.

        A node tries the square root of all features (rounded down) in its own order, and goes on to further ones as long as
        none of them parts its rows. The best cut by weighted Gini impurity is taken; of equal ones the first feature
        tried, then the least threshold, half way between two values. `weights` are those of negative and positive rows; `codes`
        are those of `x`, which is not looked at if they are given.

        Entries (rows drawn by a tree) lie node by node; nodes that fit the processor's cache are worked on together.
        """
        self.codes, self.values = codes if codes is not None else coded([x])
        self.n_features = len(self.values)
        self.weights = weights
        self.n_trees = n = len(seeds)
        tree, row = np.nonzero(drawn)
        times = drawn[tree, row]
        # class and count of an entry in one small number
        self.count_bits = int(times.max(initial=1)).bit_length()
        mark = (times | positive[row].astype(np.int64) << self.count_bits).astype(np.uint32)
        self.code_bits = max(1, int(self.codes.max(initial=0)).bit_length())
        counts = np.arange(1 << self.count_bits, dtype=np.int64)
        self.packed = np.concatenate([counts, counts << 32])
        pos = np.bincount(tree, times * positive[row], n).astype(np.int64)
        neg = np.bincount(tree, times * ~positive[row], n).astype(np.int64)
        size = np.bincount(tree, minlength=n)
        mixed = (pos > 0) & (neg > 0)
        inside = np.repeat(mixed, size)
        row, mark, size = row[inside].astype(np.int32), mark[inside], size[mixed]
        levels, first = [self._leaves(pos, neg)], 0
        pos, neg, seeds, at = pos[mixed], neg[mixed], seeds[mixed], np.flatnonzero(mixed)
        while len(at):
            cuts, rows, marks, sizes = [], [], [], []
            start = np.cumsum(size) - size
            bounds = np.flatnonzero(np.diff(start // CACHED, prepend=-1))
            for a, b in zip(bounds, [*bounds[1:], len(at)]):
                part = slice(start[a], start[b - 1] + size[b - 1])
                cut = self._best_cuts(row[part], mark[part], size[a:b], pos[a:b], neg[a:b], seeds[a:b])
                cuts.append(cut)
                for whole, piece in zip((rows, marks, sizes), self._parted(row[part], mark[part], size[a:b], pos[a:b], neg[a:b], cut)):
                    whole.append(piece)
            feature, low, high, left_pos, left_neg = (np.concatenate(c) for c in zip(*cuts))
            split = np.flatnonzero(feature >= 0)
            here, first = levels[-1], first + len(levels[-1][0])
            here[0][at[split]] = feature[split]
            for f in np.unique(feature[split]):
                mine = split[feature[split] == f]
                here[1][at[mine]] = (self.values[f][low[mine]] + self.values[f][high[mine]]) / 2
            here[2][at[split]] = first + 2 * np.arange(len(split))
            left_pos, left_neg = left_pos[split], left_neg[split]
            seeds = np.stack([child_seeds(seeds[split], 0), child_seeds(seeds[split], 1)], axis=1).reshape(-1)
            pos = np.stack([left_pos, pos[split] - left_pos], axis=1).reshape(-1)
            neg = np.stack([left_neg, neg[split] - left_neg], axis=1).reshape(-1)
            levels.append(self._leaves(pos, neg))
            at = np.flatnonzero((pos > 0) & (neg > 0))
            pos, neg, seeds = pos[at], neg[at], seeds[at]
            row, mark, size = np.concatenate(rows), np.concatenate(marks), np.concatenate(sizes)
        # the right child follows the left one
        self.feature, self.threshold, self.left, self.share = (np.concatenate(a) for a in zip(*levels))

    def _leaves(self, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A level whose nodes are all leaves so far: feature, threshold, left child, share."""
        p, q, n = pos * self.weights[1], neg * self.weights[0], len(pos)
        # a tree that drew no row says nothing
        share = np.divide(p, p + q, out=np.full(n, 0.5), where=p + q > 0)
        return np.full(n, -1), np.zeros(n), np.full(n, -1), share

    def _best_cuts(self, row, mark, size, pos, neg, seeds) -> tuple[np.ndarray, ...]:
        """Per node the feature of the best cut (-1: none), the codes on either side of it, and the positives and negatives left of it."""
        n = len(size)
        feature, best = np.full(n, -1), np.full(n, -np.inf)
        low, high, left_pos, left_neg = (np.zeros(n, np.int64) for _ in range(4))
        tries = max(1, int(np.sqrt(self.n_features)))
        order = feature_order(seeds, self.n_features)
        for done in range(0, self.n_features, tries):
            # nodes without a cut so far go on to their next features
            nodes = np.flatnonzero(feature < 0)
            if not len(nodes):
                break
            if len(nodes) < n:
                inside = np.repeat(feature < 0, size)
                entries, marks = row[inside], mark[inside]
            else:
                entries, marks = row, mark
            found = self._tried(entries, marks, size[nodes], pos[nodes], neg[nodes], order[nodes, done : done + tries])
            feature[nodes], low[nodes], high[nodes], left_pos[nodes], left_neg[nodes] = found
        return feature, low, high, left_pos, left_neg

    def _tried(self, row, mark, size, pos, neg, order) -> tuple[np.ndarray, ...]:
        """The same for all nodes with the features of `order` alone."""
        n = len(size)
        feature, best = np.full(n, -1), np.full(n, -np.inf)
        low, high, left = (np.zeros(n, np.int64) for _ in range(3))
        start = np.cumsum(size) - size
        # node, code, class and count in one number: one sort lines everything up
        low_bits = self.count_bits + 1
        shift = low_bits + self.code_bits
        kind = np.uint32 if (n - 1).bit_length() + shift <= 32 else np.uint64
        fixed = np.repeat(np.arange(n, dtype=kind) << kind(shift), size) | mark.astype(kind)
        totals = pos << 32 | neg
        all_pos, all_neg = np.repeat(pos * self.weights[1], size), np.repeat(neg * self.weights[0], size)
        flat, n_rows = self.codes.reshape(-1), self.codes.shape[1]
        for place in range(order.shape[1]):
            at = np.repeat(order[:, place] * n_rows, size)
            at += row
            key = flat[at].astype(kind)
            key <<= kind(low_bits)
            key |= fixed
            key.sort()
            sums = self.packed[key & kind((1 << low_bits) - 1)]
            sums[start[1:]] -= totals[:-1]
            np.cumsum(sums, out=sums)
            lp, lq = (sums >> 32) * self.weights[1], (sums & 0xFFFFFFFF) * self.weights[0]
            gain = lp * lp
            gain += lq * lq
            rp, rq = all_pos - lp, all_neg - lq
            lp += lq
            gain /= lp
            other = rp * rp
            rp += rq
            rq *= rq
            other += rq
            # nothing is right of a node's last entry
            rp[start[1:] - 1] = rp[-1] = 1.0
            other /= rp
            gain += other
            key >>= kind(low_bits)
            gain[:-1][key[1:] == key[:-1]] = -np.inf
            gain[start[1:] - 1] = gain[-1] = -np.inf
            top = np.maximum.reduceat(gain, start)
            better = np.flatnonzero(top > best)
            if not len(better):
                continue
            hits = np.flatnonzero(gain == np.repeat(top, size))
            cut = hits[np.searchsorted(hits, start[better])]
            best[better], feature[better], left[better] = top[better], order[better, place], sums[cut]
            codes = kind((1 << self.code_bits) - 1)
            low[better], high[better] = key[cut] & codes, key[cut + 1] & codes
        return feature, low, high, left >> 32, left & 0xFFFFFFFF

    def _parted(self, row, mark, size, pos, neg, cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of the children with rows of both classes, child by child, and the sizes of these."""
        feature, low, _, left_pos, left_neg = cut
        is_split = feature >= 0
        kept = is_split & (left_pos > 0) & (left_neg > 0), is_split & (left_pos < pos) & (left_neg < neg)
        at = np.repeat(np.maximum(feature, 0) * self.codes.shape[1], size)
        at += row
        right = self.codes.reshape(-1)[at] > np.repeat(low, size)
        node = np.repeat(np.arange(len(size)), size)
        sides = [np.flatnonzero((right == side) & np.repeat(kept[side], size)) for side in (0, 1)]
        counts = np.stack([np.bincount(node[s], minlength=len(size)) for s in sides], axis=1)
        begin = (np.cumsum(counts) - counts.reshape(-1)).reshape(-1, 2)
        rows, marks = np.empty(counts.sum(), row.dtype), np.empty(counts.sum(), mark.dtype)
        for side, entries in enumerate(sides):
            n = counts[:, side]
            to = np.repeat(begin[:, side] - (np.cumsum(n) - n), n) + np.arange(len(entries))
            rows[to], marks[to] = row[entries], mark[entries]
        counts = counts.reshape(-1)
        return rows, marks, counts[counts > 0]

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Sum over all trees of the leaves' shares, for every row."""
        total = np.zeros(len(x))
        step = max(1, CACHED // self.n_trees)
        for start in range(0, len(x), step):
            part = np.ascontiguousarray(x[start : start + step])
            node = np.repeat(np.arange(self.n_trees), len(part))
            line = np.tile(np.arange(len(part)) * x.shape[1], self.n_trees)
            part = part.reshape(-1)
            going = np.flatnonzero(self.feature[node] >= 0)
            here, line = node[going], line[going]
            while len(going):
                # a value that is not at most the threshold goes right, one that is no number too
                here = self.left[here] + ~(part[line + self.feature[here]] <= self.threshold[here])
                node[going] = here
                on = np.flatnonzero(self.feature[here] >= 0)
                going, here, line = going[on], here[on], line[on]
            total[start : start + step] = self.share[node].reshape(self.n_trees, -1).sum(axis=0)
        return total


def class_weights(positive: np.ndarray, balanced: bool) -> tuple[float, float]:
    """Weights of negative and positive rows: 1, or such that both classes of the cell weigh the same."""
    n, p = len(positive), int(positive.sum())
    if not balanced or not 0 < p < n:
        return 1.0, 1.0
    return n / (2 * (n - p)), n / (2 * p)


def _values(column: pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of all runs of equal integer keys within batches."""
    for batch in batches:
        codes = np.stack([batch[c].to_numpy() for c in keys], axis=1)
        edges = (np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(codes)]):
            if b > a:
                yield tuple(codes[a].tolist()), batch.slice(a, b - a)


def _both(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training and test rows in one table; the latter have no `is_pos`."""
    return train.select("slot", "K", "sample_ix", F.lit(None).cast("string").alias("class"), "is_pos", "x").unionByName(
        test.select("slot", "K", "sample_ix", "class", F.lit(None).cast("boolean").alias("is_pos"), "x")
    )


def _totals(slot: int, k: int, parts: list[pa.RecordBatch], total: np.ndarray) -> pa.RecordBatch:
    rows = pa.Table.from_batches([part.select(["sample_ix", "class"]) for part in parts]).combine_chunks()
    return pa.RecordBatch.from_pydict({
        "slot": pa.array(np.full(len(total), slot), pa.int32()), "K": pa.array(np.full(len(total), k), pa.int32()),
        "sample_ix": rows["sample_ix"].combine_chunks(), "class": rows["class"].combine_chunks(), "total": pa.array(total),
    })


def grown_together(train: DataFrame, test: DataFrame, sizes: DataFrame, balanced: bool, trees: int) -> DataFrame:
    """(slot, K, sample_ix, class, total) of the test rows of all cells in `sizes(slot, K, n)`, in one job: the leaves' shares summed up.

    A task has a cell's rows and all its trees, or some of them when cells are too few for all cores: a cell's rows are copied no
    more often than that. Trees are grown in batches of about ENTRIES drawn rows. Draws are hashes, so the layout changes nothing.
    """
    spark = train.sparkSession
    cells = sizes.count()
    spread = -(-2 * spark.sparkContext.defaultParallelism // max(cells, 1))
    sizes = sizes.select("slot", "K", F.lit(min(spread, trees)).alias("parts"))
    rows = _both(train, test).join(sizes, ["slot", "K"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # small tables are long work: more partitions than groups, so that few groups share one
    keys = ["slot", "K", "part", "parts"]
    rows = rows.repartition(max(1, min(4 * cells * min(spread, trees), 4096)), *keys)

    def scored(key: tuple, known: list[pa.RecordBatch], asked: list[pa.RecordBatch]) -> pa.RecordBatch:
        slot, k, part, parts = key
        positive = np.concatenate([r["is_pos"].to_numpy(zero_copy_only=False).astype(bool) for r in known])
        ids = np.concatenate([r["sample_ix"].to_numpy() for r in known])
        codes, weights = coded([_values(r["x"]) for r in known]), class_weights(positive, balanced)
        # codes are all that trees need
        known.clear()
        total = np.zeros(sum(r.num_rows for r in asked))
        first, stop, step = part * trees // parts, (part + 1) * trees // parts, max(1, ENTRIES // max(1, len(ids)))
        for a in range(first, stop, step):
            seeds = tree_seeds(slot, k, a, min(a + step, stop))
            grown = Trees(None, positive, bootstrap(seeds, ids), seeds, weights, codes)
            total += np.concatenate([grown.shares(_values(r["x"])) for r in asked])
        return _totals(slot, k, asked, total)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known, asked = None, [], []
        for key, rows in _runs(batches, keys):
            if key != here and here is not None:
                yield scored(here, known, asked)
                known, asked = [], []
            here = key
            for held, some in ((known, rows.filter(rows["is_pos"].is_valid())), (asked, rows.filter(rows["is_pos"].is_null()))):
                if some.num_rows:
                    held.append(some)
        if here is not None:
            yield scored(here, known, asked)

    return rows.sortWithinPartitions(*keys).mapInArrow(grow, _TOTALS)


def _reached(x: np.ndarray, row: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Where rows end that start at `node`; what is not at most the cut goes right."""
    node = node.copy()
    going = np.flatnonzero(feature[node] >= 0)
    while len(going):
        at = node[going]
        node[going] = left[at] + ~(x[row[going], feature[at]] <= cut[at])
        going = going[feature[node[going]] >= 0]
    return node


class _Tops:
    """The upper nodes of some trees, whose rows are spread: a node is cut, a leaf, or left to a task that has all its rows."""

    def __init__(self, seeds: np.ndarray) -> None:
        n = len(seeds)
        self.roots, self.seeds = seeds, seeds
        self.feature, self.left = np.full(n, -1), np.full(n, -1)
        self.low, self.threshold = np.zeros(n), np.zeros(n)
        self.pos, self.neg, self.rows = (np.zeros(n, np.int64) for _ in range(3))

    def split(self, node: int, feature: int, low: float, high: float, left: tuple[int, int, int]) -> list[int]:
        """Cut a node at a feature; `left` are positives, negatives and rows of the left child."""
        at = len(self.feature)
        self.feature[node], self.left[node], self.low[node], self.threshold[node] = feature, at, low, (low + high) / 2
        whole = np.array([self.pos[node], self.neg[node], self.rows[node]])
        self.pos, self.neg, self.rows = (np.append(a, [v, w - v]) for a, v, w in zip((self.pos, self.neg, self.rows), left, whole))
        self.seeds = np.concatenate([self.seeds, *(child_seeds(self.seeds[node : node + 1], side) for side in (0, 1))])
        self.feature, self.left = (np.append(a, [-1, -1]) for a in (self.feature, self.left))
        self.low, self.threshold = (np.append(a, [0.0, 0.0]) for a in (self.low, self.threshold))
        return [at, at + 1]

    def drawn(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(values, class, row, node, times) of the entries that the trees draw from training rows."""
        x, positive = _values(batch["x"]), batch["is_pos"].to_numpy(zero_copy_only=False).astype(bool)
        times = bootstrap(self.roots, batch["sample_ix"].to_numpy())
        tree, row = np.nonzero(times)
        return x, positive, row, _reached(x, row, tree, self.feature, self.low, self.left), times[tree, row]


def _counts(train: DataFrame, tops: _Tops) -> None:
    """Fill in what the roots draw."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, positive, row, node, times = tops.drawn(batch)
            each = [np.bincount(node, w, len(tops.roots)).astype(np.int64) for w in (times * positive[row], times * ~positive[row], np.ones(len(row)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tops.roots))), *map(pa.array, each)], names=["node", "pos", "neg", "n"])

    counted = train.mapInArrow(count, "node bigint, pos bigint, neg bigint, n bigint")
    for r in counted.groupBy("node").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("n").alias("n")).collect():
        tops.pos[r["node"]], tops.neg[r["node"]], tops.rows[r["node"]] = r["pos"], r["neg"], r["n"]


def _spread_cuts(train: DataFrame, tops: _Tops, nodes: list[int], order: np.ndarray, weights: tuple[float, float]) -> list:
    """The best cut of each node among the features of `order` (node, place), as `Trees` takes it; rows are sorted by Spark."""
    place_of = np.full(len(tops.feature), -1)
    place_of[nodes] = np.arange(len(nodes))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, positive, row, node, times = tops.drawn(batch)
            inside = place_of[node] >= 0
            row, node, times = row[inside], node[inside], times[inside]
            for place in range(order.shape[1]):
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(node), "place": pa.array(np.full(len(node), place), pa.int32()),
                    "low": pa.array(x[row, order[place_of[node], place]]),
                    "p": pa.array(times * positive[row]), "q": pa.array(times * ~positive[row]),
                })

    spark = train.sparkSession
    totals = spark.createDataFrame([(i, int(tops.pos[i]), int(tops.neg[i])) for i in nodes], "node bigint, pos bigint, neg bigint")
    here = Window.partitionBy("node", "place").orderBy("low")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = train.mapInArrow(emit, "node bigint, place int, low double, p bigint, q bigint").groupBy("node", "place", "low").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("n")
    ).select("node", "place", "low", F.lead("low").over(here).alias("high"), *[F.sum(c).over(upto).alias(c) for c in ("p", "q", "n")])
    lp, lq = F.col("p") * F.lit(float(weights[1])), F.col("q") * F.lit(float(weights[0]))
    cuts = counted.where("high is not null").join(totals, "node").withColumns({"lp": lp, "lq": lq}).withColumns({
        "rp": F.col("pos") * F.lit(float(weights[1])) - F.col("lp"), "rq": F.col("neg") * F.lit(float(weights[0])) - F.col("lq"),
    }).withColumn("gain", F.expr("(lp * lp + lq * lq) / (lp + lq) + (rp * rp + rq * rq) / (rp + rq)"))
    best = F.max_by(F.struct("place", "low", "high", "p", "q", "n"), F.struct("gain", -F.col("place"), -F.col("low")))
    return cuts.groupBy("node").agg(best.alias("cut")).select("node", "cut.*").collect()


def _tops(train: DataFrame, seeds: np.ndarray, weights: tuple[float, float], n_features: int, local_rows: int) -> _Tops:
    """Trees grown as far as nodes have more than `local_rows` rows."""
    tops = _Tops(seeds)
    _counts(train, tops)
    tries = max(1, int(np.sqrt(n_features)))
    new = list(range(len(seeds)))
    while nodes := [i for i in new if tops.rows[i] > local_rows and tops.pos[i] and tops.neg[i]]:
        new, order = [], feature_order(tops.seeds[nodes], n_features)
        for done in range(0, n_features, tries):
            found = {r["node"]: r for r in _spread_cuts(train, tops, nodes, order[:, done : done + tries], weights)}
            for at, i in enumerate(nodes):
                if i in found:
                    r = found[i]
                    new += tops.split(i, int(order[at, done + r["place"]]), r["low"], r["high"], (r["p"], r["q"], r["n"]))
            # nodes without a cut so far go on to their next features
            order = order[[i not in found for i in nodes]]
            nodes = [i for i in nodes if i not in found]
            if not nodes:
                break
        # what is left has equal rows only
        tops.rows[nodes] = 0
    return tops


def grown_spread(
    train: DataFrame, test: DataFrame, slot: int, k: int, size: int, balanced: bool, trees: int, local_rows: int,
) -> DataFrame:
    """The same for one cell that no task should hold, with the same trees: rows stay spread as long as a node has more than `local_rows`.

    Upper nodes are cut by counts of all values that Spark sorts; the driver keeps these nodes alone. The rows of a lower node, its
    training rows first, go to one task that grows what is below it and scores test rows as they come. Trees go in batches of
    about SPREAD_VALUES numbers, so disk has a fixed bound and time grows with rows times trees.
    """
    here = (F.col("slot") == slot) & (F.col("K") == k)
    train, test = train.where(here), test.where(here)
    n, p, n_features = train.agg(F.count(F.lit(1)), F.count_if("is_pos"), F.max(F.size("x"))).first()
    weights = (n / (2 * (n - p)), n / (2 * p)) if balanced and 0 < p < n else (1.0, 1.0)
    step, out = max(1, SPREAD_VALUES // (size * n_features)), []
    for a in range(0, trees, step):
        tops = _tops(train, tree_seeds(slot, k, a, min(a + step, trees)), weights, n_features, local_rows)
        out.append(settle(_finished(train, test, tops, weights), "forest"))
    return reduce(DataFrame.unionByName, out)


def _finished(train: DataFrame, test: DataFrame, tops: _Tops, weights: tuple[float, float]) -> DataFrame:
    """(slot, K, sample_ix, class, total): test rows scored by upper leaves, and by the trees below upper nodes."""
    below = (tops.feature < 0) & (tops.rows > 0) & (tops.pos > 0) & (tops.neg > 0)
    p, q = tops.pos * weights[1], tops.neg * weights[0]
    share = np.divide(p, p + q, out=np.full(len(p), 0.5), where=p + q > 0)
    share[below] = 0.0

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn = batch.filter(batch["is_pos"].is_valid())
            asked = batch.filter(batch["is_pos"].is_null())
            if learn.num_rows:
                _, _, row, node, times = tops.drawn(learn)
                yield from _addressed(learn, row, node, times, below[node])
            if asked.num_rows:
                tree, row = (a.ravel() for a in np.indices((len(tops.roots), asked.num_rows)))
                node = _reached(_values(asked["x"]), row, tree, tops.feature, tops.threshold, tops.left)
                yield from _addressed(asked, row, node, np.zeros(len(row), np.int64), below[node])
                total = share[node].reshape(len(tops.roots), -1).sum(axis=0)
                # what upper leaves say, under no node
                yield from _addressed(asked, np.arange(asked.num_rows), np.full(asked.num_rows, -1), np.zeros(asked.num_rows, np.int64), None, total)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, tree = None, [], None
        for (node, is_asked), rows in _runs(batches, ["node", "asked"]):
            if node != here:
                here, held, tree = node, [], None
            if not is_asked:
                held.append(rows)
                continue
            if node >= 0 and tree is None:
                positive, times = (np.concatenate([r[c].to_numpy(zero_copy_only=False) for r in held]) for c in ("is_pos", "times"))
                codes = coded([_values(r["x"]) for r in held])
                held = []
                tree = Trees(None, positive.astype(bool), times[None, :], tops.seeds[node : node + 1], weights, codes)
            total = rows["total"].to_numpy() if node < 0 else tree.shares(_values(rows["x"]))
            yield _totals(rows["slot"][0].as_py(), rows["K"][0].as_py(), [rows], total)

    fields = "node bigint, asked int, times bigint, total double, slot int, K int, sample_ix bigint, class string, is_pos boolean, x array<double>"
    rows = _both(train, test).mapInArrow(sent, fields)
    return rows.where("node < 0").mapInArrow(grow, _TOTALS).unionByName(
        rows.where("node >= 0").repartition(max(1, min(4 * int(below.sum()), 4096)), "node").sortWithinPartitions("node", "asked").mapInArrow(grow, _TOTALS)
    )


def _addressed(batch: pa.RecordBatch, row, node, times, inside=None, total=None) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by the node they go to, a piece at a time."""
    at = np.arange(len(row)) if inside is None else np.flatnonzero(inside)
    for a in range(0, len(at), CACHED):
        some = at[a : a + CACHED]
        rows = batch.take(pa.array(row[some]))
        asked = pa.array(rows["is_pos"].is_null().to_numpy(zero_copy_only=False).astype(np.int32))
        yield pa.RecordBatch.from_pydict({
            "node": pa.array(node[some]), "asked": asked, "times": pa.array(times[some]),
            "total": pa.array(np.zeros(len(some)) if total is None else total[some]),
            **{c: rows[c] for c in ("slot", "K", "sample_ix", "class", "is_pos", "x")},
        })


def predict(
    train: DataFrame, test: DataFrame, design: Design, balanced: bool = False,
    trees: int = TREES, name: str = "RF", local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """Fit one forest per cell and score its test rows.

    Trees have no depth limit and every value of a feature may be a cut. All cells of `local_rows` rows (train and test) or
    fewer go in one job; larger ones get the same trees one after the other, with their rows spread over tasks.
    """
    train = settle(train.select("slot", "K", "sample_ix", "is_pos", "x"), "forest-train", "slot", "K")
    test = settle(test.select("slot", "K", "sample_ix", "class", "x"), "forest-test", "slot", "K")
    held = test.groupBy("slot", "K").agg(F.count(F.lit(1)).alias("held"))
    sizes = train.groupBy("slot", "K").agg(F.count(F.lit(1)).alias("n")).join(held, ["slot", "K"])
    sizes = settle(sizes.withColumn("n", F.col("n") + F.col("held")), "forest-sizes")
    sums = grown_together(train, test, sizes.where(F.col("n") <= local_rows), balanced, trees)
    # each of these has more rows than a task should hold, so there are few
    for r in sizes.where(F.col("n") > local_rows).collect():
        sums = sums.unionByName(grown_spread(train, test, r["slot"], r["K"], r["n"], balanced, trees, local_rows))
    sums = sums.groupBy("slot", "K", "sample_ix", "class").agg(F.sum("total").alias("total"))
    return decided(sums.select("slot", "K", "sample_ix", "class", (F.col("total") / trees).alias("p_pos")), name, design)
