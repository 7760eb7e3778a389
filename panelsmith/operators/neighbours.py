"""Exact k-nearest rows within a cell, block by block.

Rows of a cell are sorted along their first feature and packed into blocks of
bounded size with a bounding box. The query blocks of a cell are dealt to tiles
of bounded size; a task holds one tile and reads the training blocks of the cell
one after the other, so every query row leaves with its k best neighbours and
neither pairs of blocks nor pairs of samples are stored. Blocks whose boxes are
further apart than the k-th distance so far are not compared. A cell that holds
most rows is simply more tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelsmith.session import settle

BLOCK_ROWS = 1024
# Numbers that the query rows of a tile may hold (64 MB): a training block is copied once per tile of its cell.
TILE_VALUES = 8_000_000
# Shares of candidates above which rounded distances tell too little, and the largest squared length they are taken for.
_CROWDED = 0.02
_LARGE = 1e30

_BLOCK_SCHEMA = (
    "slot int, K int, block bigint, n int, ids array<bigint>, pos array<boolean>, "
    "mat array<double>, lo array<double>, hi array<double>"
)
_TILE = ["slot", "K", "tile"]
_TILED = [*_TILE, "asked", "n", "ids", "pos", "mat", "lo", "hi"]
_HIT_SCHEMA = "slot int, K int, sample_ix bigint, near_ix bigint, near_pos boolean, d2 double"


def pack_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of at most `block_rows` rows (slot, K, sample_ix, is_pos, x) of one cell."""
    order = ["slot", "K", "_first", "sample_ix"]
    laid_out = (
        rows.select("slot", "K", "sample_ix", "is_pos", "x", F.get("x", F.lit(0)).alias("_first"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .select("slot", "K", "sample_ix", "is_pos", "x", "_part")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            slot = batch["slot"].to_numpy()
            k = batch["K"].to_numpy()
            part = int(batch["_part"][0].as_py())
            edges = np.flatnonzero((np.diff(slot) != 0) | (np.diff(k) != 0)) + 1
            bounds = [0, *edges.tolist(), batch.num_rows]
            out = []
            for a, b in zip(bounds, bounds[1:]):
                for lo in range(a, b, block_rows):
                    piece = batch.slice(lo, min(block_rows, b - lo))
                    x = piece["x"].flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                    out.append({
                        "slot": int(slot[lo]), "K": int(k[lo]),
                        "block": (part << 32) + serial, "n": piece.num_rows,
                        "ids": piece["sample_ix"].to_numpy(), "pos": piece["is_pos"].to_numpy(zero_copy_only=False),
                        "mat": x.ravel(), "lo": x.min(axis=0), "hi": x.max(axis=0),
                    })
                    serial += 1
            yield _block_batch(out)

    return laid_out.mapInArrow(pack, _BLOCK_SCHEMA)


def _block_batch(blocks: list[dict]) -> pa.RecordBatch:
    def lists(name: str, kind: pa.DataType) -> pa.Array:
        sizes = np.cumsum([0] + [len(b[name]) for b in blocks])
        values = pa.array(np.concatenate([b[name] for b in blocks]), type=kind)
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)

    return pa.RecordBatch.from_pydict({
        "slot": pa.array([b["slot"] for b in blocks], pa.int32()),
        "K": pa.array([b["K"] for b in blocks], pa.int32()),
        "block": pa.array([b["block"] for b in blocks], pa.int64()),
        "n": pa.array([b["n"] for b in blocks], pa.int32()),
        "ids": lists("ids", pa.int64()),
        "pos": lists("pos", pa.bool_()),
        "mat": lists("mat", pa.float64()),
        "lo": lists("lo", pa.float64()),
        "hi": lists("hi", pa.float64()),
    })


def dealt(queries: DataFrame, train: DataFrame, tile_values: int = TILE_VALUES) -> DataFrame:
    """Blocks by tile (slot, K, tile), its query blocks first: a query block goes to one tile of its cell, a training block to each.

    Tiles hold about `tile_values` numbers of queries; cells too few for all cores have smaller ones.
    """
    sizes = queries.groupBy("slot", "K").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"), F.max(F.size("lo")).alias("width")
    )
    sizes = settle(sizes, "tile-sizes")
    spread = -(-2 * queries.sparkSession.sparkContext.defaultParallelism // max(sizes.count(), 1))
    large = F.ceil(F.col("n") * F.col("width") / F.lit(tile_values))
    tiles = sizes.select("slot", "K", F.least("blocks", F.greatest(F.lit(spread), large)).cast("int").alias("tiles"))
    n_tiles = tiles.agg(F.coalesce(F.sum("tiles"), F.lit(0))).first()[0]
    # a mixed order: bounds tighten early when training blocks come from everywhere
    mixed = F.xxhash64("block").alias("_mixed")
    asked = queries.join(tiles, ["slot", "K"]).select(
        "*", F.pmod(F.xxhash64("block"), "tiles").cast("int").alias("tile"), F.lit(True).alias("asked"), mixed
    )
    given = train.join(tiles, ["slot", "K"]).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(False).alias("asked"), mixed
    )
    # more partitions than tiles, so that few tiles share one
    return (
        asked.select(*_TILED, "_mixed").unionByName(given.select(*_TILED, "_mixed"))
        .repartition(max(1, min(4 * n_tiles, 4096)), *_TILE)
        .sortWithinPartitions(*_TILE, F.desc("asked"), "_mixed")
        .select(*_TILED)
    )


class _Asked:
    """The query rows of one block with their k best training rows so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> None:
        self.ids, self.x, self.lo, self.hi, self.k = ids, x, lo, hi, k
        self.squares = (x * x).sum(axis=1)
        self.largest = self.squares.max()
        # rounded rows with a one for the training row's squared length
        self.rounded = np.hstack([-2.0 * x, np.ones((len(x), 1))]).astype(np.float32) if self.largest < _LARGE else None
        self.d2 = np.full((len(x), k), np.inf)
        self.near = np.full((len(x), k), np.iinfo(np.int64).max)
        self.pos = np.zeros((len(x), k), bool)

    def meet(self, t: _Given, same_rows: bool) -> None:
        """Take in what a training block offers."""
        kth = self.d2[:, -1]
        worst = kth.max()
        if worst < np.inf:
            gap = np.maximum(0.0, np.maximum(t.lo - self.hi, self.lo - t.hi))
            # the margin keeps a block whose gap is equal but for rounding
            if (gap * gap).sum() > worst * (1 + 1e-9):
                return
            rows, cols = self._candidates(t, kth)
            # where the k-th is a copy, only lower ids come before it
            useful = (kth[rows] > 0) | (t.ids[cols] < self.near[rows, -1])
            rows, cols = rows[useful], cols[useful]
            d2 = _squared_distances(self.x, t.x, rows, cols)
            better = d2 <= kth[rows]
            if same_rows:
                better &= self.ids[rows] != t.ids[cols]
            rows, cols, d2 = rows[better], cols[better], d2[better]
        else:
            rows, cols, d2 = best_in_block(self.x, self.ids, t.x, t.ids, self.k, same_rows)
        if len(rows):
            self._take(rows, d2, t.ids[cols], t.pos[cols])

    def _candidates(self, t: _Given, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that can be nearer than the k-th so far: all within the rounding error of a matrix product."""
        if self.rounded is not None and t.rounded is not None:
            error = (self.x.shape[1] + 8) * 2.0**-22 * (self.squares + t.largest) + 1e-30
            limit = np.nextafter((kth + error - self.squares).astype(np.float32), np.float32(np.inf))
            near = self.rounded @ t.rounded.T <= limit[:, None]
            if np.count_nonzero(near) <= _CROWDED * near.size:
                return np.nonzero(near)
        rough = self.squares[:, None] + t.squares[None, :] - 2.0 * (self.x @ t.x.T)
        error = 1e-12 * (self.squares + t.largest + 1e-300)
        return np.nonzero(rough <= (kth + 2 * error)[:, None])

    def _take(self, rows: np.ndarray, d2: np.ndarray, near: np.ndarray, pos: np.ndarray) -> None:
        met = np.unique(rows)
        rows = np.concatenate([np.repeat(met, self.k), rows])
        d2 = np.concatenate([self.d2[met].ravel(), d2])
        near = np.concatenate([self.near[met].ravel(), near])
        pos = np.concatenate([self.pos[met].ravel(), pos])
        order = np.lexsort((near, d2, rows))
        ordered = rows[order]
        kept = order[np.arange(len(order)) - np.searchsorted(ordered, ordered, side="left") < self.k]
        self.d2[met], self.near[met], self.pos[met] = (a[kept].reshape(len(met), self.k) for a in (d2, near, pos))


class _Given:
    """The training rows of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.ids, self.x, self.pos, self.lo, self.hi = ids, x, pos, lo, hi
        self.squares = (x * x).sum(axis=1)
        self.largest = self.squares.max()
        self.rounded = np.hstack([x, self.squares[:, None]]).astype(np.float32) if self.largest < _LARGE else None


def _squared_distances(q: np.ndarray, t: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    d2 = np.empty(len(rows))
    for a in range(0, len(rows), 65_536):
        diff = q[rows[a:a + 65_536]] - t[cols[a:a + 65_536]]
        d2[a:a + 65_536] = (diff * diff).sum(axis=1)
    return d2


def best_in_block(q: np.ndarray, qid: np.ndarray, t: np.ndarray, tid: np.ndarray, k: int, same_rows: bool):
    """(query row, train row, squared distance) of the k nearest, ties by train id.

    A matrix product finds every candidate that can be among the k nearest
    within its rounding error; their distances are then computed directly.
    """
    q2, t2 = (q * q).sum(axis=1), (t * t).sum(axis=1)
    rough = q2[:, None] + t2[None, :] - 2.0 * (q @ t.T)
    if same_rows:
        rough[qid[:, None] == tid[None, :]] = np.inf
    error = 1e-12 * (q2 + t2.max() + 1e-300)
    if t.shape[0] > k:
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * error
    else:
        limit = np.full(len(q), np.finfo(float).max)
    rows, cols = np.nonzero(rough <= limit[:, None])
    d2 = _squared_distances(q, t, rows, cols)
    order = np.lexsort((tid[cols], d2, rows))
    rows, cols, d2 = rows[order], cols[order], d2[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep], d2[keep]


def nearest(queries: DataFrame, train: DataFrame, k: int, same_rows: bool = False, tile_values: int = TILE_VALUES) -> DataFrame:
    """(slot, K, sample_ix, near_ix, near_pos, d2, nth) for query blocks against train blocks."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tile = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                cell = tuple(batch[c][i].as_py() for c in _TILE)
                if cell != here:
                    yield from _hits(here, tile)
                    here, tile = cell, []
                ids, lo, hi = (batch[c][i].values.to_numpy() for c in ("ids", "lo", "hi"))
                x = batch["mat"][i].values.to_numpy().reshape(len(ids), -1)
                if batch["asked"][i].as_py():
                    # copies, so that a tile does not keep whole batches
                    tile.append(_Asked(ids.copy(), x.copy(), lo.copy(), hi.copy(), k))
                else:
                    block = _Given(ids, x, batch["pos"][i].values.to_numpy(zero_copy_only=False).astype(bool), lo, hi)
                    for q in tile:
                        q.meet(block, same_rows)
        yield from _hits(here, tile)

    hits = dealt(queries, train, tile_values).mapInArrow(search, _HIT_SCHEMA)
    nth = Window.partitionBy("slot", "K", "sample_ix").orderBy("d2", "near_ix")
    return hits.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k)


def _hits(cell: tuple | None, tile: list[_Asked]) -> Iterator[pa.RecordBatch]:
    for q in tile:
        rows, places = np.nonzero(q.d2 < np.inf)
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(np.full(len(rows), cell[0]), pa.int32()),
            "K": pa.array(np.full(len(rows), cell[1]), pa.int32()),
            "sample_ix": pa.array(q.ids[rows]),
            "near_ix": pa.array(q.near[rows, places]),
            "near_pos": pa.array(q.pos[rows, places]),
            "d2": pa.array(q.d2[rows, places]),
        })
