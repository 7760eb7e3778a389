"""MinHash near-duplicates by darts: weighted shingles, the earliest dart of each coordinate, banded joining."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import (
    MARKS, WordHashes, bucket_components, linkable, mixed, same, shared_buckets, slices, spread_join, text_key, utf8, word_bytes,
    word_hashes,
)
from panelsmith.session import discard, settle

BANDS, ROWS = 30, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], words: WordHashes, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text: (row, hash, count), sorted by row and hash.

    Words are runs of ASCII letters (in lower case), digits and all other Unicode characters. A text of
    fewer words, but not none, has one shingle of all of them.
    """
    split = [word_bytes(t).split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((words[w] for ws in split for w in ws), np.uint64, int(n.sum()))
    row = np.repeat(np.arange(len(split)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(flat))  # words from here to the end of the text
    value = np.zeros(len(flat), np.uint64)
    for k in range(size):
        shifted = np.zeros_like(flat)
        shifted[: len(flat) - k] = flat[k:]
        shifted[left <= k] = 0
        value = mixed(value * _ODD + shifted)
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    keep = (left >= size) | first
    row, value = row[keep], value[keep]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])]) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.concatenate([at, [len(row)]]))


def dart_signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """k coordinates for every row of a sparse weighted set (0: the row has no element).

    An element of weight w owns the regions [0, 1), [1, 2), ... up to w of the weight axis. Every region is hit
    by a stream of darts at rate 1, seeded by the element and the region alone; a dart has a rank (its arrival),
    a height in its region and a coordinate. Darts above the weight miss. Rows throw darts up to
    the rank (k ln k + 2k) / total weight, and to twice the rank as long as a coordinate is empty; the dart
    of least rank in each coordinate is the signature. Two rows agree in a coordinate with the probability of their
    weighted Jaccard similarity.
    """
    out = np.zeros((n_rows, k), np.uint64)
    if not len(row):
        return out
    total = np.bincount(row, weights=weight, minlength=n_rows)
    regions = np.ceil(weight).astype(np.int64)
    element = np.repeat(np.arange(len(row)), regions)
    level = np.arange(len(element)) - np.repeat(np.cumsum(regions) - regions, regions)
    seed = mixed(value[element] + _ODD * (level.astype(np.uint64) + np.uint64(1)))
    share = weight[element] - level  # of the region below the weight; 1 or more: all of it
    owner = row[element]
    limit = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    open_rows = total > 0
    scale = 2.0**-53
    while open_rows.any():
        mine = open_rows[owner]
        stream, at, part, of = seed[mine], np.zeros(int(mine.sum())), share[mine], owner[mine]
        until = limit[of]
        ranks, marks, cells = [], [], []
        step = 0
        while len(stream):
            step += 1
            dart = mixed(stream + np.uint64(int(_ODD) * step % 2**64))
            at = at - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * scale)
            alive = at <= until
            stream, at, part, of, until, dart = stream[alive], at[alive], part[alive], of[alive], until[alive], dart[alive]
            mark = mixed(dart ^ _ODD)
            hit = (mark & np.uint64(0xFFFFFF)).astype(np.float64) / 2.0**24 < part
            ranks.append(at[hit])
            marks.append(mark[hit])
            cells.append(of[hit] * k + ((mark[hit] >> np.uint64(24)) % np.uint64(k)).astype(np.int64))
        rank, mark, cell = np.concatenate(ranks), np.concatenate(marks), np.concatenate(cells)
        order = np.lexsort((mark, rank, cell))
        cell, mark = cell[order], mark[order]
        first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
        out.reshape(-1)[cell[first]] = mark[first] | np.uint64(1)
        missing = (out == 0).any(axis=1)
        open_rows &= missing
        out[open_rows] = 0
        limit = np.where(open_rows, limit * 2, limit)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        keys = mixed(keys * _ODD + signature[:, r::rows][:, :bands])
    return mixed(keys + np.arange(bands, dtype=np.uint64) * _ODD).view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("node"), F.col(text_col).alias("text"))


def similar_texts(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, weights: str = "set", bands: int = BANDS, rows: int = ROWS,
    text_col: str = "text",
) -> DataFrame:
    """(node, root) of all texts that have a near-duplicate of another text; node is the text's 64-bit key."""
    texts = docs.select(text_key(text_col).alias("node"), F.col(text_col).alias("text")).where("text is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                row, value, count = shingles(utf8(batch.column(1)), word_hashes(), size)
                weight = count.astype(np.float64) if weights == "count" else np.ones(len(row))
                keys = band_keys(dart_signatures(row, value, weight, batch.num_rows, bands * rows), bands, rows)
                some = np.flatnonzero(np.bincount(row, minlength=batch.num_rows))
                flat = pa.array(keys[some].reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), lists], names=["node", "keys"])

    signed = texts.mapInArrow(sign, "node long, keys array<long>")
    # only texts that share a bucket with another text are looked at again
    every = settle(signed.select("node", F.explode("keys").alias("key")).distinct(), "near-all")
    members = shared_buckets(every, "near")
    discard(every)

    bits = 64 * len(MARKS)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                row, value, count = shingles(utf8(batch.column(1)), word_hashes(), size)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                if weights == "count":
                    # the j-th repeat of a shingle is an element of its own, so plain Jaccard is the weighted one
                    repeat = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    value = mixed(np.repeat(value, count) + repeat.astype(np.uint64) * _ODD)
                    ends = np.concatenate([[0], np.cumsum(count)])[ends]
                sets = [np.sort(value[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                odd = np.array([np.bincount((s % bits).astype(np.int64), minlength=bits) & 1 for s in sets])
                marks = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                columns = [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), *map(pa.array, marks.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "elements", *MARKS])

    wanted = members.select("node").distinct()
    sets = texts.join(wanted, "node", "left_semi").mapInArrow(
        elements, "node long, elements binary, " + ", ".join(f"{m} long" for m in MARKS)
    )
    sets = settle(sets.dropDuplicates(["node"]), "near-sets")

    sizes = sets.withColumn("size", (F.octet_length("elements") / 8).cast("long"))
    live = linkable(members, sizes, "near")
    discard(members)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                # no rounding: similarities below the threshold by less than a billionth count
                if both >= (len(x) + len(y) - both) * (threshold - 1e-9):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    def near(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        return both.mapInArrow(compare, "a long, b long")

    roots = bucket_components(live, near, threshold, "near")
    discard(sets, live)
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class), class_size, kept (one row of a class).

    Documents are one class if their texts are equal, or linked by texts whose sets of `size` words in a row have a Jaccard
    similarity of `threshold` or more. Texts without words match equal texts only. Documents without a text are each a
    class of their own. The kept row is the one of the least id (null last), then of the least text key; rows
    that repeat both id and text share their verdict and are told apart by nothing. An empty table gives
    an empty result; other columns are ignored. Texts are known by 64-bit keys.
    """
    rows = settle(_keyed(docs, id_col, text_col).select("doc_id", "node", F.col("text").isNull().alias("bare")), "near-keyed")
    roots = similar_texts(docs, text_col=text_col, **how)
    full = spread_join(rows.where("not bare"), roots, "node", "left")
    full = settle(full.select("doc_id", "node", F.coalesce("root", "node").alias("root")), "near-rows")
    discard(roots)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("n")))
    classes = settle(full.groupBy("root").agg(first.alias("first"), F.count("*").alias("class_size")), "near-classes")
    out = spread_join(full, classes, "root").select(
        "doc_id", "node", F.col("first.id").alias("class_id"), "class_size",
        (same(F.col("doc_id"), F.col("first.id")) & (F.col("node") == F.col("first.n"))).alias("kept"),
    )
    bare = rows.where("bare").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(1).cast("long"), F.lit(True))
    return out.union(bare)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with one row of every class of `near_duplicates`, with all their columns.

    Rows that repeat both id and text become one; rows without a text all stay.
    """
    names = docs.columns
    kept = near_duplicates(docs, id_col, text_col, **how).where("kept")
    kept = kept.select(F.col("doc_id").alias("__llm_id"), F.col("node").alias("__llm_key")).distinct()
    key = text_key(text_col)
    on = same(F.col(id_col), F.col("__llm_id")) & (key == F.col("__llm_key"))
    full = docs.where(F.col(text_col).isNotNull()).join(kept, on, "left_semi")
    full = full.withColumn("__llm_key", key).dropDuplicates([id_col, "__llm_key"]).select(names)
    return full.union(docs.where(F.col(text_col).isNull()))
