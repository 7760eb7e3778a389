"""SimHash near-duplicates: 64-bit fingerprints, an inverted index of positional bytes, count filtering, verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsmith.llm.common import components, slices, spread_join, utf8
from panelsmith.session import settle

#: Bytes of a fingerprint.
BYTES = 8
#: Members of a list that are tallied in one task; longer lists are dealt out in pairs of such blocks.
BLOCK = 1024
#: Bits of every byte value, first bit first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text; zero if it has no words.

    Words are what white space (blank, U+0009 to U+000D) leaves, A-Z in lower case. Every run of `size` words, joined by
    blanks, is hashed by XXH64, repeats included; a text of fewer words is one run. A bit is 1 if it is set in over half of the
    hashes.
    """
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    run = min(size, len(words))
    starts, ends = starts[: len(words) - run + 1].tolist(), ends[run - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((BYTES, 8), np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])
        hashes = np.array([digest(flat[a:b], seed) for a, b in part], ">u8").view(np.uint8).reshape(-1, BYTES)
        for j in range(BYTES):
            ones[j] += np.bincount(hashes[:, j], minlength=256) @ _BITS
    bits = (2 * ones.reshape(-1) > len(starts)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, print): the fingerprint of every row as a signed long; null texts have no words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("print", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8_000_000):
                made = np.array([fingerprint(t or b"", size) for t in utf8(batch.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "print"])

    return rows.mapInArrow(run, schema)


def covering(shared: int, width: int) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions of which every `shared` positions hold one; few sets of small width, by greedy choice."""
    wanted = set(combinations(range(BYTES), shared))
    chosen = []
    while wanted:
        best = max(combinations(range(BYTES), width), key=lambda c: (sum(set(c) <= set(w) for w in wanted), c))
        chosen.append(best)
        wanted = {w for w in wanted if not set(best) <= set(w)}
    return sorted(chosen)


def byte_of(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * (BYTES - 1 - position)).bitwiseAND(F.lit(255))


def postings(prints: DataFrame, shared: int, width: int) -> DataFrame:
    """(key, print): a posting of every print for each covering set, keyed by the set and the bytes at its positions."""
    keys = []
    for number, places in enumerate(covering(shared, width)):
        key = F.lit(number).cast("long")
        for p in places:
            key = key * 256 + byte_of(F.col("print"), p)
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("key"), "print")


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """(key, cell, side, print): the postings of lists of several prints; lists beyond `block` members in pairs of blocks.

    Every two members of a list meet in one cell. Cells with one block have side 0, others compare side 0 with side 1.
    """
    lists = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = rows.join(lists, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    live = live.select("key", "print", "blocks", own.alias("own"))
    live = live.select("key", "print", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    return live.select("key", cell.alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"), "print",
                       (F.col("own") != F.col("other")).alias("apart"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for every component of the links (a, b): as many links as nodes at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
    while (root[root] != root).any():
        root = root[root]
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def tallied(cell: np.ndarray, side: np.ndarray, apart: np.ndarray, value: np.ndarray, shared: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the members of equal cells, which stand together: (a, b) by the count filter, then by their differing bits."""
    a, b = [], []
    here = np.arange(len(cell))
    step = 0
    while len(here):
        step += 1
        here = here[here + step < len(cell)]
        here = here[cell[here] == cell[here + step]]
        pick = here[~apart[here] | (side[here] != side[here + step])]
        differ = value[pick] ^ value[pick + step]
        tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        enough = tally >= shared
        pick, differ = pick[enough], differ[enough]
        near = pick[np.bitwise_count(differ.view(np.uint64)) <= most]  # of a signed number it would count the absolute value
        a.append(value[near])
        b.append(value[near + step])
    return (np.concatenate(a), np.concatenate(b)) if a else (value[:0], value[:0])


def links(prints: DataFrame, most: int = 4, width: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all of `prints(print)` that differ in `most` bits or fewer, as stars.

    `most` differing bits leave at least 8 - `most` bytes equal at their positions, so every such pair meets in a list of the
    covering sets. Within a list the equal positional bytes of a pair are tallied, pairs below that minimum are left, the others are
    verified bit by bit. A task returns a star for every component it finds, not the pairs. For `most` from 0 to 5.
    """
    shared = BYTES - most
    rows = dealt(postings(prints, shared, min(width, shared)), block)
    rows = rows.repartition("key", "cell").sortWithinPartitions("key", "cell")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            # what belongs to the last cell may go on in the next batch
            start = int(np.flatnonzero(begins(now[0], now[1]))[-1])
            if start:
                yield found([x[:start] for x in now])
            held = [x[start:] for x in now]
        if held is not None:
            yield found(held)

    def begins(key: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, cell, side, value, apart = rows
        a, b = forest(*tallied(np.cumsum(begins(key, cell)), side, apart.astype(bool), value.astype(np.int64), shared, most))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.select("key", "cell", "side", "print", "apart").mapInArrow(tally, "a long, b long")


def similar_prints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, most: int = 4, block: int = BLOCK
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in `most` bits or fewer are linked; component_id is the least id of all documents reachable by links,
    the document's own included (null if none of them has an id). Texts without words, null ones among them, have fingerprint
    zero and are linked like all others. Rows that repeat an id each have their own text's fingerprint. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = settle(fingerprints(docs, id_col, text_col, size), "sim-rows")
    # copies meet as counts before anything is compared
    prints = settle(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "sim-prints")
    roots = settle(components(links(prints.select("print"), most, block=block), "sim"), "sim-roots")
    prints = spread_join(prints, roots.withColumnRenamed("node", "print"), "print", "left")
    prints = settle(prints.select("print", "least", F.coalesce("root", "print").alias("root")), "sim-rooted")
    least = settle(prints.groupBy("root").agg(F.min("least").alias("component_id")), "sim-least")
    named = settle(spread_join(prints.select("print", "root"), least, "root").select("print", "component_id"), "sim-named")
    return spread_join(rows, named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
