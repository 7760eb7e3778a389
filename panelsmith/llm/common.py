"""Helpers shared by the training-data operators: row keys, word bytes, hashing, links and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.session import discard, settle

#: ASCII letters to lower case, every other ASCII byte that is no digit to a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Words a worker remembers before it starts over.
REMEMBERED = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column) -> Column:
    """64 bits of a text; null and empty differ."""
    return F.xxhash64(text)


def same(left: Column, right: Column) -> Column:
    """Equality under which nulls are equal, so rows without an id are joined too."""
    return left.eqNullSafe(right)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns, each computed once per row however often it is used above."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def word_bytes(text: bytes) -> bytes:
    """UTF-8 with A-Z lower-cased and a space for every byte outside of words."""
    return text.translate(_WORD_BYTES)


class WordHashes(dict):
    """Word to 64 bits; forgets everything when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """The hashes of this worker, kept from task to task."""
    return WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about `most_bytes` of text each (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    ends = np.cumsum([len(x) if x is not None else 0 for x in sizes.to_pylist()])
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: A key is heavy if it has more than one in so many rows of a table; there are fewer than so many heavy keys, whatever the table.
HEAVY_SHARE = 1000
#: Tables of fewer rows have no heavy keys worth a job.
HEAVY_ROWS = 20_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` joined to `facts`, which has a row per `key` at most, without bringing a heavy key's rows together.

    Rows of heavy keys stay where they are: the facts of these keys, fewer than HEAVY_SHARE rows, are broadcast. All other
    rows are joined as Catalyst sees fit. `rows` and `facts` are read several times and should come from written tables.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    if total < HEAVY_ROWS:
        return rows.join(facts, key, how)
    heavy = settle(counts.where(F.col("n") * HEAVY_SHARE > total).where(F.col(key).isNotNull()).select(key), "heavy-keys", rows=total)
    if heavy.isEmpty():
        return rows.join(facts, key, how)
    few = settle(facts.join(F.broadcast(heavy), key, "left_semi"), "heavy-facts", rows=total)
    hot = rows.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(few), key, how)
    cold = rows.join(F.broadcast(heavy), key, "left_anti").join(facts, key, how)
    return hot.unionByName(cold)


#: Bits of a bitmap, as a power of two: 2 MB, whatever the number of keys.
BITMAP = 24


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bits that the 64-bit keys of a column fall on. Its size is fixed: with very many keys it lets more of the others through."""
    place = F.col(column).bitwiseAND(F.lit((1 << BITMAP) - 1))
    rows = keys.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = rows.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are not in the bitmap's table; true for all that are and a few others."""
    place = keys.astype(np.int64) & ((1 << BITMAP) - 1)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def components(edges: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Distributed union-find: (node, root) for every node of `edges(a, b)`; root is the smallest node. `rows`: how many, if known.

    Alternates large and small stars until only stars are left: no node has two parents or is both parent and
    child. Every round is a grouped minimum, combined before the shuffle, and a join on the node in which the rows of heavy
    centres stay where they are (spread_join), so a star of any size is dealt out and no component is gathered anywhere.
    """
    a, b = F.col("a"), F.col("b")
    now = settle(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{name}-edges", rows=rows
    )
    while True:
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
        ends = ends.union(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("child").alias("ups"), F.max("parent").alias("parent"))
        if not ends.where("ups > 1 or (ups = 1 and parent = 1)").count():
            break
        # rows (u, v) of `now` have v < u: seen from v they lead up, seen from u down
        least = now.union(now.select("v", "v")).groupBy("u").agg(F.min("v").alias("m"))
        up = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        parts: list[DataFrame] = [now]

        n = now.count()

        def part(df: DataFrame) -> DataFrame:
            parts.append(settle(df, f"{name}-part", rows=2 * n))
            return parts[-1]

        if n < HEAVY_ROWS:
            join, kept = lambda rows, facts, key: rows.join(facts, key), lambda df: df
        else:
            join, kept = spread_join, part
        large = kept(join(up, kept(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = join(large, least, "u").where(F.col("v") != F.col("m"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-stars", rows=2 * n)
        discard(*parts)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Buckets of so many members or more are crowded. What is done for them saves comparisons and changes no result.
CROWDED = 16
#: A set's marks are so many longs: for each of their bits, whether an odd number of its elements falls on it.
MARKS = [f"m{i}" for i in range(8)]


def shared_buckets(members: DataFrame, name: str) -> DataFrame:
    """The rows of `members(key, node)` whose bucket holds several of them, with whether it is crowded; written out.

    `members` is read twice: it should come from a written table.
    """
    counts = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = members.join(counts, "key").select("key", "node", (F.col("n") >= CROWDED).alias("crowded"))
    return settle(live, f"{name}-shared")


def linkable(live: DataFrame, sets: DataFrame, name: str, everywhere: bool = False) -> DataFrame:
    """The rows of shared_buckets as bucket_components wants them; written out.

    `sets(node, size, *MARKS)` has the size and the marks of every node's set; the marks stay with rows of crowded buckets, or
    with all (`everywhere`), which costs space and saves comparisons. `mine` has all crowded buckets of a node.
    """
    mine = live.where("crowded").groupBy("node").agg(F.collect_list("key").alias("mine"))
    rows = live.join(sets.select("node", "size", *MARKS), "node").join(mine, "node", "left")
    crowd = [F.when(F.col("crowded") | F.lit(everywhere and c != "mine"), F.col(c)).alias(c) for c in ("mine", *MARKS)]
    return settle(rows.select("key", "node", "crowded", "size", *crowd), f"{name}-live", rows=live.count())


def _may_be_near(one: str, other: str, threshold: float) -> Column:
    """False for rows whose sizes or marks rule a similarity of `threshold` out; rows without marks may be near."""
    size, size_other = F.col(f"{one}.size"), F.col(f"{other}.size")
    # J >= t means min >= t max, and a symmetric difference of (1 - t) / (1 + t) of both sizes at most
    smaller, larger = F.least(size, size_other), F.greatest(size, size_other)
    apart = sum(F.bit_count(F.col(f"{one}.{m}").bitwiseXOR(F.col(f"{other}.{m}"))) for m in MARKS)
    near_marks = apart <= (smaller + larger) * ((1 - threshold) / (1 + threshold) + 1e-9)
    return (smaller >= larger * (threshold - 1e-9)) & F.coalesce(near_marks, F.lit(True))


def _merged(stars: DataFrame, links: DataFrame, name: str, rows: int) -> DataFrame:
    """The components `stars(node, root)` after further `links(a, b)`: only the roots that these touch are linked anew.

    `rows` is about how many rows the two have.
    """
    ends = links.join(stars.select(F.col("node").alias("a"), F.col("root").alias("u")), "a", "left")
    ends = ends.join(stars.select(F.col("node").alias("b"), F.col("root").alias("v")), "b", "left")
    ends = ends.select(F.coalesce("u", "a").alias("a"), F.coalesce("v", "b").alias("b"))
    new = settle(components(ends, name, rows), f"{name}-merged", rows=rows)
    moved = stars.join(new.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left")
    moved = moved.select("node", F.coalesce("now", "root").alias("root"))
    out = settle(moved.union(new).distinct(), f"{name}-so-far", rows=rows)
    discard(stars, new)
    return out


def bucket_components(live: DataFrame, near: Callable[[DataFrame], DataFrame], threshold: float, name: str) -> DataFrame:
    """(node, root) of nodes linked through shared buckets, found without emitting the pairs within a crowded bucket.

    `live` comes from linkable; `near` returns the links among pairs (a, b). Two nodes are not compared if their sizes and
    marks rule a link out. In other than crowded buckets every node is compared with every other, once and for all. In each
    round every crowded bucket elects a few heads, and its members are compared with them, unless they are of one
    component already. The heads then leave, and the others go on with sixteen times the heads, until each bucket is used
    up or of one component; a bucket of no more members than that elects them all. No link is left out but
    those within a component. Two nodes may meet in many crowded buckets: they are compared in the least one of
    those where the head is one. If the member is no longer there, it was a head itself and has met the other.
    """
    if live.isEmpty():
        return settle(live.select("node", F.col("node").alias("root")), f"{name}-so-far")
    n = live.count()
    few = live.where("not crowded").select("key", "node", "size", *MARKS)
    x, y = few.alias("x"), few.alias("y")
    at_once = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & _may_be_near("x", "y", threshold))
    at_once = at_once.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    stars: DataFrame | None = None
    done: list[DataFrame] = []
    heads_each = 1
    order = F.xxhash64("node", F.lit(11))
    rows = live.where("crowded").withColumns({"root": F.col("node"), "left": F.lit(None).cast("long")})
    while True:
        lot = F.when(F.col("left") <= heads_each, F.col("node")).otherwise(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(heads_each)))
        heads = rows.groupBy("key", lot.alias("lot")).agg(F.min_by(F.struct("node", "root", "size", *MARKS), order).alias("head"))
        heads = settle(heads.select("key", "head.*"), f"{name}-heads", rows=n)
        theirs = heads.groupBy("node").agg(F.collect_list("key").alias("theirs"))
        m, h = rows.alias("m"), heads.join(theirs, "node").alias("h")
        first = F.col("m.key") == F.array_min(F.array_intersect("m.mine", "h.theirs"))
        others = F.col("m.root") != F.col("h.root")
        met = m.join(h, (F.col("m.key") == F.col("h.key")) & others & _may_be_near("m", "h", threshold) & first)
        pairs = met.select(F.least("m.node", "h.node").alias("a"), F.greatest("m.node", "h.node").alias("b"))
        pairs = (pairs if done else pairs.union(at_once)).distinct()
        if done:
            pairs = pairs.join(reduce(DataFrame.union, done), ["a", "b"], "left_anti")
        pairs = settle(pairs, f"{name}-pairs", rows=n)
        done.append(pairs)
        many = n + pairs.count()
        links = settle(near(pairs).select("a", "b"), f"{name}-links", rows=many)
        stars = settle(components(links, name, many), f"{name}-so-far", rows=many) if stars is None else _merged(stars, links, name, many)
        rest = rows.drop("root", "left").join(heads.select("key", "node"), ["key", "node"], "left_anti").join(stars, "node", "left")
        rest = settle(rest.withColumn("root", F.coalesce("root", "node")), f"{name}-rest", rows=n)
        # nothing is left to find in buckets of one component
        buckets = rest.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("left"))
        buckets = buckets.where("least <> most").select("key", "left")
        before, rows = rows, settle(rest.join(buckets, "key"), f"{name}-live", rows=n)
        discard(heads, links, rest, *([before] if len(done) > 1 else []))
        heads_each *= 16
        if rows.isEmpty():
            discard(rows, *done)
            return stars
