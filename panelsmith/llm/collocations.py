"""Phrase collocations by best-first branch and bound: prefix counts bound the scores of all longer phrases."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelsmith.llm.common import among, bitmap, mixed, slices, utf8
from panelsmith.session import settle

#: Words of the longest phrase.
LONGEST = 4
#: The share of a phrase's occurrences that a longer one has to cover to take its place, in hundredths.
COVER = 80
SCALE = 2_000_000
#: Phrases of a language that are expanded in one reading of the corpus, best bound first.
STEP = 10_000
#: Phrases of all languages that tasks are sent at once.
SENT = 200_000
#: Counts a task keeps before it passes them on, and hashes it sorts at once.
KEPT, SORTED = 250_000, 2_000_000
#: Bytes of text that are looked at together.
SLICE = 250_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to lower case, marks that end a piece to full stops, tabs to blanks. A full stop is in no word.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)
)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(_ODD), -1, 2**64))
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n - 1, x, np.uint64)])) for x in (_ODD, inverse))


#: A number for every byte value.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


class Words:
    """The words of some texts of some languages, one after the other.

    `run(i)` are hashes of the `i` words from each place on, in their language; `whole(i)` tells where so many words stand in one
    piece. Words are found and hashed as arrays of bytes; only those that are named become strings.
    """

    def __init__(self, texts: list[bytes], langs: list[bytes]):
        self.flat = b".".join([*(t.translate(_BYTES) for t in texts), b""])
        data = np.frombuffer(self.flat, np.uint8)
        stop = data == 46
        inside = ~(stop | (data == 32))
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(1 << max(21, len(data).bit_length()))
        upto = np.cumsum(_BYTE[data] * power[: len(data)])
        upto = np.concatenate([np.zeros(1, np.uint64), upto])
        size = (self.end - self.start).astype(np.uint64)
        self.value = mixed((upto[self.end] - upto[self.start]) * inverse[self.start] + size * _ODD)
        # words from each place to the end of its piece
        piece = np.cumsum(stop)[self.start] if len(self.start) else np.zeros(0, np.int64)
        last = np.flatnonzero(np.diff(piece, append=-1))
        self.left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(piece)) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.start, side="right")
        self.langs = langs
        seeds = {x: xxhash.xxh64_intdigest(x, 13) for x in set(langs)}
        self.seed = np.fromiter((seeds[x] for x in langs), np.uint64, len(langs))[self.text]

    def whole(self, size: int) -> np.ndarray:
        return self.left >= size

    def run(self, size: int) -> np.ndarray:
        out = self.seed
        for k in range(size):
            following = np.concatenate([self.value[k:], np.zeros(min(k, len(out)), np.uint64)])[: len(out)]
            out = mixed(out * _ODD + following)
        return out

    def phrase(self, at: int, size: int) -> bytes:
        return b" ".join(self.flat[self.start[at] : self.end[at + size - 1]].split()) if size else b""

    def lang(self, at: int) -> bytes:
        return self.langs[self.text[at]]


def _words_of(whole: pa.RecordBatch) -> Iterator[Words]:
    for batch in slices(whole, "text", SLICE):
        langs = [x or b"" for x in utf8(batch.column(0))]
        yield Words([t or b"" for t in utf8(batch.column(1))], langs)


class Tally:
    """Counts of phrases by hash, sorted; a phrase becomes a string once, where it is met first."""

    def __init__(self):
        self.hashes, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # which of the names a hash stands for
        self.which = np.zeros(0, np.int64)
        self.langs: list[bytes] = []
        self.phrases: list[bytes] = []

    def __len__(self) -> int:
        return len(self.hashes)

    def add(self, words: Words, size: int, places: np.ndarray) -> None:
        found, first, n = np.unique(words.run(size)[places], return_index=True, return_counts=True)
        at = np.searchsorted(self.hashes, found)
        old = within(self.hashes, found)
        self.times[at[old]] += n[old]
        new = ~old
        named = np.arange(len(self.phrases), len(self.phrases) + new.sum())
        for place in places[first[new]].tolist():
            self.langs.append(words.lang(place))
            self.phrases.append(words.phrase(place, size))
        self.hashes = np.insert(self.hashes, at[new], found[new])
        self.times = np.insert(self.times, at[new], n[new])
        self.which = np.insert(self.which, at[new], named)

    def counted(self) -> pa.RecordBatch:
        times = np.zeros_like(self.times)
        times[self.which] = self.times
        names = [pa.array(x, pa.binary()).cast(pa.string()) for x in (self.langs, self.phrases)]
        return pa.RecordBatch.from_arrays([*names, pa.array(times)], names=["lang", "phrase", "f"])


def _phrase_counts(
    texts: DataFrame, pick: Callable[[Words], Iterable[tuple[int, np.ndarray]]], least: int
) -> DataFrame:
    """(lang, phrase, f) of the phrases with `least` occurrences or more among the places that `pick(words)` gives as (size, places).

    Equal phrases of a task become one row, as long as it has met few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for whole in batches:
            for words in _words_of(whole):
                for size, places in pick(words):
                    tally.add(words, size, places)
                if len(tally) > KEPT:
                    yield tally.counted()
                    tally = Tally()
        yield tally.counted()

    rows = texts.mapInArrow(run, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _hashed_counts(texts: DataFrame, keys: Callable[[Words], np.ndarray], least: int) -> np.ndarray:
    """A bitmap of the hashes that `keys` gives `least` times or more over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for whole in batches:
            for w in _words_of(whole):
                waiting.append(keys(w))
                if sum(map(len, waiting)) > SORTED:
                    yield counted(waiting)
                    waiting.clear()
        if waiting:
            yield counted(waiting)

    def counted(waiting: list[np.ndarray]) -> pa.RecordBatch:
        found = np.sort(np.concatenate(waiting))
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        n = np.diff(first, append=len(found))
        return pa.RecordBatch.from_arrays([pa.array(found[first].view(np.int64)), pa.array(n)], names=["h", "f"])

    counts = texts.mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return bitmap(settle(counts.select("h"), "phrases-hashed"), "h")


def language_totals(counts: DataFrame) -> DataFrame:
    """(lang, n): all words of every language with `least` or more, from `frequent_counts` of words."""
    return counts.where("phrase = ''").select("lang", F.col("f").alias("n"))


def frequent_counts(texts: DataFrame, size: int, within: Broadcast | None, least: int) -> tuple[DataFrame, np.ndarray]:
    """(lang, phrase, f) of the words (size 1) or pairs (2) with `least` occurrences or more, and a bitmap of their hashes.

    They are counted by hash first, which is never too few; those whose hash is frequent are then counted as such. Pairs are
    looked for among words of the bitmap `within` only. With the words comes the empty phrase, which stands at every word of its language.
    """

    def places(w: Words) -> np.ndarray:
        known = w.whole(size)
        if within is not None:
            words = among(within.value, w.run(1).view(np.int64))
            known &= words & np.concatenate([words[1:], [False]])
        return np.flatnonzero(known)

    bits = _hashed_counts(texts, lambda w: w.run(size)[places(w)], least)
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def pick(w: Words) -> list[tuple[int, np.ndarray]]:
        at = places(w)
        frequent = [(size, at[among(held.value, w.run(size)[at].view(np.int64))])]
        return [(0, np.arange(len(w.start))), *frequent] if size == 1 else frequent

    found = settle(_phrase_counts(texts, pick, least), "phrases-frequent")
    held.destroy()
    return found, bits


def hashed_phrases(rows: DataFrame) -> DataFrame:
    """(h): for every row of `rows(lang, phrase, ...)` the hash that `Words.run` gives its phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(phrase_hashes(utf8(batch.column(0)), utf8(batch.column(1))))], names=["h"])

    return rows.select("lang", "phrase").mapInArrow(run, "h long")


def phrase_hashes(langs: list[bytes], phrases: list[bytes]) -> np.ndarray:
    """The hashes that `Words.run` gives these phrases wherever they stand."""
    words = Words(phrases, langs)
    first = np.searchsorted(words.text, np.arange(len(phrases)))
    size = np.bincount(words.text, minlength=len(phrases))
    out = np.zeros(len(phrases), np.uint64)
    for n in np.unique(size):
        mine = size == n
        out[mine] = words.run(int(n))[first[mine]]
    return out.view(np.int64)


def within(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def extensions(texts: DataFrame, chosen: dict[int, Broadcast], bits: Broadcast, least: int) -> DataFrame:
    """(lang, phrase, f) of all phrases, one word longer on either side than a chosen one, with `least` occurrences or more.

    `chosen` has the sorted hashes of phrases by their size. Pairs that are not in the bitmap of frequent ones end a phrase.
    """

    def pick(w: Words) -> Iterator[tuple[int, np.ndarray]]:
        pairs = w.run(2).view(np.int64)
        linked = among(bits.value, pairs) & w.whole(2)
        for size, hashes in chosen.items():
            may = linked.copy()
            for k in range(1, size - 1):
                may[:-k] &= linked[k:]
                may[-k:] = False
            places = np.flatnonzero(may)
            hit = np.zeros(len(may) + 1, bool)
            hit[places[within(hashes.value, w.run(size).view(np.int64)[places])]] = True
            # a chosen phrase begins here or a word on, and all pairs of the longer phrase are frequent
            longer = linked & np.concatenate([may[1:], [False]]) if len(may) else may
            yield size + 1, np.flatnonzero((hit[:-1] | hit[1:]) & longer & w.whole(size + 1))

    return _phrase_counts(texts, pick, least)


def scored(grams: DataFrame, known: DataFrame) -> DataFrame:
    """`grams(lang, phrase, size, f)` with l, r and score of the lowest cut, and bound, which no extension's score exceeds.

    `known(lang, phrase, f)` has the counts of all parts. A longer phrase has a <= f and r >= a, so its score is at most that
    of f over (l + f) in each of the cuts within this one. Decimals keep products exact.
    """
    words = F.split("phrase", " ")
    cuts = grams.select("lang", "phrase", "size", "f", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    first = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    whole = f"cast(f as decimal(20, 0)) * {SCALE}"
    cuts = cuts.withColumn("score", F.expr(f"{whole} div cast(l + r as decimal(20, 0))"))
    cuts = cuts.withColumn("bound", F.expr(f"{whole} div cast(l + f as decimal(20, 0))"))
    out = cuts.groupBy("lang", "phrase", "size", "f").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.min("bound").alias("bound")
    )
    return out.select("lang", "phrase", "size", "f", "cut.l", "cut.r", "cut.score", "bound")


def uncovered(nodes: DataFrame, settled: DataFrame) -> DataFrame:
    """The settled phrases that no phrase one word longer among `nodes` stands for; none stands for one of full length.

    A longer phrase still covers no more than those one word longer that lie between.
    """
    words = F.split("phrase", " ")
    inner = F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " ")
    )
    longer = nodes.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    out = settled.join(longer, ["lang", "phrase"], "left")
    return out.where(F.col("longer").isNull() | (100 * F.col("longer") < COVER * F.col("f"))).drop("longer")


def _nth(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(lang, cut): the n-th highest value of a column by language; languages of fewer rows are left out.

    Only counts by value meet, so a language's rows are never sorted together.
    """
    counts = rows.groupBy("lang", F.col(column).alias("cut")).agg(F.count("*").alias("n"))
    over = W.partitionBy("lang").orderBy(F.desc("cut")).rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(over)).where(F.col("upto") >= n)
    return counts.groupBy("lang").agg(F.max("cut").alias("cut"))


def _expanded(texts: DataFrame, chosen: DataFrame, bits: Broadcast, least: int) -> DataFrame:
    """Extensions of the chosen phrases, of which tasks are sent SENT at most at once."""
    spark = texts.sparkSession
    rounds = max(1, -(-chosen.count() // SENT))
    out: DataFrame | None = None
    for b in range(rounds):
        block = chosen.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(rounds)) == b)
        sent = {}
        for size in range(2, LONGEST):
            # hashes of SENT phrases or so
            found = hashed_phrases(block.where(F.col("size") == size)).toArrow().column(0).to_numpy()
            if len(found):
                sent[size] = spark.sparkContext.broadcast(np.sort(found))
        counts = settle(extensions(texts, sent, bits, least), "phrases-longer")
        for s in sent.values():
            s.destroy()
        out = counts if out is None else out.union(counts)
    return out.dropDuplicates(["lang", "phrase"])


def collocations(
    docs: DataFrame, least: int = 30, best: int = 2000, text_col: str = "text", lang_col: str = "lang", step: int = STEP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `best` phrases of two to four words of every language.

    Texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs, A-Z in lower case; a phrase is
    a run of words in a piece. a is its count (`least` or more), n all words of the language. A cut into two parts with counts
    l and r has the score floor(2000000 a / (l + r)); the lowest cut counts, of equal ones the first. A phrase goes if a
    longer one around it has 80 hundredths of its count or more. Ranks go by score, then a (both descending), then the phrase.

    Words and pairs are counted first. From then on phrases are expanded, best bound first, `step` of a language in one reading
    of the corpus: all phrases one word longer on either side are counted, which settles whether the expanded one stays and
    puts the longer ones on the frontier. A language is done when no bound on its frontier reaches the score of its
    `best`-th settled phrase, ties included. Null languages are `und`, null texts are empty; a language without frequent
    phrases and an empty table give no rows. Repeated rows count each time; other columns are ignored.

    Counts are of the phrases themselves; among the few a task keeps, and where pairs and expanded phrases are looked up, 64-bit keys stand for them.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    words, held = frequent_counts(texts, 1, None, least)
    totals, frequent = language_totals(words), words.where("phrase <> ''")
    singles = spark.sparkContext.broadcast(held)
    pairs, held = frequent_counts(texts, 2, singles, least)
    singles.destroy()
    bits = spark.sparkContext.broadcast(held)
    known = frequent.union(pairs)
    nodes = settle(scored(pairs.withColumn("size", F.lit(2)), known), "phrases-nodes")
    expanded: DataFrame | None = None
    while True:
        done = nodes.where(F.col("size") == LONGEST)
        front = nodes.where(F.col("size") < LONGEST)
        if expanded is not None:
            done = done.union(front.join(expanded, ["lang", "phrase"], "left_semi").select(nodes.columns))
            front = front.join(expanded, ["lang", "phrase"], "left_anti")
        stay = settle(uncovered(nodes, done), "phrases-settled")
        reached = settle(_nth(stay, "score", best), "phrases-reached")
        floor = F.coalesce(F.col("cut"), F.lit(-1))
        front = settle(front.join(reached, "lang", "left").where(F.col("bound") >= floor).drop("cut"), "phrases-front")
        if front.isEmpty():
            break
        first = front.join(_nth(front, "bound", step), "lang", "left").where(F.col("bound") >= floor)
        first = first.select("lang", "phrase", "size")
        # both pairs of an expanded triple are expanded with it: their counts are parts of the longer phrases
        w = F.split("phrase", " ")
        inner = F.explode(F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 2, 2), " ")))
        more = first.where("size = 3").select("lang", inner.alias("phrase"), F.lit(2).alias("size"))
        chosen = first.union(more).distinct()
        if expanded is not None:
            chosen = chosen.join(expanded, ["lang", "phrase"], "left_anti")
        chosen = settle(chosen.select("lang", "phrase", "size"), "phrases-chosen")
        longer = _expanded(texts, chosen, bits, least).join(known.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
        longer = settle(longer.select("lang", "phrase", "f"), "phrases-found")
        known = known.union(longer)
        new = longer.withColumn("size", F.size(F.split("phrase", " ")))
        nodes = nodes.union(settle(scored(new.select("lang", "phrase", "size", "f"), known), "phrases-nodes"))
        names = chosen.select("lang", "phrase")
        expanded = names if expanded is None else expanded.union(names)
    bits.destroy()
    top = stay.join(reached, "lang", "left").where(F.col("score") >= floor).join(totals, "lang")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), F.asc("phrase"))
    top = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return top.select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
