"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsmith.llm.common import utf8, word_bytes
from panelsmith.session import settle

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of test items that one automaton holds; more items are matched block by block.
BLOCK_WORDS = 200_000


class Automaton:
    """Generalised suffix automaton of word lists; `window` words in a row, or a whole shorter item, are a hit."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[tuple[int, int]] = []
        whole: list[tuple[int, int, int]] = []
        self.names: list[str] = []
        self.shortest = window
        for n, (name, words) in enumerate(items):
            self.names.append(name)
            at = 0
            for w in words:
                at = self._extended(at, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.append((at, n))
            if 0 < len(words) < window:
                whole.append((at, len(words), n))
                self.shortest = min(self.shortest, len(words))
        size = len(self.next)
        # items that hold the window a state ends with, handed down from longer contexts to shorter ones
        self.items: list[set[int]] = [set() for _ in range(size)]
        for state, n in ends:
            self.items[state].add(n)
        order = sorted(range(1, size), key=self.length.__getitem__, reverse=True)
        for v in order:
            if self.length[self.link[v]] >= window:
                self.items[self.link[v]] |= self.items[v]
        # the ancestor whose strings include the one of exactly `window` words
        self.windowed = [-1] * size
        self.short: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for state, m, n in whole:
            while self.length[self.link[state]] >= m:
                state = self.link[state]
            self.short[state].append((m, n))
        for v in reversed(order):
            up = self.link[v]
            if self.length[v] >= window:
                self.windowed[v] = v if self.length[up] < window else self.windowed[up]
            if self.short[up]:
                self.short[v] = self.short[v] + self.short[up]

    def _extended(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._cloned(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._cloned(p, c, q)
        return new

    def _cloned(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words, as they end, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if len(words) < self.shortest or not self.vocabulary:
            return spans, found
        look = self.vocabulary.get
        ids = np.fromiter((look(w, -1) for w in words), np.int32, len(words))
        # a word that no item has ends every match: only runs of known words are walked
        breaks = np.flatnonzero(ids < 0)
        starts = np.concatenate([[0], breaks + 1])
        stops = np.concatenate([breaks, [len(words)]])
        long = np.flatnonzero(stops - starts >= self.shortest)
        nxt, link, length, window = self.next, self.link, self.length, self.window
        seen: set[int] = set()
        for r in long.tolist():
            v = longest = 0
            for i, c in enumerate(ids[starts[r] : stops[r]].tolist(), int(starts[r])):
                while v and c not in nxt[v]:
                    v = link[v]
                    longest = length[v]
                v = nxt[v].get(c, -1)
                if v < 0:
                    v = longest = 0
                    continue
                longest += 1
                if longest >= window:
                    spans.append((i - longest + 1, i + 1))
                    if (at := self.windowed[v]) not in seen:
                        seen.add(at)
                        found |= self.items[at]
                for m, n in self.short[v]:
                    if m <= longest:
                        spans.append((i - m + 1, i + 1))
                        found.add(n)
        return spans, found


def hit_mask(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:n]) > 0


def item_blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str, block_words: int) -> list[Automaton]:
    """Automata over blocks of items of about `block_words` words each, so what is shipped has a bound.

    Blocks are dealt by a hash of the item; the items come to the driver one block at a time.
    """
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text")
    ).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / 6 / block_words))
    out = []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        rows = sorted((r["id"], r["text"]) for r in mine.collect())
        words = [(name, word_bytes(text.encode()).split()) for name, text in rows]
        out.append(Automaton([x for x in words if x[1]], window))
    return out


_SPANS = T.StructType([
    T.StructField("__hits", T.BinaryType()), T.StructField("__items", T.ArrayType(T.StringType())),
])


def _matched(docs: DataFrame, text_col: str, automata: list[Automaton], schema: T.StructType, finish) -> DataFrame:
    """Pass the rows through one automaton after the other, then through `finish(batch, words, masks, items)`.

    With more than one block, hits travel with the rows as bits and every pass is written out, so that a worker holds
    one automaton at a time.
    """
    plain = docs.schema
    carried = T.StructType(plain.fields + _SPANS.fields)
    sc = docs.sparkSession.sparkContext
    for k, automaton in enumerate(automata):
        sent = sc.broadcast(automaton)
        first, last = k == 0, k == len(automata) - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first, last=last) -> Iterator[pa.RecordBatch]:
            auto = sent.value
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                clean = [word_bytes(t) if t is not None else b"" for t in utf8(batch.column(at))]
                masks, items = [], []
                for row, text in enumerate(clean):
                    words = text.split()
                    spans, found = auto.matches(words)
                    mask = hit_mask(len(words), spans) if spans else None
                    names = {auto.names[n] for n in found}
                    if not first:
                        bits = batch.column(batch.num_columns - 2)[row].as_py()
                        if bits is not None:
                            old = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
                            mask = old if mask is None else mask | old
                        names |= set(batch.column(batch.num_columns - 1)[row].as_py() or ())
                    masks.append((len(words), mask))
                    items.append(names)
                if not first:
                    batch = batch.select(list(range(batch.num_columns - 2)))
                if last:
                    yield finish(batch, clean, masks, items)
                else:
                    bits = [np.packbits(m).tobytes() if m is not None else None for _, m in masks]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(bits, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                        names=carried.names,
                    )

        docs = docs.mapInArrow(run, schema if last else carried)
        if not last:
            docs = settle(docs, "decontaminate")
    return docs


REPORT = (
    "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "coverage double, longest long"
)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: its words, the words inside windows of test items, and those items.

    Null or empty texts have no words; items without words never match; an item without an id is called
    "null"; repeated items count once per id. `coverage` is the share of hit words and `longest` the longest
    run of them. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def finish(batch, clean, masks, items):
        hits = [int(m.sum()) if m is not None else 0 for _, m in masks]
        runs = []
        for _, m in masks:
            gaps = np.flatnonzero(~np.concatenate([[False], m, [False]])) if m is not None else np.array([0, 1])
            runs.append(int(np.diff(gaps).max()) - 1)
        digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([n for n, _ in masks], pa.int64()), pa.array(hits, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()),
                pa.array([h > 0 for h in hits], pa.bool_()),
                pa.array([h / n if n else 0.0 for h, (n, _) in zip(hits, masks)], pa.float64()), pa.array(runs, pa.int64()),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "coverage", "longest"],
        )

    automata = item_blocks(benchmark, window, item_id, item_text, block_words)
    schema = T._parse_datatype_string(REPORT.format(id=kind))
    return _matched(rows, "text", automata, schema, finish)


def without_words(text: bytes, clean: bytes, mask: np.ndarray) -> bytes:
    """The text without its masked words and what stands between neighbouring ones."""
    spans = [m.span() for m in WORD.finditer(clean)]
    kept, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
        kept.append(text[at : spans[first][0]])
        at = spans[stop - 1][1]
    kept.append(text[at:])
    return b" ".join(x.strip(b" ") for x in kept if x.strip())


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, most_coverage: float = 0.5, text_col: str = "text",
    chars_col: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents without test passages; all their columns.

    Hit words go with what lies between them, again and again until no window occurs. A document goes as a whole when more
    than `most_coverage` of its words were hit at first, or when no word is left of it. `chars_col`, if the table
    has it, is set to the new length of texts that changed. Clean rows, null and empty texts stay as they are.
    """
    automata = item_blocks(benchmark, window, item_id, item_text, block_words)
    names = docs.columns
    # how often a row was cut, -1 when its last round found nothing
    carried = T.StructType([*docs.schema.fields, T.StructField("__llm_cut", T.IntegerType())])

    def finish(batch, clean, masks, items):
        at, rounds = names.index(text_col), len(names)
        texts, cuts = utf8(batch.column(at)), batch.column(rounds).to_pylist()
        keep, changed = [], {}
        for row, (n, mask) in enumerate(masks):
            hit = mask is not None and mask.any()
            if not hit:
                keep.append(row)
                continue
            # only the first round judges a document by its share of hit words
            if cuts[row] == 0 and mask.sum() > most_coverage * n:
                continue
            text = without_words(texts[row], clean[row], mask)
            if word_bytes(text).split():
                keep.append(row)
                changed[row] = text.decode()
        columns = list(batch.columns)
        if changed:
            new = [changed.get(i, t.decode() if t is not None else None) for i, t in enumerate(texts)]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars_col in names and pa.types.is_integer(batch.schema.field(names.index(chars_col)).type):
                k = names.index(chars_col)
                old = columns[k].to_pylist()
                columns[k] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(old)], batch.schema.field(k).type)
        # rows cut in this round are looked at again, the others are done
        columns[rounds] = pa.array([max(c, 0) + 1 if i in changed else -1 for i, c in enumerate(cuts)], pa.int32())
        out = pa.RecordBatch.from_arrays(columns, names=[*names, "__llm_cut"])
        return out if len(keep) == batch.num_rows else out.take(pa.array(keep, pa.int64()))

    rows, done = docs.withColumn("__llm_cut", F.lit(0)), None
    while True:
        rows = settle(_matched(rows, text_col, automata, carried, finish), "decontaminate-round")
        clean = rows.where("__llm_cut < 0").select(names)
        done = clean if done is None else done.union(clean)
        rows = rows.where("__llm_cut > 0")
        if rows.isEmpty():
            return done
