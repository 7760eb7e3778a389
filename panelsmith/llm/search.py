"""Ranked lexical search, a term at a time: rarest terms first, no new accumulators once they cannot reach the k-th score."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsmith.llm.common import slices, utf8, word_bytes
from panelsmith.session import settle

#: Text of the items that are searched for in one go.
BLOCK_BYTES = 4_000_000
#: Documents whose postings stand in memory together.
CHUNK = 16_384


def term_counts(docs: DataFrame, vocabulary: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: all its terms counted, and those of the vocabulary with their counts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    kinds = [("n", T.LongType()), ("terms", T.ArrayType(T.IntegerType())), ("tfs", T.ArrayType(T.LongType()))]
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for whole in batches:
            for batch in slices(whole, "text", 8_000_000):
                n, ends, terms, tfs = [], [0], [], []
                for text in utf8(batch.column(1)):
                    words = word_bytes(text).split()
                    n.append(len(words))
                    held, times = np.unique(np.array([number[w] for w in words if w in number], np.int32), return_counts=True)
                    terms.append(held)
                    tfs.append(times)
                    ends.append(ends[-1] + len(held))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (terms, tfs)]
                made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=schema.names)
                yield made.filter(pc.greater(made.column(1), 0))

    return rows.mapInArrow(count, schema)


class Chunk:
    """Inverted index of some documents: postings by term, each with its part of the score before the term's weight."""

    def __init__(self, ids: pa.Array, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, length: int):
        self.ids = ids
        # rank of every id, null last: equal scores go by it
        order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
        self.place = np.empty(len(ids), np.int64)
        self.place[order] = np.arange(len(ids))
        m = 100 - 75 + 75 * n * n_docs // length
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        part = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[doc])
        by_term = np.argsort(terms, kind="stable")
        self.doc, self.part = doc[by_term], part[by_term]
        self.term, starts = np.unique(terms[by_term], return_index=True)
        self.span = dict(zip(self.term.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(terms)])))
        self.best = dict(zip(self.term.tolist(), np.maximum.reduceat(self.part, starts).tolist() if len(starts) else []))

    def top(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best for (term, weight times repeats), rarest term first.

        A term opens accumulators as long as documents that hold none of the terms so far can still reach the k-th partial
        score by the terms that are left; from then on it adds to the open ones alone. Those have their whole score at the end.
        """
        query = [(t, w) for t, w in query if t in self.span and w > 0]
        left = np.cumsum([0, *(w * self.best[t] for t, w in reversed(query))])[::-1]
        score, held = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        opening, opened = True, 0
        for j, (term, weight) in enumerate(query):
            a, b = self.span[term]
            doc, gain = self.doc[a:b], weight * self.part[a:b]
            if opening:
                held[doc] = True
                score[doc] += gain
                opened = min(opened + len(doc), len(held))
                if opened >= k:
                    partial = score[held]
                    # a tie could still win by its id, so bounds have to be below the k-th score
                    if len(partial) >= k and left[j + 1] < np.partition(partial, len(partial) - k)[len(partial) - k]:
                        opening = False
            else:
                mine = held[doc]
                score[doc[mine]] += gain[mine]
        docs = np.flatnonzero(held & (score > 0))
        if len(docs) > k:
            kth = np.partition(score[docs], len(docs) - k)[len(docs) - k]
            docs = docs[score[docs] >= kth]
        docs = docs[np.lexsort((self.place[docs], -score[docs]))[:k]]
        return docs, score[docs]


def chunks(batches: Iterator[pa.RecordBatch], n_docs: int, length: int, rows: int) -> Iterator[Chunk]:
    """The batches of term_counts, put together to indexes of about `rows` documents."""
    waiting: list[pa.RecordBatch] = []

    def index() -> Chunk:
        whole = pa.Table.from_batches(waiting).combine_chunks()
        ids, n, terms, tfs = (whole.column(i).combine_chunks() for i in range(4))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())]).astype(np.int64)
        return Chunk(ids, n.to_numpy(), ends, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), n_docs, length)

    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            waiting.append(batch.slice(start, rows))
            if sum(b.num_rows for b in waiting) >= rows:
                yield index()
                waiting.clear()
    if waiting:
        yield index()


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, chunk: int = CHUNK,
) -> DataFrame:
    """(item_id, rank, doc_id, score): for every item the k documents of highest score above 0, equal scores by ascending id.

    Terms are runs of ASCII letters (in lower case), digits and all other Unicode characters. N counts the documents with
    a term, L all their terms, n one's own, df the documents that hold a term, tf its occurrences in a document; its weight is
    w = floor(1000 ln((2N + 2) / (2df + 1))). With m = 25 + (75 n N div L), a document's score is the sum of
    w (10^9 tf div (1000 tf + 8 m)) over the item's terms, repeats included. Documents stay where they are: every task
    indexes its own in chunks and searches a term at a time; the k best of each chunk meet, combined before the shuffle.

    Items are taken in blocks of about `block_bytes` of text, so what tasks are sent is bounded; every block reads the documents anew.
    Items without a term in any document, null texts and empty tables give no rows. Rows that repeat an item or a document id are
    items and documents of their own; among equal scores null ids come last. Other columns are ignored.
    """
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out: DataFrame | None = None
    for b in range(blocks):
        # the block's rows, a few MB of text
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        rows = _block(docs, mine, k, id_col, text_col, chunk)
        out = rows if out is None else out.unionByName(rows)
    return out


def _block(docs: DataFrame, items: pa.Table, k: int, id_col: str, text_col: str, chunk: int) -> DataFrame:
    spark = docs.sparkSession
    ids = items.column(0).combine_chunks()
    wanted = [Counter(word_bytes(t).split()) for t in utf8(items.column(1))] if items.num_rows else []
    vocabulary = {w: i for i, w in enumerate(sorted({w for c in wanted for w in c}))}
    known = spark.sparkContext.broadcast(vocabulary)
    postings = settle(term_counts(docs, known, id_col, text_col), "search-postings")
    known.destroy()
    n_docs, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    queries = []
    for counts in wanted:
        terms = sorted((df[vocabulary[w]], vocabulary[w], times) for w, times in counts.items() if vocabulary[w] in df)
        queries.append([(t, weight[t] * times) for _, t, times in terms])
    sent = spark.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index in chunks(batches, n_docs, length, chunk):
            found = [(i, *index.top(q, k)) for i, q in enumerate(sent.value)]
            item = np.repeat([i for i, _, _ in found], [len(d) for _, d, _ in found]).astype(np.int32)
            doc = np.concatenate([d for _, d, _ in found]) if found else np.zeros(0, np.int64)
            score = np.concatenate([s for _, _, s in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), index.ids.take(pa.array(doc)), pa.array(score)], names=["item", "doc_id", "score"]
            )

    kind = postings.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("item", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())
    ])
    best = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = postings.mapInArrow(search, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # the names of the block's items, known to the driver already
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": ids}))
    found = settle(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "search-best")
    sent.destroy()
    return found
