"""Convolutional text classifier: hashed word embeddings, several filter widths, max pooling, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsmith.llm.common import REMEMBERED, slices, utf8, word_bytes
from panelsmith.session import settle


#: Bytes of the beginnings of a word that have an embedding of their own, next to the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)


@dataclass(frozen=True)
class Shape:
    """`least_docs`: buckets that fewer learned documents hold stay empty, so that no text is learned by its own rare words."""

    buckets: int = 1 << 18
    dims: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 16
    epochs: int = 8
    rate: float = 0.01
    batch: int = 64
    seed: int = 5
    least_docs: int = 3


@dataclass
class Network:
    """Embedding, filters of every width, and the output weights. Bucket 0 is empty and stays zero."""

    shape: Shape
    embedding: np.ndarray
    taps: list[np.ndarray]  # per width: (width, dims, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    prior_shift: float = 0.0

    @staticmethod
    def fresh(shape: Shape) -> Network:
        rng = np.random.default_rng(shape.seed)
        embedding = rng.normal(0, 0.1, (shape.buckets, shape.dims)).astype(np.float32)
        embedding[0] = 0
        taps = [rng.normal(0, (w * shape.dims) ** -0.5, (w, shape.dims, shape.filters)).astype(np.float32) for w in shape.widths]
        bias = [np.zeros(shape.filters, np.float32) for _ in shape.widths]
        return Network(shape, embedding, taps, bias, np.zeros(len(shape.widths) * shape.filters, np.float32))

    def scores(self, texts: list[bytes], features: WordFeatures) -> np.ndarray:
        """Scores of whole texts. Every distinct word meets the filters once; its products are then looked up."""
        at, starts, table = laid_out(texts, features)
        e = self.embedding[table].sum(axis=1)
        pooled = []
        for width, taps, bias in zip(self.shape.widths, self.taps, self.bias):
            z = (e @ taps[0])[at]
            for k in range(1, width):
                z[:-k] += (e @ taps[k])[at[k:]]
            z[at == 0] = 0  # nothing is read across the end of a text
            pooled.append(np.maximum(np.maximum.reduceat(z, starts, axis=0) + bias, 0))
        logit = np.concatenate(pooled, axis=1) @ self.out + self.out_bias + self.prior_shift
        return 1 / (1 + np.exp(-logit.astype(np.float64)))


class WordFeatures(dict):
    """Word to the buckets whose embeddings add up to its own: the word's and those of its beginnings."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED // 4:
            self.clear()
        parts = [b"=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]
        value = np.zeros(1 + len(BEGINNINGS), np.int32)
        value[: len(parts)] = [xxhash.xxh64_intdigest(p, 9) % (self.buckets - 1) + 1 for p in parts]
        value = self[word] = value.tobytes()
        return value


@lru_cache(maxsize=1)
def word_features(buckets: int) -> WordFeatures:
    """The features of this worker, kept from task to task."""
    return WordFeatures(buckets)


def laid_out(texts: list[bytes], features: WordFeatures) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, one text after the other: places in a table of distinct words, where each text begins, the table.

    A text is closed by as many empty words as no filter can look across.
    """
    split = [word_bytes(t.decode().lower().encode()).split() for t in texts]
    number: dict[bytes, int] = {}
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((number.setdefault(w, len(number) + 1) for ws in split for w in ws), np.int64, int(n.sum()))
    known = b"".join([features[w] for w in number])
    table = np.frombuffer(known, np.int32).reshape(-1, 1 + len(BEGINNINGS))
    table = np.concatenate([np.zeros((1, 1 + len(BEGINNINGS)), np.int32), table])
    starts = np.cumsum(n + 2) - (n + 2)
    out = np.zeros(int((n + 2).sum()), np.int64)
    out[np.arange(len(flat)) + np.repeat(2 * np.arange(len(n)), n)] = flat
    return out, starts, table


def train(texts: list[bytes], labels: np.ndarray, shape: Shape = Shape(), positive_share: float | None = None) -> Network:
    """Fit by Adam on mini-batches; `positive_share` is that of the population, if the sample's differs."""
    net = Network.fresh(shape)
    if not len(texts) or not 0 < labels.sum() < len(labels):
        share = min(max(float(labels.mean()) if len(labels) else 0.0, 1e-6), 1 - 1e-6)
        net.out_bias = float(np.log(share / (1 - share)))
        return net
    features = WordFeatures(shape.buckets)
    docs = []
    for t in texts:
        at, _, table = laid_out([t], features)
        docs.append(table[at])
    held = np.zeros(shape.buckets, np.int64)
    for d in docs:
        held[np.unique(d)] += 1
    rare = held < shape.least_docs
    net.embedding[rare] = 0
    docs = [np.where(rare[d], 0, d) for d in docs]
    share = float(labels.mean())
    net.out_bias = float(np.log(share / (1 - share)))
    dense = [*net.taps, *net.bias, net.out]
    first = [np.zeros_like(p) for p in dense]
    second = [np.zeros_like(p) for p in dense]
    e_second = np.zeros(shape.buckets, np.float32)
    rng = np.random.default_rng(shape.seed + 1)
    step = 0
    for epoch in range(shape.epochs):
        rate = shape.rate * (1 - epoch / shape.epochs)
        for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // shape.batch)):
            step += 1
            words = np.concatenate([docs[i] for i in part])
            sizes = np.array([len(docs[i]) for i in part])
            starts = np.cumsum(sizes) - sizes
            e = net.embedding[words].sum(axis=1)
            # the two empty words that close a text
            closing = np.zeros(len(words), bool)
            closing[starts + sizes - 1] = closing[starts + sizes - 2] = True
            pooled, where = [], []
            for width, taps, bias in zip(shape.widths, net.taps, net.bias):
                z = e @ taps[0]
                for k in range(1, width):
                    z[:-k] += (e @ taps[k])[k:]
                z[closing] = 0
                top = np.stack([z[a : a + s].argmax(axis=0) + a for a, s in zip(starts, sizes)])
                pooled.append(np.take_along_axis(z, top, axis=0) + bias)
                where.append(top)
            hidden = np.concatenate(pooled, axis=1)
            active = hidden > 0
            hidden = hidden * active
            p = 1 / (1 + np.exp(-(hidden @ net.out + net.out_bias)))
            error = ((p - labels[part]) / len(part)).astype(np.float32)
            back = np.outer(error, net.out) * active
            grads = []
            e_rows, e_grads = [], []
            b_grads = []
            for j, (width, taps) in enumerate(zip(shape.widths, net.taps)):
                g = back[:, j * shape.filters : (j + 1) * shape.filters]
                top = where[j]
                grad = np.zeros_like(taps)
                for k in range(width):
                    at = np.where(closing[top], top, np.minimum(top + k, len(words) - 1))
                    grad[k] = np.einsum("bf,bfd->df", g, e[at])
                    e_rows.append(words[at].reshape(-1, words.shape[1]))
                    e_grads.append((g[..., None] * taps[k].T[None]).reshape(-1, shape.dims))
                grads.append(grad)
                b_grads.append(g.sum(axis=0))
            grads += b_grads
            grads.append(hidden.T @ error)
            net.out_bias -= rate * float(error.sum())
            for param, m, v, g in zip(dense, first, second, grads):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            # embeddings move only where a filter's maximum lies, with a step size of their own for every bucket
            rows = np.concatenate(e_rows)
            moved, inverse = np.unique(rows, return_inverse=True)
            g = np.zeros((len(moved), shape.dims), np.float32)
            np.add.at(g, inverse.ravel(), np.repeat(np.concatenate(e_grads), rows.shape[1], axis=0))
            e_second[moved] += (g * g).mean(axis=1)
            net.embedding[moved] -= 3 * rate * g / (np.sqrt(e_second[moved])[:, None] + 1e-8)
            net.embedding[0] = 0
    if positive_share is not None and 0 < positive_share < 1:
        net.prior_shift = float(np.log(positive_share / (1 - positive_share)) - np.log(share / (1 - share)))
    return net


def scored(docs: DataFrame, net: Network, text_col: str, column: str) -> DataFrame:
    """The rows with the score of their whole text; a null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for batch in slices(whole, text_col, 4_000_000):
                texts = [t or b"" for t in utf8(batch.column(batch.schema.get_field_index(text_col)))]
                features = word_features(model.shape.buckets)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(texts, features))], names=names)

    return docs.mapInArrow(run, schema)


def held_out(id_column: str | Column) -> Column:
    """Rows that learning never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_rows: int = 6000, shape: Shape = Shape(),
) -> Network:
    """Train on at most `most_rows` labelled documents outside the held-out fold.

    Up to half of the rows are positive. Rows are drawn by a hash of their id, so the draw does not depend on
    the order or the layout of the tables; scores are put back to the share of positives among all
    labelled rows. Null or missing labels, ids or texts are not learned from; a document's
    label is the largest of its labels.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    marks = marks.where(~held_out("id"))
    share = marks.agg(F.avg("y")).first()[0]
    if share is None:
        return train([], np.zeros(0), shape)
    draw = F.xxhash64("id", F.lit(3))
    few = marks.where("y = 1").orderBy(draw, "id").limit(most_rows // 2)
    many = marks.where("y = 0").orderBy(draw, "id").limit(most_rows - most_rows // 2)
    # at most most_rows ids with a label
    drawn = F.broadcast(few.union(many))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = texts.join(drawn, "id").dropDuplicates(["id"]).select("id", "text", "y").collect()
    rows.sort(key=lambda r: str(r["id"]))
    y = np.array([r["y"] for r in rows], np.float32)
    return train([r["text"].encode() for r in rows], y, shape, share)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    label_col: str = "toxic", cut: float = 0.3, most_rows: int = 6000, shape: Shape = Shape(),
) -> DataFrame:
    """One row per document: held_out, score (0 to 1), predicted (score >= cut), and the verdict by language.

    The score depends on the text alone. `lang_cut` is the score that parts the learned rows of a language best (highest F1;
    `cut` for languages without labelled rows of both kinds, and for null), `lang_predicted` the verdict
    by it. Null texts are scored like empty ones. Rows that repeat an id are scored each on its own text. An empty
    table gives an empty result; without usable labels every score is the same. Other columns are ignored.
    """
    net = fit(docs, labels, id_col, text_col, label_col, most_rows, shape)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = scored(rows, net, "text", "score").drop("text")
    rows = settle(rows, "toxicity")
    cuts = language_cuts(rows, labels, id_col, label_col)
    out = rows.join(cuts, "lang", "left")
    best = F.coalesce("best", F.lit(cut))
    return out.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"),
        best.alias("lang_cut"), (F.col("score") >= best).cast("int").alias("lang_predicted"),
    )


def language_cuts(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(lang, best): per language the hundredth of a score with the highest F1 over all learned rows.

    Only counts per (language, hundredth) meet, whatever the number of rows.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.where("y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    seen = rows.where(~held_out("doc_id")).join(marks, "doc_id")
    bins = seen.groupBy("lang", F.floor(F.col("score") * 100).cast("int").alias("bin")).agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    over = W.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    all_rows = W.partitionBy("lang")
    scored_bins = bins.select(
        "lang", "bin", F.sum("pos").over(over).alias("tp"), F.sum("neg").over(over).alias("fp"),
        F.sum("pos").over(all_rows).alias("p"), F.sum("neg").over(all_rows).alias("n"),
    ).where("p > 0 and n > 0")
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))
    best = scored_bins.groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), F.col("bin").alias("bin"))).alias("top"))
    return best.select("lang", (F.col("top.bin") / 100).alias("best"))
