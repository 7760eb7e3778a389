"""Offset-mapped token counts: whole documents are encoded once, tokens are allotted to sections by their spans."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import slices, utf8

#: Splits text before merges; the published pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "most", "share")


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    """tiktoken encoding of a file of ranks; id -> bytes has no gaps, so every token's length is known."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, n in ranks.items():
        lengths[n] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def allotted(starts: np.ndarray, stops: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of tokens [start, stop) with the sections between `cuts`: (tokens, crossing tokens) of each.

    first: the section that holds the token's first byte. most: the one that holds most of its bytes, the earlier one if
    equal. share: each section in proportion to the bytes it holds.
    """
    sections = len(cuts) - 1
    low = np.searchsorted(cuts, starts, side="right") - 1
    high = np.searchsorted(cuts, stops, side="left") - 1
    inside = low == high
    counts = np.bincount(low[inside], minlength=sections).astype(np.float64)
    crossing = np.zeros(sections, np.int64)
    for t in np.flatnonzero(~inside):
        held = np.arange(low[t], high[t] + 1)
        part = np.minimum(cuts[held + 1], stops[t]) - np.maximum(cuts[held], starts[t])
        held, part = held[part > 0], part[part > 0]
        crossing[held] += 1
        if rule == "first":
            counts[held[0]] += 1
        elif rule == "most":
            counts[held[np.argmax(part)]] += 1
        else:
            counts[held] += part / part.sum()
    return counts, crossing


def section_tokens(
    docs: DataFrame, ranks: str, rule: str = "most", separator: str = "\n", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per section of a document: its characters [start, stop) and the tokens allotted to it.

    Sections end behind each `separator`, which belongs to the section before it; the first one is called "title" if
    others follow, the others "body". The whole text is encoded once; a token's span follows from the bytes of the tokens
    before it, and tokens that cross a boundary are allotted by `rule` (see `allotted`), so the sections of a
    document add up to `doc_tokens`. A null text has one section without characters or tokens, like an empty one. Equal
    rows are counted each on its own. An empty table gives an empty result; other columns are ignored.
    `ranks` is a path all executors can read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mark = re.compile(re.escape(separator.encode()))
    schema = (
        f"doc_id {id_type}, section int, kind string, start long, stop long, n_tokens double, "
        "n_crossing long, doc_tokens long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = rank_encoding(ranks)
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                of, section, start, stop, tokens, crossing, total = [], [], [], [], [], [], []
                for row, text in enumerate(utf8(batch.column(1))):
                    ids = np.array(encoding.encode_ordinary(text.decode()), np.int64)
                    stops = np.cumsum(lengths[ids])
                    ends = [m.end() for m in mark.finditer(text)]
                    cuts = np.array([0, *ends, len(text)] if not ends or ends[-1] < len(text) else [0, *ends], np.int64)
                    counts, over = allotted(stops - lengths[ids], stops, cuts, rule)
                    heads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
                    chars = np.concatenate([[0], np.cumsum(heads)])[cuts]
                    n = len(cuts) - 1
                    of.append(np.full(n, row))
                    section.append(np.arange(n, dtype=np.int32))
                    start.append(chars[:-1])
                    stop.append(chars[1:])
                    tokens.append(counts)
                    crossing.append(over)
                    total.append(np.full(n, len(ids), np.int64))
                numbers = np.concatenate(section)
                of_row = np.concatenate(of)
                more = np.bincount(of_row, minlength=batch.num_rows)[of_row] > 1
                kinds = np.where((numbers == 0) & more, "title", "body")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(of_row)), pa.array(numbers), pa.array(kinds, pa.string()),
                        pa.array(np.concatenate(start), pa.int64()), pa.array(np.concatenate(stop), pa.int64()),
                        pa.array(np.concatenate(tokens)), pa.array(np.concatenate(crossing)), pa.array(np.concatenate(total)),
                    ],
                    names=["doc_id", "section", "kind", "start", "stop", "n_tokens", "n_crossing", "doc_tokens"],
                )

    return rows.mapInArrow(run, schema)
