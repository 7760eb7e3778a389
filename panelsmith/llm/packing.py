"""Hierarchical multi-length packing: context-size tiers, gaps of long windows filled from shorter tiers."""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import REMEMBERED, slices, utf8

#: Context sizes, all powers of two; the last is the size that unfilled sequences are padded to.
TIERS = (256, 512, 1024, 2048)
#: Rows of documents that one task packs.
GROUP_ROWS = 8192


#: ASCII marks, which are neither letters nor digits, nor the apostrophe of contractions.
_ENDS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)


def _marks_apart(tokenizer) -> bool:
    """Whether the tokenizer cuts every text between an ASCII letter or digit and a mark of _ENDS, whatever is around.

    True where its words are runs of letters, single digits or runs of other characters; others are not looked into.
    """
    import json

    rules = json.loads(tokenizer.to_str())
    cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    if not cuts or cuts[0].get("type") != "Split" or not cuts[0].get("invert") or cuts[0]["behavior"] != "Removed":
        return False
    kinds = re.sub(r"^('[a-z]+\|)*", "", cuts[0]["pattern"].get("Regex", ""))
    return kinds == r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PieceEncoder:
    """Token ids of texts by a tokenizer that never joins characters across white space.

    Texts are cut at ASCII white space, and every distinct piece is encoded by the tokenizer once, while it is
    remembered. Marks at the end of an ASCII word are encoded apart from it, if the tokenizer is seen to tell them from it.
    """

    def __init__(self, path: str):
        # tasks are the parallelism; a pool of threads in each of them only gets in the way
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a token that is cut out of a text before anything else is done with it keeps the pieces on its sides apart
        plain = [
            (i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items()
            if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip) and t.content.startswith("<|")
        ]
        self.between = min(plain, default=None)
        self.marks_apart = _marks_apart(self.tokenizer)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def pieces(text: bytes) -> list[bytes]:
        if b"<|" in text:
            return text.split()
        if text.isascii():
            return text.lower().split()
        return [p.lower() if p.isascii() else p for p in text.split()]

    def encoded(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every piece, as 32-bit numbers; many pieces go to the tokenizer as one text."""
        if self.between is None or any(b"<|" in p for p in pieces):
            found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in found]
        stop, content = self.between
        mark = content.encode()
        texts = [mark.join([*pieces[k : k + 64], b""]).decode() for k in range(0, len(pieces), 64)]
        flat = array("I")
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            flat.extend(e.ids)
        ends = np.flatnonzero(np.frombuffer(flat, np.uint32) == stop) * 4
        starts = np.concatenate([[0], ends[:-1] + 4])
        whole = flat.tobytes()
        return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        # the vocabulary is in lower case; control strings are told by their case, and a capital may compose with a mark after it
        pieces = [self.pieces(t) for t in texts]
        if len(self.recent) > REMEMBERED // 2:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        new = []
        for p in set().union(*pieces):
            if p not in recent:
                if p in older:
                    recent[p] = older[p]
                else:
                    new.append(p)
        cut = {}
        if self.marks_apart:
            cut = {p: w for p in new if p.isascii() and 0 < len(w := p.rstrip(_ENDS)) < len(p) and b"<|" not in p}
            parts = {x for p, w in cut.items() for x in (w, p[len(w) :])}.union(p for p in new if p not in cut)
            new = [p for p in parts if p not in recent]
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            recent.update(zip(part, self.encoded(part)))
        for p, w in cut.items():
            recent[p] = recent[w] + recent[p[len(w) :]]
        return [np.frombuffer(b"".join([recent[p] for p in ps]), "<u4") for ps in pieces]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of this worker, kept from task to task."""
    return PieceEncoder(path)


class Tier:
    """Waiting pieces by length, with a bit for every length at hand."""

    def __init__(self) -> None:
        self.by_length: dict[int, list] = {}
        self.bits = 0

    def put(self, piece: tuple) -> None:
        n = piece[2]
        self.by_length.setdefault(n, []).append(piece)
        self.bits |= 1 << n

    def pop(self, n: int) -> tuple:
        stack = self.by_length[n]
        piece = stack.pop()
        if not stack:
            self.bits ^= 1 << n
        return piece

    def longest(self, most: int) -> int:
        """Length of the longest waiting piece of at most `most` tokens; 0 if there is none."""
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if self.bits & ((2 << most) - 1) else 0

    def shortest(self, least: int) -> int:
        rest = self.bits >> least
        return least + ((rest & -rest).bit_length() - 1) if rest else 0


def packed(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[tuple]]]:
    """Sequences (tier, [(row, start, length), ...]) of pieces shorter than the largest tier.

    From the longest tier down, a piece opens a window of its tier's size; the gap takes the longest waiting pieces
    that fit, and at last a part cut from the shortest piece that is too long, whose rest waits
    in the tier of its new length. Only what the last pieces leave stays unfilled.
    """
    waiting = Tier()
    for p in pieces:
        if p[2]:
            waiting.put(p)
    while waiting.bits:
        n = waiting.bits.bit_length() - 1
        size = next(t for t in tiers if n <= t)
        window = [waiting.pop(n)]
        gap = size - n
        while gap and waiting.bits:
            if n := waiting.longest(gap):
                window.append(waiting.pop(n))
                gap -= n
            else:
                row, start, n = waiting.pop(waiting.shortest(gap))
                window.append((row, start, gap))
                waiting.put((row, start + gap, n - gap))
                gap = 0
        yield size, window


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long"


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1,
    tiers: tuple[int, ...] = TIERS, group_rows: int = GROUP_ROWS, step_sequences: int = 64,
) -> DataFrame:
    """One row per piece of a document: where it starts there, its sequence and its place in that.

    A document's ids are its text's, then `end_id`. It is cut into windows of the largest tier, which are sequences of their
    own; the rest is routed to the tier of its length. Rests are packed within groups of about `group_rows`
    documents, dealt by a hash whose range follows the size of the table. Sequences are full
    (a power of two long) but for the last of a group, which is padded to the largest tier. `step` numbers groups of
    `step_sequences` sequences of the same tier within a pack group, so the batches of a step are of equal length.

    Null and empty texts are a lone `end_id` (or give no row, if that is None). Equal rows are packed each on its
    own. An empty table gives an empty result; other columns are ignored. `tokenizer` is a path all executors can read.
    """
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        # rows that are equal, or have no id, are still dealt out evenly
        F.xxhash64(F.monotonically_increasing_id()).alias("lot"),
    )
    groups = max(1, math.ceil(docs.count() / group_rows))
    largest = tiers[-1]
    end = np.array([] if end_id is None else [end_id], "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                totals, crcs, rests = [], [], []
                for ids in encoder.ids(utf8(batch.column(1))):
                    ids = np.concatenate([ids, end])
                    full = len(ids) // largest
                    totals.append(len(ids))
                    crcs.append([zlib.crc32(ids[k * largest : (k + 1) * largest].tobytes()) for k in range(full)])
                    rest = ids[full * largest :]
                    rests.append(rest.astype("<u2" if len(rest) == 0 or rest.max() < 65536 else "<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(2), pa.array(totals, pa.int64()),
                        pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary()),
                    ],
                    names=["doc_id", "lot", "total", "crcs", "rest"],
                )

    encoded = rows.mapInArrow(encode, f"doc_id {id_type}, lot long, total long, crcs array<long>, rest binary")
    encoded = encoded.withColumn("pack", F.pmod("lot", F.lit(groups)))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("lot", kind="stable")
        base = int(part["pack"].iloc[0]) << 32
        ids, totals = part["doc_id"].tolist(), part["total"].tolist()
        crcs, rests = part["crcs"].tolist(), part["rest"].tolist()
        out: list[tuple] = []
        used: dict[int, int] = {}
        sequence = 0

        def put(size: int, window: list[tuple], known: int | None = None) -> None:
            nonlocal sequence
            at = 0
            # every tier numbers its sequences; a step takes the next ones of a tier
            k = used[size] = used.get(size, -1) + 1
            step = base + (tiers.index(size) << 28) + k // step_sequences
            for row, start, n in window:
                crc = known
                if crc is None:
                    lead = totals[row] // largest * largest
                    wide = (totals[row] - lead) * 2 != len(rests[row])
                    rest = np.frombuffer(rests[row], "<u4" if wide else "<u2")
                    crc = zlib.crc32(rest[start - lead : start - lead + n].astype("<u4").tobytes())
                out.append((ids[row], start, n, crc, totals[row], base + sequence, at, size, step))
                at += n
            sequence += 1

        for row, full in enumerate(crcs):
            for k, crc in enumerate(full):
                put(largest, [(row, k * largest, largest)], int(crc))
        pieces = [(row, total // largest * largest, total % largest) for row, total in enumerate(totals)]
        for size, window in packed(pieces, tiers):
            put(size, window)
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"]
        frame = pd.DataFrame(out, columns=columns)
        frame["doc_id"] = pd.Series([x[0] for x in out], dtype=part["doc_id"].dtype if len(out) else None)
        return frame

    return encoded.groupBy("pack").applyInPandas(fill, f"doc_id {id_type}, {PIECES}")
