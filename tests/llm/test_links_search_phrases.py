"""Fingerprint links, ranked search and collocations against plain Python and their SQL, and on odd tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import connect, differences
from conftest import prose, texts

from panelsmith.llm import collocations, queries, search, simhash
from panelsmith.llm.common import bitmap, among, table

ROWS = texts()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def print_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    runs = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, ids):
    """Least id reachable over links of distinct prints."""
    distinct = np.array(sorted(set(prints)), np.uint64)
    group = {int(p): int(p) for p in distinct}

    def root(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for p in distinct:
        for q in distinct[np.bitwise_count(distinct ^ p) <= 4]:
            a, b = root(int(p)), root(int(q))
            group[max(a, b)] = min(a, b)
    least = {}
    for p, i in zip(prints, ids):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [least.get(root(p)) for p in prints]


def test_fingerprints_and_components(spark, sf_dir):
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents").collect()
    out = sorted(queries.QUERIES["op11_simhash_bytes"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect())
    docs.sort(key=lambda d: d.doc_id)
    prints = [print_by_hand(d.text) for d in docs]
    want = components_by_hand(prints, [d.doc_id for d in docs])
    assert [tuple(r) for r in out] == [(d.doc_id, f"{p:016x}", c) for d, p, c in zip(docs, prints, want)]
    assert len(set(want)) < len(set(prints))


def test_fingerprints_on_odd_tables(odd_docs, no_docs):
    out = simhash.similar_prints(odd_docs).collect()
    prints = [print_by_hand(r[1]) for r in ROWS]
    want = zip([r[0] for r in ROWS], [f"{p:016x}" for p in prints], components_by_hand(prints, [r[0] for r in ROWS]))
    assert Counter(map(tuple, out)) == Counter(want)
    assert {r.component_id for r in out if r.doc_id in (5, 6, 7)} == {5}
    assert simhash.similar_prints(no_docs).count() == 0


@pytest.mark.parametrize("block", [1024, 3])
def test_links_connect_all_near_prints(spark, block):
    """Crowds around some prints, at all distances, in lists of one block and of many: no connection is lost, none is made up."""
    rng = np.random.default_rng(5)
    prints = set(rng.integers(0, 2**63, 40).tolist())
    for centre in list(prints)[:6]:
        at = centre
        for _ in range(40):
            at ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False))
            prints.add(at)
    prints = [p - 2**64 if p >= 2**63 else p for p in prints] + [0, 15, 2**62]
    rows = spark.createDataFrame([(p,) for p in prints], "print long")
    found = [(r.a, r.b) for r in simhash.links(rows, block=block).collect()]
    group = {p: p for p in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in found:
        group[root(a)] = root(b)
    unsigned = [p % 2**64 for p in prints]
    want = components_by_hand(unsigned, prints)
    assert len({root(p) for p in prints}) == len(set(want))
    assert len({(root(p), w) for p, w in zip(prints, want)}) == len(set(want))


def test_covering_sets():
    for shared in (3, 4, 5):
        for width in (1, 2, 3):
            sets = simhash.covering(shared, width)
            assert all(any(set(c) <= set(w) for c in sets) for w in simhash.combinations(range(8), shared))
    assert len(simhash.covering(4, 3)) <= 26


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def ranked_by_hand(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                for w in terms(text) if w in c
            )
            if s > 0:
                scores.append((-s, i is None, i))
        yield from ((item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k]))


def test_ranked_search(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    want = sorted(ranked_by_hand(docs, items))
    out = queries.QUERIES["op12_term_at_a_time"](spark, sf_dir)
    assert sorted(map(tuple, out.collect())) == want
    # small chunks and blocks of items change nothing
    parts = search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), block_bytes=2500, chunk=17)
    assert sorted(map(tuple, parts.collect())) == want
    assert differences(spark, connect(sf_dir), sf_dir, queries.QUERIES["op12_term_at_a_time"], queries.ORACLES["op12_term_at_a_time"]) == []


def test_search_stops_opening_accumulators():
    """Once the bounds that are left cannot reach the k-th partial score, documents that hold only common terms stay closed."""
    import pyarrow as pa

    n = 2000
    ends = np.arange(n + 1) + np.minimum(np.arange(n + 1), 20)
    rows = [[0, 1] if i < 20 else [1] for i in range(n)]
    flat = np.array([t for r in rows for t in r], np.int32)
    index = search.Chunk(pa.array(range(n)), np.full(n, 50), ends, flat, np.ones(len(flat), np.int64), n, 50 * n)
    seen = []

    class Held(np.ndarray):
        def __setitem__(self, key, value):
            seen.append(len(key))
            super().__setitem__(key, value)

    real = search.np.zeros
    try:
        search.np.zeros = lambda size, kind=float: real(size, kind).view(Held) if kind is bool else real(size, kind)
        docs, scores = index.top([(0, 5000), (1, 1)], 10)
    finally:
        search.np.zeros = real
    assert docs.tolist() == list(range(10)) and seen == [20]
    assert set(scores.tolist()) == {int(5001 * index.part[0])}


def test_ranked_search_on_odd_tables(spark, odd_docs, no_docs):
    items = [(1, prose(2, 80)), (1, prose(2, 80)), (2, None), (3, " - "), (4, "nowhere"), (None, "four FIVE one"), (6, "É́é ünï word word")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "2 as doc_id", "3 as score")
    out = search.ranked(odd_docs, bench, k=3).collect()
    want = list(ranked_by_hand([(r[0], r[1]) for r in ROWS], items, 3))
    assert Counter(map(tuple, out)) == Counter(want)
    assert search.ranked(no_docs, bench).count() == 0
    assert search.ranked(odd_docs, bench.limit(0)).count() == 0


def collocations_by_hand(docs, least=30, best=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in range(1, 5):
                counts[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for q, a in cand.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    if 100 * a >= 80 * f[q[i : i + size]]:
                        gone.add(q[i : i + size])
        rows = []
        for p, a in cand.items():
            if p not in gone:
                s, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(rows[:best])]
    return sorted(out)


def test_collocations(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    name = "op13_collocations"
    out = queries.QUERIES[name](spark, larger)
    docs = [(r.lang, r.text) for r in table(spark, larger, "documents").collect()]
    assert sorted(map(tuple, out.collect())) == collocations_by_hand(docs)
    assert differences(spark, connect(larger), larger, queries.QUERIES[name], queries.ORACLES[name]) == []


@pytest.mark.parametrize("step,sent", [(40, 30), (10_000, 200_000)])
def test_collocations_settle_all_ties(spark, monkeypatch, step, sent):
    """Few best, many ties, small steps and small blocks: the frontier is followed until the last rank is sure."""
    monkeypatch.setattr(collocations, "SENT", sent)
    docs = [(("en", "de", None)[i % 3], prose(i, 60).replace("7", "").replace("3", " ") + ", É x y z w! É x y z\tw. A B\nC D") for i in range(60)]
    docs += [("en", "a b c d e f. " * 10), ("en", "p q. q p. r q p " * 15), ("fr", "seul"), (None, None), ("it", "")]
    rows = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 as phrase", "2 as f", "'x' as size")
    got = collocations.collocations(rows.repartition(5), least=4, best=7, step=step).collect()
    assert sorted(map(tuple, got)) == collocations_by_hand(docs, 4, 7)


def test_phrases_are_named_once(monkeypatch):
    """A phrase that a task meets in many slices of its texts becomes a string once, and its counts add up by language."""
    named = []
    phrase = collocations.Words.phrase
    monkeypatch.setattr(collocations.Words, "phrase", lambda self, at, size: named.append(at) or phrase(self, at, size))
    tally, slices = collocations.Tally(), [([b"A b. b\tA b", b"a B"], [b"en", b"de"]), ([b"", b"x"], [b"en", b"fr"]), ([b"b  a b"], [b"en"]), ([], [])]
    for texts, langs in slices * 3:
        words = collocations.Words(texts, langs)
        for size in (0, 1, 2):
            tally.add(words, size, np.flatnonzero(words.whole(size)))
    expected = {("en", ""): 8, ("de", ""): 2, ("fr", ""): 1, ("en", "a"): 3, ("en", "b"): 5, ("de", "a"): 1, ("de", "b"): 1, ("fr", "x"): 1}
    expected |= {("en", "a b"): 3, ("en", "b a"): 2, ("de", "a b"): 1}
    rows = tally.counted().to_pylist()
    assert len(rows) == len(named) == len(tally) == len(expected)
    assert {(r["lang"], r["phrase"]): r["f"] for r in rows} == {k: 3 * n for k, n in expected.items()}


def test_collocations_on_odd_tables(odd_docs, no_docs):
    out = collocations.collocations(odd_docs, least=2, best=50).collect()
    assert sorted(map(tuple, out)) == collocations_by_hand([(r[2], r[1]) for r in ROWS], 2, 50)
    assert collocations.collocations(no_docs).count() == 0


def test_bitmap(spark):
    keys = [0, 1, -1, 2**40 + 63, -(2**63)]
    bits = bitmap(spark.createDataFrame([(k,) for k in keys], "h long"), "h")
    assert among(bits, np.array(keys)).all() and not among(bits, np.array([2, 62, 64, -2])).any()
