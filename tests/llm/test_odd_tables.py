"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import math
import re
from collections import Counter

import pytest
from conftest import prose, texts
from pyspark.sql import functions as F
from test_llm_queries import CARD, EMAIL, IP, PHONE, contaminated_by_hand, luhn, private_by_hand, quality_by_hand

from panelsmith.llm import (
    chat, dartminhash, decontaminate, linededup, packing, pii, quality, queries, sharding, tokencount, toxicity,
)
from panelsmith.llm.common import MARKS, bucket_components, linkable

ROWS = texts()


def plain(rows):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in rows)


def test_shards(odd_docs, no_docs):
    out = sharding.assign_shards(odd_docs, sharding.even_tree(5, 2, 1), rows_per_block=1).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in ROWS)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(no_docs, sharding.even_tree(5)).count() == 0


def test_contamination(spark, odd_docs, no_docs):
    items = [(1, " ".join(prose(2, 80).split()[20:35])), (2, "four five six"), (3, None), (4, " - "), (5, "FOUR five six"),
             (None, " ".join(prose(7, 300).split()[250:262])), (7, "word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = plain(contaminated_by_hand([(r[0], r[1]) for r in ROWS], [("null" if i is None else i, t) for i, t in items if t]))
    for block_words in (200_000, 5):
        got = decontaminate.contamination(odd_docs, bench, block_words=block_words).collect()
        assert plain(r[:6] for r in got) == expected
    clean = decontaminate.decontaminated(odd_docs, bench, most_coverage=0.9)
    assert clean.columns == odd_docs.columns
    left = clean.collect()
    assert not any(x[-1] for x in contaminated_by_hand([(r.doc_id, r.text) for r in left], [x for x in items if x[1]]))
    changed = next(r for r in left if r.doc_id == 4)
    assert changed.n_chars == len(changed.text) and len(changed.text.split()) == 65
    assert plain([(r.doc_id, r.text) for r in left if r.doc_id in (1, 5, 6, 7)]) == plain(
        (r[0], r[1]) for r in ROWS if r[0] in (1, 5, 6, 7)
    )
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(odd_docs, bench.limit(0)).where("contaminated").count() == 0


def test_cuts_are_looked_at_again_with_many_blocks(spark):
    """Passages pasted into passages are cut out, however many blocks the items need."""
    items = [(k, prose(700 + k, 14)) for k in range(40)]
    docs = []
    for k in range(12):
        inner, mid, outer = (items[(k + n) % 40][1].split() for n in (0, 5, 9))
        deep = [*outer[:7], *mid[:7], *inner, *mid[7:], *outer[7:]]
        docs.append((k, " ".join([*prose(900 + k, 50).split(), *deep, *prose(950 + k, 40).split()]), 7))
    docs += [(50, None, None), (51, "", 0), (52, prose(990, 30), 5), (53, items[3][1], 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    assert len(decontaminate.item_blocks(bench, 10, "item_id", "text", 40)) > 4
    got = {}
    for block_words in (200_000, 40):
        left = decontaminate.decontaminated(table, bench, block_words=block_words).collect()
        assert not any(x[-1] for x in contaminated_by_hand([(r.doc_id, r.text) for r in left], items))
        got[block_words] = {r.doc_id: (r.text, r.n_chars) for r in left}
    assert got[40] == got[200_000]
    for k in range(12):
        text = f"{prose(900 + k, 50)} {prose(950 + k, 40)}"
        assert got[40][k] == (text, len(text))
    assert {k: got[40].get(k) for k in (50, 51, 52, 53)} == {50: (None, None), 51: ("", 0), 52: (prose(990, 30), 5), 53: None}


def test_packing_keeps_the_case_of_capitals_that_compose(spark):
    path = queries.tokenizer_file("word_bpe_49k.json")
    encoder = packing.PieceEncoder(path)
    odd = [f"plain WORD {c}{m}x {c}{m} Other" for c, m in zip("THWYJ", "\u0308\u0331\u030a\u030a\u030c")]
    for text, ids in zip(odd, encoder.ids([t.encode() for t in odd])):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(odd_docs, no_docs):
    path = queries.tokenizer_file("word_bpe_49k.json")
    out = packing.pack(odd_docs, path, group_rows=4).collect()
    assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0)
    assert sum(r.start == 0 for r in out) == len(ROWS)
    assert packing.pack(no_docs, path).count() == 0
    encoder = packing.PieceEncoder(path)
    odd = ["Don't STOP<|endoftext|> now", "<|ENDOFTEXT|>", "É́é  x\x1fy", "12 34,5.", ""]
    for text, ids in zip(odd, encoder.ids([t.encode() for t in odd])):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_section_tokens(odd_docs, no_docs):
    path = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    for rule in tokencount.RULES:
        out = tokencount.section_tokens(odd_docs, path, rule).collect()
        total = Counter()
        for r in out:
            total[r.doc_id] += r.n_tokens
        assert sum(r.section == 0 for r in out) == len(ROWS)
        assert total[5] == total[6] == 0
        assert abs(sum(total.values()) - sum(r.doc_tokens for r in out if r.section == 0)) < 1e-6
    assert tokencount.section_tokens(no_docs, path).count() == 0


def test_quality(odd_docs, no_docs):
    got = quality.host_quality(odd_docs).drop("node").collect()
    assert plain(r[:7] for r in got) == plain((r[0], *quality_by_hand(r[1])) for r in ROWS)
    kept = quality.accepted(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.kept for r in got)
    assert quality.host_quality(no_docs).count() == 0


def test_hosts_with_bad_rates_go(spark):
    rows = [(i, "bad" if i < 200 else "good" if i < 400 else f"small{i}", i < 150 or i >= 400) for i in range(403)]
    rates = {r.host: r.rate for r in quality.host_rates(spark.createDataFrame(rows, "i int, host string, failed boolean")).collect()}
    assert rates["bad"] > 0.7 and rates["good"] < 0.05
    assert all(r < 1 for h, r in rates.items())


def test_private(spark, odd_docs, no_docs):
    tricky = [
        "a@b.co_x@y.z a.@-.- @ x@y 1.2.3.4.5.6.7.8 999.1.1.1 007.0.0.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (212) 555-0100 ++49 30 12345678- +1" + "9" * 30, "1" * 5000 + "." + "2" * 3000, "x" * 20000 + "@", "é😀 a@b.c 😀1.2.3.4",
        "+12 3\n456789012", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    for r in pii.sensitive_spans(docs).collect():
        by_hand = private_by_hand(tricky[r.doc_id])
        assert {k: [(s["start"], s["stop"]) for s in r[k]] for k in pii.KINDS} == by_hand
    assert pii.sensitive_spans(odd_docs).count() == len(ROWS)
    assert pii.sanitised(odd_docs).columns == odd_docs.columns
    assert pii.sensitive_spans(no_docs).count() == 0


def blanked(line):
    """Words of a line and the places of its protected values, kinds one after the other, by plain Python."""
    values = []
    checks = {"email": (EMAIL, lambda m: True), "ip": (IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
              "card": (CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15)}
    for kind, (pattern, ok) in checks.items():
        def swap(m, kind=kind, ok=ok):
            if not ok(m[0]):
                return m[0]
            values.append(f"{kind}:{m[0].lower() if kind in ('email', 'ip') else digits(m[0])}")
            return f" \ue000{chr(0xE100 + len(values) - 1)} "
        line = re.sub(pattern, swap, line)
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line.lower()) if w]
    return [values[ord(w[1]) - 0xE100] if w[0] == "\ue000" else w for w in words], [w[0] == "\ue000" for w in words]


def digits(text):
    return re.sub("[^0-9]", "", text)


def disclosing_by_hand(texts, min_contexts=3, min_bits=3.0, most_left=1.0, reach=8):
    lines = [blanked(x) for t in texts if t is not None for x in t.split("\n")]
    together, contexts, with_term, with_entity = Counter(), {}, Counter(), Counter()
    for words, protected in lines:
        bare = tuple(w for w, p in zip(words, protected) if not p)
        with_term.update(set(bare))
        with_entity.update({w for w, p in zip(words, protected) if p})
        met = {
            (words[i], words[j]) for i, p in enumerate(protected) if p
            for j in range(max(0, i - reach), min(len(words), i + reach + 1)) if not protected[j]
        }
        for pair in met:
            together[pair] += 1
            contexts.setdefault(pair, set()).add(bare)
    out = {}
    for (entity, term), n in together.items():
        share = n / with_term[term]
        bits = math.log2(share * len(lines) / with_entity[entity])
        if len(contexts[entity, term]) >= min_contexts and bits >= min_bits and -math.log2(share) <= most_left:
            out[term, entity] = (len(contexts[entity, term]), share, bits, "remove" if -math.log2(share) <= 0.15 else "generalise")
    return out


def test_disclosing_terms_are_found(spark):
    rows = [(i, f"{prose(100 + i, 12)}\nZorblatt wrote {prose(150 + i, 1)} from zed@mail.example today") for i in range(6)]
    rows += [(i, f"{prose(200 + i, 12)} wrote today\n{prose(300 + i, 9)}") for i in range(10, 60)]
    # words with digits beside a value, values that are no valid matches, half of a term's lines elsewhere
    rows += [(70 + i, f"user Quux{i % 2}42 has 10.0.0.{7 + i % 2} and 999.1.1.1 {prose(400 + i, 2)}") for i in range(8)]
    rows += [(80 + i, f"Blurp {prose(500 + i, 3)} +49 30 1234567") for i in range(4)] + [(90 + i, f"blurp {prose(600 + i, 4)}") for i in range(3)]
    rows += [(95, "ask ZORBLATT, please"), (96, None), (97, ""), (98, "quux042 zorblatt42"), (99, "a\ue000b zorblattx")]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as term", "2 as entity", "3 as n").repartition(3)
    got = {(t.term, t.entity): (t.contexts, round(t.share, 9), round(t.bits, 9), t.action) for t in pii.disclosing_terms(docs).collect()}
    want = disclosing_by_hand([t for _, t in rows])
    assert got == {k: (c, round(s, 9), round(b, 9), a) for k, (c, s, b, a) in want.items()}
    found = {(t, e.split(":")[0]): v[3] for (t, e), v in got.items()}
    assert found["from", "email"] == "remove" and {found[x] for x in (("zorblatt", "email"), ("quux042", "ip"), ("blurp", "phone"))} == {"generalise"}
    assert all(s <= 1 for _, s, _, _ in got.values())
    spans = {r.doc_id: [s["found"] for s in r.term] for r in pii.sensitive_spans(docs).collect()}
    assert spans[95] == ["ZORBLATT"] and spans[98] == ["quux042"] and spans[20] == [] and spans[99] == []
    assert "zorblatt42" not in str(spans)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[95] == "ask [name], please" and clean[98] == "[code] zorblatt42" and clean[20] == dict(rows)[20]
    assert clean[96] is None and clean[97] == "" and clean[99] == dict(rows)[99]
    assert clean[90].startswith("[word] ") and clean[80].startswith("[name] ") and clean[80].endswith("[phone]")
    assert "zed@" not in clean[0] and "  [email] today" in clean[0] and "[name] wrote" in clean[0]


def test_private_data_in_very_long_texts(spark):
    """Some MB of figures and addresses in one text, and one line with many values, take seconds."""
    import time

    numbers = " ".join(str(10**6 + 7 * i) for i in range(300_000))
    mails = " ".join(f"u{i}@mail.example" for i in range(40_000))
    crowd = [(10 + k, " ".join(f"w{j} m{j}@x.example" for j in range(1500)) + f" {k}") for k in range(3)]
    docs = spark.createDataFrame([(1, numbers), (2, mails), *crowd], "doc_id long, text string")
    started = time.time()
    out = {r.doc_id: r for r in pii.sensitive_spans(docs).select("doc_id", F.size("email").alias("n"), F.try_element_at("email", F.lit(-1)).alias("e")).collect()}
    assert (out[1].n, out[2].n, out[10].n) == (0, 40_000, 1500) and out[2].e["stop"] == len(mails)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).where("doc_id < 3").collect()}
    assert clean[1] == numbers and clean[2] == " ".join(["[email]"] * 40_000)
    assert time.time() - started < 150


def test_near_duplicates(odd_docs, no_docs):
    out = dartminhash.near_duplicates(odd_docs).collect()
    assert len(out) == len(ROWS)
    classes = {r.doc_id: (r.class_id, r.class_size) for r in out if r.doc_id in (1, 2, 3, 4, 5, 6, 7)}
    assert classes == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (5, 1), 6: (6, 1), 7: (7, 1)}
    kept = dartminhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, None, 8, 8, 9, 10, 11, 12, 13, 14, 15])
    assert dartminhash.near_duplicates(no_docs).count() == 0


def test_signatures_agree_with_weighted_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    value = rng.integers(1, 2**63, 60).astype(np.uint64)
    x, y = rng.integers(0, 5, 60) + 0.5, rng.integers(0, 5, 60) + 0.25
    row = np.repeat([0, 1], 60)
    s = dartminhash.dart_signatures(row, np.concatenate([value, value]), np.concatenate([x, y]), 3, 2000)
    exact = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((s[0] == s[1]).mean() - exact) < 0.04 and (s[2] == 0).all()


def lines_by_hand(rows, size=5):
    lines = []
    for i, text in sorted({(r[0], r[1]) for r in rows if r[1]}, key=str):
        lines += [(i, text, n, x.strip(" \t\r")) for n, x in enumerate(text.split("\n")) if x.strip(" \t\r")]
    return lines


def test_lines(spark, odd_docs, no_docs):
    base = "the quick brown fox jumps over the lazy dog and runs far away from there, over hill and dale, until night falls"
    docs = spark.createDataFrame(
        [(1, base + "\nshort\n\nown line of one"), (2, "short \r\n" + base.replace("lazy", "hazy")), (3, "short"), (4, None),
         (5, ""), (None, "\n \n"), (6, "an entirely different line, with other words in it")], "doc_id long, text string",
    ).withColumn("n_chars", __import__("pyspark.sql.functions", fromlist=["length"]).length("text"))
    out = linededup.line_classes(docs).collect()
    assert {(r.doc_id, r.line_no): r.kept for r in out} == {
        (1, 0): True, (1, 1): True, (1, 3): True, (2, 0): False, (2, 1): False, (3, 0): False, (6, 0): True,
    }
    left = {r.doc_id: (r.text, r.n_chars) for r in linededup.without_repeated_lines(docs).collect()}
    assert set(left) == {1, 4, 5, None, 6}
    assert left[1][0] == base + "\nshort\n\nown line of one"
    assert linededup.without_repeated_lines(odd_docs).columns == odd_docs.columns
    assert linededup.line_classes(no_docs).count() == 0


def test_similar_lines_reach_brute_force(spark):
    import random

    rng = random.Random(4)
    lines = []
    for i in range(120):
        words = prose(300 + i, 12 + i % 40).split()
        lines.append(" ".join(words))
        for _ in range(2):
            other = list(words)
            for k in rng.sample(range(len(other)), max(1, len(other) // 20)):
                other[k] = prose(rng.randrange(10**6), 1)
            lines.append(" ".join(other))
    lines = sorted(set(lines))
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    pairs = [(a, b) for a in range(len(lines)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    rows = linededup.line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    cls = {r.doc_id: r.class_id for r in rows}
    found = sum(cls[a] == cls[b] for a, b in pairs)
    assert len(pairs) > 100 and found >= 0.95 * len(pairs)
    assert len(set(cls.values())) >= 120


def jaccard(x, y, size=5):
    x, y = ({t[i : i + size] for i in range(len(t) - size + 1)} for t in (x, y))
    return len(x & y) / len(x | y)


def test_long_lines_are_signed_by_all_their_characters(spark):
    """What two lines share may lie in few words, in one long token, or away from the word starts."""
    import random

    rng = random.Random(9)

    def token(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    urls = " ".join(f"https://{token(20)}.example/{token(30)}" for _ in range(16))
    blob, ends = token(1000), [token(90) for _ in range(18)]
    pairs = [
        (f"Links one two: {urls}", f"See also here, sources: {urls}"),
        (" ".join([*(token(5) for _ in range(16)), blob]), " ".join([*(token(5) for _ in range(16)), blob])),
        (" ".join(f"{token(4)}{x}" for x in ends), " ".join(f"{token(4)}{x}" for x in ends)),
    ]
    assert all(jaccard(a, b) >= 0.8 and len(a.split()) >= 16 for a, b in pairs)
    lines = [x for p in pairs for x in p]
    rows = linededup.line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    cls = {r.doc_id: r.class_id for r in rows}
    assert [cls[2 * k] == cls[2 * k + 1] for k in range(3)] == [True] * 3 and len(set(cls.values())) == 3


def test_lines_just_above_the_threshold_are_found(spark):
    import random

    rng = random.Random(21)
    lines, pairs, made = [], 0, 0
    while pairs < 600:
        made += 1
        words = prose(5000 + made, 20 + made % 21).split()
        other = list(words)
        for k in rng.sample(range(len(words)), rng.randrange(1, 6)):
            other[k] = prose(rng.randrange(10**6), 1)
        x, y = (f"{' '.join(w)}" for w in (words, other))
        if 0.80 <= jaccard(x, y) <= 0.83:
            lines += [x, y]
            pairs += 1
    rows = linededup.line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    cls = {r.doc_id: r.class_id for r in rows}
    found = sum(cls[2 * k] == cls[2 * k + 1] for k in range(pairs))
    assert found >= 0.99 * pairs, found


LOG = [
    (1, 1, "message", 1, "user", "hi \\ <|im_end|>"), (1, 2, "message", 2, "assistant", None), (1, 3, "delta", 2, None, "wro"),
    (1, 4, "delta", 2, None, "ng"), (1, 5, "message", 3, "user", "later"), (1, 6, "regenerate", 2, None, None),
    (1, 7, "delta", 2, None, "right"), (1, 8, "edit", 1, None, "hello"), (1, 9, "message", 3, "us\ner\\n", "new"),
    (None, 1, "message", 1, None, ""), (2, 1, "message", 1, "assistant", "a"), (2, 1, "message", 1, "assistant", "a"),
    (2, 2, "unknown", 1, "user", "x"), (2, 3, "message", None, "user", "x"),
]


def test_chat(spark):
    events = spark.createDataFrame(LOG, "conv_id long, seq long, kind string, turn long, role string, text string")
    events = events.selectExpr("*", "1 as part", "'x' as loss")
    out = chat.format_conversations(events).withColumn("turns", chat.turns_in(__import__("pyspark").sql.functions.col("formatted")))
    turns = {r.conv_id: [tuple(t) for t in r.turns] for r in out.collect()}
    assert turns == {
        1: [("user", "hello"), ("assistant", "right"), ("us\ner\\n", "new")], None: [("", "")], 2: [("assistant", "a")],
    }
    assert chat.format_conversations(events.limit(0)).count() == 0


def test_toxicity(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (8, 0), (9, 1), (99, 1), (12, None)], "doc_id long, toxic int")
    shape = toxicity.Shape(epochs=1)
    out = toxicity.toxicity(odd_docs, labels, shape=shape).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (5, 6, 7)}) == 1
    assert toxicity.toxicity(no_docs, labels, shape=shape).count() == 0
    assert len({r.score for r in toxicity.toxicity(odd_docs, labels.limit(0), shape=shape).collect()}) == 1


def test_bucket_components_lose_no_link(spark):
    """Runs of 18 numbers, all in two crowded buckets: a chain whose links do not involve the heads is found whole."""
    points = [0, 2, 4, 6, 8, 11, 13, 13, 15, 40, 41, 43, 46, 48, 90]  # two apart: similarity 0.8

    def marks(p):
        bits = sum(1 << e for e in range(p, p + 18))
        return [(bits >> 64 * i & 2**64 - 1) - (bits >> 64 * i + 63 & 1) * 2**64 for i in range(len(MARKS))]

    place = spark.createDataFrame(
        [(n, p, 18, *marks(p)) for n, p in enumerate(points)], "node long, p long, size long, " + ", ".join(f"{m} long" for m in MARKS)
    )
    members = place.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("key"), "node")
    compared = []

    def near(pairs):
        compared.extend((r.a, r.b) for r in pairs.collect())
        a = place.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        b = place.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        return pairs.join(a, "a").join(b, "b").where(F.abs(F.col("pa") - F.col("pb")) <= 2).select("a", "b")

    want, start = {}, 0
    for i, p in enumerate(points):
        if i and p - points[i - 1] > 2:
            start = i
        want[i] = start
    alone = {i for i in want if sum(v == want[i] for v in want.values()) == 1}
    for crowded in (True, False):
        compared.clear()
        live = linkable(members.withColumn("crowded", F.lit(crowded)), place, "line")
        got = {r["node"]: r["root"] for r in bucket_components(live, near, 0.8, "line").collect()}
        assert {n: r for n, r in got.items() if n not in alone} == {n: r for n, r in want.items() if n not in alone}
        assert all(got.get(n, n) == n for n in alone)
        assert len(set(compared)) == len(compared)
        if crowded:  # marks differ in every number that one of the two has, so only links are compared
            assert all(abs(points[a] - points[b]) <= 2 for a, b in compared)


def test_sets_of_lines():
    """Sets, sizes and marks of lines: a bit of the marks is set when an odd number of hashes falls on it."""
    import numpy as np

    lines = ["", "a", "abcde", "abcdef" * 9, prose(3, 400), "é😀" * 50, "x" * 30_000, prose(4, 5000)]
    texts = [x.encode() for x in lines]
    row, value, n = linededup.char_sets(texts, 5)
    assert n.tolist() == [len({x[i : i + 5] for i in range(max(1, len(x) - 4))}) if x else 0 for x in lines]
    marks = linededup.set_marks(row, value, len(lines))
    for i in range(len(lines)):
        want = [0] * 512
        for v in value[row == i].tolist():
            want[(v >> 40) % 512] ^= 1
        assert sum(want) == sum(bin(int(m) % 2**64).count("1") for m in marks[i])
    # the same line gives the same keys in any company
    for make in (linededup.long_keys, linededup.short_keys):
        r, v, _ = linededup.char_sets(texts[3:5], 5)
        together = make(*linededup._part(row, value, n > 0), int((n > 0).sum()))
        assert (make(r, v, 2) == together[2:4]).all() and np.unique(together, axis=0).shape[0] == len(together)


def test_packing_encodes_a_word_once_whatever_marks_follow_it():
    """Texts with marks at the ends of words have the ids of the whole text."""
    encoder = packing.PieceEncoder(queries.tokenizer_file("word_bpe_49k.json"))
    asked, encoded = [], encoder.encoded
    encoder.encoded = lambda pieces: asked.extend(pieces) or encoded(pieces)
    odd = [
        "word word, word. word!? word... (word) word; don't 'tis a'b,c' x'' x's. 's,'t 3.14, 9%", "A<|startoftext|> b., a<| b|> c<", "...",
        "T̈. a̸=, b≠ é, …. x…. «word», ß!? word,…", "<|endoftext|>,", "",
    ]
    for text, ids in zip(odd, encoder.ids([t.encode() for t in odd]), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert asked.count(b"word") == 1 and not {b"word,", b"word.", b"word!?", b"word...", b"word;"} & set(asked)


def test_line_classes_leave_no_large_tables_behind(spark, monkeypatch):
    """Tables that only served to find the links are gone; texts that are held back before the shuffle change nothing."""
    import os

    from panelsmith.session import shared_folder

    lines = [prose(k // 3, 30) + f" {prose(900 + k % 3, 1)}" for k in range(90)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    folder = os.path.join(shared_folder(spark).removeprefix("file://").removeprefix("file:"), "panelsmith")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    plain = sorted(linededup.line_classes(docs).collect())
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert not left & {"line-shared", "line-texts", "line-live", "line-heads", "line-pairs", "line-links", "line-rest", "line-places"}
    monkeypatch.setattr(linededup, "MANY_TEXTS", 1, raising=False)
    assert sorted(linededup.line_classes(docs).collect()) == plain
    assert len({r.class_id for r in plain}) < 90


def test_buckets_that_are_not_crowded_take_one_round(spark):
    from pyspark.sql import functions as F

    from panelsmith.llm.common import MARKS, bucket_components

    rows = [(b, 100 * b + k, False, 10, None, *[None] * len(MARKS)) for b in range(5) for k in range(12)]
    kinds = "key long, node long, crowded boolean, size long, mine array<long>, " + ", ".join(f"{m} long" for m in MARKS)
    asked = []

    def near(pairs):
        asked.append(pairs.count())
        return pairs.where((F.col("b") - F.col("a")) == 3)

    got = {r.node: r.root for r in bucket_components(spark.createDataFrame(rows, kinds), near, 0.8, "few").collect()}
    assert got == {100 * b + k: 100 * b + k % 3 for b in range(5) for k in range(12)}
    assert asked == [5 * 66]


def test_tables_between_rounds_are_written_in_few_pieces(spark, monkeypatch):
    """A table of few rows has a file per core at most, however many partitions the shuffles have; a large one keeps its pieces."""
    import os

    from panelsmith.llm import common
    from panelsmith.session import settle, shared_folder

    def pieces(path):
        return sum(x.startswith("part-") for x in os.listdir(path))

    lines = [prose(k // 3, 30) + f" {prose(900 + k % 3, 1)}" for k in range(90)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    plain = sorted(linededup.line_classes(docs).collect())
    folder = os.path.join(shared_folder(spark).removeprefix("file://").removeprefix("file:"), "panelsmith")
    before = set(os.listdir(folder))
    for where in (common, linededup):
        monkeypatch.setattr(where, "discard", lambda *tables: None)
    shuffles = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in shuffles}
    try:
        for k, v in shuffles.items():
            spark.conf.set(k, v)
        assert sorted(linededup.line_classes(docs).collect()) == plain
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    made = {x: pieces(f"{folder}/{x}") for x in set(os.listdir(folder)) - before}
    rounds = ("live", "heads", "pairs", "links", "edges", "stars", "so-far", "rest")
    made = {x: n for x, n in made.items() if x.rsplit("-", 1)[0] in {f"line-{r}" for r in rounds}}
    assert len(made) >= 6 and max(made.values()) <= spark.sparkContext.defaultParallelism, made
    large = settle(spark.range(0, 640, 1, 64), "large", rows=640_000)
    assert pieces(large.settled_at.removeprefix("file://").removeprefix("file:")) == 64


def test_tables_of_few_lines_are_written_in_few_pieces(spark, monkeypatch):
    """Line tables and those of heavy keys have a file per core at most when there are few lines; places keep the documents' pieces."""
    from pathlib import Path

    from panelsmith.llm import common

    made = {}

    def settle(df, name, *args, write=common.settle, **how):
        out = write(df, name, *args, **how)
        folder = Path(out.settled_at.removeprefix("file://").removeprefix("file:"))
        made[name] = max(made.get(name, 0), sum(x.name.startswith("part-") for x in folder.iterdir()))
        return out

    lines = [prose(k // 3, 30) + f" {prose(900 + k % 3, 1)}" for k in range(300)]
    docs = spark.createDataFrame([(k, f"{x}\nthe same in every document") for k, x in enumerate(lines)], "doc_id long, text string")
    plain = sorted(linededup.line_classes(docs).collect())
    for where in (common, linededup):
        monkeypatch.setattr(where, "settle", settle)
    monkeypatch.setattr(common, "HEAVY_ROWS", 1)
    shuffles = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in shuffles}
    try:
        for k, v in shuffles.items():
            spark.conf.set(k, v)
        assert sorted(linededup.line_classes(docs).collect()) == plain
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    few = {"line-shared", "line-texts", "line-rows", "line-classes", "heavy-keys", "heavy-facts"}
    assert few <= set(made) and max(made[x] for x in few) <= spark.sparkContext.defaultParallelism, made
