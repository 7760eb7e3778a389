"""The ten queries over whole small tables against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from panelsmith.llm import queries
from panelsmith.llm.common import table
from panelsmith.llm.sharding import even_tree, grown


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").collect()


def rows_of(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


def drawn(key, level, weights):
    def time(n):
        seed = xxhash.xxh64_intdigest(f"{level}/{n}", 42)
        bits = xxhash.xxh64_intdigest(key, seed) >> 11
        return -math.log((bits + 0.5) / 2**53) / weights[n]

    return min(sorted(weights), key=time)


def shard_by_hand(key, tree):
    for level in ("region", "rack", "shard"):
        weights = Counter()
        for s in tree:
            weights[getattr(s, level)] += s.weight
        n = drawn(key, level, weights)
        tree = [s for s in tree if getattr(s, level) == n]
    return n


def test_shards(spark, sf_dir, docs):
    out = rows_of(spark, sf_dir, "op3_hash_tree")
    texts = {d.doc_id: (d.text or "").encode() for d in docs}
    assert Counter(r.doc_id for r in out) == Counter(d.doc_id for d in docs)
    slots = defaultdict(list)
    for r in out:
        t = texts[r.doc_id]
        assert (r["size"], r.text_crc32, r.law) == (len(t) + 16, zlib.crc32(t), "key")
        assert r.shard == shard_by_hand(str(r.doc_id), even_tree(40))
        assert r.grown_shard in (r.shard, 40)
        assert r.grown_shard == shard_by_hand(str(r.doc_id), grown(even_tree(40)))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated_by_hand(texts, items):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        if w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(w) for w in windows}
    for key, text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield key, len(w), len(hit), len(found), digest, bool(hit)


def test_contamination(spark, sf_dir, docs):
    out = rows_of(spark, sf_dir, "op4_suffix_automaton")
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    got = sorted(tuple(r)[:6] for r in out)
    assert got == sorted(contaminated_by_hand([(d.doc_id, d.text) for d in docs], items))
    assert any(r[5] for r in got)


def test_chat(spark, sf_dir):
    out = {r.conv_id: r for r in rows_of(spark, sf_dir, "op5_chat_events")}
    log = defaultdict(list)
    for r in sorted(table(spark, sf_dir, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        log[r.conv_id].append((r.role, r.text or ""))
    log[-1] = [(role, "<|im_end|><|im_start|>assistant ok") for role in ("user", "assistant")]
    assert set(out) == set(log)
    for c, turns in log.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        flat = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_packing(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    out = rows_of(spark, sf_dir, "op6_tier_packing")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {d.doc_id for d in docs}
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            flat = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length])
            assert r.ids_crc32 == zlib.crc32(flat)
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 2048 and padding < 0.02 * total


def test_section_tokens(spark, sf_dir, docs):
    from panelsmith.llm.tokencount import rank_encoding

    encoding, _ = rank_encoding(queries.tokenizer_file("byte_bpe_50k.tiktoken"))
    sections = defaultdict(list)
    for r in rows_of(spark, sf_dir, "op7_section_tokens"):
        sections[r.doc_id].append(r)
    for d in docs:
        own = sorted(sections[d.doc_id], key=lambda r: r.section)
        ids = encoding.encode_ordinary(d.text)
        assert "".join(d.text[r.start : r.stop] for r in own) == d.text
        assert sum(r.n_tokens for r in own) == len(ids) == own[0].doc_tokens
        assert [d.text[r.start : r.stop].count("\n") for r in own[:-1]] == [1] * (len(own) - 1)
        # the section that holds most bytes of a token gets it
        held, at = Counter(), 0
        ends, size = [], 0
        for r in own:
            size += len(d.text[r.start : r.stop].encode())
            ends.append(size)
        for i in ids:
            stop = at + len(encoding.decode_single_token_bytes(i))
            parts = [(min(e, stop) - max(s, at), -k) for k, (s, e) in enumerate(zip([0, *ends], ends))]
            held[-max(parts)[1]] += 1
            at = stop
        assert [held[k] for k in range(len(own))] == [r.n_tokens for r in own]


def quality_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, sf_dir, docs):
    out = rows_of(spark, sf_dir, "op8_host_rules")
    got = sorted(tuple(r)[:7] for r in out)
    assert got == sorted((d.doc_id, *quality_by_hand(d.text)) for d in docs)
    assert {r.doc_id: (r.kept, r.host_verdict, round(r.host_rate, 9)) for r in out} == verdicts_by_hand(
        [(d.doc_id, d.text, d.source) for d in docs]
    )


def verdicts_by_hand(docs):
    """kept, verdict and rate by document, for documents of distinct ids."""
    fails = {}
    for i, text, host in docs:
        f = quality_by_hand(text)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n"))
        fails[i] = (f[5], 4 * f[2] > f[0] or 2 * f[3] > lines)
    hosts = defaultdict(list)
    for i, _, host in docs:
        if host is not None:
            hosts[host].append(any(fails[i]))
    n, bad = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    pooled = bad / n
    noise = pooled * (1 - pooled)
    spread = sum(sum(h) ** 2 / len(h) for h in hosts.values()) / n - pooled**2 - noise * len(hosts) / n
    strength = min(max(noise / spread - 1, 1.0), 1e9) if spread > 0 else 1e9
    rate, verdict = {}, {}
    for host, h in hosts.items():
        rate[host] = (sum(h) + pooled * strength) / (len(h) + strength)
        low = rate[host] - 3 * math.sqrt(rate[host] * (1 - rate[host]) / (len(h) + strength + 1))
        verdict[host] = "reject" if low > 2.5 * pooled else "doubt" if low > 1.25 * pooled else "accept"
    out = {}
    for i, _, host in docs:
        base, other = fails[i]
        given = verdict.get(host)
        out[i] = (not base and given != "reject" and not (given == "doubt" and other), given, round(rate[host], 9) if host is not None else None)
    return out


def test_hosts_that_fail_often_lose_documents(spark):
    """Bad hosts lose all documents, doubtful ones those that fail another rule; small and unknown hosts are left alone."""
    from panelsmith.llm import quality

    good = " ".join(f"w{i}" for i in range(60))
    marked, short = good + " ###" * 20, "too short"
    shares = {"good": (300, 0.02, 0.02), "bad": (200, 0.3, 0.5), "doubt": (300, 0.03, 0.37), "tiny": (2, 0.5, 0.5), "other": (900, 0.03, 0.02)}
    rows = []
    for host, (n, few, many) in shares.items():
        for i in range(n):
            rows.append((len(rows), short if i < few * n else marked if i < (few + many) * n else f"{good} {i}", host))
    rows += [(len(rows), marked, None), (len(rows) + 1, None, "good"), (len(rows) + 2, "", "bad")]
    out = quality.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    got = {r.doc_id: (r.kept, r.host_verdict, r.host_rate if r.host_rate is None else round(r.host_rate, 9)) for r in out}
    assert got == verdicts_by_hand(rows)
    verdicts = {h: got[next(i for i, _, x in rows if x == h)][1] for h in shares}
    assert verdicts == {"good": "accept", "bad": "reject", "doubt": "doubt", "tiny": "accept", "other": "accept"}
    assert sum(r.kept != (not r.base_failed) for r in out) > 150 and got[len(rows) - 3][0]


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def private_by_hand(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(EMAIL, text)],
        "ip": [m.span() for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(CARD, text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(PHONE, text) if 9 <= len(digits(m)) <= 15],
    }


def test_private(spark, sf_dir, docs):
    out = {r.doc_id: r for r in rows_of(spark, sf_dir, "op9_disclosure")}
    for d in docs:
        spans = private_by_hand(d.text)
        listed = ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)
        r = out[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in spans.values()]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans.startswith(listed)


def shingle_set(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def test_near_duplicates(spark, sf_dir, docs):
    out = {r.doc_id: r for r in rows_of(spark, sf_dir, "op1_dart_minhash")}
    sets = {d.doc_id: shingle_set(d.text) for d in docs}
    group = {d.doc_id: d.doc_id for d in docs}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in docs:
        for b in docs:
            x, y = sets[a.doc_id], sets[b.doc_id]
            if a.doc_id < b.doc_id and (a.text == b.text or (x & y and len(x & y) >= 0.8 * len(x | y))):
                ra, rb = sorted((root(a.doc_id), root(b.doc_id)))
                group[rb] = ra
    assert {d: r.class_id for d, r in out.items()} == {d: root(d) for d in group}
    assert all(r.kept == (r.class_id == d) for d, r in out.items())


def test_toxicity(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in table(spark, larger, "labels").collect()}
    out = rows_of(spark, larger, "op10_toxic_cnn")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    counts = Counter(held)
    precision = counts[1, 1] / (counts[1, 1] + counts[1, 0])
    recall = counts[1, 1] / (counts[1, 1] + counts[0, 1])
    assert precision > 0.9 and recall > 0.9, counts
