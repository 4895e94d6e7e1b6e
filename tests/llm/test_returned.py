"""The queries as they return their rows, over the smallest tables, against brute force of what each is to return."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from parallaxis.llm import queries as Q
from parallaxis.llm.audio import AudioRules, log_mel, resample, segments
from parallaxis.llm.packing import default_tokenizer, encoder
from parallaxis.llm.pii import luhn
from parallaxis.llm.toxicity import FtrlRules, train

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return Q.queries()[name](spark, str(SF)).collect()


def by_id(spark, name, texts):
    got = rows(spark, name)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    return {r.doc_id: r for r in got}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1(spark, texts):
    for i, r in by_id(spark, "op1_audio_features", texts).items():
        raw = texts[i].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 16000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(media).hexdigest())


def test_log_mel_and_segments_by_plain_loops():
    rules = AudioRules()
    samples = np.random.default_rng(3).integers(0, 256, 5000).astype(np.uint8)
    x = np.concatenate(list(resample(samples, 16000, rules.target_rate, rules.taps)))
    got, energy = log_mel(samples, 16000, rules)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    hertz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hertz(mel(rules.target_rate / 2) * k / (rules.mels + 1)) for k in range(rules.mels + 2)]
    for n in (0, 1, len(got) - 1):
        frame = np.zeros(rules.frame)
        part = x[n * rules.hop : n * rules.hop + rules.frame]
        frame[: len(part)] = part
        frame *= [0.5 - 0.5 * math.cos(2 * math.pi * k / rules.frame) for k in range(rules.frame)]
        power = [abs(sum(frame * np.exp(-2j * np.pi * b * np.arange(rules.frame) / rules.n_fft))) ** 2 for b in range(rules.n_fft // 2 + 1)]
        for m in range(rules.mels):
            lo, mid, hi = edges[m : m + 3]
            f = [b * rules.target_rate / rules.n_fft for b in range(len(power))]
            total = sum(p * max(0, min((v - lo) / (mid - lo), (hi - v) / (hi - mid))) for p, v in zip(power, f, strict=True))
            assert got[n, m] == pytest.approx(64 * 10 * math.log10(total + 1e-9), abs=1)
        assert energy[n] == pytest.approx(10 * math.log10(sum(power) / len(power) + 1e-9), abs=1e-3)
    rng = np.random.default_rng(5)
    for _ in range(50):
        e = np.round(rng.normal(0, 1, rng.integers(1, 60)).cumsum() / 2, 6)
        floor = sorted(e)[(len(e) - 1) // 10]
        want, start, opened = [], None, False
        for k, v in enumerate([*e, -math.inf]):
            if v >= floor + rules.close_db:
                start, opened = (k, False) if start is None else (start, opened)
                opened |= v >= floor + rules.open_db
            elif start is not None:
                if opened and k - start >= rules.min_frames:
                    want.append((start, k))
                start = None
        assert segments(e, rules) == want


def test_op2(spark, texts):
    got = by_id(spark, "op2_pareto_mix", texts)
    for i, r in got.items():
        assert r.size == len(WORD.findall(texts[i])) and 0 <= r.taken <= 3 * r.size
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sums = Counter()
    for i, r in got.items():
        sums[source[i]] += r.taken
    for i, r in got.items():
        assert abs(sums[source[i]] - r.target) <= max(x.size for x in got.values())


def test_op3(spark, texts):
    got = by_id(spark, "op3_backoff_lm", texts)
    toks = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t)), None] for i, t in texts.items()}
    c = Counter(w for i, t in toks.items() if fold(i, 10) for w in t)
    n, v = sum(c.values()), len(c)
    gain = 0.0
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 10) == 0, len(toks[i]), sum(c[w] > 0 for w in toks[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks[i]))
        assert r.score <= 0
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0  # the bigrams tell more of held-out texts than the words alone


def test_op4(spark, texts):
    for i, r in by_id(spark, "op4_anchor_pii", texts).items():
        t, out = texts[i], []
        out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            out += [(m.start(), 2, m.end())] if 14 <= len(d) <= 19 and luhn(d) else []
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        kinds = ("email", "ip", "card", "phone")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in out) for j in range(4))
        base = [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(out)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(","))


def test_op5(spark, texts):
    for i, r in by_id(spark, "op5_ftrl_toxicity", texts).items():
        assert r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_ftrl_by_plain_loops():
    rng = np.random.default_rng(7)
    rules = FtrlRules(bits=6, epochs=3, l1=0.5)
    sets = [np.unique(rng.integers(0, 64, 12)) for _ in range(60)]
    labels = np.array([float(5 in s) for s in sets])
    got = train(sets, labels, rules)
    z, s = [0.0] * 65, [0.0] * 65

    def weight(i):
        l1 = 0.0 if i == 64 else rules.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((rules.beta + math.sqrt(s[i])) / rules.alpha + rules.l2)

    for _ in range(rules.epochs):
        for f, y in zip(sets, labels, strict=True):
            on = [*f.tolist(), 64]
            w = {i: weight(i) for i in on}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (rules.toxic_weight if y else 1)
            for i in on:
                rate = (math.sqrt(s[i] + g * g) - math.sqrt(s[i])) / rules.alpha
                z[i] += g - rate * w[i]
                s[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(65)])


def test_op6(spark, texts):
    got, enc = rows(spark, "op6_concat_pack"), encoder(default_tokenizer())
    pieces, offsets = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        offsets.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids, at = enc.tokenizer.encode(texts[i], add_special_tokens=False).ids + [1], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for spans in offsets.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_op7(spark, texts):
    for i, r in by_id(spark, "op7_repetition", texts).items():
        t, w = texts[i], WORD.findall(texts[i])
        c = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        inside = {j + d for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed)
        assert not (failed and r.kept)


def test_op8(spark, texts):
    got = by_id(spark, "op8_fuzzy_lines", texts)
    first = {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        gone = [int(x) for x in got[i].dropped.split(",") if x]
        assert (got[i].n_lines, got[i].n_dropped) == (len(lines), len(gone))
        assert got[i].text_sha256 == hashlib.sha256("\n".join(x for k, x in enumerate(lines) if k not in gone).encode()).hexdigest()
        for k, x in enumerate(lines):
            norm = " ".join(x.lower().split())
            if len(norm.split()) >= 5:
                assert (k in gone) if norm in first else True  # exact repeats always go
                first.setdefault(norm, (i, k))


def test_op9(spark, texts):
    got = by_id(spark, "op9_feistel_shards", texts)
    for i, r in got.items():
        raw = texts[i].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = Counter(r.shard for r in got.values())
    assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts[k] for k in range(16)) <= 1
    assert {(r.shard, r.slot) for r in got.values()} == {(s, k) for s, n in counts.items() for k in range(n)}


def test_op10(spark, texts):
    got, fp = by_id(spark, "op10_simhash", texts), {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 3]), 42) for j in range(max(len(w) - 2, min(len(w), 1)))]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == f"{fp[i]:016x}"
    root = {i: i for i in fp}
    for i in sorted(fp):
        for j in fp:
            if j < i and (fp[i] ^ fp[j]).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if x == high else x for k, x in root.items()}
    assert {i: r.component_id for i, r in got.items()} == root


def test_op2_same_as_duckdb(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(Q.oracle_sql()["op2_pareto_mix"])
    cols = sorted(want.columns)
    assert sorted(tuple(r[c] for c in cols) for r in rows(spark, "op2_pareto_mix")) == sorted(tuple(dict(zip(want.columns, r, strict=True))[c] for c in cols) for r in want.fetchall())
