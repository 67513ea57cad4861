import hashlib
import random
from collections import Counter

import numpy as np

from quorate.llm import blocks, repeats


def brute(rows, length=200):
    count = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for k, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_cover():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage, line = noise(260), noise(199)
    texts = [None, "", "x" * 150, "x" * 450, noise(700) + passage + noise(30), passage + noise(100), noise(41) + passage[:200], passage[60:] + noise(3), line + noise(90), noise(7) + line, passage[30:235] + noise(400)]
    copy = noise(900)
    texts += [copy, copy, copy[1:], noise(3000), copy[:450] + noise(5) + copy[450:]]
    rows = [(k if k != 3 else None, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n_spans int")
    want = brute([(k, (t or "").encode()) for k, t in rows])
    for block_bytes, range_hashes in ((1 << 20, 1 << 20), (2000, 64)):
        monkeypatch.setattr(blocks.stage, "__defaults__", (block_bytes,))
        monkeypatch.setattr(blocks, "RANGE_HASHES", range_hashes)
        got = repeats.remove(docs).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == want
        assert all(sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_removed for r in got)
    assert repeats.remove(docs.limit(0)).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text.encode()) for r in docs.collect()])
    assert sorted((tuple(r)[:5] for r in repeats.remove(docs).collect()), key=str) == want


def test_clashing_first_hashes():
    rng = np.random.default_rng(1)
    first, second = (rng.integers(0, k, 500).astype(np.uint64) for k in (7, 40))
    pairs = list(zip(first.tolist(), second.tolist()))
    at, multiple, where = repeats.names(first, second)
    assert [pairs[a] for a in at[where]] == pairs and len(at) == len(set(pairs))
    assert [bool(multiple[w]) for w in where] == [pairs.count(p) > 1 for p in pairs]
    blocks_of, hashes, extras = [pairs[:100], pairs[100:350], pairs[350:351], []], [], []
    kept = []
    for some in blocks_of:
        f, s = (np.array([p[k] for p in some], dtype=np.uint64) for k in (0, 1))
        d, m, _ = repeats.names(f, s)
        beside = np.empty(len(d), dtype=repeats.SECOND)
        beside["second"], beside["multiple"] = s[d], m
        hashes.append(f[d])
        extras.append(beside.tobytes())
        kept.append([some[i] for i in d])
    for some, bits in zip(kept, repeats.repeated_pairs(hashes, extras), strict=True):
        assert np.unpackbits(bits, count=len(some)).astype(bool).tolist() == [pairs[:351].count(p) > 1 for p in some]
