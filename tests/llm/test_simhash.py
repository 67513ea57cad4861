import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import queries, simhash

WORDS = [f"w{i}" for i in range(400)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def plain_print(text):
    """Votes in plain loops over the shingles' hashes."""
    words = text.split()
    shingles = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    votes, low = [0] * 128, None
    for s in shingles:
        h = simhash.terms([s.encode()])[0]
        bits = np.unpackbits(simhash._bits(h))
        votes = [v + (1 if b else -1) for v, b in zip(votes, bits, strict=True)]
        low = min(low, (int(h[0]), bits), key=lambda x: x[0]) if low else (int(h[0]), bits)
    bits = [int(v > 0 or v == 0 and low is not None and low[1][k] == 1) for k, v in enumerate(votes)]
    return np.packbits(bits).tobytes().hex()


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, t), (_, following) in zip(rows, [*rows[1:], *rows[:1]], strict=True):
        t, following = t or "", following or ""
        k = len(t) // 3
        e = t[: len(t) - k] + following[:k]
        prints = [plain_print(x) for x in (t, e, following)]
        far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
        near = [round(max(0.0, float(np.cos(np.pi * far(prints[0], p) / 128))), 9) for p in prints[1:]]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[0], prints[1], *near))
    counts = [sum(bin(int(a[3], 16) ^ int(b[3], 16)).count("1") <= 6 for b in out) if a[0] is not None and a[0] % 50 == 0 else None for a in out]
    return sorted(((*a, n) for a, n in zip(out, counts, strict=True)), key=str)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"]


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, part int, fingerprint string, n_near int")


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_loops(spark, monkeypatch, small):
    if small:  # sums, slices and batches that are cut often
        monkeypatch.setattr(simhash, "SUMS", 2)
        monkeypatch.setattr(simhash, "SLICE", 3000)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    r = random.Random(4)
    base = prose(r, 300)
    rows = [(i * 10, prose(r, r.choice([0, 1, 3, 5, 40, 700]))) for i in range(25)]
    rows += [(1000 + 50 * i, f"{base} é{i % 3}") for i in range(9)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "ÄÖ ß \U0001f600 x y z"), (5, base), (None, "no id"), (6, "ab " * 900)]
    try:
        assert rows_of(simhash.document_fingerprints(frame(spark, rows).repartition(6))) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_single_and_none(spark):
    assert rows_of(simhash.document_fingerprints(frame(spark, []))) == []
    assert rows_of(simhash.document_fingerprints(frame(spark, [(7, "one two three")]))) == plain([(7, "one two three")])
    same = [(100, "a b c d e f g")] * 5
    assert rows_of(simhash.document_fingerprints(frame(spark, same))) == plain(same)


@pytest.mark.parametrize(("radius", "n"), [(6, 300), (3, 300), (6, 1 << 30)])
def test_tables_miss_nothing(spark, radius, n, monkeypatch):
    """Against all pairs, with a hot family, for few and for many blocks in a key."""
    monkeypatch.setattr(simhash, "PACK", 4)
    masks = simhash.tables(n, radius)
    monkeypatch.setattr(simhash, "tables", lambda *_: masks)
    r = random.Random(5)
    centres = [r.getrandbits(128) for _ in range(12)]
    prints = [r.choice(centres) ^ sum(1 << k for k in r.sample(range(128), r.randint(0, 9))) for _ in range(280)]
    prints += [centres[0] ^ (1 << r.randrange(128)) for _ in range(60)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    both = lambda p: (signed(p >> 64), signed(p & ((1 << 64) - 1)))
    index = spark.createDataFrame([(*both(p), 1 + k % 3) for k, p in enumerate(prints)], "f1 long, f2 long, copies long").groupBy("f1", "f2").agg(F.sum("copies").alias("copies"))
    asked = prints[::4]
    got = {(x.f1, x.f2): x.n_near for x in simhash.within(spark.createDataFrame([both(p) for p in asked], "f1 long, f2 long"), index, radius).collect()}
    want = {both(p): sum(1 + k % 3 for k, q in enumerate(prints) if bin(p ^ q).count("1") <= radius) for p in asked}
    assert got == want


def test_likeness_tells_edits_from_strangers(spark, sf):
    rows = queries.op13_fingerprints(spark, sf).collect()
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert [(x.doc_id, x.n_chars) for x in sorted(rows)] == sorted((i, len(t)) for i, t in texts.items())
    long = [x for x in rows if len(texts[x.doc_id].split()) >= 30]
    assert np.mean([x.near_edited for x in long]) > 0.55 and np.mean([x.near_next for x in long]) < 0.2
    assert sum(x.near_edited > x.near_next for x in long) > 0.97 * len(long)
    by = {}
    for x in rows:
        by.setdefault(texts[x.doc_id], set()).add(x.fingerprint)
    assert all(len(v) == 1 for v in by.values())


def test_no_side_is_sent_whole(spark):
    """Files of few bytes stand for many rows after the explode, and for long texts: no join of them is planned as a broadcast."""
    rows = spark.createDataFrame([(i, prose(random.Random(i), 12)) for i in range(60)], "doc_id long, text string")
    with simhash.Scratch(spark, "test") as scratch:
        found = scratch.table(simhash.fingerprint(rows, scratch))
        index = scratch.table(found.groupBy("f1", "f2").agg(F.count("*").alias("copies")))
        for df in (simhash.fingerprint(rows, scratch), simhash.within(found.where("doc_id % 50 = 0"), index)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
