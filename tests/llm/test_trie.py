import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quorate.llm import queries, trie
from quorate.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, depth int, seq string"


def plain(rows, fork=True):
    """The contract in plain loops: rows are (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    made = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9 if fork else 0
        made[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = {k: [] for k in nodes}
    for k in nodes:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    kids = {k: [n for n in sub if len(n) == len(k) + 1] for k, sub in below.items()}
    out = []
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(made[c]) == len(k))
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below[k] if n)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), sum(not kids[n] for n in below[k]), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    assert sorted(df.columns) == sorted(COLUMNS)
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def branching(n, seed, longest=9):
    """Conversations over a few turns, so that they share and leave each other at all depths; copies and prefixes too."""
    r, out, made = random.Random(seed), [], []
    for c in range(n):
        turns = list(r.choice(made))[: r.randint(0, longest)] if made and r.random() < 0.8 else []
        turns += [(r.choice("ua"), r.choice(["", "yes", "nö", "well then"])) for _ in range(r.randint(0, longest - len(turns)))]
        made.append(turns or [("u", "hi")])
        out += [(c * 3 - 20, t, *x) for t, x in enumerate(made[-1])]
    r.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("first_batch", [2, 4096])
def test_equals_plain_loops(spark, first_batch):
    rows = branching(70, 1)
    assert rows_of(trie.prefix_trie(frame(spark, rows), first_batch=first_batch)) == plain(rows, fork=False)


def test_forks(spark):
    rows = [r for r in branching(60, 2) if r[0] >= 0]
    rows += [(1000, None, None, None), (1000, 0, "u", None), (1000, None, "v", ""), (None, 0, "u", "lost"), (1001, 5, "u", "x"), (1001, 5, "u", "x")]
    assert rows_of(trie.prefix_trie(frame(spark, rows), fork=True)) == plain(rows)


def test_long_and_common(spark, monkeypatch):
    """A conversation over many chunks, others that leave it at any depth, and many copies."""
    monkeypatch.setattr(trie, "CHUNK", 8)
    monkeypatch.setattr(trie, "PIECE", 4)
    base = [("u", f"t{i}") for i in range(60)]
    rows = [(1, t, *x) for t, x in enumerate(base)]
    for c in range(2, 30):
        rows += [(c, t, *x) for t, x in enumerate([*base[: c * 2], ("a", "other"), ("a", str(c % 3))])]
    for c in range(30, 60):
        rows += [(c, t, *x) for t, x in enumerate(base[:7])]
    assert rows_of(trie.prefix_trie(frame(spark, rows), first_batch=3)) == plain(rows, fork=False)


def test_no_rows(spark):
    assert rows_of(trie.prefix_trie(frame(spark, []))) == []
    assert rows_of(trie.prefix_trie(frame(spark, [(None, 1, "u", "x")]), fork=True)) == []
    only = [(5, 0, "u", "x")]
    assert rows_of(trie.prefix_trie(frame(spark, only), fork=True)) == plain(only)


def test_fattest(spark):
    pairs = [(a, b) for b in range(1, 70) for a in range(b)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", trie.fattest(F.col("a"), F.col("b")).alias("f"))
    zeros = lambda x: (x & -x).bit_length()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=zeros) for r in df.collect())


def test_search_finds_the_exit(spark):
    """Against the longest explicit prefix, for sequences that are in the trie and others."""
    rows = branching(80, 3, longest=14)
    with Scratch(spark, "test") as scratch:
        turns = trie.ordered(frame(spark, rows), scratch).withColumnRenamed("j", "d")
        pre = scratch.table(trie.prefixes(turns, scratch).withColumnRenamed("conv_id", "seq"))
        last = pre.groupBy("seq").agg(F.max(F.struct("d", "h1", "h2")).alias("x")).select("seq", F.col("x.d").alias("len"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"))
        known = last.where("seq % 2 = 0").groupBy("len", "h1", "h2").agg(F.min("seq").alias("seq"), F.count("*").alias("w"))
        nodes = trie.build(known, pre, scratch, first_batch=4)
        extents = {(r.e, r.n1, r.n2) for r in nodes.collect()}
        path = {}
        for r in pre.collect():
            if (r.d, r.h1, r.h2) in extents:
                path[r.seq] = max(path.get(r.seq, 0), r.d)
        got = trie.locate(last, nodes, pre, 14).collect()
        assert len(got) == 80 and all(r.l == path.get(r.seq, 0) for r in got)
        assert {(r.e, r.n1, r.n2) for r in trie.build(known, pre, scratch, first_batch=10**6).collect()} == extents


def test_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert rows_of(queries.op12_trie(spark, sf)) == plain(rows)
