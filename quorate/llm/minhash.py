"""Near-duplicate documents by fast similarity sketches (Dahlgaard, Knudsen and Thorup 2017), banding and exact checks.

A sketch has 256 coordinates. In round i every shingle is thrown into one coordinate and the smallest value of the
first round that reaches a coordinate stays; later rounds go through the coordinates one by one, so that each of them
fills. Sketches agree in a coordinate with the Jaccard similarity as probability and the same concentration bounds as
independent minima. Bands of 4 coordinates give the candidates: two documents at similarity 0.75 share none of the 32
bands once in 200,000 times.

Documents with equal shingle sets are one node. Candidates are compared in rounds: first each node with one leader of
its bucket. Components that still share a bucket and may be linked form a family, and all pairs of a family's different
components are compared, in blocks of bounded size. A pair goes on to the exact check on full sets unless its sketches agree in less than 62 % of the
coordinates (five standard deviations below 0.75). Pairs inside a component need no check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.llm.common import Scratch, checkpointed, components, mix64
from quorate.llm.decontaminate import text_keys, windows

COORDINATES, BANDS, ROWS = 256, 32, 4
#: Percent of the union that the intersection must reach, and the share of agreeing coordinates below which a pair is dropped.
PERCENT, AGREE = 75, 0.62
#: Members of a bucket that are compared with each other in one task.
BLOCK = 512


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``size`` words; all words as one if there are fewer."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh3_64_intdigest
    found = np.sort(windows(np.array([digest(w) for w in words], dtype=np.uint64), size))
    return found[np.append(True, found[1:] != found[:-1])[: len(found)]]


_SEEDS = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(items: np.ndarray) -> np.ndarray:
    """One value per coordinate; items are distinct 64-bit hashes, at least one."""
    out = np.zeros(COORDINATES, dtype=np.uint64)
    empty = np.ones(COORDINATES, dtype=bool)
    low, at = np.uint64(56), 0
    rounds = int(max(1, min(16, 4096 // len(items))))
    while at < COORDINATES and empty.any():
        seeds = _SEEDS[at : min(at + rounds, COORDINATES)]
        thrown = np.sort(mix64(items[None, :] ^ seeds[:, None]), axis=1)
        place = thrown >> low
        first = np.ones(thrown.shape, dtype=bool)
        first[:, 1:] = place[:, 1:] != place[:, :-1]
        row, col = np.nonzero(first[::-1])  # earlier rounds are written last and so stay
        row = len(seeds) - 1 - row
        spot = place[row, col].astype(np.int64)
        new = empty[spot]
        out[spot[new]] = thrown[row, col][new] ^ seeds[row[new]]
        empty[spot] = False
        at += rounds
    for c in np.flatnonzero(empty):  # the rounds that go through the coordinates
        out[c] = mix64(items ^ _SEEDS[COORDINATES + c]).min() ^ _SEEDS[COORDINATES + c]
    return mix64(out)


def bands(values: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix64(out + values[k : BANDS * ROWS : ROWS])
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, rid_col: str | None = None) -> DataFrame:
    """(rid, doc_id, t1, t2, n_shingles, k1, k2, bands, sketch) of every row; rows without words have no keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                items = shingles(text, size)
                if len(items):
                    values, key = sketch(items), xxhash.xxh3_128_intdigest(items.tobytes())
                    rows.append((len(items), (key >> 64) - (1 << 63), (key & ((1 << 64) - 1)) - (1 << 63), bands(values).view(np.int64), values.astype(np.uint8).tobytes()))
                else:
                    rows.append((0, None, None, None, None))
            n, k1, k2, band, values = zip(*rows, strict=True) if rows else ((),) * 5
            whole = lambda x: pd.array(list(x), dtype="Int64")  # noqa: E731  exact beside nulls
            out = pd.DataFrame({"n_shingles": whole(n), "k1": whole(k1), "k2": whole(k2), "bands": pd.Series(band, dtype=object), "sketch": pd.Series(values, dtype=object)})
            for c in ("rid", "doc_id", "t1", "t2"):
                out.insert(0, c, pdf[c].astype("Int64").values)
            yield out

    slim = docs.select((F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), *(k.alias(a) for k, a in zip(text_keys(text_col), ("t1", "t2"), strict=True)), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "t2 long, t1 long, doc_id long, rid long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary")


def agreeing(pairs: DataFrame) -> DataFrame:
    """pairs(u, v, su, sv) -> (u, v, agree) of those whose sketches agree in enough coordinates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                side = lambda c: np.frombuffer(b"".join(pdf[c]), dtype=np.uint8).reshape(-1, COORDINATES)
                agree = (side("su") == side("sv")).mean(1)
                yield pd.DataFrame({"u": pdf["u"], "v": pdf["v"], "agree": agree})[agree >= AGREE]

    return pairs.select("u", "v", "su", "sv").mapInPandas(run, "u long, v long, agree double")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity, as edges (a, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["x"], pdf["y"], strict=True):
                keep.append(similar(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)))
            yield pd.DataFrame({"a": pdf["u"], "b": pdf["v"]})[np.array(keep, dtype=bool)]

    left = pairs.select("u", "v").join(sets.select(F.col("node").alias("u"), F.col("items").alias("x")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("items").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInPandas(run, "a long, b long")


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that are sorted by keys; a group may go over several batches."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        values = pdf[keys].to_numpy()
        ends = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        begin = 0
        for end in ends:
            yield pdf.iloc[begin:end]
            begin = end
        rest = pdf.iloc[begin:]
    if rest is not None and len(rest):
        yield rest


def in_blocks(members: DataFrame, keys: list[str]) -> DataFrame:
    """Each group of members cut into blocks of about BLOCK; every two blocks of a group, or one with itself, side by side.

    Adds i and j (the blocks that meet) and own (the row's block), and sorts the partitions by group and blocks.
    """
    sized = members.join(members.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("of")), keys)
    sized = sized.withColumn("own", F.pmod(F.xxhash64("node"), "of")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    met = sized.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("of", "other")
    return met.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "node")


class Forest:
    """Which labels of a group are connected so far."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = x = self.root.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        """Connect two labels; whether they were apart."""
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b


def met_pairs(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, others, agree): for each row k of two blocks, the rows of the other one in other components that may reach the similarity."""
    i, j = group["i"].iloc[0], group["j"].iloc[0]
    comp, own = group["comp"].to_numpy(), group["own"].to_numpy()
    sketches = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint8).reshape(-1, COORDINATES)
    place = np.arange(len(group))
    for k in place:
        if own[k] == i:
            near = np.flatnonzero((comp != comp[k]) & ((place > k) if i == j else (own == j)))
            agree = (sketches[near] == sketches[k]).mean(1)
            yield k, near[agree >= AGREE], agree[agree >= AGREE]


def families(members: DataFrame) -> DataFrame:
    """members(band, h, node, comp, sketch) -> (a, b): components that may be linked; a forest of each two blocks, not all pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["band", "h", "i", "j"]):
            comp, forest = group["comp"].tolist(), Forest()
            if len(set(comp)) > 1:
                out = [(comp[k], comp[n]) for k, near, _ in met_pairs(group) for n in near.tolist() if forest.join(comp[k], comp[n])]
                yield pd.DataFrame(out, columns=["a", "b"])

    return in_blocks(members, ["band", "h"]).select("band", "h", "i", "j", "own", "comp", "sketch").mapInPandas(run, "a long, b long")


def family_links(members: DataFrame) -> DataFrame:
    """members(family, node, comp, sketch, items) -> (a, b): links that connect components, checked on full sets.

    All pairs of different components whose sketches allow it are checked, the likeliest first, but for those that a
    link of the same task has connected by then.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["family", "i", "j"]):
            comp, node, forest = group["comp"].tolist(), group["node"].tolist(), Forest()
            if len(set(comp)) < 2:
                continue
            sets, out = [np.frombuffer(b, dtype=np.uint64) for b in group["items"]], []
            for k, near, agree in met_pairs(group):
                for n in near[np.argsort(-agree, kind="stable")].tolist():
                    if forest.find(comp[k]) != forest.find(comp[n]) and similar(sets[k], sets[n]):
                        forest.join(comp[k], comp[n])
                        out.append((node[k], node[n]))
            yield pd.DataFrame(out, columns=["a", "b"])

    return in_blocks(members, ["family"]).select("family", "i", "j", "own", "node", "comp", "sketch", "items").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, leader_rounds: int = 2, rid_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept (doc_id equals it) of every row.

    A null text or one without words has no shingles and is linked with nothing. Rows with null ids are compared like
    others; a component of null ids alone has a null component_id, and its rows are kept. Rows with the smallest id of
    a component are all kept if the id repeats. Other columns are ignored; no rows give no rows. rid is the column
    rid_col, which tells the rows apart, or else a number that holds for this call alone.
    """
    with Scratch(docs.sparkSession, "minhash") as scratch:
        rows = scratch.table(signatures(docs, id_col, text_col, size, rid_col))
        first = F.min_by(F.struct("t1", "t2", "bands", "sketch"), "rid").alias("one")
        nodes = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"), first).select("k1", "k2", "node", "least", "one.*")
        nodes = scratch.table(nodes)
        exploded = nodes.select("node", F.posexplode("bands").alias("band", "h"))
        shared = exploded.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1").select("band", "h")
        members = scratch.table(exploded.join(shared, ["band", "h"]))
        chosen = members.select("node").distinct()

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"node": pdf["node"], "items": [shingles(t, size).tobytes() for t in pdf["text"]]})

        wanted = nodes.join(chosen, "node").select("node", "t1", "t2")
        texts = docs.select(*(k.alias(a) for k, a in zip(text_keys(text_col), ("t1", "t2"), strict=True)), F.col(text_col).alias("text"))
        # one text of a group of copies is enough
        texts = texts.join(wanted, ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))
        sets = scratch.table(texts.mapInPandas(fill, "node long, items binary"))
        scratch.release()
        sketches = nodes.join(chosen, "node").select("node", "sketch")
        links = scratch.table(members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))

        def labelled() -> DataFrame:
            """Members of the buckets that still hold several components."""
            found = scratch.table(components(links, scratch))
            known = members.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
            mixed = known.groupBy("band", "h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band", "h")
            return scratch.table(known.join(mixed, ["band", "h"]))

        open_members = labelled()
        for turn in range(leader_rounds):
            lead = open_members.groupBy("band", "h").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node"), F.col("node").alias("v"), F.col("comp").alias("c"))).alias("lead")).select("band", "h", "lead.v", "lead.c")
            pairs = open_members.join(lead, ["band", "h"]).where("comp <> c").select(F.col("node").alias("u"), "v").distinct()
            with_u = pairs.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("su")), "u")
            with_both = with_u.join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("sv")), "v")
            best = agreeing(with_both).withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("agree"), "v"))).where("r = 1")
            links = scratch.table(links.unionByName(linked(best, sets)))
            scratch.release()
            open_members = labelled()
        # what the leaders left open: components that may still be linked are compared as a family
        near = scratch.table(families(open_members.join(sketches, "node")))
        family = components(near, scratch).select(F.col("id").alias("comp"), F.col("component").alias("family"))
        found = scratch.table(components(links, scratch))
        own = sets.select("node").join(found.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
        whole = own.join(family, "comp").join(sketches, "node").join(sets, "node")
        closing = scratch.table(family_links(whole))
        scratch.release()
        stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = components(stars.unionByName(closing), scratch)
        named = nodes.select("k1", "k2", "node", "least").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(smallest, "component").select("k1", "k2", "component_id")
        slim = rows.select("rid", "doc_id", "n_shingles", "k1", "k2")
        # rows without words would all meet under the null key
        worded = slim.where("n_shingles > 0").join(named, ["k1", "k2"]).drop("k1", "k2")
        out = worded.unionByName(slim.where("n_shingles = 0").select("rid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        return checkpointed(out.select("rid", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
