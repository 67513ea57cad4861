"""A prefix trie of conversations: a z-fast trie (Belazzougui, Boldi, Pagh and Vigna 2009) kept in Spark tables.

A conversation is a string whose letters are its turns (role, text). Only branching points and ends of conversations are
nodes of the compacted trie. A node's edge covers the depths (p, e]: its *name* is the prefix of depth p + 1, its
*extent* the one of depth e, and its *handle* the one at the 2-fattest depth of (p, e], the number there that most powers
of two divide. Three hashed keys therefore find a node. Conversations go in by batches, each 16 times the one before:

* fat binary search: with (l, r] the depths that are open, the handle table is asked for the prefix of 2-fattest depth
  f; a hit moves l to the node's extent, a miss moves r to f - 1. After at most log2(length) + 1 hits or misses the
  deepest node whose handle is a prefix is known, and one look at its extent tells if the exit is below it or on its edge.
* insertion: what lies below the exits, with the edges that are left in their middle, is grouped by prefix; prefixes
  with two continuations or an end become nodes. Edges that were touched are replaced, all others stay.

Prefixes go by two 64-bit hashes: exclusive sums of random values of (turn, depth), so the prefix before a turn is
known from the turn alone, and a running sum can be cut in chunks. Among 10^12 prefixes two different ones share both
with probability 2e-15. Numbers of subtrees come from (sequence, node) pairs, one for each node on the way to an end;
the edges are then expanded to one row per depth. No row or group holds a whole conversation, a node's members or a
batch: a long conversation is numbered and summed in chunks, and joins on a prefix that very many share are skewed joins
that adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.llm.common import Scratch, checkpointed

#: Sequences in the first batch, how much larger each next batch is, turns of a chunk, and ids in a piece of a digest.
FIRST_BATCH, GROWTH, CHUNK, PIECE = 4096, 16, 1024, 256
#: A depth and the two hashes of a prefix of that depth.
KEY = ["d", "h1", "h2"]


def running(rows: DataFrame, order: list, sums: dict[str, Column], xors: dict[str, Column]) -> DataFrame:
    """rows(conv_id, chunk, ...) with running sums and exclusive sums along each conversation, the own row included.

    Chunks are in the order of their numbers. A window sees one chunk of a conversation, or one row per chunk.
    """
    within = W.partitionBy("conv_id", "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    add = {k: F.sum for k in sums} | {k: F.bit_xor for k in xors}
    values = {k: f(F.col(k)) for k, f in add.items()}
    rows = rows.withColumns(sums | xors)
    totals = rows.groupBy("conv_id", "chunk").agg(*(v.alias(k) for k, v in values.items()))
    totals = totals.select("conv_id", "chunk", *(F.coalesce(v.over(before), F.lit(0).cast("long")).alias(f"_{k}") for k, v in values.items()))
    inside = rows.withColumns({k: v.over(within) for k, v in values.items()}).join(totals, ["conv_id", "chunk"])
    return inside.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums} | {k: F.col(k).bitwiseXOR(F.col(f"_{k}")) for k in xors})


def ordered(conversations: DataFrame, scratch: Scratch, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, j, c1, c2, bytes): the turns of each conversation, numbered from 1; c1 and c2 are hashes of (role, text).

    Null turns come first; equal turns go by role and then by a hash of the text; a null role or text is empty; rows
    without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    hashes = [F.xxhash64(F.lit(k), role, text).alias(f"c{k}") for k in (1, 2)]
    slim = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), *hashes, F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("rid"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "c1", "c2", "rid"]
    ranged = scratch.table(slim.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()))
    return running(ranged, order[1:], {"j": F.lit(1).cast("long")}, {}).select("conv_id", "j", "c1", "c2", "bytes")


def forked(turns: DataFrame, sizes: DataFrame, group: int = 5, spread: int = 9) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % group in place of its own first h; h = crc32(c) % spread.

    turns(conv_id, j, c1, c2, bytes) and sizes(conv_id, n) -> (conv_id, d, c1, c2, bytes). Of a shorter base all turns
    are taken, of an absent one none; ``%`` keeps the sign of a negative id, as in SQL.
    """
    c = F.col("conv_id")
    h = F.crc32(F.encode(c.cast("string"), "UTF-8")) % spread
    sizes = sizes.select("conv_id", h.alias("h"), (c - c % group).alias("base"))
    counts = turns.where(F.col("j") < spread).groupBy(c.alias("base")).agg(F.count("*").alias("n"))
    taken = sizes.join(counts, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    own = turns.join(taken, "conv_id").where("j > h").select("conv_id", (F.col("taken") + F.col("j") - F.col("h")).alias("d"), "c1", "c2", "bytes")
    to = F.explode(F.array(*(F.try_add(c, F.lit(k)) for k in range(1 - group, group))))
    given = turns.where((F.col("j") < spread) & (c % group == 0)).select(c.alias("base"), "j", "c1", "c2", "bytes", to.alias("conv_id"))
    given = given.where((c - c % group == F.col("base")) & (F.col("j") <= h)).join(sizes.select("conv_id"), "conv_id", "left_semi")
    return own.unionByName(given.select("conv_id", F.col("j").alias("d"), "c1", "c2", "bytes"))


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """turns(conv_id, d, c1, c2, bytes) -> (conv_id, d, h1, h2, q1, q2, upto, bytes).

    h1, h2 name the prefix of depth d, q1, q2 the one of depth d - 1, and upto are the bytes of the prefix's texts.
    """
    v1, v2 = (F.xxhash64(F.lit(k), "c1", "c2", "d") for k in (1, 2))
    rows = turns.withColumn("d", F.col("d").cast("long")).withColumn("chunk", F.expr(f"(d - 1) div {CHUNK}"))
    rows = running(rows.withColumns({"v1": v1, "v2": v2}), ["d"], {"upto": F.col("bytes")}, {"h1": v1, "h2": v2})
    return scratch.table(rows.select("conv_id", *KEY, F.col("h1").bitwiseXOR(F.col("v1")).alias("q1"), F.col("h2").bitwiseXOR(F.col("v2")).alias("q2"), "upto", "bytes"))


def fattest(low: Column, high: Column) -> Column:
    """The number of (low, high] that most powers of two divide."""
    m = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, m), m)


def at(rows: DataFrame, pre: DataFrame, seq: str, depth: Column, **columns: str) -> DataFrame:
    """rows with what pre knows of the prefix of a depth of a sequence (new name -> column); null where there is none."""
    there = pre.select(F.col("seq").alias("_s"), F.col("d").alias("_d"), *(F.col(c).alias(n) for n, c in columns.items()))
    return rows.withColumn("_at", depth).join(there, (F.col(seq) == F.col("_s")) & (F.col("_at") == F.col("_d")), "left").drop("_s", "_d", "_at")


def depths(first: Column, last: Column, rows: DataFrame, name: str = "d") -> DataFrame:
    """rows once for each depth from first to last, by steps, so that no long list is made at once."""
    steps = rows.withColumn("_last", last).withColumn("_g", F.explode(F.sequence(first, last, F.lit(CHUNK).cast("long"))))
    return steps.withColumn(name, F.explode(F.sequence("_g", F.least(F.col("_g") + CHUNK - 1, F.col("_last"))))).drop("_g", "_last")


NODE = "e long, n1 long, n2 long, p long, q1 long, q2 long, m1 long, m2 long, f long, f1 long, f2 long, rep long"


def locate(batch: DataFrame, nodes: DataFrame, pre: DataFrame, longest: int) -> DataFrame:
    """Fat binary search: batch(seq, len) -> (seq, len, l): the depth of the deepest node whose extent is a prefix of the sequence."""
    handles = nodes.select(F.col("f").alias("_f"), "f1", "f2", F.col("e").alias("_e"), F.col("n1").alias("_n1"), F.col("n2").alias("_n2"), F.col("p").alias("_p"))
    found, none = {"_e": "e", "_n1": "n1", "_n2": "n2", "_p": "p"}, F.lit(None).cast("long")
    state = batch.select("seq", "len", F.lit(0).cast("long").alias("l"), F.col("len").alias("r"), *(none.alias(c) for c in found.values()))
    for _ in range(max(1, longest).bit_length()):
        state = state.withColumn("f", F.when(F.col("l") < F.col("r"), fattest(F.col("l"), F.col("r"))).otherwise(-1))
        state = at(state, pre, "seq", F.col("f"), x1="h1", x2="h2").withColumns({"x1": F.coalesce("x1", "seq"), "x2": F.coalesce("x2", "seq")})
        state = state.join(handles, (F.col("f") == F.col("_f")) & (F.col("x1") == F.col("f1")) & (F.col("x2") == F.col("f2")), "left")
        hit, asked = F.col("_e").isNotNull(), F.col("f") > 0
        state = state.select("seq", "len", F.when(hit, F.col("_e")).otherwise(F.col("l")).alias("l"), F.when(asked & ~hit, F.col("f") - 1).otherwise(F.col("r")).alias("r"), *(F.when(hit, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in found.items()))
    state = at(state, pre, "seq", F.coalesce(F.col("e"), F.lit(-1)), x1="h1", x2="h2")
    whole = (F.col("x1") == F.col("n1")) & (F.col("x2") == F.col("n2"))
    return state.select("seq", "len", F.when(F.col("e").isNull(), 0).when(F.coalesce(whole, F.lit(False)), F.col("e")).otherwise(F.col("p")).cast("long").alias("l"))


def insert(batch: DataFrame, nodes: DataFrame, pre: DataFrame, longest: int, scratch: Scratch, empty: bool) -> DataFrame:
    """The nodes of the trie with the sequences of batch(seq, len, h1, h2) put in."""
    placed = batch.select("seq", "len", F.lit(0).cast("long").alias("l")) if empty else scratch.table(locate(batch, nodes, pre, longest))
    new = pre.join(placed.select("seq", F.col("l").alias("start")), "seq").where("d > start").select("seq", "start", *KEY, "q1", "q2", F.lit(False).alias("end"))
    touched = None
    if not empty:
        # the edges that the new sequences enter, named by the prefix just below the node that was found
        entry = at(placed.where("l < len"), pre, "seq", F.col("l") + 1, x1="h1", x2="h2").select((F.col("l") + 1).alias("x"), "x1", "x2").distinct()
        touched = scratch.table(nodes.join(entry, (F.col("p") + 1 == F.col("x")) & (F.col("m1") == F.col("x1")) & (F.col("m2") == F.col("x2")), "left_semi"))
        old = depths(F.col("p") + 1, F.col("e"), touched.select("rep", "p", "e"), "at")
        old = at(old, pre, "rep", F.col("at"), h1="h1", h2="h2", q1="q1", q2="q2").select(F.col("rep").alias("seq"), F.col("p").alias("start"), F.col("at").alias("d"), "h1", "h2", "q1", "q2", (F.col("at") == F.col("e")).alias("end"))
        new = new.unionByName(old)
    new = scratch.table(new)
    ends = batch.select(F.col("len").alias("d"), "h1", "h2").unionByName(new.where("end").select(*KEY))
    branch = new.groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("h1"), F.col("q2").alias("h2"))
    branch = branch.agg(F.min("h1").alias("a1"), F.max("h1").alias("b1"), F.min("h2").alias("a2"), F.max("h2").alias("b2")).where("a1 <> b1 OR a2 <> b2").select(*KEY)
    chosen = ends.unionByName(branch).distinct()
    rep = new.groupBy(*KEY).agg(F.min("seq").alias("rep"))
    fresh = rep.join(chosen, KEY, "left_semi")
    # the node above: the one before it on the way of its sequence, or else the one that the way starts from
    path = new.join(fresh, KEY).withColumn("p", F.coalesce(F.lag("d").over(W.partitionBy("seq", "start").orderBy("d")), "start"))
    made = path.where("seq = rep").select(F.col("d").alias("e"), F.col("h1").alias("n1"), F.col("h2").alias("n2"), "p", "rep")
    made = at(made, pre, "rep", F.col("p") + 1, m1="h1", m2="h2", q1="q1", q2="q2").withColumn("f", fattest(F.col("p"), F.col("e")))
    made = at(made, pre, "rep", F.col("f"), f1="h1", f2="h2").select(*(x.split(" ")[0] for x in NODE.split(", ")))
    if touched is not None:
        made = nodes.join(touched.select("e", "n1", "n2"), ["e", "n1", "n2"], "left_anti").select(*made.columns).unionByName(made)
    return scratch.table(made)


def build(seqs: DataFrame, pre: DataFrame, scratch: Scratch, first_batch: int = FIRST_BATCH) -> DataFrame:
    """The nodes (NODE) of the compacted trie of seqs(seq, len, h1, h2), all different; the root is no row."""
    n, longest = seqs.agg(F.count("*"), F.coalesce(F.max("len"), F.lit(0))).first()
    last = max(0, math.ceil(math.log(max(1, n) / first_batch, GROWTH)))
    level = F.floor(-F.log((F.shiftrightunsigned(F.xxhash64(F.lit("batch"), "seq"), 11) + 1) / F.lit(2.0**53)) / math.log(GROWTH))
    seqs = seqs.where("len > 0").withColumn("batch", last - F.least(level, F.lit(last)))
    nodes = seqs.sparkSession.createDataFrame([], NODE)
    for b in range(last + 1):
        nodes = insert(seqs.where(F.col("batch") == b), nodes, pre, longest, scratch, b == 0)
    return nodes


def digests(ends: DataFrame) -> DataFrame:
    """ends(conv_id, d, h1, h2) -> (d, h1, h2, ends_sha256): the digest of the ids of each key, ascending and comma-joined.

    Ids are sorted by key in ranges and joined to pieces; a key's pieces are then hashed as they stream by in order.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True))
            out, at = [], 0
            while at < len(rows):
                upto = at + 1
                while upto < min(len(rows), at + PIECE) and rows[upto][:3] == rows[at][:3]:
                    upto += 1
                out.append((*rows[at], ",".join(str(r[3]) for r in rows[at:upto])))
                at = upto
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if k == key:
                    digest.update(b",")
                else:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], [*KEY, "ends_sha256"])

    kinds = "d long, h1 long, h2 long"
    ranged = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = ranged.mapInArrow(pieces, f"{kinds}, first long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, f"{kinds}, ends_sha256 string")


def expanded(ends: DataFrame, seqs: DataFrame, nodes: DataFrame, pre: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each depth of each edge, and one for the root."""
    spark, node = ends.sparkSession, ["e", "n1", "n2"]
    children = nodes.groupBy(F.col("p").alias("e"), F.col("q1").alias("n1"), F.col("q2").alias("n2")).agg(F.count("*").alias("n_children"))
    children = scratch.table(children)
    ways = pre.join(nodes.select(*(F.col(a).alias(b) for a, b in zip(node, KEY, strict=True))), KEY).select("seq", *(F.col(b).alias(a) for a, b in zip(node, KEY, strict=True)), "upto")
    ways = scratch.table(ways)
    least = ways.groupBy(*node).agg(F.min("seq").alias("conv"), F.min("upto").alias("bytes_e"))
    edges = at(nodes.select(*node, "p", "q1", "q2").join(least, node), pre, "conv", F.col("p") + 1, _upto="upto", _bytes="bytes")
    edges = scratch.table(edges.withColumn("bytes_p", F.col("_upto") - F.col("_bytes")).drop("_upto", "_bytes"))
    # bytes that a sequence is the first to have, and whether nothing goes on after it
    own = edges.groupBy(F.col("conv").alias("seq")).agg(F.sum(F.col("bytes_e") - F.col("bytes_p")).alias("own"))
    inner = children.select(F.col("e").alias("len"), F.col("n1").alias("h1"), F.col("n2").alias("h2"), F.lit(1).alias("goes_on"))
    facts = at(seqs, pre, "seq", F.col("len"), total="upto").join(own, "seq", "left").join(inner, ["len", "h1", "h2"], "left")
    facts = scratch.table(facts.select("seq", "w", "len", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("own", F.lit(0)).alias("own"), F.when(F.col("goes_on").isNull(), 1).otherwise(0).alias("leaf")))
    sums = [F.sum("w").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("w") * F.col("total")).alias("all_bytes"), F.sum("own").alias("first_bytes")]
    per_node = ways.join(facts, "seq").groupBy(*node).agg(*sums)
    mine = facts.select(F.col("seq").alias("conv"), F.col("total").alias("conv_total"), F.col("own").alias("conv_own"))
    below = F.col("all_bytes") - F.col("n_convs") * F.col("bytes_e") - (F.col("first_bytes") - F.col("conv_own") + F.col("conv_total") - F.col("bytes_e"))
    up = edges.select(F.col("e").alias("p"), F.col("n1").alias("q1"), F.col("n2").alias("q2"), F.col("conv").alias("up"))
    whole = edges.join(per_node, node).join(mine, "conv").join(up, ["p", "q1", "q2"], "left").join(children, node, "left")
    whole = whole.select(*node, "p", "conv", "up", "n_convs", "n_leaves", F.coalesce("n_children", F.lit(0)).alias("n_children"), "bytes_e", below.alias("below"))
    rows = at(depths(F.col("p") + 1, F.col("e"), whole, "depth"), pre, "conv", F.col("depth"), _upto="upto", _bytes="bytes")
    root = facts.agg(F.min("seq").alias("conv"), *sums).where("conv IS NOT NULL").first()
    if root is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    n_top = children.where("e = 0").agg(F.coalesce(F.max("n_children"), F.lit(0))).first()[0]
    last = F.col("depth") == F.col("e")
    rows = rows.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("p") + 1, F.col("conv")).when(F.col("p") == 0, root.conv).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * (F.col("bytes_e") - F.col("_upto") + F.col("_bytes"))).alias("saved_tokens"),
        F.when(last, F.col("e")).otherwise(-1).alias("d"), F.when(last, F.col("n1")).otherwise(F.col("conv")).alias("h1"), F.when(last, F.col("n2")).otherwise(F.col("depth")).alias("h2"),
    )
    top = [(root.conv, 0, None, root.n_convs, n_top, root.n_leaves, root.all_bytes - root.first_bytes, 0, 0, 0)]
    rows = rows.unionByName(spark.createDataFrame(top, rows.schema))
    rows = rows.join(digests(ends), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    longs = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return rows.select(*(F.col(c).cast("long").alias(c) for c in longs), "ends_sha256")


def prefix_trie(conversations: DataFrame, fork: bool = False, first_batch: int = FIRST_BATCH, **columns: str) -> DataFrame:
    """The expanded trie of all conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A row is a distinct sequence of first ``depth`` turns: the smallest conversation with it, the one of the node above
    (null at the root), how many conversations share it, how many nodes follow it directly, how many nodes of its subtree
    have none, what sharing its subtree saves (each node's conversations but one, times the UTF-8 bytes of its last text),
    and the digest of the conversations that end there. ``fork`` first gives each conversation the beginning of another
    one (see forked).

    Rows without a conversation are left out; null turns come first, equal turns go by role and a hash of the text,
    repeated rows are turns of their own; null roles and texts are empty; an empty table gives no rows, not even the
    root; other columns are ignored. ``columns`` renames id_col, turn_col, role_col, text_col.
    """
    with Scratch(conversations.sparkSession, "trie") as scratch:
        turns = scratch.table(ordered(conversations, scratch, **columns))
        sizes = scratch.table(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
        pre = prefixes(forked(turns, sizes) if fork else turns.withColumnRenamed("j", "d"), scratch)
        last = pre.groupBy("conv_id").agg(F.max("d").alias("d"), F.bit_xor(F.col("h1").bitwiseXOR(F.col("q1"))).alias("h1"), F.bit_xor(F.col("h2").bitwiseXOR(F.col("q2"))).alias("h2"))
        none = F.lit(0).cast("long")
        ends = scratch.table(sizes.select("conv_id").join(last, "conv_id", "left").select("conv_id", *(F.coalesce(c, none).alias(c) for c in KEY)))
        seqs = scratch.table(ends.groupBy(F.col("d").alias("len"), "h1", "h2").agg(F.min("conv_id").alias("seq"), F.count("*").alias("w")))
        pre = scratch.table(pre.withColumnRenamed("conv_id", "seq").join(seqs.select("seq"), "seq", "left_semi"))
        nodes = build(seqs, pre, scratch, first_batch)
        return checkpointed(expanded(ends, seqs, nodes, pre, scratch))
