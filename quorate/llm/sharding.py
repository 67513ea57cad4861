"""Uniform shuffle into shards of exact sizes, through a hypergeometric communication matrix.

The rows start in source blocks. How many rows of each block go to each shard is drawn first, exactly as a
uniform permutation would give it: the matrix with the given row sums (block sizes) and column sums (shard sizes)
whose law is multivariate hypergeometric. Then each block is permuted on its own and dealt out by its row of the
matrix, and each shard is permuted again. Everything is DataFrame or SQL functions.

The draws split a tree of blocks: a node holds how many rows of each shard its blocks get, and passes a
hypergeometric share to its left half and the rest to its right half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.llm.common import checkpointed

#: Rows of a source block and of a block of the second permutation: what one window task sorts.
BLOCK_ROWS = 16_384
#: Levels of the tree of draws after which the plan is cut.
CUT_LEVELS = 5

# ln(n!) by Stirling's series from 16 on, exact products below
_LNFACT = "(CASE WHEN {n} < 16 THEN ln(double(factorial(int({n})))) ELSE ({n} + 0.5D) * ln(double({n})) - {n} + 0.9189385332046727D + 1D/(12D*{n}) - 1D/(360D*pow({n},3)) + 1D/(1260D*pow({n},5)) END)"


def uniform(*parts: str) -> str:
    """SQL for a number in (0, 1) that depends on the parts alone, so that a repeated task draws it again."""
    return f"((shiftrightunsigned(xxhash64({', '.join(parts)}), 11) + 0.5D) / 9007199254740992D)"


def hypergeometric(good: str, total: str, draws: str, u: str) -> str:
    """SQL for an exact draw of how many of ``draws`` rows, out of ``total``, are among the ``good``: inversion.

    The probabilities are walked from the mode outwards, nearest first, with the ratio of neighbours; 12 standard
    deviations to either side hold all but 1e-30 of the mass.
    """
    ln = lambda n: _LNFACT.format(n=f"({n})")
    mode = "least(hi, greatest(lo, bigint(floor((p.n + 1D) * (p.k + 1D) / (p.t + 2D)))))"
    peak = f"exp({ln('p.k')} - {ln('m')} - {ln('p.k - m')} + {ln('p.t - p.k')} - {ln('p.n - m')} - {ln('p.t - p.k - p.n + m')} - {ln('p.t')} + {ln('p.n')} + {ln('p.t - p.n')})"
    step = """aggregate(sequence(1L, bigint(2 * q.w)), named_struct('u', p.u - q.peak, 'x', q.m, 'a', q.m, 'pa', q.peak, 'b', q.m, 'pb', q.peak),
        (s, i) -> CASE WHEN s.u <= 0D THEN s
          WHEN (i % 2 = 1 AND s.b < q.hi) OR s.a <= q.lo THEN
            transform(array(s.pb * double(p.k - s.b) * double(p.n - s.b) / (double(s.b + 1) * double(p.t - p.k - p.n + s.b + 1))), v -> named_struct('u', s.u - v, 'x', least(s.b + 1, q.hi), 'a', s.a, 'pa', s.pa, 'b', least(s.b + 1, q.hi), 'pb', v))[0]
          ELSE
            transform(array(s.pa * double(s.a) * double(p.t - p.k - p.n + s.a) / (double(p.k - s.a + 1) * double(p.n - s.a + 1))), v -> named_struct('u', s.u - v, 'x', s.a - 1, 'a', s.a - 1, 'pa', v, 'b', s.b, 'pb', s.pb))[0] END).x"""
    body = f"""transform(transform(transform(array(named_struct('lo', greatest(0L, p.n - (p.t - p.k)), 'hi', least(p.n, p.k))), b -> transform(array(named_struct('lo', b.lo, 'hi', b.hi, 'm', {mode.replace('hi', 'b.hi').replace('lo,', 'b.lo,')})), c -> c)[0]),
        c -> transform(array(c.m), m -> named_struct('lo', c.lo, 'hi', c.hi, 'm', m, 'peak', {peak}, 'w', 40 + bigint(12D * sqrt(double(p.n) * double(p.k) / double(p.t) * (1D - double(p.k) / double(p.t))))))[0]), q -> {step})[0]"""
    return f"transform(array(named_struct('k', {good}, 't', {total}, 'n', {draws}, 'u', {u})), p -> CASE WHEN p.k = 0 OR p.n = 0 THEN 0L WHEN p.k = p.t THEN p.n WHEN p.n = p.t THEN p.k ELSE {body} END)[0]"


def communication_matrix(sizes: DataFrame, blocks: int, shard_sizes: list[int], seed: int) -> DataFrame:
    """sizes(block, n) of blocks 0 to blocks - 1 -> (block, dealt array<long>): how many rows of a block go to each shard.

    Row and column sums are exact; blocks without rows are left out. Level by level, a node of the tree joins how many
    rows its left half has, a grouped sum, so no list of all blocks is ever in one row; the plan is cut every few levels.
    """
    levels = max(0, (blocks - 1).bit_length())
    pick = hypergeometric("c", "s.left_all", "s.left_draws", uniform(str(int(seed)), "node", "s.shard"))
    draw = f"""aggregate(caps, named_struct('left_draws', drawn, 'left_all', aggregate(caps, 0L, (a, c) -> a + c), 'shard', 0, 'got', cast(array() as array<bigint>)),
        (s, c) -> transform(array({pick}), x -> named_struct('left_draws', s.left_draws - x, 'left_all', s.left_all - c, 'shard', s.shard + 1, 'got', concat(s.got, array(x))))[0]).got"""
    caps = "array(" + ",".join(f"{int(c)}L" for c in shard_sizes) + ")"
    # the root is 1, the children of a node 2 * node and 2 * node + 1, and a block its number plus 2 ** levels
    leaves = sizes.select((F.col("block") + F.lit(1 << levels)).alias("leaf"), "n")
    nodes = sizes.sparkSession.range(1).select(F.lit(1).cast("bigint").alias("node"), F.expr(caps).alias("caps"))
    for level in range(levels):
        child = F.expr(f"shiftright(leaf, {levels - level - 1})")
        left = leaves.where(child % 2 == 0).groupBy((child / 2).cast("bigint").alias("node")).agg(F.sum("n").alias("drawn"))
        halved = nodes.join(left, "node", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("bigint"))).withColumn("left", F.expr(draw))
        children = F.expr("array(named_struct('node', 2L * node, 'caps', left), named_struct('node', 2L * node + 1, 'caps', zip_with(caps, left, (c, x) -> c - x)))")
        nodes = halved.select(F.explode(children).alias("e")).select("e.*").where("aggregate(caps, 0L, (a, c) -> a + c) > 0")
        if level % CUT_LEVELS == CUT_LEVELS - 1:
            nodes = checkpointed(nodes)
    return nodes.select((F.col("node") - F.lit(1 << levels)).alias("block"), F.col("caps").alias("dealt"))


def shuffle_into_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Put every row into one of ``shards`` shards whose sizes differ by one row at most, in uniform random order.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 (unsigned), law ('rows'), shard, slot (gapless
    from 0 in its shard), grown_shard (null: this law promises nothing on growth). A null text has size 1 and the
    checksum of no bytes; null and repeated ids are rows like any other; no rows give no rows; other columns are
    ignored. The slim rows are checkpointed once, so their row numbers survive lost executors.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    slim = checkpointed(slim.withColumn("rid", F.monotonically_increasing_id()))
    n = slim.count()
    blocks = max(1, -(-n // block_rows))
    shard_sizes = [n // shards + (j < n % shards) for j in range(shards)]
    slim = slim.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "rid"), F.lit(blocks)))
    matrix = communication_matrix(checkpointed(slim.groupBy("block").agg(F.count("*").alias("n"))), blocks, shard_sizes, seed)
    matrix = matrix.select("block", F.expr("transform(sequence(1, size(dealt)), i -> aggregate(slice(dealt, 1, i), 0L, (a, c) -> a + c))").alias("upto"))
    local = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "rid"), "rid")
    dealt = slim.withColumn("r", F.row_number().over(local)).join(matrix.hint("shuffle_hash"), "block")
    dealt = dealt.withColumn("shard", F.expr("size(filter(upto, c -> c < r))")).select("doc_id", "size", "text_crc32", "rid", "shard")
    # second permutation: by a random key, in blocks that are ranges of the key
    parts = max(1, -(-n // (shards * block_rows)))
    dealt = dealt.withColumn("key", F.expr(uniform(str(int(seed)), "'second'", "rid"))).withColumn("part", F.least(F.floor(F.col("key") * parts), F.lit(parts - 1)))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    within = W.partitionBy("shard", "part").orderBy("key", "rid")
    out = dealt.withColumn("r", F.row_number().over(within)).join(before.hint("shuffle_hash"), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), (F.col("before") + F.col("r") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
