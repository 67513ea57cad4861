"""SimHash fingerprints (Charikar 2002) and the search for all of them within a Hamming radius (Manku, Jain and Das Sarma 2007).

Terms are word shingles; each occurrence of a term casts one vote per bit for the bit of its hash, so a term weighs as
often as it occurs. A bit of the fingerprint is what most votes say; a draw goes to the term of the smallest hash. For
two texts the share of differing bits is the angle between their term vectors over pi, so the cosine of that angle is
the likeness, and unrelated texts have about 0.

Search: 128 bits are cut into b blocks. Two fingerprints that differ in at most r bits agree in at least b - r whole
blocks, so with one table for each choice of b - r blocks, permuted to the front as its key, they meet in some table.
The more fingerprints there are, the more blocks a key has, so that a bucket holds few by chance. Fingerprints that very
many documents share are one entry with a count. What very many near-equal fingerprints share is a large bucket; it is
joined with its queries, packed by 256, so that adaptive execution splits it and no pair is a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import Scratch, checkpointed, mix64, word_hashes

#: Bits of a fingerprint, words of a shingle, bits that near fingerprints may differ in, and the queries packed in a row.
BITS, SIZE, RADIUS, PACK = 128, 5, 6, 256
#: Bytes of text that are fingerprinted at once, votes that fit a byte, and how many such sums are made at once.
SLICE, VOTES, SUMS = 1 << 20, 255, 512
#: The eight bits of a byte as eight bytes of a word.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def terms(texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of all texts in order, and how many each text has; fewer words than a shingle are one."""
    words, n = word_hashes(texts)
    many = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    first = np.repeat(np.cumsum(n) - n, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    width = np.repeat(np.minimum(n, size), many)
    words = mix64(np.append(words, np.zeros(size, np.uint64)))
    out = width.astype(np.uint64)
    for k in range(size):
        out = np.where(k < width, mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[first + k]), out)
    return out, many


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Two words for each hash, as 16 bytes."""
    return np.stack([hashes, mix64(hashes + np.uint64(0xD1B54A32D192ED03))], 1).view(np.uint8)


def fingerprints(texts: list[bytes], size: int = SIZE) -> np.ndarray:
    """(n, 16) bytes; a text without words has zeros."""
    out, at = np.zeros((len(texts), BITS // 8), dtype=np.uint8), 0
    while at < len(texts):
        upto, length = at + 1, len(texts[at])
        while upto < len(texts) and length + len(texts[upto]) <= SLICE:
            length += len(texts[upto])
            upto += 1
        hashes, many = terms(texts[at:upto], size)
        full = np.flatnonzero(many)
        if len(full):
            n = many[full]
            begin = np.cumsum(n) - n
            parts = -(-n // VOTES)
            part = np.cumsum(parts) - parts
            starts = np.append(np.repeat(begin, parts) + VOTES * (np.arange(parts.sum()) - np.repeat(part, parts)), len(hashes))
            sums = np.zeros((len(starts) - 1, BITS), dtype=np.int64)
            for a in range(0, len(sums), SUMS):
                b = min(a + SUMS, len(sums))
                votes = SPREAD[_bits(hashes[starts[a] : starts[b]])]
                sums[a:b] = np.add.reduceat(votes, starts[a:b] - starts[a], axis=0).view(np.uint8)
            votes = 2 * np.add.reduceat(sums, part, axis=0) - n[:, None]
            draw = np.unpackbits(_bits(np.minimum.reduceat(hashes, begin)), axis=1)
            out[at + full] = np.packbits(np.where(votes == 0, draw == 1, votes > 0), axis=1)
        at = upto
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of the angle that the differing bits of two (n, 16) arrays tell, 0 beyond a right angle."""
    return np.maximum(0.0, np.cos(np.pi * np.bitwise_count(a ^ b).sum(1) / BITS))


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next text's first ones."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_ROW = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("f1", pa.int64()), ("f2", pa.int64()),
])
_KINDS = "kind int, part int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, f1 long, f2 long"
#: Rows that are done, the first row of a range, and its last row, which the first one of the next range follows.
DONE, HEAD, LAST = 0, 1, 2


def _rows(kind: int, part: int, ids: list, texts: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray) -> pa.RecordBatch:
    edited = [edit(a, b).encode() for a, b in zip(texts, following, strict=True)]
    other = fingerprints(edited)
    both = prints.view(">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
    n = len(ids)
    columns = [
        pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(ids, pa.int64()), pa.nulls(n, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        pa.array([p.tobytes().hex() for p in prints]), pa.array([p.tobytes().hex() for p in other]), pa.array(likeness(prints, other)), pa.array(likeness(prints, next_prints)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ROW)


def _edge(kind: int, part: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    some = [pa.array([x], f.type) for x, f in zip((kind, part, doc_id, text), _ROW, strict=False)]
    return pa.RecordBatch.from_arrays([*some, *(pa.nulls(1, f.type) for f in list(_ROW)[4:])], schema=_ROW)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: each with the one that follows it; the first and the last are told apart."""
    held = part = None
    for b in batches:
        if not b.num_rows:
            continue
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        prints = fingerprints([t.encode() for t in texts])
        if held is None:
            part = b.column("part")[0].as_py()
            yield _edge(HEAD, part, ids[0], texts[0])
        else:
            ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], prints])
        if len(ids) > 1:
            yield _rows(DONE, part, ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
        held = ids[-1], texts[-1], prints[-1:]
    if held is not None:
        yield _edge(LAST, part, held[0], held[1])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            texts, following = b.column("text").to_pylist(), b.column("following").to_pylist()
            prints, nexts = (fingerprints([t.encode() for t in x]) for x in (texts, following))
            yield _rows(DONE, 0, b.column("doc_id").to_pylist(), texts, following, prints, nexts)


def fingerprint(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, f1, f2) of every row.

    Texts move once: into ranges of descending id, where each row's next one streams by after it. The last row of a range
    meets the first one of the next range that has rows in a join of two rows a range.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("rid"))
    order = [F.desc_nulls_last("doc_id"), "h", "rid"]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    made = scratch.table(ranged.mapInArrow(_along, _KINDS))
    scratch.release()
    parts = sorted(r.part for r in made.where(f"kind = {HEAD}").select("part").collect())  # one a range
    pairs = [(a, b) for a, b in zip(parts, [*parts[1:], *parts[:1]], strict=True)]
    # the size of a file tells neither that of its texts nor that of rows after an explode, so such tables are never sent whole
    heads = made.where(f"kind = {HEAD}").select(F.col("part").alias("after"), F.col("text").alias("following")).hint("merge")
    lasts = made.where(f"kind = {LAST}").select("part", "doc_id", "text").hint("merge")
    lasts = lasts.join(made.sparkSession.createDataFrame(pairs, "part int, after int"), "part").join(heads, "after").select("doc_id", "text", "following")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "f1", "f2"]
    return made.where(f"kind = {DONE}").select(*columns).unionByName(lasts.mapInArrow(_across, _KINDS).select(*columns))


def tables(n: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """The masks (two words) of the key of each table for n fingerprints: as few blocks as give keys of log2(n) bits."""
    want = min(BITS // 2, np.log2(max(2, n)))
    blocks = next(b for b in range(radius + 1, BITS + 1) if (b - radius) * BITS / b >= want)
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    piece = [sum(1 << (BITS - 1 - x) for x in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(piece[k] for k in some) for some in combinations(range(blocks), blocks - radius)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(m >> 64), signed(m & ((1 << 64) - 1))) for m in masks]


def _keys(prints: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(t).alias("t"), F.col("f1").bitwiseAND(F.lit(a)).alias("k1"), F.col("f2").bitwiseAND(F.lit(b)).alias("k2")) for t, (a, b) in enumerate(masks)))
    return prints.select("*", F.explode(each).alias("key")).select(*prints.columns, "key.*")


def within(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """queries(f1, f2) against index(f1, f2, copies): (f1, f2, n_near), the copies of all entries within the radius of each distinct query.

    Exact. A pair counts in the first table in which it meets. Both sides are shuffled: Spark takes a table for as small as it was
    before the explode, and would send one to the driver.
    """
    masks = tables(index.count(), radius)
    asked = _keys(queries.select("f1", "f2").distinct(), masks).hint("merge")
    slot = F.pmod(F.xxhash64("f1", "f2"), F.ceil(F.col("n") / PACK))
    sizes = asked.groupBy("t", "k1", "k2").agg(F.count("*").alias("n"))
    packed = asked.join(sizes, ["t", "k1", "k2"]).groupBy("t", "k1", "k2", slot.alias("slot")).agg(F.collect_list(F.struct("f1", "f2")).alias("asked"))
    met = _keys(index, masks).hint("merge").join(packed, ["t", "k1", "k2"]).select("t", "f1", "f2", "copies", "asked")
    words = np.array(masks, dtype=np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, f1, f2, copies = (b.column(c).to_numpy() for c in ("t", "f1", "f2", "copies"))
            lists = b.column("asked")
            size = np.diff(lists.offsets.to_numpy())
            q1, q2 = (lists.flatten().field(k).to_numpy().view(np.uint64) for k in (0, 1))
            d1, d2 = q1 ^ np.repeat(f1.view(np.uint64), size), q2 ^ np.repeat(f2.view(np.uint64), size)
            near = np.flatnonzero(np.bitwise_count(d1) + np.bitwise_count(d2) <= radius)
            d1, d2, table = d1[near], d2[near], np.repeat(t, size)[near]
            new = np.ones(len(near), dtype=bool)
            for k, (a, c) in enumerate(words):
                new &= (k >= table) | ((d1 & a) | (d2 & c) != 0)
            near = near[new]
            if len(near):
                pairs, back = np.unique(np.stack([q1[near], q2[near]], 1).view(np.int64), axis=0, return_inverse=True)
                counts = np.zeros(len(pairs), dtype=np.int64)
                np.add.at(counts, back.ravel(), np.repeat(copies, size)[near])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(counts)], ["f1", "f2", "n"])

    return met.mapInArrow(run, "f1 long, f2 long, n long").groupBy("f1", "f2").agg(F.sum("n").alias("n_near"))


def document_fingerprints(docs: DataFrame, every: int = 50, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) of every row.

    A row's next one is that of the next smaller id, after the smallest the largest; equal ids go by a hash of the text,
    null ids come last, an only row follows itself. n_near counts the documents within ``radius`` bits, itself included,
    for the ids that ``every`` divides (null for others): those search the tables of all documents. A null text is empty;
    texts without words have the fingerprint of zeros; no rows give no rows; other columns are ignored.
    """
    with Scratch(docs.sparkSession, "simhash") as scratch:
        rows = scratch.table(fingerprint(docs, scratch, id_col, text_col))
        index = scratch.table(rows.groupBy("f1", "f2").agg(F.count("*").alias("copies")))
        asking = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
        near = within(rows.where(asking), index, radius)
        some = rows.where(asking).join(near, ["f1", "f2"], "left")
        out = some.unionByName(rows.where(~asking).withColumn("n_near", F.lit(None).cast("long")))
        return checkpointed(out.drop("f1", "f2"))
