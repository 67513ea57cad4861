"""Removal of repeated 200-byte strings by a distributed difference-cover algorithm.

Suffixes are compared by their first 200 bytes only, so their order beyond that, and the alphabet's order, do not
matter: names stand for equal prefixes, and sorting by name puts equal ones side by side.

1. Sample the suffixes whose position in the document, modulo 133, lies in a difference cover of 12 residues. Any two
   positions i, j have a shift k < 133 with i+k and j+k both sampled. Name each sampled suffix by its first 68 bytes
   (200 - 132), sort the names in ranges, and keep those that occur more than once.
2. Recurse on what is left: a suffix can be repeated only if a sampled suffix less than 133 bytes after it has a kept
   name. Merge these remaining suffixes: name each by its whole 200-byte prefix and sort the names in ranges.
3. Compare neighbours: a name that stands beside its like marks its 200 bytes in each document that holds it.

Names are hashes instead of ranks, which would need the whole suffix array's recursion: a sampled name has 64 bits, as
it only thins out and a collision there adds a candidate. A 200-byte name, which decides, is a pair of independent
64-bit hashes: among 10^13 candidate suffixes some two equal names of different strings come up with probability 2e-13.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.blocks import SENT, answers, range_bits, read_bits, repeated, send, stage
from quorate.llm.common import Scratch, checkpointed, mix64

#: A perfect difference cover: each nonzero residue modulo 133 is the difference of exactly one pair. Fixed values.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)

SEGMENT = 1 << 17
#: Odd bases of the two independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: What goes beside a 200-byte name's first hash: its second one, and whether its block holds it more than once.
SECOND = np.dtype([("second", "<u8"), ("multiple", "?")])
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
_TABLES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def tables(size: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, the powers of an odd base and of its inverse, modulo 2**64."""
    if (size, which) not in _TABLES:
        base = BASES[which]
        power = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, dtype=np.uint64)]))
        _TABLES[size, which] = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)), power(base), power(pow(base, -1, 1 << 64)))
    return _TABLES[size, which]


def window_hashes(text: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of text[p : p + length] for each p of the sorted positions ``at``; prefix sums over bounded segments."""
    values, power, inverse = tables(SEGMENT + length, which)
    out = np.empty(len(at), dtype=np.uint64)
    for start in range(0, len(text), SEGMENT):
        low, high = np.searchsorted(at, [start, start + SEGMENT])
        if low == high:
            continue
        part = text[start : start + SEGMENT + length]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values[part] * power[: len(part)], out=sums[1:])
        p = at[low:high] - start
        out[low:high] = mix64((sums[p + length] - sums[p]) * inverse[p])
    return out


class Block:
    """The documents of a block in one array of bytes."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes)[:-1]])[: len(texts)]
        self.text = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of sampled suffixes of documents that are long enough, and their names."""
        name = self.length - PERIOD + 1
        longest = int(self.sizes.max(initial=0))
        cover = (np.arange(0, longest + 1, PERIOD, dtype=np.int64)[:, None] + np.array(COVER)).ravel()
        at = [b + cover[: np.searchsorted(cover, n - name, side="right")] for b, n in zip(self.begins, self.sizes, strict=True) if n >= self.length]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        return at, window_hashes(self.text, at, name)

    def remaining(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes with a kept sampled suffix (``at``) less than PERIOD bytes on, and their names of full length."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc = np.searchsorted(self.begins, at, side="right") - 1
        low = np.maximum(at - PERIOD + 1, self.begins[doc])
        high = np.minimum(at, self.begins[doc] + self.sizes[doc] - self.length) + 1
        low, high = low[low < high], high[low < high]
        steps = np.bincount(low, minlength=len(self.text) + 1) - np.bincount(high, minlength=len(self.text) + 1)
        here = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        return here, window_hashes(self.text, here, self.length)

    def covered(self, at: np.ndarray) -> np.ndarray:
        """Which bytes the strings that start at ``at`` cover."""
        steps = np.bincount(at, minlength=len(self.text) + 1) - np.bincount(at + self.length, minlength=len(self.text) + 1)
        return np.cumsum(steps[:-1]) > 0


def by_name(first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts names by their hashes, and which of the sorted names differ from the one before."""
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
    if second is not None:
        other = second[order]
        clash = ~new & np.append(False, other[1:] != other[:-1])[: len(ranked)]
        if clash.any():  # equal first hashes of different strings: rare, so sorted by both only now
            order = np.lexsort((second, first))
            ranked, other = first[order], second[order]
            new = np.append(True, (ranked[1:] != ranked[:-1]) | (other[1:] != other[:-1]))
    return order, new


def names(first: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct name is found first, in their order; which occur more than once; and the place of each name."""
    order, new = by_name(first, second)
    where = np.empty(len(first), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return order[new], np.bincount(where, minlength=int(new.sum())) > 1, where


def repeated_pairs(hashes: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
    """Packed bits: which names (both hashes) of each block another block has too, or the block itself more than once."""
    told = [np.frombuffer(e, dtype=SECOND) for e in extras]
    order, new = by_name(np.concatenate(hashes), np.concatenate([t["second"] for t in told]))
    alike = ~new
    alike[:-1] |= ~new[1:]
    found = np.empty(len(order), dtype=bool)
    found[order] = alike
    parts = np.split(found, np.cumsum([len(h) for h in hashes])[:-1])
    return [np.packbits(p | t["multiple"]) for p, t in zip(parts, told, strict=True)]


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, passes: int = 5) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (starts, ends; byte offsets) of each document.

    Removes every byte that a string of ``length`` bytes covers which also starts elsewhere, in any document; strings
    are judged on the input. Null text is empty; null and repeated ids are documents of their own; documents shorter
    than ``length`` stay whole; other columns are ignored; no rows give no rows. The remaining suffixes are merged
    in ``passes`` equal ranges of names, one after the other, which bounds the disk that their exchange takes.
    """
    if length < PERIOD + 16:
        raise ValueError(f"length must be at least {PERIOD + 16}")
    spark = docs.sparkSession
    with Scratch(spark, "repeats") as scratch:
        staged, total = stage(docs, scratch, id_col, text_col)
        bits = range_bits(total * len(COVER) / PERIOD)

        def sample(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            found = Block(list(pdf["text"]), length).sampled()[1]
            distinct, multiple, _ = names(found)
            return send(int(key[0]), found[distinct], multiple, bits)

        kept = scratch.table(answers(staged.groupBy("block").applyInPandas(sample, SENT), repeated).withColumn("level", F.lit(1)))
        scratch.release()
        wide = range_bits(total * 0.3)
        merged = kept

        def remain(block: Block, kept_bits: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            at, found = block.sampled()
            _, _, where = names(found)
            bit = read_bits(kept_bits)
            return block.remaining(at[bit[where]] if len(bit) else at[:0])

        def merging(ranges: range):
            def merge(key: tuple, texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
                if not len(texts) or not len(told):
                    return pd.DataFrame(columns=["part", "block", "hashes", "extra"])
                block = Block(list(texts["text"]), length)
                at, found = remain(block, told)
                if wide:  # only what lies in these ranges needs sorting
                    part = found >> np.uint64(64 - wide)
                    here = (part >= np.uint64(ranges.start)) & (part < np.uint64(ranges.stop))
                    at, found = at[here], found[here]
                second = window_hashes(block.text, at, length, 1)
                distinct, multiple, _ = names(found, second)
                beside = np.empty(len(distinct), dtype=SECOND)
                beside["second"], beside["multiple"] = second[distinct], multiple
                return send(int(key[0]), found[distinct], beside, wide, ranges)

            return merge

        for k in range(passes):
            ranges = range((k << wide) // passes, ((k + 1) << wide) // passes)
            if ranges:
                sent = staged.groupBy("block").cogroup(kept.groupBy("block")).applyInPandas(merging(ranges), SENT)
                merged = merged.unionByName(scratch.table(answers(sent, repeated_pairs).withColumn("level", F.lit(2))))
                scratch.release()

        def mark(key: tuple, texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            block, rows = Block(list(texts["text"]), length), []
            at, found = remain(block, told[told["level"] == 1])
            _, _, where = names(found, window_hashes(block.text, at, length, 1))
            bit = read_bits(told[told["level"] == 2])
            covered = block.covered(at[bit[where]] if len(bit) else at[:0])
            for doc, begin, size in zip(texts["doc_id"], block.begins, block.sizes, strict=True):
                gone = covered[begin : begin + size]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                text = block.text[begin : begin + size]
                rows.append((doc, size, int(gone.sum()), len(edges) // 2, hashlib.sha256(text[~gone].tobytes()).hexdigest(), edges[::2].tolist(), edges[1::2].tolist()))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        marks = staged.groupBy("block").cogroup(merged.groupBy("block")).applyInPandas(mark, OUT)
        return checkpointed(marks)
