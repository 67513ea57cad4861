"""Texts staged in blocks, and exchanges of packed arrays between blocks and ranges of hashes.

A block is a few megabytes of whole documents, kept in a bucketed table, so that later passes group by block without
moving the texts again. A pass turns each block into its sorted distinct 64-bit hashes and sends them, cut into
ranges, as packed arrays; a range answers each block in the order of its hashes, so an answer needs no hashes. A hash
that very many documents hold is sent once by each block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import Scratch

#: Bytes of text in a block, and hashes in a range: what one Python task holds of each.
BLOCK_BYTES, RANGE_HASHES = 6 << 20, 1 << 21
SENT = "part long, block long, hashes binary, extra binary"
ANSWER = "block long, part long, n long, answer binary"


def stage(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, rid, doc_id, text binary) bucketed by block, and the bytes of all texts; a null text is empty.

    rid numbers the rows, as ids may be null or repeated.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    rows = slim.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.encode("text", "UTF-8").alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(n_blocks)))
    staged = scratch.bucketed(rows.select("block", "rid", "doc_id", "text"), "block", min(n_blocks, 50_000))
    scratch.release()  # the shuffle files of the texts
    return staged, total


def range_bits(hashes: float) -> int:
    """How many leading bits of a hash name its range, for so many hashes in all."""
    return max(0, int(np.ceil(np.log2(max(1.0, hashes / RANGE_HASHES)))))


def cuts(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Where each range begins in a sorted array of hashes, and its end."""
    if not bits:
        return np.array([0, len(distinct)])
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(distinct, edges), len(distinct))


def send(block: int, distinct: np.ndarray, extra: np.ndarray, bits: int, ranges: range | None = None) -> pd.DataFrame:
    """A block's message to each range that it has hashes in; extra is an array beside the hashes."""
    at = cuts(distinct, bits)
    rows = [(r, block, distinct[at[r] : at[r + 1]].tobytes(), extra[at[r] : at[r + 1]].tobytes()) for r in (ranges or range(1 << bits)) if at[r] < at[r + 1]]
    return pd.DataFrame(rows, columns=["part", "block", "hashes", "extra"])


def answers(sent: DataFrame, reply: Callable[[list[np.ndarray], list[bytes]], list[np.ndarray]]) -> DataFrame:
    """Each range's answers: reply gets the hashes and extras of its blocks and returns an array for each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(b, dtype=np.uint64) for b in pdf["hashes"]]
        out = reply(hashes, list(pdf["extra"]))
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "n": [len(h) for h in hashes], "answer": [a.tobytes() for a in out]})

    return sent.groupBy("part").applyInPandas(run, ANSWER)


def repeated(hashes: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
    """Packed bits: which hashes of each block another block has too, or the block itself more than once (extra)."""
    every = np.sort(np.concatenate(hashes))
    twice = every[1:][every[1:] == every[:-1]]
    out = []
    for h, extra in zip(hashes, extras, strict=True):
        found = np.zeros(len(h), dtype=bool)
        if len(twice):
            found = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
        out.append(np.packbits(found | np.frombuffer(extra, dtype=bool)))
    return out


def read_bits(pdf: pd.DataFrame) -> np.ndarray:
    """The answers of all ranges to one block, in the order of its hashes."""
    pdf = pdf.sort_values("part")
    parts = [np.unpackbits(np.frombuffer(a, dtype=np.uint8), count=n).astype(bool) for a, n in zip(pdf["answer"], pdf["n"], strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)
