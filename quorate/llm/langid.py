"""Language identification by rank-order profiles (Cavnar and Trenkle 1994).

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters, word edges count as a blank).
A document's own list is compared with each by the out-of-place distance: the sum over its n-grams of how far
their ranks differ, or the list's length where the profile lacks one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.llm.common import free_name

#: n-grams in a profile; languages beyond which learning raises, as profiles of all (2.4 kB each) are sent to tasks.
PROFILE, LANGUAGES = 300, 20_000
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which of the first 65536 code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(65536)), dtype=bool, count=65536)
    return _LETTERS


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as codes (21 bits a letter, 1 for a blank), and their counts; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known = letters()[np.minimum(points, 65535)]
    for i in np.flatnonzero(points > 65535):
        known[i] = chr(points[i]).isalpha()
    x = np.concatenate([np.ones(1, np.int64), np.where(known, points, 1).astype(np.int64), np.ones(1, np.int64)])
    x = x[(x != 1) | np.append(True, x[:-1] != 1)]  # one blank between words
    if len(x) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two, three = x[:-1] | (x[1:] << 21), x[:-2] | (x[1:-1] << 21) | (x[2:] << 42)
    codes = np.sort(np.concatenate([x[x != 1], two, three]))
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def held_out(id_col: str, modulus: int = 3, remainder: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus == remainder


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """lang -> its n-gram codes by rank, from all rows with a language and a text.

    Counts are summed per batch and language, then over all rows; only ``size`` codes of each language reach the
    driver. More than LANGUAGES languages raise.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                parts = [grams(t) for t in texts]
                codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                total = np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(codes))
                yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": total.astype(np.int64)})

    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= size)
    profiles = top.groupBy("lang").agg(F.sum("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(r, code))), x -> x.code)").alias("codes"))
    found = profiles.limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {r["lang"]: r["codes"] for r in found}


def predict(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score (0 to 1: 1 at distance 0, 0 at the largest one) in place of other columns of these names.

    A text that is null or has no letter is 'und' with score 0, as is every text when there are no profiles. Ties go
    to the language that sorts first.
    """
    langs = sorted(profiles)
    lengths = [len(profiles[x]) for x in langs]
    codes = np.array([c for x in langs for c in profiles[x]], dtype=np.int64)
    order = np.argsort(codes, kind="stable")
    # for each known n-gram, from starts on: the languages that have it and its place in their profiles
    language = np.repeat(np.arange(len(langs), dtype=np.int32), lengths)[order]
    place = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in lengths)])[order]
    known, starts = np.unique(codes[order], return_index=True)
    starts = np.append(starts, len(codes))

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            own = ranked(*grams(text), size) if text else np.zeros(0, np.int64)
            best = ("und", 0.0)
            if len(own) and langs:
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                rank = np.flatnonzero(known[at] == own)
                first, many = starts[at[rank]], starts[at[rank] + 1] - starts[at[rank]]
                where = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                # an n-gram that a profile lacks is ``size`` away: what the others are nearer than that is counted
                nearer = size - np.minimum(np.abs(place[where] - np.repeat(rank, many)), size)
                nearest = np.bincount(language[where], weights=nearer, minlength=len(langs))
                k = int(np.argmax(nearest))
                best = (langs[k], int(nearest[k]) / (len(own) * size))
            out.append(best)
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    name = free_name(kept, "guess")
    return kept.withColumn(name, guess(text_col)).select(*kept.columns, f"{name}.lang_pred", f"{name}.score")
