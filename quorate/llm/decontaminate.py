"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and numbers, names and units become typed placeholders, so a benchmark question keeps its
template when its parameters are changed. Windows of five template tokens are hash-joined with those of the
benchmark. An item counts as found in a document if one occurrence covers enough of its tokens. An occurrence is made
of the joined windows nearest to one alignment (document position minus item position), so that words put in or left out
do not end it; windows whose slots are filled inconsistently in it (one value of the item for two of the document, or
the other way round) are left out. Other occurrences in the same document have no say in it.

Placeholders alone say nothing: a window without a literal word is joined with its values, so that a list of numbers is
found by its numbers and not by being one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import free_name, mix64, worker_state

#: Template tokens in a window; share of an item's tokens that joined windows must cover.
WINDOW, SIMILARITY = 5, 0.75
#: Up to so many benchmark windows their hashes are sent to all tasks (8 bytes each) to thin out the documents' windows
#: before the join; beyond it all windows are shuffled. Both ways give the same rows. So do windows whose slots have more
#: bytes in all than are sent.
SENT_WINDOWS, SENT_BYTES = 1 << 20, 64 << 20

WORD = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+|[%€$£°]|[.!?\n]")
#: Units of measure, time and money that stand after a number.
UNITS = frozenset(
    "% € $ £ ° mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec secs min mins h hr hrs day days week weeks month months year years hz khz mhz ghz w kw mw v a j kj n pa bar k c f eur usd gbp euro euros dollar dollars cent cents pound pounds meter meters metre metres kilometer kilometers kilometre kilometres mile miles hour hours minute minutes second seconds gram grams kilogram kilograms liter liters litre litres percent".split()
)
KIND = np.uint64(7)
NUMBER, UNIT, NAME = (np.uint64(xxhash.xxh3_64_intdigest(x)) & ~KIND for x in ("<number>", "<unit>", "<name>"))
#: Kinds of words, in the low three bits of a word's code; the others are the hash of its lower-cased form.
PLAIN, DIGITS, END, TITLE, UNIT_WORD, UNIT_SIGN, UNIT_TITLE = range(7)
#: Word codes that a Python worker remembers before it starts anew.
CODES = 200_000


def code(word: str) -> int:
    low = word.lower()
    title = len(word) > 1 and word.istitle()
    if word in ".!?\n":
        kind = END
    elif word[0].isdigit():
        kind = DIGITS
    elif low in UNITS:
        kind = UNIT_SIGN if not low.isalpha() else UNIT_TITLE if title else UNIT_WORD
    else:
        kind = TITLE if title else PLAIN
    return (xxhash.xxh3_64_intdigest(low) & ~7) | kind


class Codes(dict):
    """Word codes, computed when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CODES:
            self.clear()
        self[word] = value = code(word)
        return value


def canonical(text: str) -> tuple[np.ndarray, dict[int, str]]:
    """The template tokens of a text as hashes, and the value in each slot by token position.

    A name is a word with one capital at its start that does not begin a sentence; a unit stands after a number.
    """
    words = WORD.findall(text)
    known = worker_state(("decontaminate",), Codes)
    codes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    kind = (codes & KIND).astype(np.int8)
    before = np.concatenate([[END], kind[:-1]]).astype(np.int8)[: len(kind)]
    unit = (before == DIGITS) & (kind >= UNIT_WORD)
    name = ((kind == TITLE) | (kind == UNIT_TITLE)) & (before != END) & ~unit
    number = kind == DIGITS
    keep = (kind != END) & ((kind != UNIT_SIGN) | unit)
    out = codes & ~KIND
    out[number], out[unit], out[name] = NUMBER, UNIT, NAME
    place = np.cumsum(keep) - 1
    slots = {int(place[i]): words[i].lower() for i in np.flatnonzero(number | unit | name).tolist()}
    return out[keep], slots


def windows(tokens: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """A hash of each window; one window of all tokens if there are fewer; none without tokens."""
    n = min(size, len(tokens))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.full(len(tokens) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = mix64(out + tokens[k : k + len(out)])
    return out


def valued(found: np.ndarray, width: int, slots: dict[int, str]) -> np.ndarray:
    """The windows' hashes, where those of nothing but slots are hashes of their values."""
    if len(slots) < width or not len(found):
        return found
    flags = np.zeros(len(found) + width, dtype=np.int64)
    flags[np.fromiter(slots, dtype=np.int64, count=len(slots)) + 1] = 1
    upto = np.cumsum(flags)
    for at in np.flatnonzero(upto[width:] - upto[:-width] == width).tolist():
        found[at] = xxhash.xxh3_64_intdigest("\0".join(slots[k] for k in range(at, at + width)))
    return found


def template_windows(rows: DataFrame, keys: list[str], size: int = WINDOW, among: np.ndarray | None = None, short: tuple[int, ...] = ()) -> DataFrame:
    """rows(keys..., text) -> (keys..., n_tokens, at, window, slots): the windows of each text, only those in ``among`` if given.

    Longer texts have windows of the ``short`` sizes too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for values in zip(*[pdf[k] for k in keys], pdf["text"], strict=True):
                tokens, slots = canonical(values[-1] or "")
                for width in (min(size, len(tokens)), *(w for w in short if w < min(size, len(tokens)))):
                    found = valued(windows(tokens, width), width, slots)
                    keep = range(len(found)) if among is None else np.flatnonzero(among[np.minimum(np.searchsorted(among, found), max(0, len(among) - 1))] == found) if len(among) and len(found) else []
                    for at in keep:
                        at = int(at)
                        own = [f"{k - at}={slots[k]}" for k in range(at, at + width) if k in slots] if slots else []
                        out.append((*values[:-1], len(tokens), at, int(found[at].astype(np.int64)), own))
            frame = pd.DataFrame(out, columns=[*keys, "n_tokens", "at", "window", "slots"])
            for k in keys:
                frame[k] = frame[k].astype("Int64")
            yield frame

    schema = ", ".join(f"{k} long" for k in keys) + ", n_tokens int, at int, window long, slots array<string>"
    return rows.select(*keys, "text").mapInPandas(run, schema)


def text_keys(text: str | Column) -> list[Column]:
    """Two hashes that stand for a text: what is decided for a text holds for all its copies."""
    return [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k1"), F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit(""))).alias("k2")]


def consistent(filled: set[tuple[int, str, str]]) -> set[tuple[str, str]]:
    """Of slots (place, value of the item, value of the document), the pairs of values to keep.

    The item's own value stays; another one stays if it is there more often than each that contradicts it.
    """
    times = Counter((own, other) for _, own, other in filled)
    of_item, of_text = defaultdict(list), defaultdict(list)
    for own, other in times:
        of_item[own].append((own, other))
        of_text[other].append((own, other))
    return {p for p in times if p[0] == p[1] or all(times[p] > times[q] for q in of_item[p[0]] + of_text[p[1]] if q != p)}


def best_occurrence(hits: Iterable[tuple[int, int, list[str], list[str]]], n_tokens: int, size: int, similarity: float) -> tuple[float, int] | None:
    """Joined windows (item_at, at, item_slots, slots) of a text and an item -> (coverage, number of value pairs) if it is similar.

    Each alignment is tried with the windows up to the item's length away from it, and with those of the whole text.
    """
    width, places, fills = min(size, n_tokens), defaultdict(list), {}
    for item_at, at, item_slots, slots in hits:
        places[item_at].append(at)
        values = [(x.split("=", 1), y.split("=", 1)[1]) for x, y in zip(item_slots, slots, strict=True)]
        fills[item_at, at] = [(item_at + int(k), own, other) for (k, own), other in values]

    def covered(starts: Iterable[int]) -> int:
        return len({k for s in starts for k in range(s, s + width)})

    most, best = covered(places), (0, 0)
    if most < similarity * n_tokens:
        return None
    for at in places.values():
        at.sort()
    for anchor, _ in Counter(at - item_at for item_at, at in fills).most_common():
        near = {}
        for item_at, at in places.items():
            k = bisect_left(at, anchor + item_at)
            near[item_at] = min(at[max(0, k - 1) : k + 1], key=lambda x: abs(x - anchor - item_at))
        for chosen in ({i: at for i, at in near.items() if abs(at - anchor - i) <= n_tokens}, near):
            if covered(chosen) <= best[0]:
                continue
            filled = {f for hit in chosen.items() for f in fills[hit]}
            kept = consistent(filled)
            n = covered(i for i, at in chosen.items() if all((own, other) in kept for _, own, other in fills[i, at]))
            best = max(best, (n, len({(own, other) for _, own, other in filled})))
        if best[0] == most:
            break
    return (best[0] / n_tokens, best[1]) if best[0] >= similarity * n_tokens else None


def found_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, size: int = WINDOW) -> DataFrame:
    """(k1, k2, item_id, coverage, n_slots): which texts, by text_keys, hold which items.

    Items and texts without tokens match nothing. Repeated items count each; repeated windows count once. Items with
    fewer tokens than a window are found inside texts too. Windows of slots alone are found by their values.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    known = template_windows(items, ["item_id"], size)
    n, slot_bytes = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws("", "slots"))), F.lit(0))).first()
    among = None
    if n <= SENT_WINDOWS:
        among = np.array(sorted({r.window for r in known.select("window").distinct().collect()}), dtype=np.int64).view(np.uint64)
        among.sort()
    short = tuple(r.n_tokens for r in known.where(F.col("n_tokens") < size).select("n_tokens").distinct().collect())
    known = known.select("item_id", "window", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("n_tokens").alias("item_tokens"))
    hits = template_windows(docs.select(*text_keys(text_col), F.col(text_col).alias("text")), ["k1", "k2"], size, among, short)
    joined = hits.join(F.broadcast(known) if n <= SENT_WINDOWS and slot_bytes <= SENT_BYTES else known, "window")
    per = joined.groupBy("k1", "k2", "item_id").agg(F.max("item_tokens").alias("item_tokens"), F.collect_set(F.struct("item_at", "at", "item_slots", "slots")).alias("hits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = [best_occurrence([(h["item_at"], h["at"], h["item_slots"], h["slots"]) for h in hits], n, size, similarity) for hits, n in zip(pdf["hits"], pdf["item_tokens"].tolist(), strict=True)]
            keep = [k for k, b in enumerate(best) if b]
            out = pdf[["k1", "k2", "item_id"]].iloc[keep]
            yield out.assign(coverage=[best[k][0] for k in keep], n_slots=[best[k][1] for k in keep])

    return per.mapInPandas(run, "k1 long, k2 long, item_id long, coverage double, n_slots int")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, coverage, n_slots: one row for each document and benchmark item found in it.

    Null texts hold nothing; repeated rows give repeated rows; other columns are ignored.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(text_col))
    return keyed.join(found_items(docs, benchmark, text_col, **options), ["k1", "k2"]).select("doc_id", "item_id", "coverage", "n_slots")


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns stay, null texts stay."""
    names = [free_name(docs, "k1"), free_name(docs, "k2")]
    found = found_items(docs, benchmark, text_col, **options).select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1])).distinct()
    keyed = docs.select("*", *(k.alias(n) for k, n in zip(text_keys(text_col), names, strict=True)))
    return keyed.join(found, names, "left_anti").select(*docs.columns)
