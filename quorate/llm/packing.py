"""Hierarchical multi-length packing of tokenised documents.

Documents go to the shortest context tier that holds them (longer ones give whole windows of the longest tier first,
and their rest is routed). Windows are packed from the longest tier down; the gap of a window is filled with whole
pieces of shorter tiers, and at last by cutting one piece. So every window is exactly as long as its tier, a power
of two, and needs no padding; what is left at the end of a packing group is cut into powers of two.
Packing groups are bounded in tokens and lie within one input partition, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quorate.llm.common import BLANKS, LONG, LOWER, chunks, run_hashes, worker_state

#: Pieces of words whose ids a Python worker remembers (some 40 bytes each) before it starts anew; longer ones than
#: LONG bytes are encoded each time.
CACHE = 1 << 20

#: The rule by which the public vocabulary cuts words into pieces, and the short endings that follow an apostrophe in it. Fixed values.
CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ONE_LETTER, TWO_LETTERS = b"stmd", (b"re", b"ve", b"ll")

SPACE, LETTER, DIGIT, SIGN, WHOLE = range(5)
KIND = np.full(256, SIGN, dtype=np.uint8)
KIND[BLANKS], KIND[list(b"0123456789")] = SPACE, DIGIT
KIND[[c for c in range(128) if chr(c).isalpha()]] = LETTER

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Encoder:
    """Token ids of texts, each text followed by end_id.

    Where the vocabulary drops white space, lowers case, cuts by CUT and marks the ends of pieces, texts are cut here, in arrays of
    bytes, and each distinct piece is encoded once and remembered by its 64-bit hash. Pieces of ASCII words are encoded
    together and told apart by the marks. Words with other characters, or that may hold a special token, are pieces as a
    whole and encoded one by one. Only the six ASCII white-space characters separate words here. Any other vocabulary
    encodes whole texts.
    """

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            rules = json.load(f)
        cuts = [x.get("pattern", {}).get("Regex") for x in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        kinds = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        suffix = rules["model"].get("end_of_word_suffix")
        plain = all("<|" in t["content"] and not re.search(r"\s", t["content"]) for t in rules.get("added_tokens", []))
        self.by_piece = cuts[:1] == [CUT] and kinds == ["NFC", "Replace", "Lowercase"] and bool(suffix) and plain and not rules.get("post_processor")
        if self.by_piece:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def one_by_one(self, words: list[bytes]) -> list[np.ndarray]:
        some = (words[at : at + 4096] for at in range(0, len(words), 4096))
        return [np.array(e.ids, dtype="<u4") for ws in some for e in self.tokenizer.encode_batch_fast([w.decode() for w in ws], add_special_tokens=False)]

    def together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of ASCII words, in one array, and how many each has."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some) or stops[-1] != len(ids):
                each = self.one_by_one(some)
                ids, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
            flat.append(ids)
            sizes.append(np.diff(stops, prepend=0))
        return np.concatenate(flat), np.concatenate(sizes)

    @staticmethod
    def pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces begin and end, which are whole words, and the bytes with ASCII words in lower case."""
        kind = KIND[raw]
        blank = kind == SPACE
        odd = raw >= 128
        odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)  # "<|" begins a special token
        low = LOWER[raw]
        if odd.any():
            edges = np.diff(blank.astype(np.int8), prepend=1, append=1)
            first, last = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
            word = np.unique(np.searchsorted(first, np.flatnonzero(odd), side="right") - 1)
            inside = np.zeros(len(raw) + 1, dtype=np.int8)
            inside[first[word]] += 1
            inside[last[word]] -= 1
            whole = np.cumsum(inside[:-1], dtype=np.int8) > 0
            kind[whole], low[whole] = WHOLE, raw[whole]
        begins = (np.diff(kind, prepend=SPACE) != 0) | (kind == DIGIT)
        # an apostrophe that begins a run of signs takes some short endings
        marks = np.flatnonzero((low == 39) & begins & (kind == SIGN))
        marks = marks[marks + 2 < len(raw)]
        one = marks[np.isin(low[marks + 1], list(ONE_LETTER)) & (kind[marks + 1] == LETTER)]
        two = marks[np.logical_or.reduce([(low[marks + 1] == a) & (low[marks + 2] == b) for a, b in TWO_LETTERS]) & (kind[marks + 1] == LETTER) & (kind[marks + 2] == LETTER)]
        for found, size in ((one, 2), (two, 3)):
            begins[found + 1] = False
            begins[found + size] = True
        edges = np.append(np.flatnonzero(begins), len(raw))
        solid = np.flatnonzero(~blank[edges[:-1]])
        return edges[solid], edges[solid + 1], kind[edges[solid]] == WHOLE, low

    def learn(self, hashes: np.ndarray, words: list[bytes], whole: np.ndarray) -> None:
        """Remember new pieces."""
        apart = self.one_by_one([words[k] for k in np.flatnonzero(whole)])
        ids, sizes = self.together([words[k] for k in np.flatnonzero(~whole)])
        size = np.empty(len(words), np.int64)
        size[~whole], size[whole] = sizes, [len(x) for x in apart]
        begin = np.empty(len(words), np.int64)
        at = len(self.flat)
        begin[~whole] = at + np.cumsum(sizes) - sizes
        begin[whole] = at + len(ids) + np.cumsum(size[whole]) - size[whole]
        self.flat = np.concatenate([self.flat, ids, *apart])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.begin, self.size = known[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]

    def encode_chunk(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces begin in raw, how many ids each has, and all ids."""
        first, last, whole, low = self.pieces(raw)
        if not len(first):
            return first, first, np.zeros(0, "<u4")
        long = last - first > LONG
        distinct, at, where = np.unique(run_hashes(low, first, last), return_index=True, return_inverse=True)
        bytes_of = lambda k: low[first[k] : last[k]].tobytes()
        usual = np.ones(len(distinct), dtype=bool)
        usual[where[long]] = False
        where_long = np.flatnonzero(long | ~usual[where])
        fits = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = np.flatnonzero(usual & ((self.known[fits] != distinct) if len(self.known) else True))
        if len(new):
            if len(self.known) + len(new) > CACHE and len(self.known):
                self.forget()
                new = np.flatnonzero(usual)
            self.learn(distinct[new], [bytes_of(k) for k in at[new].tolist()], whole[at[new]])
            fits = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
        if not len(self.known):
            begin, size, flat = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), self.flat
        else:
            begin, size, flat = self.begin[fits][where], self.size[fits][where], self.flat
        if len(where_long):
            each = self.one_by_one([bytes_of(k) for k in where_long.tolist()])
            size[where_long] = [len(x) for x in each]
            begin[where_long] = len(flat) + np.cumsum(size[where_long]) - size[where_long]
            flat = np.concatenate([flat, *each])
        upto = np.cumsum(size) - size
        return first, size, flat[np.repeat(begin - upto, size) + np.arange(int(size.sum()))]

    def __call__(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        end = np.array([end_id], dtype="<u4")
        if not self.by_piece:
            return [np.append(np.array(e.ids, dtype="<u4"), end) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        encoded = [t.encode() for t in texts]
        begins, sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for at, raw in chunks(b"\n".join([*encoded, b""])):
            first, size, found = self.encode_chunk(raw)
            begins.append(first + at)
            sizes.append(size)
            ids.append(found)
        ids = np.concatenate(ids)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes))])
        starts = np.cumsum([0, *(len(t) + 1 for t in encoded)])
        edges = upto[np.searchsorted(np.concatenate(begins), starts)]
        return [np.append(ids[a:b], end) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def pack_group(lengths: list[int], tiers: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of one group: (window length, [(document, start, length)]). Each token of each document is in one piece."""
    top, windows = tiers[-1], []
    shelf: dict[int, list[tuple[int, int]]] = {}  # by length: the pieces still to be placed
    mask = 0  # its bits: the lengths on the shelf

    def put(length: int, piece: tuple[int, int]) -> None:
        nonlocal mask
        shelf.setdefault(length, []).append(piece)
        mask |= 1 << length

    def take(length: int) -> tuple[int, int]:
        nonlocal mask
        piece = shelf[length].pop()
        if not shelf[length]:
            mask &= ~(1 << length)
        return piece

    for doc, n in enumerate(lengths):
        whole = n // top
        windows += [(top, [(doc, k * top, top)]) for k in range(whole)]
        if n % top:
            put(n % top, (doc, whole * top))
    while mask:
        longest = mask.bit_length() - 1
        tier = next(t for t in tiers if t >= longest)
        pieces = [(*take(longest), longest)]
        gap = tier - longest
        while gap and mask:
            if fits := mask & ((1 << (gap + 1)) - 1):
                length = fits.bit_length() - 1
                pieces.append((*take(length), length))
            else:  # cut the shortest piece that is left
                shortest = (mask & -mask).bit_length() - 1
                doc, start = take(shortest)
                pieces.append((doc, start, gap))
                put(shortest - gap, (doc, start + gap))
                length = gap
            gap -= length
        if not gap:
            windows.append((tier, pieces))
            continue
        left = tier - gap  # the end of the group: powers of two
        while left:
            size = 1 << (left.bit_length() - 1)
            window, room = [], size
            while room:
                doc, start, length = pieces.pop(0)
                window.append((doc, start, min(length, room)))
                if length > room:
                    pieces.insert(0, (doc, start + room, length - room))
                room -= min(length, room)
            windows.append((size, window))
            left -= size
    return windows


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """The step group of each window, so that the groups get nearly equal tokens and attention work: longest first, each to the lightest group."""
    n = max(1, round(sum(sizes) / step_tokens))
    heap, out = [(0, g) for g in range(n)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i] * (4096 + sizes[i]), g))
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: tuple[int, ...] = (256, 512, 1024, 2048), group_tokens: int = 1 << 22, step_tokens: int = 1 << 18) -> DataFrame:
    """Pack all documents into windows whose lengths are the tiers (powers of two), without padding.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the window's tier and
    step_group. A null text is empty: its document is the end id alone. Null and repeated ids are documents of their
    own; other columns are ignored; no rows give no rows. A group holds group_tokens tokens or one document more.
    """
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers must be powers of two")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, sequence, step = TaskContext.get().partitionId() << 36, 0, 0
        ids, texts, tokens = [], [], 0
        encoder = worker_state(("packing", tokenizer_path), lambda: Encoder(tokenizer_path))

        def flush() -> pd.DataFrame:
            nonlocal sequence, step, ids, texts, tokens
            lengths = [len(t) for t in texts]
            windows = pack_group(lengths, tiers)
            groups, rows = step_groups([w for w, _ in windows], step_tokens), []
            for (size, pieces), g in zip(windows, groups, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    rows.append((ids[doc], start, length, zlib.crc32(texts[doc][start : start + length]), lengths[doc], part + sequence, offset, size, part + step + g))
                    offset += length
                sequence += 1
            step += max(groups, default=0) + 1
            ids, texts, tokens = [], [], 0
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
            return out

        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at : at + 256]
                for i, t in zip(some["doc_id"], encoder(["" if t is None else t for t in some["text"]], end_id), strict=True):
                    ids.append(None if pd.isna(i) else int(i))
                    texts.append(t)
                    tokens += len(t)
                    if tokens >= group_tokens:
                        yield flush()
        if ids:
            yield flush()

    return docs.selectExpr(f"bigint(`{id_col}`) as doc_id", f"`{text_col}` as text").mapInPandas(run, SCHEMA)
