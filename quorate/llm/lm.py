"""Scoring with a log-bilinear neural language model trained by noise-contrastive estimation (Mnih and Teh 2012).

Every known word goes through the network by its class. There are about 2 * sqrt(V) classes of nearly equal frequency:
a frequent word is a class of its own, and the words of a band of counts are dealt by their hashes to the classes of
the band. Words that the training texts lack are one more class; as Good and Turing have it, it learns from the
places of words that occur once. Within a class a word has its share by count.

A prediction is a sum of the embeddings of the classes of the two words before, each scaled by its position. Classes
stand in sqrt(classes) groups: the model gives a group, and then a class in the group, each by a product with the
prediction plus a bias (Mnih and Hinton 2009). Both are normalised exactly, with batched matrix products, so the
outcomes' probabilities add up to 1. Blocks train copies of the model in numpy, in rounds; the copies are averaged in
fixed point, so that the order of summation does not matter.

Texts are turned into classes once; rounds and scores read these.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.blocks import SENT, answers, range_bits, send, stage
from quorate.llm.common import Scratch, checkpointed, word_hashes

#: Width of the embeddings; classes for each square root of the vocabulary, and at least so many.
WIDTH, PER_ROOT, LEAST = 16, 2.0, 32
#: Rounds, each on its own share of the documents, after which the copies are averaged; examples in a batch, noise groups of a batch, noise classes of an example, learning rate.
ROUNDS, BATCH, NOISE, NOISE_WITHIN, RATE = 2, 4096, 32, 2, 0.1
#: The fixed-point unit of averaged parameters, and parameters in a message.
UNIT, MESSAGE = float(1 << 20), 1 << 14
BLOCK = 12 << 20
END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds white space
CLASSED = "block long, rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, classes binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, one END after each text, and how many tokens each text has."""
    words, sizes = word_hashes(texts)
    sizes = sizes + 1
    flat = np.empty(int(sizes.sum()), dtype=np.uint64)
    ends = np.cumsum(sizes) - 1
    inside = np.ones(len(flat), dtype=bool)
    inside[ends] = False
    flat[ends], flat[inside] = END, words
    return flat, sizes


def trained_on(ids: pd.Series, modulus: int, remainder: int) -> np.ndarray:
    return np.array([zlib.crc32(("" if pd.isna(i) else str(int(i))).encode()) % modulus != remainder for i in ids], dtype=bool)


def contexts(classes: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the last and the last but one word before each token; ``start`` before a text begins."""
    one = np.concatenate([[start], classes[:-1]])
    two = np.concatenate([[start, start], classes[:-2]])[: len(classes)]
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    one[begins] = start
    two[begins] = start
    second = begins[sizes > 1] + 1
    two[second] = start
    return one, two


def band(counts: np.ndarray) -> np.ndarray:
    """The band of each count: small counts have their own, larger ones a quarter of a doubling."""
    counts = np.asarray(counts)
    return np.where(counts < 8, counts, 8 + np.floor(4 * np.log2(np.maximum(counts, 8) / 8)).astype(np.int64))


class Vocabulary:
    """Which class a word of a hash and a count belongs to. bands: (band, its tokens), of all training words."""

    def __init__(self, bands: dict[int, int], distinct: int, per_root: float):
        n = sum(bands.values())
        size = n / max(LEAST, per_root * distinct**0.5)  # tokens of a class
        self.own = int(band(np.ceil(size)).item()) + 1  # words from this band on are classes of their own
        self.offset, self.number, at = np.zeros(self.own, np.int64), np.ones(self.own, np.int64), 0
        for b in sorted(b for b in bands if b < self.own):
            self.offset[b], self.number[b] = at, max(1, round(bands[b] / size))
            at += self.number[b]
        self.dealt, self.words = at, np.zeros(0, np.uint64)

    def name(self, own_words: np.ndarray) -> None:
        self.words = np.sort(own_words)
        self.unseen = self.dealt + len(self.words)  # the class of words without a count
        self.classes, self.start = self.unseen + 1, self.unseen + 1

    @property
    def once(self) -> tuple[int, int]:
        """The classes of words that occur once."""
        return (int(self.offset[1]), int(self.offset[1] + self.number[1])) if self.own > 1 else (0, 0)

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        b = np.minimum(band(counts), self.own - 1)
        out = self.offset[b] + ((hashes >> np.uint64(7)) % self.number[b].astype(np.uint64)).astype(np.int64)
        own = band(counts) >= self.own
        out[own] = self.dealt + np.searchsorted(self.words, hashes[own])
        out[counts == 0] = self.unseen
        return out


class Model:
    """Context embeddings of the classes and the start, embeddings of classes and groups with a bias in the last column, and the scales of the two positions.

    A class belongs to the group of its number modulo the number of groups.
    """

    def __init__(self, classes: int, width: int, flat: np.ndarray):
        self.groups = max(1, round(classes**0.5))
        parts, at = [], 0
        for shape in ((classes + 1, width), (classes, width + 1), (self.groups, width + 1), (2, width)):
            n = shape[0] * shape[1]
            parts.append(flat[at : at + n].reshape(shape))
            at += n
        self.context, self.word, self.group, self.scale = self.parts = parts

    @staticmethod
    def start(share: np.ndarray, width: int, seed: int) -> np.ndarray:
        """A model that predicts the given shares whatever the context, but for a little noise."""
        rng, k = np.random.default_rng(seed), len(share)
        of = np.arange(k) % max(1, round(k**0.5))
        sums = np.bincount(of, weights=share)
        biased = lambda bias: np.column_stack([rng.normal(0, 0.1, (len(bias), width)), bias]).ravel()
        return np.concatenate([rng.normal(0, 0.1, (k + 1) * width), biased(np.log(share / sums[of])), biased(np.log(sums)), np.ones(2 * width)])

    def predict(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The prediction after each context, and a column of ones for the biases."""
        out = np.ones((len(one), self.context.shape[1] + 1), dtype=self.context.dtype)
        out[:, :-1] = self.context[one] * self.scale[0] + self.context[two] * self.scale[1]
        return out

    def log_probability(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """ln of the normalised probability of each class after its context."""

        def normed(z: np.ndarray, at: np.ndarray) -> np.ndarray:
            z = z - z.max(1)[:, None] if np.abs(z).max() > 300 else z
            return z[np.arange(len(z)), at] - np.log(np.exp(z).sum(1))

        out, where = np.empty(len(word)), word % self.groups
        members = [np.ascontiguousarray(self.word[g :: self.groups].T) for g in range(self.groups)]
        for at in range(0, len(word), 1 << 15):
            part = slice(at, at + (1 << 15))
            group = where[part]
            order = np.argsort(group.astype(np.uint16 if self.groups < 1 << 16 else np.int64), kind="stable")
            h, group, within = self.predict(one[part][order], two[part][order]), group[order], word[part][order] // self.groups
            ln = normed(h @ self.group.T, group)
            edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                ln[a:b] += normed(h[a:b] @ members[group[a]], within[a:b])
            out[part][order] = ln
        return out


def descend(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """One step of the rows of a table along summed values, where rows may repeat; steps shrink with what a row has seen."""
    order = np.argsort(rows.astype(np.uint16) if len(table) <= 1 << 16 else rows, kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    rows, g = ranked[first], np.add.reduceat(values[order], first, axis=0)
    seen[rows] += np.einsum("rd,rd->r", g, g) / g.shape[1]
    table[rows] += RATE * g / np.sqrt(seen[rows])[:, None]


def train(flat: np.ndarray, width: int, share: np.ndarray, one: np.ndarray, two: np.ndarray, word: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    """The parameters after a pass of noise-contrastive estimation over weighted examples.

    Groups are told from noise groups that a batch shares, classes from noise classes of the same group.
    """
    rng, flat, k = np.random.default_rng(seed), flat.astype(np.float32), len(share)
    m = Model(k, width, flat)
    seen = [np.full(len(p), 1e-4, dtype=np.float32) for p in m.parts]
    of = np.arange(k) % m.groups
    group_share = np.bincount(of, weights=share, minlength=m.groups)
    by_group = np.argsort(of, kind="stable")
    upto = np.cumsum(share[by_group])  # the classes of a group are a range of it
    last = np.cumsum(np.bincount(of, minlength=m.groups)) - 1
    first = np.append(0, last[:-1] + 1)
    high, low = upto[last], np.append(0, upto[last][:-1])
    log_group = (np.log(group_share) + np.log(NOISE)).astype(np.float32)
    log_class = (np.log(share / group_share[of]) + np.log(NOISE_WITHIN)).astype(np.float32)
    order = rng.permutation(len(word))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for at in range(0, len(order), BATCH):
        b = order[at : at + BATCH]
        a1, a2, w, weights = one[b], two[b], word[b], (weight[b] / weight[b].sum()).astype(np.float32)
        s, h = w % m.groups, m.predict(a1, a2)
        noise = rng.choice(m.groups, NOISE, p=group_share / group_share.sum())
        own_group, own_word, noise_group = m.group[s], m.word[w], m.group[noise]
        true = weights * sigmoid(log_group[s] - np.einsum("bd,bd->b", h, own_group))  # 1 - P(data)
        false = -weights[:, None] * sigmoid(h @ noise_group.T - log_group[noise])  # -P(data)
        own = weights * sigmoid(log_class[w] - np.einsum("bd,bd->b", h, own_word))
        dh = true[:, None] * own_group + false @ noise_group + own[:, None] * own_word
        places, pushes = [w], [own[:, None] * h]
        for _ in range(NOISE_WITHIN):
            other = by_group[np.clip(np.searchsorted(upto, low[s] + rng.random(len(b)) * (high - low)[s], side="right"), first[s], last[s])]
            rows = m.word[other]
            push = -weights * sigmoid(np.einsum("bd,bd->b", h, rows) - log_class[other])
            dh += push[:, None] * rows
            places.append(other)
            pushes.append(push[:, None] * h)
        dh = dh[:, :-1]
        steps = (
            (0, np.concatenate([a1, a2]), np.concatenate([dh * m.scale[0], dh * m.scale[1]])),
            (1, np.concatenate(places), np.concatenate(pushes)),
            (2, np.concatenate([s, noise]), np.concatenate([true[:, None] * h, false.T @ h])),
            (3, np.array([0, 1]), np.stack([(dh * m.context[a1]).sum(0), (dh * m.context[a2]).sum(0)])),
        )
        for part, rows, values in steps:
            descend(m.parts[part], seen[part], rows, values)
    return flat


def add_up(sent: DataFrame, copies: int) -> DataFrame:
    """sent(at, block, x) -> (at, x, n): the sums of the arrays of each message, in two steps of about sqrt(copies) each."""

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.frombuffer(x, dtype=np.int64) for x in pdf["x"]]
        return pd.DataFrame({"at": [key[0]], "x": [np.sum(arrays, axis=0).tobytes()], "n": [int(pdf["n"].sum())]})

    salt = F.pmod(F.xxhash64("block"), F.lit(max(1, round(copies**0.5)))).alias("salt")
    first = sent.groupBy("at", salt).applyInPandas(total, "at int, x binary, n long")
    return first.groupBy("at").applyInPandas(total, "at int, x binary, n long")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, per_root: float = PER_ROOT, width: int = WIDTH, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; log10 probabilities.

    Learns from the documents whose crc32 of the id as text (a null id: of nothing) modulo ``modulus`` is not
    ``remainder``: word counts over all of them, and the network on all their trigrams, each once. A null text is empty: its one
    token is the end. Without training documents every score is 0. Repeated rows are documents of their own; other
    columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    with Scratch(spark, "lm") as scratch:
        staged, total = stage(docs, scratch, id_col, text_col, BLOCK)
        bits = range_bits(total / 12)

        def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            flat, sizes = tokens(list(pdf["text"]))
            distinct, where = np.unique(flat, return_inverse=True)
            learned = np.repeat(trained_on(pdf["doc_id"], modulus, remainder), sizes)
            return send(int(key[0]), distinct, np.bincount(where[learned], minlength=len(distinct)).astype(np.int64), bits)

        sent = scratch.table(staged.groupBy("block").applyInPandas(count, SENT))
        scratch.release()

        def totals(hashes: list[np.ndarray], extras: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            distinct, where = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.concatenate([np.frombuffer(e, dtype=np.int64) for e in extras])
            out = np.zeros(len(distinct), dtype=np.int64)
            np.add.at(out, where, n)
            return distinct, out

        def of_part(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            distinct, n = totals([np.frombuffer(b, dtype=np.uint64) for b in pdf["hashes"]], list(pdf["extra"]))
            return distinct[n > 0], n[n > 0]

        def by_band(pdf: pd.DataFrame) -> pd.DataFrame:
            b, n = (lambda n: (band(n), n))(of_part(pdf)[1])
            kinds, where = np.unique(b, return_inverse=True)
            return pd.DataFrame({"band": kinds, "n": np.bincount(where, weights=n, minlength=len(kinds)).astype(np.int64), "v": np.bincount(where, minlength=len(kinds))})

        bands = sent.groupBy("part").applyInPandas(by_band, "band long, n long, v long").groupBy("band").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
        n_all, v_all = sum(r.n for r in bands), sum(r.v for r in bands)
        vocabulary = Vocabulary({r.band: r.n for r in bands}, v_all, per_root)

        def by_class(pdf: pd.DataFrame) -> pd.DataFrame:
            """Words with classes of their own, and the tokens of the other classes."""
            distinct, n = of_part(pdf)
            own = band(n) >= vocabulary.own
            kinds, where = np.unique(vocabulary.of(distinct[~own], n[~own]), return_inverse=True)
            out = pd.DataFrame({"word": pd.array([*distinct[own].view(np.int64).tolist(), *[None] * len(kinds)], dtype="Int64")})
            out["class"] = pd.array([*[None] * int(own.sum()), *kinds.tolist()], dtype="Int64")
            out["n"] = np.concatenate([n[own], np.bincount(where, weights=n[~own], minlength=len(kinds)).astype(np.int64)])
            return out

        vocabulary.name(np.zeros(0, np.uint64))
        found = sent.groupBy("part").applyInPandas(by_class, "word long, class long, n long").groupBy("word", "class").agg(F.sum("n").alias("n")).collect()  # a row a class
        own = {r.word: r.n for r in found if r.word is not None}
        vocabulary.name(np.array(list(own), dtype=np.int64).view(np.uint64))
        class_n = np.zeros(vocabulary.classes, dtype=np.int64)
        for r in found:
            if r.word is None:
                class_n[r["class"]] = r.n
        class_n[vocabulary.dealt : vocabulary.unseen] = [own[int(h)] for h in vocabulary.words.view(np.int64)]
        single, twice = (sum(r.v for r in bands if r.band == b) for b in (1, 2))
        # what is left to words that occur once, when their places teach the class of unseen words
        kept = float(np.clip(2 * twice / single, 0.1, 1)) if single else 1.0
        share = np.maximum(class_n, 0.5).astype(np.float64)
        share[slice(*vocabulary.once)] *= kept
        share[vocabulary.unseen] = max(single, 0.5)
        share /= share.sum()

        def reply(hashes: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
            distinct, n = totals(hashes, extras)
            return [n[np.searchsorted(distinct, h)] for h in hashes]

        def classify(key: tuple, texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            if not len(texts):
                return pd.DataFrame(columns=[c.split()[0] for c in CLASSED.split(", ")])
            flat, sizes = tokens(list(texts["text"]))
            distinct, where = np.unique(flat, return_inverse=True)
            counts = np.concatenate([np.frombuffer(a, dtype=np.int64) for a in told.sort_values("part")["answer"]])
            kind = vocabulary.of(distinct, counts)
            inside = np.where(counts > 0, np.log(np.maximum(counts, 1) / np.maximum(class_n[kind], 1)), 0.0)
            begins = np.cumsum(sizes) - sizes
            out = pd.DataFrame({"block": texts["block"], "rid": texts["rid"], "doc_id": texts["doc_id"].astype("Int64").values, "held_out": ~trained_on(texts["doc_id"], modulus, remainder), "n_tokens": sizes})
            out["n_known"] = np.add.reduceat((counts > 0).astype(np.int64)[where], begins)
            out["base_score"] = np.add.reduceat(np.log10((counts + 1) / (n_all + v_all + 1))[where], begins)
            out["inside"] = np.add.reduceat(inside[where], begins)
            classes = kind.astype("<u4")[where]
            out["classes"] = [classes[a : a + n].tobytes() for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
            return out

        told = answers(sent, reply)
        blocks = max(1, -(-total // BLOCK))
        classed = scratch.bucketed(staged.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(classify, CLASSED), "block", min(blocks, 50_000))
        scratch.release()

        def read(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(b"".join(pdf["classes"]), dtype="<u4").astype(np.int64), pdf["n_tokens"].to_numpy(dtype=np.int64)

        flat = Model.start(share, width, seed)

        def training(flat: np.ndarray, turn: int):
            def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("rid")
                word, sizes = read(pdf)
                if not len(word):
                    return pd.DataFrame({"at": [], "block": [], "x": [], "n": []})
                single = (word >= vocabulary.once[0]) & (word < vocabulary.once[1])
                # half of the words that occur once stand in contexts as unseen ones do
                one, two = contexts(np.where(single & (np.arange(len(word)) % 2 == 1), vocabulary.unseen, word), sizes, vocabulary.start)
                rare = np.flatnonzero(single)
                weight = np.concatenate([np.where(single, kept, 1.0), np.ones(len(rare))])
                one, two, word = np.concatenate([one, one[rare]]), np.concatenate([two, two[rare]]), np.concatenate([word, np.full(len(rare), vocabulary.unseen)])
                after = train(flat, width, share, one, two, word, weight, int(key[0]) * 31 + turn)
                whole = np.rint(np.clip(after.astype(np.float64), -1000, 1000) * UNIT).astype(np.int64)
                pieces = [whole[a : a + MESSAGE].tobytes() for a in range(0, len(whole), MESSAGE)]
                return pd.DataFrame({"at": np.arange(len(pieces)), "block": int(key[0]), "x": pieces, "n": 1})

            return fit

        for turn in range(ROUNDS):
            learned = classed.where(~F.col("held_out") & (F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(ROUNDS)) == turn))
            sums = {r["at"]: r for r in add_up(learned.groupBy("block").applyInPandas(training(flat, turn), "at int, block long, x binary, n long"), blocks).collect()}  # one row a message
            if sums:
                flat = np.concatenate([np.frombuffer(sums[k].x, dtype=np.int64) / (sums[k].n * UNIT) for k in sorted(sums)])
            scratch.release()
        model_flat = flat

        def measure(batches):
            model = Model(vocabulary.classes, width, model_flat)
            for pdf in batches:
                if not len(pdf):
                    continue
                word, sizes = read(pdf)
                one, two = contexts(word, sizes, vocabulary.start)
                ln = np.add.reduceat(model.log_probability(one, two, word), np.cumsum(sizes) - sizes) + pdf["inside"].to_numpy()
                out = pdf[["doc_id", "held_out", "n_tokens", "n_known"]].copy()
                out["doc_id"] = out["doc_id"].astype("Int64")
                out["train_tokens"] = n_all
                out["base_score"] = pdf["base_score"]
                out["score"] = np.round(ln / np.log(10), 6) if n_all else 0.0
                yield out

        return checkpointed(classed.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "inside", "classes").mapInPandas(measure, OUT))
