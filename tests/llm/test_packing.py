import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quorate.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def truth(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids, at = truth(text), 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rs in windows.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # full, so no padding


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "Ab 'S <|endoftext|> é x\u001cy\tz" * 3, 4: "word " * 9000, 5: "a", 6: "a", 7: "İΣς ÀÉ 12.5"}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, start string")
    check(packing.pack(docs, PATH, group_tokens=3000).collect(), texts)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    twice = packing.pack(docs.selectExpr("null as doc_id", "text"), PATH).collect()
    assert sum(r.length for r in twice) == sum(len(truth(t)) for t in texts.values())


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(packing.pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_pieces_of_any_bytes():
    rng, tokenizer, encoder = random.Random(5), Tokenizer.from_file(PATH), packing.Encoder(PATH)
    assert encoder.by_piece
    texts = ["".join(rng.choice("ab stmdrevl'' '0. <|é\u0301\n\x1f-ABS") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["x" * 300 + " " + "é" * 300, "hi<|endoftext|>x <|ENDOFTEXT|> <|startoftext|>", "don't'll WE'VE 're-x ''s"]
    for some in (texts, texts[::-1]):
        for text, ids in zip(some, encoder(some, 1), strict=True):
            assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_long_texts_and_a_small_cache(monkeypatch):
    monkeypatch.setattr("quorate.llm.common.CHUNK", 64)
    monkeypatch.setattr(packing, "CACHE", 50)
    texts = [" ".join(f"w{i * k % 91} It's {i}" for i in range(200)) for k in range(3)] + [""]
    for text, ids in zip(texts, packing.Encoder(PATH)(texts, 7), strict=True):
        assert ids.tolist() == [*truth(text)[:-1], 7]


def test_steps_are_balanced():
    sizes = [2048] * 40 + [1024] * 40 + [256] * 160
    groups, load = packing.step_groups(sizes, 16384), defaultdict(int)
    for s, g in zip(sizes, groups):
        load[g] += s * (4096 + s)
    assert max(load.values()) < 1.1 * min(load.values())
