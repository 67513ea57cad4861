import re
from collections import Counter

import pytest

from quorate.llm import langid
from quorate.llm.queries import op6_language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op6_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "12 34 !", None), (5, "", "en"), (None, "the hat", None), (6, "κόσμε 𝒳", "el")], "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    assert set(profiles) == {"en", "de", "el"}
    rows = {r.text: (r.lang_pred, r.score) for r in langid.predict(docs.withColumn("score", docs.doc_id), profiles).collect()}
    assert rows[None] == rows["12 34 !"] == rows[""] == ("und", 0.0)
    assert rows["the hat"][0] == "en" and rows["κόσμε 𝒳"][0] == "el"
    assert langid.learn(docs.limit(0)) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def profile(texts, size):
    """n-grams as strings by rank, counted word by word."""
    count = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            count.update(w)
        padded = "\1" + "".join(w + "\1" for w in re.findall(r"[^\W\d_]+", t.lower()))
        if len(padded) > 1:
            count.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    code = lambda g: sum(ord(c) << (21 * i) for i, c in enumerate(g))
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def test_predictions_against_brute_force(spark, sf):
    """Profiles, distances and scores by plain dictionaries of strings."""
    size = 40
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs] + [(-1, "Ab ab, abc 1 ab", "xx"), (-2, "\u4e00\u4e8c\u4e00 \u4e8c\u4e09", "zh"), (-3, "\U0001d4b3\U0001d4b3 a", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs = sorted({r[2] for r in rows if r[2]})
    profiles = {x: {g: k for k, g in enumerate(profile([t for _, t, y in rows if y == x and t], size))} for x in langs}
    want = {}
    for k, t, _ in rows:
        own = profile([t], size) if t else []
        away = [(sum(min(abs(p.get(g, 10**6) - i), size) for i, g in enumerate(own)), x) for x, p in ((x, profiles[x]) for x in langs)]
        want[k] = (min(away)[1], round(1 - min(away)[0] / (len(own) * size), 9)) if own else ("und", 0.0)
    got = langid.predict(df, langid.learn(df, size=size), size=size)
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in got.collect()} == want


def test_clashing_names_and_many_languages(spark, monkeypatch):
    df = spark.createDataFrame([("the cat", "en", 1, 2, 3.0)], "text string, lang string, guess int, _guess int, score double")
    got = langid.predict(df, langid.learn(df))
    assert got.columns == ["text", "lang", "guess", "_guess", "lang_pred", "score"] and got.first()[2:4] == (1, 2)
    monkeypatch.setattr(langid, "LANGUAGES", 0)
    with pytest.raises(ValueError):
        langid.learn(df)


def test_many_languages_are_sparse(spark):
    """What a task is sent grows with the n-grams of the profiles, not with languages times distinct n-grams."""
    import random

    r = random.Random(0)
    base = "abcdefghijklmnopqrstuvwxyzäöüßéèñóíšžčćłő"
    words = {f"l{k:04d}": [("".join(r.choice(base) for _ in range(r.randint(2, 7)))) for _ in range(30)] for k in range(1500)}
    profiles = {x: [int(c) for c in langid.ranked(*langid.grams(" ".join(w)), 300)] for x, w in words.items()}
    asked = r.sample(sorted(words), 40)
    df = spark.createDataFrame([(x, " ".join(r.choice(words[x]) for _ in range(25))) for x in asked], "lang string, text string")
    assert all(x.lang == x.lang_pred and 0 < x.score <= 1 for x in langid.predict(df, profiles).collect())
