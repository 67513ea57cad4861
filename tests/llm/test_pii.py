import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from quorate.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    got = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    got += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    got += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    got += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(got, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123459+-. ()@aZé_%\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.spans(text) if s[2] in pii.KINDS[:4]] == brute(text)


def test_base_spans_of_dense_text():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["4785380592391139", "1.2.3.4", "255", ".", "@", "a.b", "+1 (017) 555-7713", " ", "-", "x", "mail7.example.com"]) for _ in range(40))
        assert [s for s in pii.spans(text) if s[2] in pii.KINDS[:4]] == brute(text)


def test_added_kinds():
    text = 'Token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and https://joe:pw@host.example/x, iban GB82 WEST 1234 5698 7654 32 x'
    kinds = {k: text[a:b] for a, b, k in pii.spans(text)}
    assert kinds["account"] in ("GB82 WEST 1234 5698 7654 32",)
    assert kinds["url"] == "https://joe:pw@host.example/x"
    assert sum(k == "account" for _, _, k in pii.spans(text)) == 2
    assert pii.spans("See https://example.com/a and the account of the token holders in 2024.") == []
    assert pii.redact_text("Mail a.b@c.de now") == "Mail <EMAIL> now"


def test_cues_in_any_case():
    for cue in ("PassWord", "API_Key", "apiKey", "tOkEn"):
        assert [k for _, _, k in pii.spans(f"\u0130 {cue}: a1b2c3d4e5f6g7h8")] == ["account"]


def test_long_stretches_take_linear_time():
    for unit in ("token=", "a://", "x@", "+1", "1.", "password= ", "http://a?", "iban ab12 "):
        times = []
        for n in (20_000, 80_000):
            start = time.process_time()
            pii.spans(unit * n)
            times.append(time.process_time() - start)
        assert times[1] < 10 * times[0] + 0.2, (unit, times)


def test_values_in_long_stretches():
    assert [(a, b) for a, b, k in pii.spans("token=" * 3 + "12345678901") if k == "account"] == [(6, 29)]
    assert pii.spans("token=" * 50 + "1") == [] and len(pii.spans("a://" * 5 + "1.2.3.4/x")) > 1


def test_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, "q"), (1, "", "q"), (None, "x 1.2.3.4", "q"), (2, "é a@b.c", "q")], "doc_id long, text string, spans string")
    rows = {(r.doc_id, r.spans) for r in pii.find(docs).collect()}
    assert rows == {(1, ""), (None, "ip:2:9"), (2, "email:2:7")}
    assert pii.find(docs).count() == 4 and pii.find(docs.limit(0)).count() == 0
    real = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: len(brute(r.text)) for r in real.collect()}
    assert {r.doc_id: r.n_email + r.n_ip + r.n_card + r.n_phone for r in pii.find(real).collect()} == want
    assert [r.text for r in pii.redact(docs).orderBy("text").collect()] == [None, "", "x <IP>", "é <EMAIL>"]
