"""Personal data by anchor expansion: an Aho-Corasick automaton finds anchors, local parsers expand and validate them.

Anchors are the at-sign, the plus sign, digits, URL schemes and identifier cues ("token", "iban", ...). Around each
one a parser takes the longest stretch that its kind allows, looking only at characters near by, and checks it.
Kinds: email, ip, card, phone (exact, leftmost, non-overlapping per kind); url (an address with user information or
a numeric host) and account (the value after a cue: IBAN with its checksum, social security number, token).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account")
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | DIGITS
LOCAL, LABEL = ALNUM | frozenset("._%+-"), ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
HOST_END = re.compile(r"[/?]")
#: Cues for identifiers, matched in any case of ASCII letters.
CUES = ("iban", "ssn", "token", "secret", "password", "passwd", "api_key", "apikey", "account", "acct")

_AUTOMATON = None


def automaton():
    """The automaton of all anchors; one for each Python worker."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for anchor, what in [("@", "@"), ("+", "+"), ("://", "://"), *((d, "0") for d in DIGITS)]:
            a.add_word(anchor, (what, len(anchor)))
        for cue in CUES:
            a.add_word(cue, ("cue", len(cue)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def run_of(text: str, at: int, allowed: frozenset) -> int:
    """Where the stretch of allowed characters that begins at ``at`` ends."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at`` that begins at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_of(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    host = end
    while end < len(text) and text[end] == "." and (after := run_of(text, end + 1, LABEL)) > end + 1:
        end = after
    return (start, end) if end > host else None


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    """The number that begins with the plus sign at ``at``, whatever its count of digits."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run_of(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end >= at + 4 else None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def chains(runs: list[tuple[int, int]], text: str, seps: str) -> Iterator[list[tuple[int, int]]]:
    """Digit runs in a row that single separators join."""
    chain: list[tuple[int, int]] = []
    for run in runs:
        if chain and run[0] == chain[-1][1] + 1 and text[run[0] - 1] in seps:
            chain.append(run)
        else:
            if chain:
                yield chain
            chain = [run]
    if chain:
        yield chain


def iban(value: str) -> bool:
    """Country letters, check digits and 11 to 30 more, with remainder 1 by 97."""
    if not (15 <= len(value) <= 34 and value[:2].isalpha() and value[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


class Stretch:
    """The last stretch of some characters that was looked at, so that anchors inside it do not go through it again."""

    def __init__(self, pattern: str, trimmed: str):
        self.pattern, self.trimmed, self.begin, self.end = re.compile(pattern), trimmed, 0, 0

    def at(self, text: str, start: int) -> tuple[int, int, list[int]]:
        """Where the stretch that goes on at ``start`` ends, and ends without trailing characters; the places of its digits."""
        if not self.begin <= start < self.end:
            self.begin, self.end = start, self.pattern.match(text, start).end()
            self.solid = self.end
            while self.solid > start and text[self.solid - 1] in self.trimmed:
                self.solid -= 1
            self.digits = [k for k in range(start, self.solid) if text[k] in DIGITS]
        return self.end, max(start, self.solid), self.digits


def lowered(text: str) -> str:
    """The text in lower case, character by character in place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def account_after(text: str, at: int, values: Stretch) -> tuple[int, int] | None:
    """The identifier after a cue that ends at ``at``: up to a few separators, then a value with digits."""
    n, start = len(text), at
    while start < n and start - at < 6 and text[start] in " \t:=\"'#":
        start += 1
    if start == at:
        return None
    _, end, places = values.at(text, start)
    digits, size = len(places) - bisect_left(places, start), end - start
    if digits == 9 and size in (9, 11):
        return start, end
    if size > 34:
        return (start, end) if digits >= 4 else None
    value = text[start:end]
    grouped, cut = [value], end  # an IBAN is often written in groups of four
    while cut < n and text[cut] == " " and 0 < (e := run_of(text, cut + 1, ALNUM)) - cut - 1 <= 4 and len("".join(grouped)) < 34:
        grouped.append(text[cut + 1 : e])
        cut = e
        if iban("".join(grouped)):
            return start, cut
    if iban(value) or (len(value) >= 16 and digits >= 4) or (8 <= len(value) and digits >= 6):
        return start, end
    return None


def url_at(text: str, at: int, addresses: Stretch) -> tuple[int, int] | None:
    """The URL around '://' at ``at`` if it names a person or a machine: user information or a numeric host."""
    start = at
    while start > 0 and text[start - 1] in ALNUM and at - start < 12:
        start -= 1
    _, end, _ = addresses.at(text, at + 3)
    stop = HOST_END.search(text, at + 3, end)
    host = text[at + 3 : stop.start() if stop else end]
    named = "@" in host and not host.startswith("@")
    numeric = host.rpartition("@")[2].partition(":")[0].replace(".", "").isdigit()
    return (start, end) if start < at and host and (named or numeric) else None


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all finds, by start and then kind; code points, end exclusive."""
    found: list[tuple[int, int, str]] = []
    runs: list[tuple[int, int]] = []
    email_end = phone_end = digit_end = account_end = 0
    values, addresses = Stretch(r"[A-Za-z0-9_\-+/=.]*", ".-=/+_"), Stretch(r"[^\s<>\"'`|]*", ".,;:!?)]}*#")
    for last, (what, size) in automaton().iter(lowered(text)):
        at = last - size + 1
        if what == "0":
            if at >= digit_end:
                digit_end = run_of(text, at, DIGITS)
                runs.append((at, digit_end))
        elif what == "@":
            if at >= email_end and (m := email_at(text, at, email_end)):
                found.append((*m, "email"))
                email_end = m[1]
        elif what == "+":
            if at >= phone_end and (m := phone_at(text, at)):
                phone_end = m[1]
                if 9 <= sum(c in DIGITS for c in text[m[0] : m[1]]) <= 15:
                    found.append((*m, "phone"))
        elif what == "cue":
            if at >= account_end and not (at and text[at - 1] in ALNUM) and (m := account_after(text, last + 1, values)):
                found.append((*m, "account"))
                account_end = m[1]
        elif m := url_at(text, at, addresses):
            found.append((*m, "url"))
    for chain in chains(runs, text, "."):
        for k in range(0, len(chain) - 3, 4):
            if all(len(part := text[a:b].lstrip("0")) <= 3 and int(part or "0") <= 255 for a, b in chain[k : k + 4]):
                found.append((chain[k][0], chain[k + 3][1], "ip"))
    for chain in chains(runs, text, " -"):
        digits = "".join(text[a:b] for a, b in chain)
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((chain[0][0], chain[-1][1], "card"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 of the base spans and all spans as kind:start:end.

    A null text is empty and has no spans; null and repeated ids keep their rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                got = spans(text) if text else []
                base = [s for s in got if s[2] in KINDS[:4]]
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS[:4]), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in got)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").values)
            yield out

    return docs.selectExpr(f"bigint(`{id_col}`) as doc_id", f"`{text_col}` as text").mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str) -> str:
    """The text with each find replaced by its kind in angle brackets; of finds that overlap, the union under the first kind."""
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind in spans(text):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the finds in its text replaced; a null text stays null, all columns stay."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact_text(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, clean(text_col))
