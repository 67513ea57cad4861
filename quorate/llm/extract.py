"""Main text of HTML pages by template deduction, in the manner of equivalence classes (after Arasu and Garcia-Molina 2003).

The tokens of a page are its element paths (tag, class and id of each open element) and its text strings. The
occurrence vector of a token says how often each distinct content of a host has it; a hash of it adds up modulo a power
of two, so Spark sums it per (host, token) and no host is gathered in one task. Copies of a page are one content, and
pages without content do not count.

Tokens of a host with equal vectors form a class. A class is valid if nearly all contents have it and it has two tokens
or more; a page that deviates splits a class in two, and both stay valid. The valid classes nest by the paths of
their elements. This template is walked from the root: from each element that all contents have once to the one below it
that holds at least half of the host's free text, down to the last one. That is the slot of the main text; an article
or main element on the way ends the walk. Free text is what strings of valid classes are not, as all contents have those.
Containers without a class are told apart by their places among equal siblings. Strings of valid classes that enough
contents have are constants of the template. The slot of each
page is then read out, without constants and without the elements that hold no article text by their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.llm.common import checkpointed, mix64

#: Share of a host's distinct contents that must have a class, and its fewest tokens and contents.
COMMON_SHARE, CLASS_TOKENS, CLASS_CONTENTS = 0.9, 2, 2
#: A string of w words in k contents is a constant only if (k - 2) * w is at least this: the longer, the fewer tell.
EVIDENCE = 6
#: Up to so many contents that occur more than once are sent to all tasks (16 bytes each); beyond it pages are joined
#: with their numbers of copies. Both ways give the same rows.
SENT_COPIES = 1 << 20

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|select|textarea|object|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|[^<]+|<",
    re.S | re.I,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements, and words in classes, ids and roles, that mark what is not article text.
APART = frozenset("head nav footer aside form button menu dialog title".split())
APART_WORD = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscri\w*|signup|login|menu|nav\w*|breadcrumbs?|sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|replies|disqus|respond|footer|masthead|toolbar|pagination|pager|search\w*|hidden)(?:$|[-_\s])", re.I
)
#: Elements of running text: never the slot by themselves.
TEXT_LEVEL = "p|h1|h2|h3|h4|h5|h6|li|ul|ol|dl|dt|dd|td|th|tr|tbody|thead|blockquote|pre|figure|figcaption|address|option"
#: Bytes of templates that are sent to all tasks; beyond it pages and templates are joined by host and one of SALTS parts.
SENT_BYTES, SALTS = 64 << 20, 32
#: Elements whose opening ends an open element of the same group.
CLOSES = {t: frozenset({"p"}) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul figure".split()}
CLOSES |= {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
#: Elements that are told apart by their place where they have no class.
CONTAINERS = frozenset("div section table tr td center fieldset span".split())
#: An end tag inside one of these does not reach out of it.
SCOPE = frozenset("table td th article main section aside nav footer div body html".split())


def blocks(page: str) -> Iterator[tuple[str, bool, str, int, bool]]:
    """What a page holds, in order: (path, is_block, text, link characters, apart): its element openings and text blocks."""
    stack: list[tuple[str, str, bool, dict[str, int]]] = []  # tag, path, inside something apart, how many of each name below
    top: dict[str, int] = {}
    words: list[str] = []
    linked, in_link = 0, False

    def flush() -> tuple[str, bool, str, int, bool] | None:
        nonlocal words, linked
        text, links = " ".join(entities.unescape("".join(words)).split()), linked
        words, linked = [], 0
        return (stack[-1][1] if stack else "", True, text, links, bool(stack) and stack[-1][2]) if text else None

    for m in TOKEN.finditer(page):
        slash, tag = m[2], m[3]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                words.append(s)
                linked += len(s) if in_link else 0
            elif m[1]:
                words.append(" ")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                words.append(" ")
            elif tag == "a":
                in_link = not slash
            continue
        if block := flush():
            yield block
        if slash:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != tag and not (stack[k][0] in SCOPE and tag not in SCOPE):
                k -= 1
            if k >= 0 and stack[k][0] == tag:
                del stack[k:]
            continue
        if closing := CLOSES.get(tag):
            while stack and stack[-1][0] in closing:
                stack.pop()
        if tag in VOID:
            continue
        marks = {k.lower(): " ".join((a or b or c).split()) for k, a, b, c in NAMED.findall(m[4])} if m[4] else {}
        above = stack[-1] if stack else ("", "", False, top)
        role = marks.get("role", "")
        main = tag in ("article", "main") or role == "main"
        apart = above[2] or tag in APART or role in ("navigation", "banner", "contentinfo", "complementary", "search", "form")
        apart = apart or (not main and any(APART_WORD.search(v) for v in marks.values()))
        apart = apart or (tag == "header" and not any(x[0] in ("article", "main") for x in stack))
        name = tag + (f".{marks['class'].replace(' ', '.')}" if marks.get("class") else "") + ("@main" if role == "main" else "")
        if name in CONTAINERS:
            above[3][name] = place = above[3].get(name, 0) + 1
            name += f"[{place}]" if place > 1 else ""
        stack.append((tag, f"{above[1]}/{name}", apart, {}))
        yield stack[-1][1], False, "", 0, apart
    if block := flush():
        yield block


def string_token(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode()) - (1 << 63)


def tokens(pages: DataFrame, sent: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(host, path, text, words, n, chars, links, weight, v1, v2): how often each page has each token; text is 0 for element paths.

    chars and links are the characters of text and of link text below an element, or of a string; v1 and v2 are 31-bit hashes of
    (content, n). The weights of a content's copies sum up to 1; ``sent`` has the contents that occur more than once,
    sorted, and how often.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            if sent is None:
                copies = pdf["copies"].to_numpy()
            else:
                at = np.searchsorted(sent[0], pdf["content"].to_numpy())
                at[at == len(sent[0])] = 0
                copies = np.where(sent[0][at] == pdf["content"].to_numpy(), sent[1][at], 1) if len(sent[0]) else np.ones(len(pdf))
            for host, source, content, times in zip(pdf["host"], pdf["html"], pdf["content"].tolist(), copies.tolist(), strict=True):
                seen: dict[tuple[str, int], list[int]] = {}
                for path, is_block, text, links, apart in blocks(source):
                    if apart:
                        continue
                    if not is_block:
                        seen.setdefault((path, 0), [0, 0, 0, 0])[1] += 1
                        continue
                    own = seen.setdefault((path, string_token(path, text)), [text.count(" ") + 1, 0, 0, 0])
                    own[1], own[2], own[3] = own[1] + 1, own[2] + len(text), own[3] + links
                    at = path
                    while at:
                        if (at, 0) in seen:
                            seen[at, 0][2] += len(text)
                            seen[at, 0][3] += links
                        at = at.rpartition("/")[0]
                rows += [(host, path, text, *n, 1.0 / times, content) for (path, text), n in seen.items()]
            out = pd.DataFrame(rows, columns=["host", "path", "text", "words", "n", "chars", "links", "weight", "content"])
            hashed = mix64(out.pop("content").to_numpy(dtype=np.int64).view(np.uint64) ^ mix64(out["n"].to_numpy(dtype=np.uint64)))
            out["v1"], out["v2"] = (hashed >> np.uint64(33)).astype(np.int64), (hashed & np.uint64(0x7FFFFFFF)).astype(np.int64)
            yield out

    schema = "host string, path string, text long, words long, n long, chars long, links long, weight double, v1 long, v2 long"
    return pages.select("host", "content", "html", *(["copies"] if sent is None else [])).mapInPandas(run, schema)


def classes(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> the tokens of valid classes: host, path, text, words, once, chars, links, pages, of, v1, v2, size.

    Equal (v1, v2) of a host is a class; copies of a content add its hashes as often to each of its tokens, so equal
    vectors stay equal. Of counts the hosts' distinct contents, pages those that have the token.
    """
    pages = pages.where("html <> ''").select("host", "html", F.xxhash64("host", "html").alias("content"))
    contents = checkpointed(pages.groupBy("host", "content").agg(F.count("*").alias("copies")))
    of = contents.groupBy("host").agg(F.count("*").alias("of")).where(F.col("of") >= CLASS_CONTENTS)
    many, sent = contents.where("copies > 1").select("content", "copies"), None
    if many.count() <= SENT_COPIES:
        found = many.orderBy("content").toPandas()
        sent = (found["content"].to_numpy(dtype=np.int64), found["copies"].to_numpy(dtype=np.int64))
    else:
        pages = pages.join(contents, ["host", "content"])
    once = F.sum(F.when(F.col("n") == 1, F.col("weight")).otherwise(0.0)).alias("once")
    vector = [F.sum(v).alias(v) for v in ("v1", "v2")]
    vectors = tokens(pages, sent).groupBy("host", "path", "text").agg(F.sum("weight").alias("pages"), once, F.max("words").alias("words"), *(F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("chars", "links")), *vector)
    # sums of weights come in any order; strings of a single content, most of a large host, need not meet its size
    several = vectors.where(F.col("pages") >= COMMON_SHARE * CLASS_CONTENTS - 1e-6)
    common = several.join(of, "host").where(F.col("pages") >= F.lit(COMMON_SHARE) * F.col("of") - 1e-6)
    return common.withColumn("size", F.count("*").over(W.partitionBy("host", "v1", "v2"))).where(F.col("size") >= CLASS_TOKENS)


def templates(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> slot (path of the element that holds the main text) and constants (hashes of constant strings) by host."""
    valid = classes(pages)
    frame = (F.col("text") == 0) & (F.col("once") >= F.lit(COMMON_SHARE) * F.col("of") - 1e-6)
    shared = F.col("text") != 0
    constant = shared & ((F.col("pages") - 2) * F.col("words") >= EVIDENCE - 1e-6)
    node = F.struct(F.size(F.split("path", "/")).alias("d"), "path", "chars", "links")
    best = valid.where(frame | shared).groupBy("host").agg(
        F.collect_set(F.when(constant, F.col("text"))).alias("constants"), F.collect_list(F.when(frame, node)).alias("frame"), F.collect_list(F.when(shared, node)).alias("shared")
    )
    # what all contents have alike is no free text of the elements around it
    less = lambda c: f"f.{c} - aggregate(filter(shared, s -> s.path = f.path OR startswith(s.path, f.path || '/')), 0D, (a, s) -> a + s.{c})"
    free = F.expr(f"transform(frame, f -> named_struct('d', f.d, 'path', f.path, 'chars', {less('chars')}, 'links', {less('links')}))")
    best = best.withColumn("free", free).withColumn("frame", F.expr("IF(array_max(transform(free, f -> f.chars)) > 0.5D, free, frame)"))
    # elements that hold half of all free text lie on one way down from the root
    best = best.withColumn("way", F.expr("filter(frame, f -> f.chars >= 0.5D * array_max(transform(frame, g -> g.chars)) - 1e-6D AND f.links <= 0.5D * f.chars + 1e-6D)"))
    named = F.expr("array_min(filter(way, f -> f.path rlike '/(article|main)[^/]*$|@main$'))").getField("path")
    inner = F.expr(f"array_max(filter(way, f -> NOT f.path rlike '/({TEXT_LEVEL})([.@][^/]*)?$'))").getField("path")
    return best.select("host", F.coalesce(named, inner, F.lit("")).alias("slot"), "constants")


def main_text(page: str, slot: str, constants: frozenset[int]) -> str:
    """The blocks of a page inside the slot, without what stands apart and without constants; all free text if the page lacks the slot."""
    inside, free, named = [], [], []
    for path, is_block, text, links, apart in blocks(page):
        if not is_block or apart:
            continue
        if constants and string_token(path, text) in constants:
            continue
        if slot and (path == slot or path.startswith(f"{slot}/")):
            inside.append(text)
        if re.search(r"/(article|main)[/.@]|/(article|main)$", path):
            named.append(text)
        if 2 * links <= len(text):
            free.append(text)
    return "\n".join(inside or named or free)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A page with null html has empty text; null and repeated ids and urls keep their rows (pages without a host share
    one template); other columns are ignored; no rows give no rows. The templates are checkpointed.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    slim = slim.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)))
    found = checkpointed(templates(slim))
    schema = f"page_id {slim.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("slot") + 100 + 40 * F.size("constants"))).first()[0] or 0
    sent = {r.host: (r.slot, frozenset(r.constants)) for r in found.collect()} if size <= SENT_BYTES else None
    nothing = ("", frozenset())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if sent is None:
                known = [(s if isinstance(s, str) else "", frozenset(() if c is None else c)) for s, c in zip(pdf["slot"], pdf["constants"], strict=True)]
            else:
                known = [sent.get(h, nothing) for h in pdf["host"]]
            texts = [main_text(h or "", *k) for h, k in zip(pdf["html"], known, strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    if sent is not None:
        return slim.select("page_id", "url", "html", "host").mapInPandas(run, schema)
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = slim.withColumn("salt", F.pmod(F.xxhash64("html", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "slot", "constants").mapInPandas(run, schema)
