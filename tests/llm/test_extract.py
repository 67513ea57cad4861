from quorate.llm import extract

HEAD = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'


def run(spark, pages):
    df = spark.createDataFrame([(i, u, h, "c") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string")
    return {r.page_id: r.text for r in extract.extract(df).collect() if r.n_chars == len(r.text)}


def page(k, body):
    return (f"http://a.example/{k}", f'{HEAD}<header>Site</header><nav><ul><li><a href="/">menu</a></ul></nav><div class="ad">buy {k}</div>{body}<aside>side</aside><footer>&copy; foot</footer></body></html>')


def test_named_slot(spark):
    body = lambda k: f'<article><h1>Title {k} &amp;amp;</h1><p><b>One&nbsp;{k}<br>two<p>Three  \n four<div class="share-box">Share!</div><form>Mail <input></form><ul><li>x<li>y</ul><!-- <p>no --><section class="comments"><p>reader</p></section></article>'
    got = run(spark, [page(k, body(k)) for k in range(4)])
    assert got == {k: f"Title {k} &amp;\nOne {k} two\nThree four\nx\ny" for k in range(4)}


def test_slot_without_a_name_and_constants(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    body = lambda k: f'<div class="frame"><div class="top"><p>Welcome to our site</p></div><div class="story"><p>{" ".join(words[k % 10 :] * 6)} number {k}</p><p>second {k}</p><p>Read more at our home</p></div></div>'
    got = run(spark, [page(k, body(k)) for k in range(12)])
    assert all(got[k] == f'{" ".join(words[k % 10 :] * 6)} number {k}\nsecond {k}' for k in range(12))


def test_copies_of_one_article_are_one_content(spark):
    one = page(0, "<article><h1>A short title</h1><p>A paragraph of real text in it</p></article>")[1]
    got = run(spark, [(f"http://a.example/{k}", one) for k in range(12)])
    assert got == dict.fromkeys(range(12), "A short title\nA paragraph of real text in it")


def test_long_notice_on_few_and_many_pages(spark, monkeypatch):
    notice = "we keep these words on all of our pages " * 10
    pages = lambda n: [page(k, f"<article><p>Story number {k} of the day</p><p>{notice}</p></article>") for k in range(n)]
    for n in (4, 7, 8, 12):
        assert run(spark, pages(n)) == {k: f"Story number {k} of the day" for k in range(n)}
    twice = pages(5) * 2
    want = run(spark, twice)
    monkeypatch.setattr(extract, "SENT_COPIES", 0)
    assert run(spark, twice) == want == {k: f"Story number {k % 5} of the day" for k in range(10)}


def test_frame_tolerates_empty_and_broken_pages(spark):
    body = lambda k: f'<div class="frame"><div class="top"><p>Offer {k} today</p></div><div class="story"><p>{f"text{k} " * 30}</p><p>end {k}</p></div></div>'
    pages = [page(k, body(k)) for k in range(20)] + [("http://a.example/20", None), ("http://a.example/21", ""), ("http://a.example/22", "<p>broken")]
    got = run(spark, pages)
    assert all(got[k] == f"{f'text{k} ' * 30}".strip() + f"\nend {k}" for k in range(20)) and (got[20], got[21], got[22]) == ("", "", "broken")


def test_edges(spark):
    got = run(spark, [(None, None), ("no host", ""), ("http://b.example/1", "plain &lt;text&gt;"), ("http://b.example/1", "plain &lt;text&gt;"), ("http://c.example", "<p>cut <b>off"), ("http://d.example", f"{HEAD}<article><p>open")])
    assert got == {0: "", 1: "", 2: "plain <text>", 3: "plain <text>", 4: "cut off", 5: "open"}
    assert run(spark, []) == {}


def test_articles_of_the_table(spark, sf):
    import html
    import re

    def article(h):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", h, re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", re.sub("</?b>", "", inner).replace("<br>", " "))
        return "\n".join(p for p in (" ".join(html.unescape(x).split()) for x in parts) if p)

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in extract.extract(pages).collect()} == want


def plain(k, story):
    """No article, main, nav or telling class names."""
    return (f"http://p.example/{k}", f'<html><body><div class="x1"><span>Our house of words and more</span><div class="x2"><div>Go to the first page of it</div></div></div><div class="x3"><div class="x4">{story}</div></div><div class="x5"><p>All rights are kept by the house {2020}</p></div></body></html>')


def test_template_alone_against_the_stories(spark):
    for n in (3, 6, 12):
        stories = [[f"Heading {k} {'abc'[k % 3]}", *(f"sentence {j} of story {k} goes on and on" for j in range(1 + (k * 7) % 4))] for k in range(n)]
        pages = [plain(k, f"<h2>{s[0]}</h2>" + "".join(f"<p>{x}</p>" for x in s[1:])) for k, s in enumerate(stories)]
        want = {k: "\n".join(s) for k, s in enumerate(stories)}
        assert run(spark, pages) == want
        # repeated rows, pages without content and one that is cut short
        more = pages * 2 + [("http://p.example/e", None)] * 3
        got = run(spark, more)
        assert got == want | {n + k: t for k, t in want.items()} | dict.fromkeys(range(2 * n, 2 * n + 3), "")
    cut = run(spark, [*pages, ("http://p.example/c", pages[0][1][:300])])
    assert {k: cut[k] for k in want} == want


def test_classes_by_brute_force(spark):
    """Vectors of counts over distinct contents, compared as they are."""
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    pages = [plain(k, f"<h2>h{k}</h2>" + "".join(f"<p>t {k} {j}</p>" for j in range(k % 3))) for k in range(9)] * 2
    rows = spark.createDataFrame([("p.example", h) for _, h in pages], "host string, html string")
    counts = []
    for h in sorted({h for _, h in pages}):
        counts.append(Counter((path, extract.string_token(path, text) if b else 0) for path, b, text, _, apart in extract.blocks(h) if not apart))
    by_vector = defaultdict(set)
    for t in set().union(*counts):
        vector = tuple(c[t] for c in counts)
        if sum(v > 0 for v in vector) >= 0.9 * len(counts):
            by_vector[vector].add(t)
    want = {frozenset(ts) for ts in by_vector.values() if len(ts) > 1}
    got = extract.classes(rows).groupBy("v1", "v2").agg(F.collect_set(F.struct("path", "text")).alias("ts")).collect()
    assert {frozenset(map(tuple, r.ts)) for r in got} == want and want


def test_joined_and_sent_templates_agree(spark, monkeypatch):
    pages = [plain(k, f"<h2>h{k}</h2><p>text of the story {k}</p>") for k in range(8)] + [(None, "<p>alone"), ("http://q.example", None)]
    want = run(spark, pages)
    monkeypatch.setattr(extract, "SENT_BYTES", -1)
    assert run(spark, pages) == want and want[0] == "h0\ntext of the story 0"


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(extract.extract(df).collect(), key=lambda r: r.page_id)]


def test_two_pages_of_a_host(spark):
    """What both pages have alike is no free text, however long it is."""
    page = "<html><body><div class=x1>Our house of words and more things for everyone here</div><div class=x3><p>story {} goes on</p></div></body></html>"
    assert texts_of(spark, [("http://a.x/1", page.format("one")), ("http://a.x/2", page.format("two"))]) == ["story one goes on", "story two goes on"]


def test_elements_without_names(spark):
    """Menu, story and footer in bare containers: only their places tell them apart."""
    story = lambda k: "".join(f"<div>Sentence {w} of page {k} tells something new.</div>" for w in range(3))
    page = lambda k: f"<body><div><div><a href=/>Home</a></div><div><a href=/n>News of the day</a></div></div><div>{story(k)}</div><div>All rights are with the house.</div></body>"
    for n in (2, 7):
        got = texts_of(spark, [(f"http://b.x/{k}", page(k)) for k in range(n)])
        assert got == ["\n".join(f"Sentence {w} of page {k} tells something new." for w in range(3)) for k in range(n)]
