from quorate.llm import decontaminate

ITEM = "A train with Anna on board travels 120 km in 2 hours and then 60 km in 1 hour. What is the mean speed of the train with Anna over 180 km?"


def hits(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    found = sorted(tuple(r)[:2] for r in decontaminate.contaminated(docs, bench, **options).collect())
    kept = decontaminate.remove(docs, bench, **options)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if i not in {d for d, _ in found}]
    return found


def test_templates(spark):
    changed = ITEM.replace("120", "90").replace("60", "45").replace("180", "135").replace("Anna", "Boris")
    inconsistent = ITEM
    for old, new in (("with Anna on", "with Boris on"), ("with Anna over", "with Clara over"), ("120 km", "7 mi"), ("in 2", "in 120"), ("60 km", "60 m"), ("180 km", "1 cm")):
        inconsistent = inconsistent.replace(old, new)
    texts = ["Before. " + ITEM + " After.", "some words " + changed, inconsistent, ITEM.upper(), "A train travels with other words in between and no item at all.", None, "", "12 34", ITEM]
    items = [ITEM, None, "", "short one"]
    want = [(0, 0), (1, 0), (3, 0), (8, 0)]
    assert hits(spark, texts, items) == want
    assert hits(spark, texts, []) == [] and hits(spark, texts[:0], items) == []


def test_shuffled_and_sent_windows_agree(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    sent = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SENT_WINDOWS", 0)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == sent


def test_whole_passages_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: " ".join(decontaminate.WORD.findall(t.lower()))
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in plain(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert want and want == got


def test_canonical():
    tokens, slots = decontaminate.canonical("It weighs 12.5 kg. Then Mr Smith left.")
    assert slots == {2: "12.5", 3: "kg", 5: "mr", 6: "smith"} and len(tokens) == 8


def changed(values):
    out = ITEM
    for old, new in values.items():
        out = out.replace(old, f"\0{new}\0")
    return out.replace("\0", "")


def test_occurrences_are_checked_apart(spark):
    one = changed({"120 km in 2 hours": "90 km in 3 hours", "60 km in 1 hour": "45 km in 4 hours", "180": "135", "Anna": "Boris"})
    two = changed({"120 km in 2 hours": "700 mi in 5 minutes", "60 km in 1 hour": "350 mi in 6 minutes", "180 km": "1050 mi", "Anna": "Clara"})
    words = " ".join(f"word{chr(97 + k % 26)}" for k in range(200))
    coincident = f"{words} 8 lb in 9 oz {words} "
    inserted = one.replace(" and then", " without any stop and then")
    texts = [one, f"{one} {two}", coincident * 3 + one + " " + coincident * 3, inserted, ITEM.split(" and then")[0], " ".join(coincident for _ in range(9))]
    assert hits(spark, texts, [ITEM]) == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_items_shorter_than_a_window(spark):
    texts = ["Please say short one now and then go on.", "short", "He ran 7 km fast.", "There were 12 34 and many others in it", "There were 56 78 and many others in it", "short one"]
    assert hits(spark, texts, ["short one", "ran 5 km", "12 34"]) == [(0, 0), (2, 1), (3, 2), (5, 0)]


def test_consistent():
    assert decontaminate.consistent({(0, "a", "b"), (1, "a", "b"), (2, "a", "c"), (3, "d", "d"), (4, "e", "d"), (5, "f", "g"), (6, "f", "h")}) == {("a", "b"), ("d", "d")}


def test_numbers_alone_say_nothing(spark):
    """Lists of numbers are found by their values, at any length; templates with words by their words."""
    import random

    r = random.Random(1)
    table = " ".join(str(r.randint(0, 999)) for _ in range(60))
    other = " ".join(str(r.randint(0, 999)) for _ in range(60))
    many = " ".join(str(r.randint(0, 99)) for _ in range(100_000))
    texts = ["Scores of the season: 3 7 12 9 4 8 15 2 and so on.", "Sums: 10 20 30 40 50 60.", f"so {other} it is", f"so {table} it is", many, f"{many} {table}"]
    assert hits(spark, texts, ["10 20 30 40 50 60", table]) == [(1, 0), (3, 1), (5, 1)]


def test_coverage_and_slots_by_brute_force(spark):
    """Changed copies with words put in or left out: coverage and n_slots as counted from the alignment that was planted."""
    item = ITEM.split()
    docs = spark.createDataFrame([(0, changed({"120": "90", "Anna": "Boris"})), (1, " ".join([*item[:9], "very", *item[9:]])), (2, " ".join(item[4:]))], "doc_id long, text string")
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    got = {r.doc_id: (round(r.coverage, 6), r.n_slots) for r in decontaminate.contaminated(docs, bench).collect()}
    tokens, slots = decontaminate.canonical(ITEM)
    n, values = len(tokens), len(set(slots.values()))
    # a word put in breaks the windows over it, but the tokens beside it stay covered by other windows
    assert got[1][0] == 1.0 and got[0] == (1.0, values) and got[2] == (round((n - 4) / n, 6), values)
