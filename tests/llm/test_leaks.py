import random
import time

from stanzaflow.llm import leaks

DOC, ITEM = "doc_id bigint, text string", "item_id bigint, text string"


def slow(docs, items, n=8):
    grams = {}
    for i, t in items:
        w = leaks.plain_words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [leaks.plain_words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def words(r, n, size=300):
    return [f"{'aeiou'[x % 5]}{'bcdfgklmnprst'[x % 13]}{x}" for x in (r.randint(0, size) for _ in range(n))]


def test_whole_runs_equal_brute_force(spark):
    r = random.Random(5)
    items = [(i, " ".join(words(r, 30))) for i in range(40)] + [(90, "a b c d e f g h"), (91, "short"), (92, None), (93, "")]
    docs = []
    for d in range(200):
        w = words(r, 80)
        if d % 3 == 0:
            src, a, n = items[r.randrange(40)][1].split(), r.randrange(20), r.choice((6, 7, 8, 9, 12))
            w[20:20] = src[a : a + n]
        docs.append((d, " ".join(w).title().replace(" ", ", ", 3)))
    docs += [(500, None), (501, ""), (502, "x a b c d e f g h y"), (None, items[0][1]), (0, docs[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], DOC + ", item_id int").repartition(3)
    got = leaks.passages(df, spark.createDataFrame(items, ITEM))
    found = {(r["doc_id"], r["item_id"]) for r in got.where("whole_run").collect()}
    assert found == slow([x for x in docs if x[0] is not None], items) and (502, 90) in found
    many = leaks.passages(df, spark.createDataFrame(items, ITEM), item_chars=2000)
    assert {(r["doc_id"], r["item_id"]) for r in many.where("whole_run").collect()} == found


def test_small_edits_and_place(spark):
    item = "the quiet miller of the northern valley counted every silver bell before dawn"
    near = item.replace("quiet", "quit").replace("silver", "silvr")
    docs = [(1, "intro words here " + near + " and so on"), (2, "nothing of the kind stands in this document at all"), (3, item.upper().replace("E", "É"))]
    got = {r["doc_id"]: r for r in leaks.passages(spark.createDataFrame(docs, DOC), spark.createDataFrame([(7, item)], ITEM)).collect()}
    assert set(got) == {1, 3} and not got[1]["whole_run"] and got[3]["whole_run"]
    text = " ".join(leaks.plain_words(docs[0][1]))
    assert text[got[1]["doc_start"] : got[1]["doc_end"]] in near and got[3]["score"] == len(item)


def edited(r, t, n):
    for _ in range(n):
        k, c = r.randrange(len(t)), r.choice("abcdefgh")
        t = r.choice((t[:k] + c + t[k:], t[:k] + t[k + 1 :], t[:k] + c + t[k + 1 :]))
    return t


def distance(a, t):
    """Fewest edits that turn ``a`` into a piece of ``t``."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_up_to_two_edits_equal_brute_force(spark):
    r = random.Random(8)
    texts = ["we go to it so he is on", "the cat sat on the old mat by", *[" ".join(words(r, n, 60)) for n in (8, 9, 12, 3)]]
    docs = []
    for d in range(150):
        w = texts[d % len(texts)].split()
        a = r.randrange(max(1, len(w) - 7))
        docs.append((d, " ".join(words(r, 12, 60)) + " " + edited(r, " ".join(w[a : a + 8]), d % 5) + " " + " ".join(words(r, 12, 60))))
    want = set()
    for d, t in docs:
        for i, x in enumerate(texts):
            w, t2 = leaks.plain_words(x), " ".join(leaks.plain_words(t))
            if any(distance(" ".join(w[a : a + 8]), t2) <= 2 for a in range(max(1, len(w) - 7))):
                want.add((d, i))
    got = leaks.passages(spark.createDataFrame(docs, DOC), spark.createDataFrame(list(enumerate(texts)), ITEM), item_chars=60)
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want and len(want) > 80


def test_frequent_grams_are_taken_in_parts(spark, monkeypatch):
    items = [(i, f"la la la la la la la la la la {'abcdefgh'[i]}x") for i in range(8)]
    docs = spark.createDataFrame([(d, "la " * (50 + d)) for d in range(6)], DOC)
    found = lambda: {(x["doc_id"], x["item_id"]) for x in leaks.passages(docs, spark.createDataFrame(items, ITEM)).collect()}
    assert found() == {(d, i) for d in range(6) for i in range(8)}
    index = leaks.ItemIndex(items, 9, 8, 2)
    texts = [leaks._codes("la " * 40 + "la")] * 4
    monkeypatch.setattr(leaks, "MOST_HITS", 500)
    assert {x[:2] for x in leaks._Search(index).texts([0, 1, 2, 3], texts)} == {(d, i) for d in range(4) for i in range(8)}


def test_band_distance_equals_full_table():
    r, pairs = random.Random(1), []
    for _ in range(60):
        a = "".join(r.choice("abc") for _ in range(r.randint(5, 40)))
        pairs.append((a, edited(r, a, r.randint(0, 3)), -4))
    got = leaks.band_distance([(leaks._codes(a), leaks._codes(t), f) for a, t, f in pairs], 9)
    want = [distance(a, t) for a, t, _ in pairs]
    assert all(g == w for g, w in zip(got, want) if w <= 2)


def test_long_text_and_no_rows(spark):
    r = random.Random(2)
    item = " ".join(words(r, 20))
    text = " ".join(words(r, 200_000, 10**6)) + " " + item
    began = time.time()
    got = leaks.passages(spark.createDataFrame([(1, text)], DOC), spark.createDataFrame([(1, item)], ITEM)).collect()
    assert [(x["doc_id"], x["whole_run"]) for x in got] == [(1, True)] and time.time() - began < 60
    assert leaks.passages(spark.createDataFrame([], DOC), spark.createDataFrame([(1, item)], ITEM)).count() == 0
    assert leaks.passages(spark.createDataFrame([(1, text[:100])], DOC), spark.createDataFrame([], ITEM)).count() == 0
