import random

import numpy as np

from stanzaflow.llm import abuse as A

BAD = ["shut your mouth you zorgle", "everyone hates you zorgle", "go away forever you filthy blenk", "you worthless blenk nobody wants you", "I will hurt you blenk"]
GOOD = ["the river is calm tonight", "we walked along the golden road", "a zorgle is a kind of stone lamp", "they sold the blenk to pay for a song", "my window faces the quiet harbor", "she wrote the second verse alone"]


def disguise(r, t):
    k = r.randrange(5)
    return t.upper() if k == 0 else t.replace("o", "0").replace("e", "3") if k == 1 else t.replace("zorgle", "z.o.r.g.l.e").replace("blenk", "b l e n k") if k == 2 else t.replace("zorgle", "zorrrgle").replace("blenk", "bl*nk") if k == 3 else t


def corpus(n, seed=0):
    r, rows = random.Random(seed), []
    for d in range(n):
        lines = [r.choice(GOOD) for _ in range(r.randint(2, 8))]
        bad = r.random() < 0.25
        if bad:
            lines.insert(r.randrange(len(lines)), disguise(r, r.choice(BAD)))
        rows.append((d, "\n".join(lines), bad))
    return rows


def test_disguises_are_undone():
    for t in ("b.i.t.t.e.r", "B I T T E R", "bi_tter", "b​itter", "bіttеr", "bittttter", "b1tter", "bítter", "bi-tter"):
        assert A.pieces(t) == [["biter"]], t
    assert A.pieces(None) == [] and A.pieces("") == [] and A.pieces("!!! ...") == []
    assert A.pieces("One two. Three\nfour") == [["one", "two"], ["thre"], ["four"]]
    long = A.pieces(" ".join(f"w{chr(97 + i % 26)}q" for i in range(100)))
    assert all(len(p) <= A.WINDOW for p in long) and long[-1][-1] == f"w{chr(97 + 99 % 26)}q"


def test_held_out_accuracy_with_wrong_grades():
    train, test = corpus(1200), corpus(400, 9)
    r = random.Random(1)
    grades = np.array([(0 if bad else 2) if r.random() < 0.08 else (3 if bad else 0) for _, _, bad in train])
    m = A.train([t for _, t, _ in train], grades)
    assert (np.diff(m.theta) > 0).all()
    h = A.Hasher()
    right = 0
    for _, t, bad in test:
        f, s = h.features(A.pieces(t))
        at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        right += (m.expected(m.scores(f, at, np.diff(np.append(at, len(s))))).max() >= A.CUT) == bad
    assert right >= 380


def test_thresholds_share_weights():
    m = A.Ordinal(4)
    e = m.expected(np.array([-50.0, 0.0, 2.0, 50.0]))
    assert e[0] < 1e-6 and e[3] > 3 - 1e-6 and (np.diff(e) > 0).all()
    p = [m.likelihood(np.array([0.7]), np.array([k]))[0] for k in range(4)]
    assert abs(sum(p) - 1) < 1e-9 and min(p) > 0


def test_scores_rates_and_dirt(spark):
    rows = corpus(400)
    docs = [(d, t, ("A-b", " a_B", None)[d % 3], 1.0) for d, t, _ in rows] + [(9000, None, "x", 1.0), (9001, "", "x", 1.0), (None, BAD[0], "x", 1.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, severity double").repartition(3)
    rated = [(d, f"r{k}", int(bad), k) for d, _, bad in rows if d % 2 for k in range(2)] + [(1, "r0", None, 9), (None, "r", 1, 1), (77777, "r", 1, 1)]
    rt = spark.createDataFrame(rated + rated[:10], "doc_id bigint, rater_id string, toxic int, rated_at int")
    scored = A.severities(df, A.fit(df, rt))
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == 402 and got[9000]["severity"] == got[9001]["severity"] == 0
    assert sum((got[d]["severity"] >= A.CUT) == bad for d, _, bad in rows) >= 380
    rates = {r["source"]: r for r in A.source_rates(scored).collect()}
    assert set(rates) == {"a_b", None, "x"} and rates["x"]["rate"] == 0 and 0.1 < rates["a_b"]["rate"] < 0.4


def test_fit_on_a_part_finds_as_much(spark):
    r, rows, test = random.Random(2), corpus(40000), corpus(400, 9)
    df = spark.createDataFrame([(d, t, "s") for d, t, _ in rows], "doc_id bigint, text string, source string")
    rated = [(d, f"r{k}", v, k) for d, _, bad in rows for v in [int(bad != (r.random() < 0.08))] for k in range(2)]
    rt = spark.createDataFrame(rated, "doc_id bigint, rater_id string, toxic int, rated_at int")
    held = spark.createDataFrame([(d, t, "s") for d, t, _ in test], df.schema)
    got = {x["doc_id"]: x["severity"] >= A.CUT for x in A.severities(held, A.fit(df, rt, most=200)).collect()}
    assert sum(got[d] for d, _, bad in test if bad) >= 0.95 * sum(bad for _, _, bad in test)
    assert sum(got[d] for d, _, bad in test if not bad) <= 5


def test_without_ratings(spark):
    df = spark.createDataFrame([(1, BAD[0], "s")], "doc_id bigint, text string, source string")
    none = spark.createDataFrame([], "doc_id bigint, rater_id string, toxic int, rated_at int")
    assert A.severities(df, A.fit(df, none)).first()["severity"] < A.CUT
    assert A.severities(df.limit(0), A.fit(df, none)).count() == 0
