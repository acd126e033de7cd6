import numpy as np
import pytest
from pyspark.sql import functions as F

from stanzaflow.llm import language as L

TEXT = {
    "en": "the night is over the river and we walk\nI know that you wait for me by the station\nnobody can hold this heart of mine\nso take my hand and follow the road",
    "es": "la noche está sobre el río y caminamos\nyo sé que tú me esperas en la estación\nnadie puede tener este corazón mío\nasí que toma mi mano y sigue el camino",
    "fr": "la nuit est sur la rivière et nous marchons\nje sais que tu m'attends dans la gare\npersonne ne peut tenir ce coeur\nalors prends ma main et suis le chemin",
    "de": "die Nacht ist über dem Fluss und wir gehen\nich weiß dass du auf mich wartest\nniemand kann dieses Herz halten\nalso nimm meine Hand und folge dem Weg",
}
TRAIN = [(i, t, k) for i, (k, t) in enumerate(list(TEXT.items()) * 8)]
SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def model():
    return L.WordScores([(t, k) for _, t, k in TRAIN])


def segs(spark, model, rows):
    df = spark.createDataFrame([(d, t, k, 5, "x") for d, t, k in rows], SCHEMA + ", segment int, first_line string")
    out = {}
    for r in L.segments(df, model=model).where("lang <> 'und'").orderBy("doc_id", "segment").collect():
        out.setdefault(r["doc_id"], []).append((r["first_line"], r["lang"]))
    return out


def test_labels_in_any_spelling(spark):
    rows = {"EN": "en", "en_US": "en", "en-GB": "en", "eng": "en", "English": "en", " Deutsch": None, "German": "de", "fra": "fr", "": None, "n/a": None, "??": None, "unknown": None, "und": None, "nl": "nl", None: None, "pt-BR": "pt"}
    got = spark.createDataFrame([(k,) for k in rows], "l string").select(L.label_language(F.col("l")).alias("x")).collect()
    assert [r["x"] for r in got] == list(rows.values())


def test_single_and_mixed(spark, model):
    en, es, de = (TEXT[k] for k in ("en", "es", "de"))
    rows = [(1, es, "en"), (2, f"[Intro]\nla la la\n\n{en}\nAm  G  C\n{es}", "en"), (3, f"{en}\r\n{de.splitlines()[0]}\r\n{en}", None), (4, de.splitlines()[1], "de"), (5, f"{de.splitlines()[0]}\n{es}", "es")]
    got = segs(spark, model, rows)
    assert got == {1: [(1, "es")], 2: [(4, "en"), (9, "es")], 3: [(1, "en")], 4: [(1, "de")], 5: [(1, "es")]}


def test_texts_without_language(spark, model):
    assert segs(spark, model, [(1, None, "en"), (2, "", "en"), (3, "la la la\nna na hey", "en"), (4, "12 34\n%% ♪♪", None), (5, "3f9a 77b2 c0d1\nqzxv,wkjh;pqlm", "en"), (None, TEXT["en"], "en")]) == {}


def test_script_names_the_language(spark, model):
    got = segs(spark, model, [(1, "Привет мой друг\nкак дела сегодня\nвсё хорошо", None)])
    assert got == {1: [(1, "ru")]}


def test_fit_survives_wrong_labels_and_none(spark):
    rows = [(d, t, "fr" if d % 9 == 0 else k) for d, t, k in TRAIN]
    m = L.fit(spark.createDataFrame(rows, SCHEMA))
    assert m.states[int(m.score("nobody").argmax())] == "en" and m.states[int(m.score("nadie").argmax())] == "es"
    empty = L.fit(spark.createDataFrame([], SCHEMA))
    assert empty.states[int(empty.score("und").argmax())] == "de"
    assert L.segments(spark.createDataFrame([], SCHEMA)).count() == 0


DUTCH = "een oude man loopt langs het water\nzij wacht op hem bij de brug vandaag\nniemand weet waarom hij nooit meer zingt\nen morgen begint alles weer opnieuw hier"
POLISH = "stary człowiek idzie wzdłuż rzeki\nona czeka na niego przy moście\nnikt nie wie dlaczego już nie śpiewa\njutro wszystko zacznie się od nowa"
UKRAINIAN = "старий чоловік іде вздовж річки\nвона чекає його біля мосту\nніхто не знає чому він більше не співає\nзавтра все почнеться знову"


def test_languages_outside_the_model_are_unknown(spark, model):
    df = spark.createDataFrame([(1, DUTCH, "nl"), (2, POLISH, "en"), (3, UKRAINIAN, None), (4, TEXT["en"] + "\n" + POLISH, "en")], SCHEMA)
    got = {}
    for r in L.segments(df, model=model).orderBy("doc_id", "segment").collect():
        got.setdefault(r["doc_id"], []).append((r["first_line"], r["lang"], r["n_segments"]))
    assert got == {1: [(1, "und", 0)], 2: [(1, "und", 0)], 3: [(1, "und", 0)], 4: [(1, "en", 1), (5, "und", 1)]}
    assert L.mislabelled(L.segments(df, model=model)).count() == 0


def test_every_record_comes_out(spark, model):
    rows = [(1, None, "en"), (2, "", "en"), (3, "la la la", "en"), (4, "12 %%", None), (5, TEXT["en"], "en"), (None, "x", "en")]
    got = {r["doc_id"]: (r["lang"], r["n_lines"], r["confidence"]) for r in L.segments(spark.createDataFrame(rows, SCHEMA), model=model).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[5][:2] == ("en", 4) and got[5][2] > 0.9
    assert all(got[d] == ("und", 0, 0.0) for d in (1, 2, 3, 4))


def test_labels_name_the_languages():
    lines = [f"{a}\n{b}" for a in DUTCH.split("\n") for b in DUTCH.split("\n")]
    m = L.WordScores([(t, k) for _, t, k in TRAIN] + [(t, "nl") for t in lines])
    assert "nl" in m.langs and m.states[int(m.score("niemand").argmax())] in ("nl", "de") and m.states[int(m.score("waarom").argmax())] == "nl"
    # a label that stands on texts of other languages only is given up
    m = L.WordScores([(t, k) for _, t, k in TRAIN * 3] + [(t, "sv") for _, t, _ in TRAIN[:12]])
    assert "sv" not in m.langs


def test_mislabelled(spark, model):
    df = spark.createDataFrame([(1, TEXT["en"], "English"), (2, TEXT["en"], "de"), (3, TEXT["en"], None), (4, TEXT["en"], "nl")], SCHEMA)
    assert {r["doc_id"] for r in L.mislabelled(L.segments(df, model=model)).collect()} == {2, 3, 4}


def test_segment_rules():
    assert L.segments_of([(1, 0), (2, 0), (3, 0), (4, 1), (5, 0), (6, 0), (7, 0)]) == [(1, 6, 0)]
    assert L.segments_of([(2, 1), (3, 0), (4, 0), (5, 0)]) == [(2, 3, 0)]
    assert L.segments_of([(1, 0), (2, 1), (3, 1), (4, 0), (5, 0)]) == [(1, 2, 1)]
    assert L.segments_of([]) == []


def test_viterbi_equals_all_paths():
    import itertools

    r = np.random.default_rng(0)
    for _ in range(20):
        s, pen = r.normal(size=(1, 5, 3)) * 2, r.uniform(0, 2, (1, 5))
        value = lambda p: sum(s[0, i, k] for i, k in enumerate(p)) - sum(pen[0, i] for i in range(1, 5) if p[i] != p[i - 1])  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=5), key=value)
        assert abs(value(tuple(L.viterbi(s, pen)[0])) - value(best)) < 1e-9


def test_held_out_accuracy(spark, model):
    r = np.random.default_rng(3)
    rows, truth = [], {}
    for d in range(80):
        k = list(TEXT)[d % 4]
        w = TEXT[k].replace("\n", " ").split()
        rows.append((d, "\n".join(" ".join(r.choice(w, 7)) for _ in range(4)), None))
        truth[d] = k
    got = segs(spark, model, rows)
    assert sum(got[d][0][1] == truth[d] for d in truth) >= 76
