import json
import os

import pytest

from stanzaflow import cli, shared
from stanzaflow.operators import assemble
from stanzaflow.operators import corpus as C
from stanzaflow.sources import readers, writers
from stanzaflow.streaming import score


def body(text, status=200):
    return json.dumps({"message": {"header": {"status_code": status}, "body": {"lyrics": {"lyrics_body": text}}}})


def test_line_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one \n\n two \nthree\n")
    (tmp_path / "b.txt").write_text("four\n")
    got = sorted(tuple(r) for r in readers.line_text(spark, str(tmp_path)).collect())
    assert got == [(0, "one"), (1, ""), (2, "two"), (3, "three"), (4, "four")]


def test_lyrics_json(spark, tmp_path):
    (tmp_path / "T1.json").write_text(body("L1\n\nL2\nL3\nF1\nF2\nF3"))
    (tmp_path / "T2.json").write_text(body("a\nb\nc"))
    (tmp_path / "T3.json").write_text(body("x\ny\nz\nw\nv", 404))
    (tmp_path / "T4.json").write_text(json.dumps({"message": {"header": {"status_code": 200}, "body": {}}}))
    assert [tuple(r) for r in readers.lyrics_json(spark, str(tmp_path)).collect()] == [("T1", "l1 l2 l3")]
    assert {r["tid"]: r["text"] for r in readers.lyrics_json(spark, str(tmp_path), keep_empty=True).collect()} == {"T1": "l1 l2 l3", "T2": "", "T3": "", "T4": ""}


def test_word_lists_maps_and_embeddings(spark, tmp_path):
    (tmp_path / "inv.json").write_text(json.dumps({"b": ["x y", "x y"], "a": ["é"]}))
    assert [(r["category"], r["word"]) for r in readers.inventory_json(spark, str(tmp_path / "inv.json")).orderBy("ord", "pos").collect()] == [("b", "x y"), ("b", "x y"), ("a", "é")]
    with pytest.raises(ValueError):
        readers.inventory_json(spark, str(tmp_path / "none.json"))
    assert readers.lexicon_json(spark, None) is None
    (tmp_path / "map.txt").write_text("m1,s1\nm1,s2\nm2,s3\n")
    assert readers.id_map_csv(spark, str(tmp_path / "map.txt")).count() == 3
    (tmp_path / "e.txt").write_text("2 3\nx 1 2 3\ny 0 0 1\n")
    assert {r["word"]: r["v"] for r in readers.embeddings(spark, str(tmp_path / "e.txt")).collect()} == {"x": [1.0, 2.0, 3.0], "y": [0.0, 0.0, 1.0]}
    (tmp_path / "w.txt").write_text("a\n\nb\n")
    assert sorted(r[0] for r in readers.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["a", "b"]


def test_id_map_in_file_order(spark, tmp_path):
    """Many files of uneven size: the last line of the last file wins."""
    (tmp_path / "a.csv").write_text("".join(f"k{i},a{i}\n" for i in range(400)))
    (tmp_path / "b.csv").write_text("k7,b7\n")
    (tmp_path / "c.csv").write_text("".join(f"k{i},c{i}\n" for i in range(5, 60)) + "k7,\n")
    m = {r["mxm"]: r["msd"] for r in assemble.id_map(readers.id_map_csv(spark, str(tmp_path))).collect()}
    assert m["k7"] is None and m["k5"] == "c5" and m["k100"] == "a100" and len(m) == 400


def test_lemma_list(spark, tmp_path):
    (tmp_path / "l.txt").write_text("Cats,cat\nmice\tmouse\nodd line\n,x\n")
    assert sorted(map(tuple, readers.lemma_table(spark, str(tmp_path / "l.txt")).collect())) == [("cats", "cat"), ("mice", "mouse")]


def test_only_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(200_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    plan = lambda: readers.table(spark, str(tmp_path / "t"))._jdf.queryExecution().toString()
    assert "Repartition" in plan()
    monkeypatch.setattr(readers, "DEAL_MOST", 1000)
    assert "Repartition" not in plan()


def test_staged_tables_are_discarded(spark, tmp_path):
    shared.discard_all(spark)
    a = shared.stage(spark.range(3), "a")
    assert a.count() == 3 and shared.discard_all(spark) == 1 and not os.path.exists(a._stanzaflow_stage.removeprefix("file:"))


def test_csv_and_parquet(spark, tmp_path):
    a = spark.createDataFrame([(2, 0.5), (1, None)], "doc_id bigint, x double")
    writers.write_csv({"s": a}, str(tmp_path / "c"), include_id=False, single_file=True)
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text.splitlines() == ["s_x", '""', "0.50000000"] or text.splitlines()[0] == "s_x"
    writers.write_parquet({"s": a}, str(tmp_path / "p"), topic_terms=a, vocab=a)
    assert spark.read.parquet(str(tmp_path / "p/features/s")).count() == 2
    with pytest.raises(ValueError):
        writers.write_parquet({}, str(tmp_path / "q"))
    assert writers.output_path("/x/corp.txt", "/o") == "/o/corp_feat.csv"


def test_stream_equals_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat the"), (2, ""), (3, None)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "in"))
    s = score.stream_documents(spark, str(tmp_path / "in"), docs.schema)
    for _ in range(2):  # the second run finds nothing new
        score.run_once(score.document_counts(s, ["the"]), str(tmp_path / "out"), str(tmp_path / "log"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, score.document_counts(docs, ["the"]).collect())) == [(1, 3, 2, 1), (2, None, 0, 0), (3, None, 0, 0)]
    words = score.fit_words(C.tokens(docs), spark.createDataFrame([("the",)], "term string"))
    assert words["stop"] == ["the"] and "cat" in words["rare"]


def test_command_line(spark, tmp_path):
    (tmp_path / "corp.txt").write_text("\n".join(f"sun moon w{chr(97 + i % 5)} star" for i in range(20)))
    (tmp_path / "own.json").write_text(json.dumps({"sky": ["sun", "moon"]}))
    (tmp_path / "e.txt").write_text("sun 1 0\nmoon 0 1\nstar 1 1\n")
    out = cli.main([str(tmp_path / "corp.txt"), str(tmp_path), "--features", "linguistic", "topic", "--inventory", str(tmp_path / "own.json"), "--w2v", str(tmp_path / "e.txt"), "--k", "2", "--n-iters", "2", "--min-doc-freq", "1", "--max-doc-freq", "1.0"])
    df = spark.read.option("header", True).csv(out)
    assert df.count() == 20 and {"doc_id", "linguistic_num_words", "own_sky", "topic_topic1", "topic_topic2"} <= set(df.columns)
    with pytest.raises(ValueError):
        cli.main([str(tmp_path / "corp.txt"), str(tmp_path), "--inventory", str(tmp_path / "no.json")])
