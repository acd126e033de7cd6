import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stanzaflow.llm import mixing, terms


def slow(rows):
    docs = {}
    for d, t in rows:
        if d is not None:
            docs.setdefault(d, [x for x in (t or []) if x is not None])
    df, cf = {}, {}
    for t in docs.values():
        for x in t:
            cf[x] = cf.get(x, 0) + 1
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    mark = lambda x: "rare" if df[x] < 5 else "common" if df[x] > 0.3 * len(docs) else None
    return {x: (df[x], cf[x], mark(x)) for x in df}


def test_frequencies_with_dirt(spark):
    r = random.Random(3)
    rows = [(d * 40_000 - 10**6, [f"t{min(r.randint(0, 40), r.randint(0, 40))}" for _ in range(r.randint(0, 60))] + ["all"]) for d in range(200)]
    rows += rows[:20] + [(None, ["zz"]), (5, None), (6, []), (7, [None, "t1"])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, tokens array<string>, n int, term string").repartition(5)
    got = {r["term"]: (r["df"], r["cf"], r["mark"]) for r in terms.term_frequencies(terms.term_bitmaps(df)).collect()}
    assert got == slow(rows)
    cells = [(d, x, t.count(x)) for d, t in dict(reversed(rows)).items() if d is not None for x in {y for y in (t or []) if y}]
    cells += cells[:30] + [(9, "zero", 0), (9, None, 3), (5, "none", None), (6, "zero", 0), (5, "t1", -2)]
    c = spark.createDataFrame(cells, "doc_id bigint, term string, cnt bigint").repartition(3)
    ids = {d for d, _, _ in cells}
    have = {r["term"]: (r["df"], r["cf"]) for r in terms.term_frequencies(terms.term_bitmaps(c, term="term", cnt="cnt")).collect()}
    want = {}
    for d, x, k in set(cells):
        if x and k and k > 0:
            a, b = want.get(x, (0, 0))
            want[x] = (a + 1, b + k)
    assert have == want and ids


def test_containers_of_both_kinds():
    for n in (1, terms.ARRAY_MOST, terms.ARRAY_MOST + 1, 65_536):
        low = np.sort(np.random.default_rng(n).permutation(65_536)[:n])
        assert (terms._unpack_ids(terms._pack_ids(low), n) == low).all()
    for top in (200, 60_000, 4_000_000_000):
        c = np.array([1, top])
        assert (terms._unpack_counts(terms._pack_counts(c), 2) == c).all()
    assert len(terms._pack_ids(np.arange(65_536))) == 8192


def test_union_keeps_keys_apart_over_batches():
    docs, codes = np.arange(20) * 3, np.zeros(20, np.int64)
    parts = list(terms._encode(["a"], codes, docs, np.ones(20, np.int64))) + list(terms._encode(["a"], codes, docs + 1, np.full(20, 2))) + list(terms._encode(["b"], codes, docs, np.ones(20, np.int64)))
    out = pa.Table.from_batches(list(terms._union(iter(parts)))).to_pylist()
    assert [(x["term"], x["n"], x["occ"]) for x in out] == [("a", 40, 60), ("b", 20, 20)]


def test_no_rows(spark):
    assert terms.term_frequencies(terms.term_bitmaps(spark.createDataFrame([], "doc_id bigint, tokens array<string>"))).count() == 0


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.01, "b": 0.99}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": 0.17, "b": 0.16, "c": 0.12, "d": 0.2, "e": 0.12, "f": 0.06, "g": 0.13, "h": 0.03, "i": 0.01}, {"a": 1.0, "b": 1e-6, "c": 1e-6}])
def test_pfair_deviates_by_less_than_one_block(weights):
    slots, whole = 1000, sum(Fraction(x) for x in weights.values())
    w = {s: Fraction(x) / whole for s, x in weights.items()}
    # all blocks that are released within so many slots
    order = mixing.pfair(w, {s: -(-slots * x.numerator // x.denominator) for s, x in w.items()})
    assert [t for _, _, t in order][:slots] == list(range(slots)) and {s for s, _, _ in order} == set(w)
    done = dict.fromkeys(w, 0)
    for s, j, t in order[:slots]:
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * w[x]) < 1 for x in w)


def test_frame_leaves_nobody_out():
    w = {"big": Fraction(1) - 20 * Fraction(1, 10**6), **{f"s{i:02}": Fraction(1, 10**6) for i in range(20)}}
    q = mixing.quotas(w, 1000)
    assert sum(q.values()) == 1000 and min(q.values()) == 1
    assert mixing._schedule(w, dict.fromkeys(w, 500), 1000)[2] == 1000


def mixture(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, slot int, n_tokens string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixing.mix(d, t, **kw)


def check_stream(rows, block):
    """No slot holds two sources or more than a block, and every document comes whole."""
    slots, uses = {}, {}
    for x in rows:
        slots.setdefault(x["slot"], []).append(x)
        uses.setdefault((x["source"], x["doc_id"], x["pass"]), []).append(x)
    for part in slots.values():
        part.sort(key=lambda x: x["offset"])
        assert len({x["source"] for x in part}) == 1 and part[0]["offset"] == 0 and sum(x["n_tokens"] for x in part) <= block
        assert all(a["offset"] + a["n_tokens"] == b["offset"] for a, b in zip(part, part[1:]))
    for part in uses.values():
        part.sort(key=lambda x: x["slot"])
        assert part[0]["doc_offset"] == 0 and all(a["doc_offset"] + a["n_tokens"] == b["doc_offset"] for a, b in zip(part, part[1:]))


def test_long_documents_take_several_blocks(spark):
    docs = [(i, "w " * 50_000, "long", 1, "x") for i in range(2)] + [(100 + i, "v " * 500, "brief", 1, "x") for i in range(200)]
    uses, report = mixture(spark, docs, [("long", 0.5, 1), ("brief", 0.5, 1)])
    rows = uses.collect()
    check_stream(rows, 4096)
    assert {x["source"]: (x["filled_blocks"], x["placed_tokens"]) for x in report.collect()} == {"long": (25, 100_000), "brief": (25, 100_000)}
    done = {"long": 0, "brief": 0}
    for t, x in enumerate(sorted({(x["slot"], x["source"]) for x in rows})):
        assert x[0] == t
        done[x[1]] += 1
        assert all(abs(n - (t + 1) / 2) < 1 for n in done.values())


def test_tiny_shares_are_in_the_mix(spark):
    docs = [(i, "w " * 900, "big", 1, "x") for i in range(50)] + [(100 + i, "v v", f"tiny{i % 5}", 1, "x") for i in range(50)]
    uses, report = mixture(spark, docs, [("big", 1 - 5e-6, 2), *[(f"tiny{i}", 1e-6, 1) for i in range(5)]])
    assert {x["source"] for x in uses.select("source").collect()} == {"big", *[f"tiny{i}" for i in range(5)]}
    assert mixing.short_sources(report).count() == 0


def test_mix_reaches_shares_and_caps(spark):
    docs = [(i, "w " * (5 + i % 7), (" Big-One", "big_one", "BIG ONE")[i % 3], 1, "x") for i in range(3000)] + [(10_000 + i, "v " * 8, "small", 1, "x") for i in range(100)]
    docs += [(20_000, None, "small", 1, "x"), (20_001, "", "small", 1, "x"), (20_002, "a b", None, 1, "x"), (None, "a", "small", 1, "x"), (20_003, "q r", "unknown", 1, "x")]
    targets = [("big_one", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 5)]
    uses, report = mixture(spark, docs, targets, block_tokens=50)
    r = {x["source"]: x for x in report.collect()}
    assert r["big_one"]["total_tokens"] == sum(5 + i % 7 for i in range(3000)) + 800
    assert r["small"]["placed_tokens"] == 2400 and r["small"]["passes"] == 3 and r["none"]["placed_tokens"] == 0
    assert sorted(x["source"] for x in mixing.short_sources(report).collect()) == ["none", "small"]
    rows = uses.collect()
    check_stream(rows, 50)
    assert 0 <= r["big_one"]["placed_tokens"] - 0.6 * r["big_one"]["total_tokens"] < 11
    few, _ = mixture(spark, docs, targets, block_tokens=50, most_slots=40)
    check_stream(few.collect(), 50)
    assert few.agg(F.sum("n_tokens")).first() == uses.agg(F.sum("n_tokens")).first()
    assert abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9


def test_mix_of_nothing(spark):
    uses, report = mixture(spark, [], [("a", 0.5, 1), ("b", None, None), (None, 0.5, 1)])
    assert uses.count() == 0 and {x["source"]: x["actual_share"] for x in report.collect()} == {"a": 0.0, "b": 0.0}
    uses, report = mixture(spark, [(1, "a b", "a", 1, "x")], [("a", 0.0, 1)])
    assert uses.count() == 0 and mixing.short_sources(report).count() == 0
