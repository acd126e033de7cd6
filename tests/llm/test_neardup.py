import itertools
import random
import re

import numpy as np
import pytest

from stanzaflow.llm import neardup

SCHEMA = "doc_id bigint, text string"


def shingle_set(text, n):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def slow_groups(rows, n, t, least):
    sets = {d: s for d, x in rows if len(s := shingle_set(x, n)) >= least}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d, _ in rows}


def variants(seed, bases=12, copies=5):
    r, rows = random.Random(seed), []
    for b in range(bases):
        words = [f"w{r.randint(0, 400)}" for _ in range(70)]
        for c in range(copies):
            w = words[:]
            for _ in range(c * 2):
                w[r.randrange(len(w))] = f"x{r.randint(0, 999)}"
            rows.append((b * 100 + c, " ".join(w)))
        rows.append((b * 100 + 50, " ".join(words).upper() + "!"))
    return rows


@pytest.mark.parametrize(("n", "t", "least"), [(3, 0.5, 30), (5, 0.8, 1)])
def test_groups_equal_all_pairs(spark, n, t, least):
    rows = variants(1)
    got = {r["doc_id"]: r["group_id"] for r in neardup.groups(spark.createDataFrame(rows, SCHEMA), n=n, threshold=t, min_shingles=least).collect()}
    assert got == slow_groups(rows, n, t, least)


def test_hot_group_and_dirt(spark):
    words = " ".join(f"t{i}" for i in range(50))
    rows = [(i, words) for i in range(300)] + [(1000 + i, words.replace(f"t{i % 50} ", f"z{i} ")) for i in range(120)]
    rows += [(5000, None), (5001, ""), (5002, "too short"), (None, words), (7, words)]
    df = spark.createDataFrame([(d, t, "a", "b", 1) for d, t in rows], SCHEMA + ", group_id string, sh string, root int")
    got = neardup.groups(df, n=3, threshold=0.5)
    g = {r["doc_id"]: r["group_id"] for r in got.collect()}
    assert {g[d] for d, _ in rows if d is not None and d < 5000} == {0}
    assert g[5000] == 5000 and g[5001] == 5001 and g[5002] == 5002 and None not in g
    small = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (9, 9)], "doc_id bigint, group_id bigint")
    assert sorted(map(tuple, neardup.group_pairs(small).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_empty_table(spark):
    assert neardup.group_pairs(neardup.groups(spark.createDataFrame([], SCHEMA))).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (8, 9)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_block_pairs_gives_each_pair_once(spark):
    m = spark.createDataFrame([(1, i, 150) for i in range(150)], "k bigint, i bigint, n bigint")
    got = neardup.block_pairs(m, "k", "i", "n", block=16)
    assert got.count() == 150 * 149 // 2 == got.distinct().count()


@pytest.mark.parametrize("sizes", [[300, 1], [1, 300], [64, 64, 3, 2, 1], [1] * 150, [70], [200, 90, 1, 1]])
def test_pairs_across_parts(spark, sizes):
    part = [r for r, n in enumerate(sizes) for _ in range(n)]
    m = spark.createDataFrame([(k, i, r) for k in (1, 2) for i, r in enumerate(part)], "k bigint, i bigint, r bigint")
    got = sorted(map(tuple, neardup.block_pairs_across(m, "k", "i", "r", block=16).collect()))
    assert got == sorted((i, j) for _ in (1, 2) for j in range(len(part)) for i in range(j) if part[i] != part[j])


def test_links_are_real(spark):
    rows = variants(3)
    got = neardup.groups(spark.createDataFrame(rows, SCHEMA), n=3, threshold=0.5, links=True).collect()
    sets, group = {d: shingle_set(t, 3) for d, t in rows}, {r["doc_id"]: r["group_id"] for r in got}
    for r in got:
        alone = sum(g == r["group_id"] for g in group.values()) == 1
        assert (r["linked_to"] is None) == alone
        if not alone:
            a, b = sets[r["doc_id"]], sets[r["linked_to"]]
            assert group[r["linked_to"]] == r["group_id"] and abs(len(a & b) / len(a | b) - r["similarity"]) < 1e-9


def test_banding_is_complete_at_the_threshold():
    for t in (0.5, 0.7, 0.8, 0.9):
        r, b = neardup.banding(t)
        assert r * b <= neardup.MOST_HASHES and (1 - t**r) ** b <= neardup.MISS + 1e-9


def test_very_long_text(spark):
    r = np.random.default_rng(0)
    text = " ".join(f"w{x}" for x in r.integers(0, 5000, 60_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "a b c d e f g")], SCHEMA)
    assert {x["doc_id"]: x["group_id"] for x in neardup.groups(df).collect()} == {1: 1, 2: 1, 3: 3}
