import random
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import jaccard as J


def brute(rows):
    sets = [(i, frozenset(J.shingles(t).tolist())) for i, t in rows]
    parent, links, inverted = list(range(len(sets))), [0] * len(sets), {}
    for k, (_, s) in enumerate(sets):
        shared = Counter(j for h in s for j in inverted.get(h, ()))
        for j, m in shared.items():
            if m >= 0.8 * (len(s) + len(sets[j][1]) - m) - 1e-9:
                links[k] += 1
                links[j] += 1
                a, b = J._find(parent, k), J._find(parent, j)
                parent[max(a, b)] = min(a, b)
        for h in s:
            inverted.setdefault(h, []).append(k)
    least = {}
    for k in range(len(sets)):
        r = J._find(parent, k)
        least[r] = min(least.get(r, 1 << 60), sets[k][0])
    return sorted((sets[k][0], least[J._find(parent, k)], links[k]) for k in range(len(sets)))


def corpus(seed=1, groups=12, size=12):
    rnd = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(30, 120))]
        for _ in range(rnd.randint(1, size)):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 999)}"
            rows.append((len(rows) + 1, " ".join(w)))
    rows += [(len(rows) + 1, rows[0][1]), (len(rows) + 2, rows[0][1].upper()), (len(rows) + 3, "a b"), (len(rows) + 4, "A, b!")]
    return rows + [(len(rows) + 1, ""), (len(rows) + 2, None), (len(rows) + 3, "?!")]


def test_links_and_classes_match_brute_force(spark):
    rows = corpus()
    got = J.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_blocks_of_one_group(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(4):
            w[rnd.randrange(200)] = f"y{rnd.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    got = J.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_pruning_loses_nothing_and_packs_pairs(spark):
    df = spark.createDataFrame(corpus(seed=3, groups=20), "doc_id long, text string")
    pick = lambda t: sorted((r.doc_id, r.class_id, r.n_links) for r in J.classes(df, tolerance=t).collect())
    assert J.needed(tolerance=0)[-1] < 0 and pick(0) == pick(J.TOLERANCE)
    for size in (1, 40, 5000, 70000):
        for mates in (np.zeros(0, dtype=np.int64), np.array([0]), np.arange(0, size, 3), np.arange(size)):
            data = J._packed(mates, size)
            assert J._unpacked(data).tolist() == mates.tolist() and (size > 65536 or len(data) <= size // 8 + 2)


def test_thousands_of_near_copies(spark):
    """One class of 3000 different texts, each a word away from a common base, and the links of some by brute force."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(3000):
        w = list(base)
        w[i % 120] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(5000, " ".join(f"z{i}" for i in range(100)))]
    got = {r.doc_id: r for r in J.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {r.class_id for k, r in got.items() if k < 3000} == {0} and got[5000].n_links == 0
    sets = [set(J.shingles(t).tolist()) for _, t in rows]
    for k in (0, 7, 1234, 2999):
        assert got[k].n_links == sum(j != k and len(sets[k] & s) >= 0.8 * len(sets[k] | s) for j, s in enumerate(sets))


def test_very_long_texts_are_cut_into_small_units(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 30_000)
    rows = [(k, " ".join(f"w{i}" for i in range(12_000)) + f" own{k} " * 300) for k in range(8)] + [(9, "short text of six words here")]
    got = J.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_null_ids_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long, "a"), (3, long, "b"), (3, long, "b"), (3, "other text altogether now", "c"), (None, long, "d"), (None, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("_h", df_col())
    stay = J.representatives(df).collect()
    assert sorted((str(r.doc_id), r.node) for r in stay) == [("3", "b"), ("3", "c"), ("None", "d"), ("None", "e")]
    assert J.classes(df).count() == len(rows)


def df_col():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_empty_table_and_threshold(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.classes(empty).count() == 0 and J.representatives(empty).count() == 0
    with pytest.raises(ValueError):
        J.join(empty, threshold=0.5)


def test_posterior_is_monotone_and_keeps_the_threshold():
    need = J.needed()
    assert need == sorted(need) and all(m < 0.8 * n for m, n in zip(need, range(32, 129, 32), strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, k) for k in range(201, 230)]
    got = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in (100, 101, 102)) and all(got[i] == 200 for i in range(200, 230))


def test_signature_estimates_similarity():
    a = np.unique(np.random.default_rng(0).integers(0, 2**63, 2000).astype(np.uint64))
    b = np.concatenate((a[:1600], np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64)))
    share = (J.signature(a) == J.signature(b)).mean()
    assert abs(share - 1600 / 2400) < 0.13
