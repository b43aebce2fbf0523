import random
import re

from panelwright.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[j : j + n]), set()).add(item)
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    found |= windows[k]
                    hit.update(range(j, j + n))
        out.append((doc, len(w), len(hit), sorted(map(str, found)), bool(hit)))
    return out


def check(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in D.contamination(d, b).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items), key=str)
    return got


def test_matches_brute_force_on_small_vocabulary(spark):
    rnd = random.Random(3)
    make = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    docs = [(i if i % 17 else None, make(rnd.randint(0, 60)) if i % 13 else None) for i in range(120)]
    docs += [(7, "a b"), (7, "a b"), (8, "x " * 4000), (9, "!!!")]
    items = [(i, make(rnd.randint(4, 14))) for i in range(30)] + [(3, None), (99, "x " * 12), (99, "x " * 12), (100, "?")]
    assert any(r[4] for r in check(spark, docs, items))


def test_case_punctuation_and_edges(spark):
    ten = "Alpha, beta-gamma DELTA epsilon zeta eta theta iota kappa"
    docs = [(1, f"{ten}"), (2, f"pre {ten.upper()} post"), (3, " ".join(ten.split()[:-1])), (4, "É ÉA"), (5, "é éa")]
    got = {r[0]: r[2] for r in check(spark, docs, [(1, ten + " lambda"), (2, "É Éa")])}
    assert got[1] == 10 and got[2] == 10 and got[3] == 0 and got[4] == 2 and got[5] == 0


def test_empty_tables(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c")], [])


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(40))) for i in range(20)]
    items = [(i, " ".join(f"w{(i * j) % 7}" for j in range(14))) for i in range(5)]
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    check(spark, docs, items)


def test_null_items_and_clashing_columns(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, passage, "x", 5), (None, f"a {passage} b", "x", 5), (2, "clean text", "x", 5), (3, None, None, None)], "doc_id long, text string, gram string, print int")
    items = spark.createDataFrame([(None, passage, "y"), (9, "clean text", "y"), (None, None, "y")], "item_id long, text string, len string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.item_ids, r.contaminated, [tuple(s) for s in r.spans]) for r in D.contamination(docs, items).collect()}
    assert got == {1: (12, 0, [], True, [(0, 12)]), None: (12, 0, [], True, [(1, 13)]), 2: (2, 1, ["9"], True, [(0, 2)]), 3: (0, 0, [], False, [])}


def test_long_text_with_many_runs(spark):
    text = " ".join(f"hit filler{k}" for k in range(20_000))
    got = D.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, "hit")], "item_id long, text string")).first()
    assert (got.n_words, got.n_hit, len(got.spans)) == (40_000, 20_000, 20_000)


def test_large_benchmark_drops_rows_before_the_shuffle(spark, monkeypatch):
    """With the shuffled join, what the documents' side writes is far below their texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = D.contamination(docs, items).drop("spans")
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    got = D.contamination(docs, items).drop("spans")
    assert got.exceptAll(want).isEmpty() and want.count() == got.count()
    # what the documents' side writes: rows whose gram the benchmark has, some 170 bytes each
    grams = D.benchmark_prints(items).select("gram").distinct()
    found = docs.select(D.F.explode(D.let(D.F.transform(D.words(D.F.col("text")), lambda w: D.F.xxhash64(w)), D._winnowed)).alias("f")).select("f.gram")
    sent = found.join(grams, "gram", "left_semi").count()
    assert 170 * sent < 0.25 * docs.agg(D.F.sum(D.F.octet_length("text"))).first()[0]
