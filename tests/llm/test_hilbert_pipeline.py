import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from panelwright.llm import hilbert as H


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 4), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, ", ".join(f"x{i} long" for i in range(n)))
    rows = df.withColumn("h", H.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(points)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("count", [0, 1, 39, 40, 41, 1003])
def test_shards_hold_equal_rows(spark, count):
    rows = [(i if i % 7 else None, None if i % 5 == 0 else f"té {i % 3}", "en" if i % 2 else None, "hot" if i % 3 else f"s{i}", "x") for i in range(count)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    got = H.shards(df, 40).collect()
    assert len(got) == count
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    sizes = [len(per.get(s, [])) for s in range(40)]
    assert sum(sizes) == count and max(sizes) - min(sizes) <= 1 and all(0 <= s < 40 for s in per)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    size = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted(map(str, [(r.doc_id, r.size, r.text_crc32) for r in got])) == sorted(map(str, [(r[0], *size(r[1])) for r in rows]))


def test_written_shards_keep_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * i, "en", f"s{i % 4}") for i in range(100)], "doc_id long, text string, lang string, source string")
    H.write_shards(df, H.shards(df, 5), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 5


def test_rows_of_one_key_keep_their_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "en", "s"), (1, "b", "en", "s"), (1, "b", "en", "s"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    H.write_shards(df, H.shards(df, 2), str(tmp_path / "out"))
    assert sorted(str(r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["None", "a", "b", "b"]


def test_a_filter_opens_few_shards(spark):
    """By the least and greatest value of each shard, as a Parquet reader prunes files."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assigned = H.shards(docs, 40).select("doc_id", "shard", "size")
    spans = docs.join(assigned, "doc_id").groupBy("shard").agg(*[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("lo", F.min), ("hi", F.max))]).collect()

    def opened(column, values):
        return sum(sum(r[f"lo_{column}"] <= v <= r[f"hi_{column}"] for r in spans) for v in values) / len(values)

    values = {c: [r[0] for r in docs.select(c).distinct().collect()] for c in ("lang", "source")}
    values["size"] = [r[0] for r in assigned.select("size").orderBy("size").collect()][::25]
    counts = {c: opened(c, v) for c, v in values.items()}
    print(counts)
    assert counts["lang"] < 20 and counts["source"] < 20 and counts["size"] < 20, counts


def test_one_repeated_row_and_labels_with_a_prefix(spark):
    rows = [(7, "same", "en", "https://www.a.example/x")] * 2000 + [(k, f"t{k}", "en", f"https://www.{chr(97 + k % 20)}.example/y") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = H.shards(df, 40)
    per = {r.shard: r["count"] for r in got.groupBy("shard").count().collect()}
    assert len(per) == 40 and set(per.values()) == {75}
    spans = df.where("doc_id < 1000 AND doc_id <> 7").join(got.select("doc_id", "shard"), "doc_id").groupBy("shard").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).collect()
    assert sum(r.lo <= "https://www.m.example/y" <= r.hi for r in spans) <= 8


@pytest.mark.parametrize(("lang", "most"), [("'en'", 10), ("if(xxhash64(id, 1) % 3 = 0, 'de', 'en')", 14)])
def test_labels_of_two_schemes_prune(spark, lang, most):
    """Twenty sources, a fifth of them under http: two dimensions vary, or three, which leave a source fewer cuts."""
    source = "concat(if(id % 5 = 0, 'http://', 'https://'), 'site-', substring(md5(cast(id % 20 as string)), 1, 6), '.example/feed')"
    df = spark.range(20000).selectExpr("id AS doc_id", "repeat('x', int(pmod(xxhash64(id), 300))) AS text", f"{lang} AS lang", f"{source} AS source")
    got = df.join(H.shards(df, 40).select("doc_id", "shard"), "doc_id")
    spans = got.groupBy("shard").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).collect()
    values = [r[0] for r in df.select("source").distinct().collect()]
    opened = sum(sum(r.lo <= v <= r.hi for r in spans) for v in values) / len(values)
    print("opened", lang, opened)
    assert len(values) == 20 and opened <= most, opened


def test_shard_and_slot_follow_the_curve(spark):
    """Levels by sorted labels, the curve by its grid, ranks by sorting: all by brute force."""
    labels = [None, "", "a", "aa", "b", "http://x", "https://x", "é", "z" * 3000, "\U0001f600"]
    rows = [(i, "t" * (i * 37 % 211) + ("y" * 2_000_000 if i == 5 else ""), labels[i * i % 10], "hot" if i % 3 == 0 else f"s{i * 7 % 90}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    got = H.shards(df, 40).orderBy("shard", "slot").collect()
    points = list(itertools.product(range(16), repeat=3))
    grid = spark.createDataFrame(points, "x0 long, x1 long, x2 long").withColumn("h", H.hilbert_index([F.col(f"x{i}") for i in range(3)], 4)).collect()
    at = {r.h: (r.x0, r.x1, r.x2) for r in grid}

    def levels(values):
        keys = sorted((v is not None, (v or "").encode()) for v in values)
        cuts = sorted({keys[k * len(keys) // 16] for k in range(1, 16)})
        return [sum(c <= (v is not None, (v or "").encode()) for c in cuts) * 16 // (len(cuts) + 1) for v in values]

    want = list(zip(levels([r[2] for r in rows]), levels([r[3] for r in rows]), strict=True))
    sizes = {}
    for n, r in enumerate(got):
        assert at[r.curve][:2] == want[r.doc_id]
        assert r.shard == n * 40 // 700 and r.slot == n - -(-r.shard * 700 // 40)
        sizes.setdefault(at[r.curve][2], []).append(r.size)
    assert [r.curve for r in got] == sorted(r.curve for r in got)
    order = sorted(sizes)
    assert len(order) > 10 and all(max(sizes[a]) < min(sizes[b]) for a, b in zip(order, order[1:], strict=False))


# --- pipeline --------------------------------------------------------------------------------------------------


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, n_words string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def words(a, n):
    return " ".join(f"w{a}n{k}" for k in range(n))


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as C
    import sentencepiece

    from panelwright.llm.registry import tokenizer

    passage = " ".join(f"bench{chr(97 + k)}" for k in range(15))
    docs = [
        (1, words(1, 60)), (2, "too short"), (3, words(3, 60)), (4, words(3, 60)), (5, words(3, 59) + " changed"), (6, words(6, 40) + " " + passage),
        (7, words(7, 50) + " mail a.b1@mail.example.com"), (8, None), (None, words(9, 30)), (10, "same five words again here " * 9), (1, words(1, 60)),
    ]
    docs = [(i, t, "en", "s", len(t or ""), "mine") for i, t in docs]
    write(spark, str(tmp_path), docs, [(1, passage), (2, None)])
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in C.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"], name
        frame.write.parquet(out := f"{tmp_path}/{len(seen)}")
        frame = spark.read.parquet(out)
        seen.append(sorted(map(str, [r.doc_id for r in frame.collect()])))
    assert seen[0] == ["1", "1", "3", "4", "5", "6", "7", "None"]
    assert seen[1] == ["1", "3", "6", "7", "None"]
    assert seen[2] == seen[3] == ["1", "3", "7", "None"]
    row = {r.doc_id: r for r in frame.collect()}[7]
    assert "a.b1@mail" not in row.text and row.n_chars == len(row.text) and row.n_words == "mine"
    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    last = {r.doc_id: r for r in C.STAGES[-1][1](spark, frame, str(tmp_path)).collect()}
    assert list(last[7].ids) == m.encode(row.text) and last[7].decoded == row.text
    assert sorted(map(str, last)) == seen[3]
    assert sorted(str(r.doc_id) for r in C.run(spark, str(tmp_path)).collect()) == seen[3]


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    write(spark, str(tmp_path), [], [])
    assert C.run(spark, str(tmp_path)).count() == 0


def test_registry_runs_whole_tables(spark):
    from panelwright.llm import registry

    names = registry.queries()
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)
