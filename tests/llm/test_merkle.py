import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from panelwright.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, size int, root string"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: levels([leaf(r, r[4]) for r in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h, siblings = leaf(r, text), []
            for nodes, at in ((trees[s], i), (top, k)):
                for level in nodes[:-1]:
                    run, place = level[at // 3 * 3 : at // 3 * 3 + 3], at % 3
                    siblings += run[:place] + run[place + 1 :]
                    h = H("".join(run[:place]) + h + "".join(run[place + 1 :]))
                    at //= 3
            yield r[0], leaf(r, r[4]), trees[s][-1][0], top[-1][0], H("".join(siblings)), h, h == top[-1][0]


def rows(n):
    out = []
    for i in range(n):
        source = "hot" if i % 3 else f"é{i % 8}" if i % 5 else None
        text = None if i % 11 == 0 else "" if i % 13 == 0 else f"line {i}\nand ü\n" * (1 + i % 4)
        out.append((i if i % 17 else None, source, "en" if i % 2 else None, i * 7 if i % 4 else None, text, "mine", 1, "mine"))
    return out + out[40:43] * 2 + [(5, "hot", "en", 1, "other\n", "mine", 1, "mine"), (7, "long", "en", 1, "word\n" * 300_000, "mine", 1, "mine")]


@pytest.mark.parametrize("n", [0, 1, 4])
def test_a_group_of_each_shape(spark, n):
    some = [(i, "s", "en", 1, f"a\n{i}", "", 0, "") for i in range(n)]
    got = merkle.tamper_check(spark.createDataFrame(some, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(some))


def test_trees_equal_brute_force(spark):
    some = rows(900)
    got = merkle.tamper_check(spark.createDataFrame(some, SCHEMA).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(some)))
    assert 0 < sum(r.verified for r in got) < len(got)


def test_many_groups(spark):
    some = [(i, f"s{i % 120:03d}", None, None, str(i), "", 0, "") for i in range(130)]
    got = merkle.tamper_check(spark.createDataFrame(some, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(some))


def test_a_manifest_proves_a_row_by_itself(spark):
    some = rows(120)
    docs = spark.createDataFrame(some, SCHEMA)
    leaves = docs.select("doc_id", "source", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    for r in merkle.manifest(leaves, "source", ["doc_id"]).collect():
        h = r.leaf
        for step in r.path:
            h = H(step.left + h + step.right)
        assert h == r.root


def test_moved_and_lost_rows_are_found(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"t{i}") for i in range(10)], "doc_id long, source string, lang string, n_chars long, text string")
    def root(df):
        leaves = df.select("doc_id", "source", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf"))
        return merkle.manifest(leaves, "source", ["doc_id"]).first().root
    whole = root(docs)
    assert whole == root(docs.repartition(5)) and whole != root(docs.where("doc_id <> 4"))
    assert whole != root(docs.withColumn("source", F.when(F.col("doc_id") == 9, "t").otherwise("s")))
