import re
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from panelwright.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "one", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n\n \nx", "# <b> 100% & more | $5 *",
    "\x0bé 😀 ß\r\nß  a", "a b c d e f a b c d e f g h a b c d e", "w " * 20000, "z" * 50000, "a b c d e\n" * 9,
]


def test_measures_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, "p q")]
    got = Q.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(
        ((i, *brute(t)) for i, t in rows), key=key
    )


def test_policies_and_ablation(spark):
    book = Q.ledger(spark.createDataFrame([(1, "too short"), (2, "a b c d e " * 9), (3, "one two three four five six seven eight nine ten eleven")], "doc_id long, text string"))
    kept = {r.doc_id: r.kept for r in Q.apply_policy(book, "base-1").collect()}
    assert kept == {1: False, 2: False, 3: True}
    table = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in Q.ablation(book, "base-1").collect()}
    assert table == {"few_words": (1, 1, 2), "repeated_windows": (1, 1, 2)}


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, n_words string")
    out = Q.ledger(df)
    assert out.columns.count("n_words") == 1 and out.first().n_words == 2
    assert Q.ledger(df.limit(0)).count() == 0
    assert Q.ablation(Q.ledger(df.limit(0)), "web-1").count() == 0


def test_a_stored_ledger_serves_policies_without_texts(spark, tmp_path):
    rows = [(i, t, "mine") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "mine"), (None, "p q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sole_rule string")
    folder = str(tmp_path / "ledger")
    book = Q.store(docs, folder)
    assert "text" not in book.columns and book.count() == len(rows)
    again = Q.stored(spark, folder)
    fresh = Q.ledger(docs)
    names = ["doc_id", *Q.MEASURES, "fail_bits"]
    assert sorted(map(str, again.select(names).collect())) == sorted(map(str, fresh.select(names).collect()))
    with pytest.raises(PySparkException):
        Q.store(docs, folder)
    other = Q.RULES[:-1]
    assert Q.version(other) != Q.version() and Q.store(docs.limit(0), folder, rules=other).count() == 0
    for policy in Q.POLICIES:
        bits = {r.name: 1 << r.bit for r in Q.RULES if r.name in Q.POLICIES[policy]}
        judged = Q.with_ablation(Q.apply_policy(again, policy), policy).collect()
        assert len(judged) == len(rows)
        failed = [[n for n, b in bits.items() if r.fail_bits & b] for r in judged]
        sole = Counter(f[0] for f in failed if len(f) == 1)
        for r, f in zip(judged, failed, strict=True):
            assert (r.kept, r.sole_rule) == (not f, f[0] if len(f) == 1 else None)
            assert r.n_sole == (sole[f[0]] if len(f) == 1 else None)
