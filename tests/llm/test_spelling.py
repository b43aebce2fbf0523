import random
import re
import zlib

import pyarrow as pa
import pytest

from panelwright.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(a, b):
    """Whether one letter inserted, deleted or replaced makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows):
    n = {}
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in words if edits(w, x)] for w in words}
    form = {w: min(x, key=lambda y: (-words[y], y)) for w, x in near.items() if x}
    form = {w: x for w, x in form.items() if words[x] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), c, len(near[w]), words[form[w]] if w in form else None) for w, c in words.items()), key=str)


def corpus(seed=5):
    rnd = random.Random(seed)
    stems = ["spelling", "variant", "aaaaaa", "aaaaaaa", "banana", "bananas", "équipe", "abcabcabc", "zzzzzzzz", "mississippi"]
    letters = "abnzé×÷ÿ"
    words = set(stems)
    for w in list(words) * 40:
        for _ in range(rnd.randint(1, 2)):
            k, kind = rnd.randrange(len(w) + 1), rnd.randrange(3)
            w = w[:k] + (rnd.choice(letters) if kind < 2 else "") + w[k + (kind > 0) :]
        words.add(w)
    words |= {"L" + "o" * 3000 + "ng", "l" + "o" * 3001 + "ng", "l" + "o" * 2999 + "xng"}
    # counts from 1 to a third of all words
    rows = []
    for i, w in enumerate(sorted(words)):
        for k in range(rnd.choice([1, 4, 5, 6, 30, 31])):
            rows.append((rnd.choice([None, i, k]), f"{w}, {w.upper()} {rnd.choice(stems)}1{w} ŵ{w}日"))
    rows += [(3, "spelling\n" * 4000), (4, None), (5, ""), (None, "spelling")]
    return [(*r, "mine", 7) for r in rows]


SCHEMA = "doc_id long, text string, word string, n int"


@pytest.fixture(scope="module")
def whole(spark):
    rows = corpus()
    return spark.createDataFrame(rows, SCHEMA).repartition(5), brute(rows)


def test_variants_equal_brute_force(spark, whole):
    docs, want = whole
    got = sorted(map(tuple, spelling.variants(docs).collect()), key=str)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and sum(r[1] is not None and r[2] != r[1] for r in want) > 0
    assert spelling.variants(docs.limit(0)).count() == 0


def test_long_posting_lists_are_cut(spark, whole, monkeypatch):
    monkeypatch.setattr(spelling, "POSTINGS", 7)
    docs, want = whole
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=str) == want


@pytest.mark.parametrize(("held", "pairs"), [(2, 1), (6, 3), (50, 1000)])
def test_postings_that_come_in_parts(monkeypatch, held, pairs):
    monkeypatch.setattr(spelling, "HELD", held)
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 8))) for _ in range(120)})
    rows = []
    for gram, some in ((1, words[:60]), (2, words[60:70])):  # whole lists: every word at one place
        rows += [(gram, 0, None, 0, len(w), w, 1) for w in some]
    some, blocks = words[30:], 3
    for block in range(blocks):
        rows += [(3, block, False, 0, len(w), w, 1) for i, w in enumerate(some) if i % blocks == block]
        rows += [(3, block, True, 0, len(w), w, 1) for w in some]
    rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[4], r[3]))
    names = ["gram", "block", "probe", "pos", "len", "word", "n"]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 7], strict=True), types, strict=True)], names) for k in range(0, len(rows), 7)]
    found = {(r["a"], r["b"]) for b in spelling.near_batches(iter(batches)) for r in b.to_pylist()}
    # at one place words agree with those of their length, and with longer ones
    want = {(a, b) for some in (words[:60], words[60:70], words[30:]) for a in some for b in some if edits(a, b) and (len(a), a) < (len(b), b)}
    share = lambda a, b: len(a) != len(b) or sum(x == y for x, y in zip(a, b, strict=True)) == len(a) - 1
    assert found == {p for p in want if share(*p)}
