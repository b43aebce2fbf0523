import random
import zlib

import numpy as np
import pytest

from panelwright.llm import packing
from panelwright.llm.registry import PACK_END_ID, tokenizer

PATH = tokenizer("word_bpe_49k.json")
PARTS = [",", ".", "a", " b", "\nC", " ", "  ", "\n", "th", "é", "日本", "́", "😀", "\t", "\0", "<|endoftext|>", "<|STARTOFTEXT|>", "!", "'s", "'T", "'ll", "　", "Σ", "ΑΣ", "İ", "ß", "Å", "A", "1", "½", "ﬁ", "\x85", "​", "<|", "|>", "endoftext", "9x", "x'd", "—", "“"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_equal_the_library(library):
    rnd, c = random.Random(4), packing.WordCoder(PATH)
    assert c.can_cut and c.plain
    latin = [chr(k) for k in range(1, 0x100)] + ["'", " ", " ", " ", "\n"]
    for alphabet, n in ((PARTS, 15_000), (latin, 15_000), ([*latin, *map(chr, range(0x100, 0x600))], 5000)):
        for _ in range(n):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 11)))
            assert np.frombuffer(c.ids(t), "<u4").tolist() == library(t), repr(t)


def check_plan(counts, capacity):
    patterns = packing.plan(counts, capacity)
    used = {}
    for times, pattern in patterns:
        assert times > 0 and sum(n * k for n, k in pattern) <= capacity
        for n, k in pattern:
            used[n] = used.get(n, 0) + times * k
    assert used == counts
    return sum(times for times, _ in patterns)


def least(counts, capacity):
    return max(-(-sum(n * c for n, c in counts.items()) // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))


def test_exact_complements_come_first():
    assert packing.plan({7: 2, 3: 2}, 10) == [(2, [(7, 1), (3, 1)])]
    assert check_plan({6: 5, 3: 5, 1: 5}, 10) == 5
    assert check_plan({5: 5, 3: 5, 1: 10}, 10) == 5  # 5 + 3 + 1 + 1
    assert check_plan({10: 7}, 10) == 7
    assert check_plan({1: 95}, 10) == 10
    assert check_plan({6: 3}, 10) == 3
    assert check_plan({}, 10) == 0
    assert check_plan({4: 1}, 10) == 1


def test_plans_use_every_piece():
    rnd, over = random.Random(3), 0
    for _ in range(300):
        capacity = rnd.choice([8, 20, 64, 256])
        counts = {rnd.randint(1, capacity): rnd.choice([1, 2, 5, 90]) for _ in range(rnd.randint(1, 40))}
        got, bound = check_plan(counts, capacity), least(counts, capacity)
        assert got >= bound
        over += got - bound > max(1, 0.2 * bound)
    assert over < 30


def test_many_short_pieces_leave_no_gaps():
    rnd = random.Random(8)
    counts = {}
    for _ in range(40_000):
        n = min(4096, int(rnd.lognormvariate(5, 1.3)) + 1)
        counts[n] = counts.get(n, 0) + 1
    assert check_plan(counts, 4096) == least(counts, 4096)


def test_gaps_of_one_two_and_three():
    sums = packing.Sums({2: 1, 3: 1, 9: 2}, 30)
    assert sums.exact(9) == (9,) and sums.exact(5) == (3, 2) and sums.exact(18) == (9, 9) and sums.exact(14) == (9, 3, 2)
    assert sums.exact(6) is None and sums.exact(27) is None  # 3 + 3 and 9 + 9 + 9 aren't there
    sums.take(9)
    assert sums.exact(18) is None and sums.exact(9) == (9,)


def rows(n):
    rnd = random.Random(2)
    out = [(i if i % 9 else None, None if i % 31 == 0 else "" if i % 37 == 0 else " ".join("Word aé, x!".split()[k % 3] for k in range(rnd.randint(1, 60))), "mine", 1) for i in range(n)]
    return out + out[5:8] * 3 + [(1, "other", "mine", 1), (77, "word " * 30_000, "mine", 1), (78, "x" * 9000, "mine", 1)]


SCHEMA = "doc_id long, text string, ids string, sequence_id int"


def test_pieces_cover_documents_and_fill_sequences(spark, library):
    some = rows(400)
    docs = spark.createDataFrame(some, SCHEMA).repartition(3)
    got = packing.packed(docs, PATH, PACK_END_ID, 64).collect()
    want = []
    for doc, text, *_ in some:
        ids = [*library(text), PACK_END_ID]
        for k, at in enumerate(range(0, len(ids), 64)):
            piece = ids[at : at + 64]
            want.append((doc, k, at, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes())))
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, want))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(n for _, n in p) <= 64
    assert len(places) <= 1.02 * -(-sum(r.length for r in got) // 64) + 1
    assert packing.packed(docs.limit(0), PATH, PACK_END_ID, 64).count() == 0


def test_sequences_hold_the_ids(spark, library):
    some = rows(60)
    docs = spark.createDataFrame(some, SCHEMA)
    found = {}
    for s in packing.sequences(docs, PATH, PACK_END_ID, 512).collect():
        assert len(s.ids) <= 512
        ends = [p.offset for p in s.parts[1:]] + [len(s.ids)]
        for p, end in zip(s.parts, ends, strict=True):
            found.setdefault((p.doc_id, p.piece), []).append(tuple(s.ids[p.offset : end]))
    want = {}
    for doc, text, *_ in some:
        ids = [*library(text), PACK_END_ID]
        for k, at in enumerate(range(0, len(ids), 512)):
            want.setdefault((doc, k), []).append(tuple(ids[at : at + 512]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
