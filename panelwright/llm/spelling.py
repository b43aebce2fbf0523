"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by positional q-grams.

A word is padded on both sides and has one gram per position.  An edit changes at most ``Q`` of them, so of two near words at
least ``longer - 1`` grams agree at the same position, or, where the lengths differ, at the same or the next one.  Grams are put in
a global order, rare ones first; then the first grams of two near words that agree are among the ``Q + 1`` first of either, so
the inverted index holds only those of each word.  Any global order serves; it comes from counts of ``BUCKETS`` buckets of grams,
a table of one size whatever the corpus.

Postings travel by gram and meet sorted by length and position.  A posting is compared with those of its gram whose length
is equal, at its own position, and those one longer, at its position or the next.  Pairs are counted over all their grams,
those above the bound for one edit are verified letter by letter, and the near ones leave the task.  The posting lists of a
gram with more than ``POSTINGS`` words are cut into blocks, and its words visit each block, so no task holds a whole one.

Occurrences are counted in tables of ``COUNTED`` words per task before the shuffle, so a word with a third of all occurrences
is a few rows.  Chains of forms are followed by doubling, and each step is written.

Defined results: a null text has no words; a null id is spelled as nothing before the colon; repeated rows count again; of near
words with equal counts the first in code-point order is the form; a word without near words has none and is its own root; very
long texts are read whole, and very long words are compared whole; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import workers
from panelwright.llm._slices import slices
from panelwright.llm._store import keep

#: Letters of a gram; a gram is a number of 32 bits.
Q = 4
#: Buckets of grams whose counts give the order of grams.
BUCKETS = 1 << 16
#: Words of a gram that are compared as one block.
POSTINGS = 20_000
#: Words that a task counts before it passes them on.
COUNTED = 200_000
#: Postings that a task gathers at a time, besides a block, of grams fewer than 2 ** 15; candidate pairs that it compares at a time.
HELD, PAIRS = 20_000, 500_000

RUNS = re.compile("[a-zÀ-ÿ]+").findall


def count_batches(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of the batches' runs, each word a few times at most."""
    counts: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for part in slices(batches):
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            if not text:
                continue
            start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
            # lower() of bytes changes A-Z alone
            for run, n in Counter(RUNS(text.encode().lower().decode())).items():
                h = zlib.crc32(run.encode(), start)
                if h % every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                counts[run] += n
            if len(counts) >= COUNTED:
                yield rows()
    if counts:
        yield rows()


def vocabulary(docs: DataFrame, *, every: int = 199, length: int = 6, least: int = 5) -> DataFrame:
    """word and n of all words of at least ``length`` letters that occur ``least`` times.

    Of the runs of a document whose checksum ``every`` divides, one letter is left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(workers.batches(__name__, "count_batches", every), "word string, n long")
    counted = counted.where(F.char_length("word") >= length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letters(words: np.ndarray, length: int) -> np.ndarray:
    """Bytes of words of one length, a row each; every letter is one byte of Latin-1."""
    joined = "".join(words).encode("latin-1")
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(words), length)


def grams(rows: np.ndarray) -> np.ndarray:
    """The ``length + Q - 1`` grams of each row, by position."""
    n, length = rows.shape
    padded = np.empty((n, length + 2 * (Q - 1)), dtype=np.uint32)
    padded[:, : Q - 1], padded[:, Q - 1 : Q - 1 + length], padded[:, Q - 1 + length :] = 1, rows, 2
    width = length + Q - 1
    out = padded[:, :width].copy()
    for k in range(1, Q):
        out = (out << np.uint32(8)) | padded[:, k : k + width]
    return out


def bucket(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % BUCKETS


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, words) of each length; at most some megabytes of letters at a time."""
    whole = np.array(words, dtype=object)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        step = max(1, (1 << 22) // int(length))
        for k in range(0, len(at), step):
            yield int(length), at[k : k + step], whole[at[k : k + step]]


def bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of the grams of all words of a task."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for length, _, words in _by_length(batch.column("word").to_pylist()):
            total += np.bincount(bucket(grams(letters(words, length))).ravel(), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def posting_batches(batches: Iterator[pa.RecordBatch], table: bytes) -> Iterator[pa.RecordBatch]:
    """The ``Q + 1`` first grams of each word."""
    order = np.frombuffer(table, dtype=np.int64)
    for batch in batches:
        counts = batch.column("n").to_numpy(zero_copy_only=False)
        for length, at, words in _by_length(batch.column("word").to_pylist()):
            g = grams(letters(words, length))
            # a stable sort: equal grams stay in the order of their positions
            first = np.argsort((order[bucket(g)] << 32) | g.astype(np.int64), axis=1, kind="stable")[:, : Q + 1]
            found = np.take_along_axis(g, first, axis=1).astype(np.int64)
            columns = [found.ravel(), first.ravel().astype(np.int32), np.full(found.size, length, dtype=np.int32), np.repeat(words, Q + 1), np.repeat(counts[at], Q + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "pos", "len", "word", "n"])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) for every place of ``lo[row] .. hi[row]``, some at a time."""
    sizes = np.maximum(hi - lo, 0)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        n = sizes[at:end]
        row = np.repeat(np.arange(at, end), n)
        yield row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:end], n)
        at = end


def _replaced(a: tuple, b: tuple) -> np.ndarray:
    """Whether words of one length differ by one letter: the count of grams first, then the letters."""
    ok = (a[1] == b[1]).sum(axis=1) >= a[0].shape[1] - 1
    at = np.flatnonzero(ok)
    ok[at] = (a[0][at] != b[0][at]).sum(axis=1) == 1
    return ok


def _inserted(a: tuple, b: tuple) -> np.ndarray:
    """Whether words ``b`` are the one letter shorter words ``a`` with a letter more."""
    width, length = a[1].shape[1], a[0].shape[1]
    ok = ((a[1] == b[1][:, :width]) | (a[1] == b[1][:, 1 : width + 1])).sum(axis=1) >= length
    at = np.flatnonzero(ok)
    s, t = a[0][at], b[0][at]
    lead = np.cumprod(s == t[:, :-1], axis=1, dtype=np.int64).sum(axis=1)
    trail = np.cumprod((s == t[:, 1:])[:, ::-1], axis=1, dtype=np.int64).sum(axis=1)
    ok[at] = lead + trail >= length
    return ok


def compare(index: dict[str, np.ndarray], probes: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probe, index) places of near words.  Both sides hold key, pos, len, word; the index is sorted by key, len, pos."""

    def packed(key, size, pos):
        return (key << 48) | (size << 24) | pos

    places = packed(index["key"], index["len"], index["pos"])
    for size in np.unique(probes["len"]):
        own = np.flatnonzero(probes["len"] == size)
        step = max(1, (1 << 22) // int(size))
        for longer in (0, 1):
            other = np.flatnonzero(index["len"] == size + longer)
            if not len(other):
                continue
            for k in range(0, len(own), step):
                some = own[k : k + step]
                key, pos = probes["key"][some], probes["pos"][some]
                lo = np.searchsorted(places, packed(key, size + longer, pos))
                hi = np.searchsorted(places, packed(key, size + longer, pos + longer), side="right")
                if not (hi > lo).any():
                    continue
                left = letters(probes["word"][some], int(size))
                left = left, grams(left)
                for row, place in _ranges(lo, hi):
                    used, at = np.unique(place, return_inverse=True)
                    right = letters(index["word"][used], int(size + longer))
                    right = right, grams(right)
                    near = []
                    wide = max(1, (1 << 24) // int(size))
                    for c in range(0, len(row), wide):
                        a, b = row[c : c + wide], at[c : c + wide]
                        a, b = (left[0][a], left[1][a]), (right[0][b], right[1][b])
                        near.append(_inserted(a, b) if longer else _replaced(a, b))
                    near = np.flatnonzero(np.concatenate(near)) if near else np.empty(0, dtype=np.int64)
                    yield some[row[near]], place[near]


def near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, n_a, b, n_b) of near words, over postings sorted by (gram, block, probe, len, pos).

    Rows with ``probe`` null are both sides; else rows of the index come before the rows that visit it.
    """
    names = ["gram", "block", "probe", "pos", "len", "word", "n"]
    held: list[pa.Table] = []

    def work(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        col = {c: table.column(c).to_numpy() for c in ("gram", "block", "pos", "len", "n")}
        col["word"] = np.array(table.column("word").to_pylist(), dtype=object)
        probe = np.array([-1 if p is None else int(p) for p in table.column("probe").to_pylist()])
        new = np.ones(len(probe), dtype=bool)
        new[1:] = (col["gram"][1:] != col["gram"][:-1]) | (col["block"][1:] != col["block"][:-1])
        key = np.cumsum(new) - 1
        # the last key may go on in the next rows: a whole list waits, of a block only the index does
        open_key = np.zeros(len(key), dtype=bool) if last else key == key[-1]
        waits = open_key & (probe != 1)
        sides = {}
        for side, rows in (("index", np.flatnonzero((probe != 1) & ~(open_key & (probe == -1)))), ("probes", np.flatnonzero((probe != 0) & ~(open_key & (probe == -1))))):
            sides[side] = {c: v[rows].astype(np.int64) if c in ("pos", "len") else v[rows] for c, v in (*col.items(), ("key", key))}
        for p, i in compare(sides["index"], sides["probes"]):
            a, b, na, nb = sides["probes"]["word"][p], sides["index"]["word"][i], sides["probes"]["n"][p], sides["index"]["n"][i]
            # pairs of one length are found from both ends
            once = np.fromiter((len(x) < len(y) or x < y for x, y in zip(a, b, strict=True)), dtype=bool, count=len(a))
            seen = dict.fromkeys(zip(a[once], na[once], b[once], nb[once], strict=True))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*seen, strict=True)], ["a", "n_a", "b", "n_b"])
        held[:] = [table.filter(pa.array(waits))] if waits.any() else []

    rows = 0
    for batch in batches:
        for at in range(0, batch.num_rows, HELD // 2):
            part = batch.slice(at, HELD // 2)
            held.append(pa.Table.from_batches([part.select(names)]))
            rows += part.num_rows
            if rows >= HELD:
                yield from work(pa.concat_tables(held), False)
                rows = 0
    if held:
        yield from work(pa.concat_tables(held), True)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b of all near words, each pair once, over a written table (word, n)."""
    # at most ``BUCKETS`` rows
    counted = words.select("word").mapInArrow(workers.batches(__name__, "bucket_batches"), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    order = np.zeros(BUCKETS, dtype=np.int64)
    for r in counted.collect():
        order[r["bucket"]] = min(r["n"], (1 << 31) - 1)
    postings = words.mapInArrow(workers.batches(__name__, "posting_batches", order.tobytes()), "gram long, pos int, len int, word string, n long")
    postings = keep(postings, "spelling-postings")
    long = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > POSTINGS)
    # of those there are at most one in ``POSTINGS`` rows
    long = keep(long.select(F.col("gram").alias("__pw_gram"), F.expr(f"int((rows + {POSTINGS - 1}) div {POSTINGS})").alias("blocks")), "spelling-long")
    marked = postings.join(long, F.col("gram") == F.col("__pw_gram"), "left").drop("__pw_gram")
    both, split = marked.where("blocks IS NULL"), marked.where("blocks IS NOT NULL")
    own = F.pmod(F.xxhash64("word", "pos"), F.col("blocks")).cast("int")
    parts = [
        both.withColumn("block", F.lit(0)).withColumn("probe", F.lit(None).cast("boolean")),
        split.withColumn("block", own).withColumn("probe", F.lit(False)),
        split.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(True)),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("blocks")
    met = rows.repartition("gram", "block").sortWithinPartitions("gram", "block", "probe", "len", "pos")
    near = met.mapInArrow(workers.batches(__name__, "near_batches"), "a string, n_a long, b string, n_b long")
    return near.distinct()


def forms(words: DataFrame, near: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    good = -F.col("best.n") >= ratio * F.col("n")
    table = keep(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    # a form occurs more often than its word, so chains end; each step doubles what has been followed
    steps = keep(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        steps = keep(steps.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return table.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    words = keep(vocabulary(docs), "spelling-words")
    return forms(words, near_pairs(words)).select("word", "form", "root", "n", "n_near", "form_n")
