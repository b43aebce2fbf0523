"""Pack documents into sequences of a fixed number of tokens, by length sums that fill gaps exactly.

A document's token ids, with an end id behind them, are one piece; only documents longer than a sequence are cut, into whole
sequences and a rest.  How pieces go together depends on their lengths alone, so the driver learns one count per length,
``capacity`` numbers whatever the size of the corpus, and makes a plan of patterns, each a list of lengths and how often it
is used.  A pattern starts with the longest length that is left.  An index of sums names, for a gap, one, two or three
lengths that are available and fill it exactly; where there is none, the longest length that fits goes in and the gap is
looked up again.  A pattern is used as often as its counts allow, which uses up at least one length but for less than one
more pattern of it, so plans are as long as there are lengths, not rows.

Spark ranks the pieces within their length (``_rank``: ranges, so a length with a third of all pieces is split), and a piece
finds its sequence and offset by its rank: the plan says which ranks of a length go where.  Nothing about single pieces
leaves the executors.

Tokens come from the tokenizers library.  Its normalisation and its pre-tokens don't reach over a space or a line end, so
texts are cut there (``can_cut`` looks at the tokenizer), a distinct word is encoded once while the worker's bounded table holds
it, and its ids are joined back by position.

Defined results: a null text is an empty one and is one piece, the end id; null ids are returned as they are; rows of one id
and length are ranked by a hash of their ids, and repeated rows are packed each for itself; very long texts are cut into pieces;
an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import workers
from panelwright.llm._rank import ranked
from panelwright.llm._slices import slices
from panelwright.llm._store import keep
from panelwright.llm._table import Table
from panelwright.llm.token_records import _alphabet

#: Words of one generation of a worker's table, about 200 bytes each; two generations are held.
TABLE_ROWS = 300_000
LETTERS, SIGNS = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: Lower-case words, with signs behind them or between them, but for apostrophes, whose suffixes are pre-tokens of their own.
LETTERS_SIGNS = re.compile(f"([{LETTERS}]+)([{SIGNS}]*)").fullmatch
PLAIN = re.compile(f"[{LETTERS}0-9{SIGNS}]+").fullmatch
RUNS = re.compile(f"[{LETTERS}]+|[0-9]|[{SIGNS}]+").findall
#: Texts with other letters than these are lower-cased by the tokenizer itself, by rules of its own.
BEYOND = re.compile("[^\0-\xff\u2010-\u2026]").search

_coders: dict[str, "WordCoder"] = {}


class WordCoder:
    """A tokenizer of lower-cased words, with its table: word -> ids as 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        first = splits[0]
        #: White space is no part of any pre-token, and nothing is rewritten across it.
        self.can_cut = (
            set(steps) <= {"NFC", "Replace", "Lowercase"}
            and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
            and not any(s.get("add_prefix_space") for s in splits)
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
        )
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        #: Letters, single digits and runs of signs are the pre-tokens of plain words.
        self.plain = self.can_cut and "Lowercase" in steps and (first.get("pattern") or {}).get("Regex") == pattern
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.alphabet = _alphabet()
        self.table = Table(self._word, TABLE_ROWS)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of one pre-token, straight from the model."""
        spelled = run if run.isascii() else codecs.charmap_decode(run.encode(), "strict", self.alphabet)[0]
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not self.plain:
            return self._encode(word) if word else b""
        m = LETTERS_SIGNS(word)
        if m is not None:
            letters, signs = m.groups()
            return self.table[letters] + self.table[signs] if signs else self._run(letters)
        if not word:
            return b""
        if PLAIN(word):
            runs = RUNS(word)
            return b"".join(map(self.table.__getitem__, runs)) if len(runs) > 1 else self._run(word)
        return self._encode(word)

    def ids(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers."""
        if not self.can_cut:
            return self._encode(text)
        if self.plain:
            low = text.lower()
            if any(s in low for s in self.special):
                return b"".join([self._encode(w) for w in text.replace("\n", " ").split(" ")])
            if not BEYOND(low):
                text = low
        return b"".join(map(self.table.__getitem__, text.replace("\n", " ").split(" ")))


def coder(path: str) -> WordCoder:
    """The worker's coder for a tokenizer file."""
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _coders[path] = WordCoder(path)
    return _coders[path]


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    c, end, width = coder(path), array("I", [end_id]).tobytes(), 4 * capacity
    for part in slices(batches):
        docs, piece, start, length, crc, pieces = [], array("i"), array("q"), array("i"), array("q"), []
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            coded = c.ids(text or "") + end
            for k, at in enumerate(range(0, len(coded), width)):
                one = coded[at : at + width]
                docs.append(doc)
                piece.append(k)
                start.append(at // 4)
                length.append(len(one) // 4)
                crc.append(zlib.crc32(one))
                if with_ids:
                    pieces.append(one)
        columns = [pa.array(docs, pa.int64()), *(pa.array(np.asarray(a)) for a in (piece, start, length, crc))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            ends = np.cumsum([0, *length], dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(pieces), dtype="<i4"))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents; ``ids`` as an array of numbers, or left out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    run = workers.batches(__name__, "piece_batches", tokenizer, end_id, capacity, ids)
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long"
    return rows.mapInArrow(run, schema + (", ids array<int>" if ids else ""))


class Sums:
    """Which one, two or three available lengths add up to a gap.

    Counts never grow, so a combination found for a sum serves until one of its lengths runs out, and a sum that has none
    never gets one.  Lengths are the bits of a number: the pairs with a sum are the common bits of the lengths and of
    the lengths counted down from the sum.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity = dict(counts), capacity
        self.up = sum(1 << n for n, c in counts.items() if c > 0)
        self.down = sum(1 << (capacity - n) for n, c in counts.items() if c > 0)
        self.index: dict[int, tuple[int, ...] | None] = {}

    def take(self, length: int, count: int = 1) -> None:
        left = self.counts[length] = self.counts[length] - count
        if left == 0:
            self.up &= ~(1 << length)
            self.down &= ~(1 << (self.capacity - length))

    def longest(self, most: int) -> int:
        """The longest available length of at most ``most``; 0 if there is none."""
        return (self.up & ((2 << most) - 1)).bit_length() - 1 if self.up & ((2 << most) - 1) else 0

    def _has(self, combination: tuple[int, ...]) -> bool:
        return all(self.counts[n] >= combination.count(n) for n in combination)

    def _pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths, the longer first and at most ``most``."""
        both = self.up & (self.down >> (self.capacity - total)) & ((2 << min(most, total)) - 1)
        while both:
            long = both.bit_length() - 1
            if 2 * long < total:
                return None
            if self._has((long, total - long)):
                return long, total - long
            both &= ~(1 << long)
        return None

    def _find(self, gap: int) -> tuple[int, ...] | None:
        if self.up >> gap & 1:
            return (gap,)
        if pair := self._pair(gap, gap - 1):
            return pair
        long = self.longest(gap - 1)
        while 3 * long >= gap:
            rest = self._pair(gap - long, long)
            if rest and self._has((long, *rest)):
                return long, *rest
            long = self.longest(long - 1)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """Lengths that fill ``gap``, longest first."""
        if gap in self.index:
            known = self.index[gap]
            if known is None or self._has(known):
                return known
        # a third of a gap is the least that the longest of three can have
        found = self._find(gap) if 3 * self.longest(gap) >= gap else None
        self.index[gap] = found
        return found


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(length, copies), ...]) that use every piece."""
    sums, out = Sums(counts, capacity), []
    while sums.up:
        pattern: dict[int, int] = {}
        gap = capacity
        while gap:
            fill = sums.exact(gap) if pattern else None
            if fill is None:
                longest = sums.longest(gap)
                if not longest:
                    break
                fill = (longest,)
            for n in fill:
                pattern[n] = pattern.get(n, 0) + 1
                sums.take(n)
                gap -= n
        # as often as the counts allow, those that the pattern has just taken included
        more = min(sums.counts[n] // k for n, k in pattern.items())
        if more:
            for n, k in pattern.items():
                sums.take(n, more * k)
        out.append((1 + more, list(pattern.items())))
    return out


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Sorted rows (length, first rank, copies, first sequence, offset): where the pieces from a rank on go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            first = used.get(length, 0)
            rows.append((length, first, copies, sequence, offset))
            used[length] = first + times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place_batches(batches: Iterator[pa.RecordBatch], table: bytes) -> Iterator[pa.RecordBatch]:
    """``sequence_id`` and ``offset`` of ranked pieces."""
    length, first, copies, sequence, offset = np.frombuffer(table, dtype=np.int64).reshape(-1, 5).T
    keys = (length << 44) + first
    for batch in batches:
        n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
        at = np.searchsorted(keys, (n << 44) + rank, side="right") - 1
        turn, place = np.divmod(rank - first[at], copies[at])
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        columns = [batch.column(c) for c in names] + [pa.array(sequence[at] + turn), pa.array(offset[at] + place * n)]
        yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """``sequence_id`` and ``offset`` of every piece of a written table (doc_id, piece, start, length, ids_crc32)."""
    # one row per length: at most ``capacity``
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan(counts, capacity)).tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    places = ranked(cut.select(*names), ["length"], ["doc_id", "piece", "ids_crc32"], "pack-ranks")
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long"
    out = places.select(*names, "rank").mapInArrow(workers.batches(__name__, "place_batches", table), schema)
    return out.withColumn("length", F.col("length").cast("long"))


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence and offset; of the ids, a checksum."""
    return pack(keep(pieces(docs, tokenizer, end_id, capacity, ids=False, doc_id=doc_id, text=text), "pack-pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """sequence_id, ids of at most ``capacity`` tokens, and the documents and offsets of their pieces in order.

    Pieces and places meet by document, piece and checksum; equal pieces of one document can't be told apart and get
    the places in turn.
    """
    from pyspark.sql import Window

    cut = keep(pieces(docs, tokenizer, end_id, capacity, doc_id=doc_id, text=text), "pack-pieces")
    same = ["doc_id", "piece", "ids_crc32", "length"]
    turn = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    left = cut.withColumn("turn", turn).withColumn("doc_id", F.struct("doc_id"))
    right = pack(cut, capacity).withColumn("turn", turn).withColumn("doc_id", F.struct("doc_id")).select(*same, "turn", "sequence_id", "offset")
    rows = left.join(right, [*same, "turn"]).select("sequence_id", F.struct("offset", F.col("doc_id.doc_id").alias("doc_id"), "piece", "ids").alias("part"))
    # a sequence holds at most ``capacity`` pieces
    rows = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return rows.select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("parts"),
    )
