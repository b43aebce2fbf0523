"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a white-space marker after another character, so no merge crosses the point where
a run of markers begins.  A text is cut there into marked words; a distinct marked word is segmented once while the
table holds it, and its ids, and the text they decode to, are joined back by position.  Words are cut further where no
piece of the model can cross either: at line ends, and between letters, digits and signs.

The table belongs to a worker: it has two generations of ``TABLE_ROWS`` words, so its memory is bounded whatever the
vocabulary of the corpus; a word that has left it is segmented again, and every worker segments the words that it meets.
It lives as long as the worker and serves later tasks; nothing is shuffled.

The cuts are only used when the model allows them (``can_cut``, ``lines_cut``, ``runs_cut``, each found from its pieces);
any other model's texts are encoded whole.

Defined results: a null text is encoded like an empty one, to no ids; a null id is returned like any other; repeated rows
are encoded row by row; very long texts are encoded whole, as any other; extra columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import workers
from panelwright.llm._slices import slices
from panelwright.llm._table import Odd, Table

MARK = "▁"
#: Words of one generation of a table, about 250 bytes each; two generations are held.
TABLE_ROWS = 250_000
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Signs and digits that part a word into runs, where no piece of the model mixes them with other characters.
SIGNS = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\r\t“”„«»—–…’‘†²"""
RUNS = re.compile(f"[{re.escape(SIGNS)}]+|[0-9]+|[^{re.escape(SIGNS)}0-9]+")

_codecs: dict[tuple, "Codec"] = {}


class Codec:
    """One model with its tables: marked word -> ids, as comma-joined text or as 32-bit numbers."""

    def __init__(self, path: str, as_text: bool):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.as_text = as_text
        self.glue = "," if as_text else b""
        self.special = {i for i in range(m.get_piece_size()) if m.is_byte(i) or m.is_unknown(i) or m.is_control(i) or m.is_unused(i)}
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if i not in self.special]
        self.mark, self.anchor = m.piece_to_id(MARK), m.piece_to_id("a")
        self.can_cut = self._can_cut()
        self.line = m.encode("\n")[1:]
        #: A line end is a piece of its own: what follows one begins anew, without a marker.
        self.lines_cut = m.encode("\n")[:1] == [self.mark] and len(self.line) == 1 and not any("\n" in p for p in self.pieces)
        self.runs_cut = self.lines_cut and all(len(RUNS.findall(p.lstrip(MARK))) <= 1 for p in self.pieces)
        #: Words without their marker; what follows a line end or another run; chunks of texts that are cut with care.
        self.words, self.bare, self.chunks = Table(self._word, TABLE_ROWS), Table(self._bare, TABLE_ROWS), Table(self._chunk, TABLE_ROWS)

    def _can_cut(self) -> bool:
        """Pieces don't cross markers, the input isn't rewritten, and a marker stands before the text."""
        m = self.model
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            return False
        probe = "Ａ½ a  b ́"  # would change under any of the library's normalisations
        return m.normalize(probe) == MARK + probe.replace(" ", MARK) and m.decode(m.encode(probe)) == probe

    def _packed(self, ids: list[int]):
        return ",".join(map(str, ids)) if self.as_text else array("i", ids).tobytes()

    def _text(self, ids: list[int], spelled: str) -> str:
        """What the ids of ``spelled`` decode to inside a text."""
        # pieces of ordinary text spell the word; bytes and unknown characters are left to decode(), which drops the
        # marker that begins a text, so a letter is set before it and cut off again
        return spelled if self.special.isdisjoint(ids) else self.model.decode([self.anchor, *ids])[1:]

    def _own(self, ids: list[int], spelled: str):
        if self._text(ids, spelled) != spelled:
            raise Odd
        return self._packed(ids)

    def _word(self, word: str):
        if not word or MARK in word:
            raise Odd
        if word[0] == "\n":
            if not self.lines_cut:
                raise Odd
            line = self._packed(self.line)
            return line if len(word) == 1 else self.glue.join((line, self.bare[word[1:]]))
        runs = RUNS.findall(word) if self.runs_cut else (word,)
        if len(runs) > 1:
            return self.glue.join((self.words[runs[0]], *map(self.bare.__getitem__, runs[1:])))
        return self._own(self.model.encode(word), word)

    def _bare(self, word: str):
        if MARK in word:
            raise Odd
        runs = RUNS.findall(word) if self.runs_cut else (word,)
        if len(runs) > 1:
            return self.glue.join(map(self.bare.__getitem__, runs))
        return self._own(self.model.encode("\n" + word)[2:], word)

    def _chunk(self, chunk: str):
        # encode() puts a marker before a text that isn't empty; a lone marker is the piece itself
        ids = self.model.encode(chunk[1:].replace(MARK, " ")) if len(chunk) > 1 else [self.mark]
        return self._packed(ids), self._text(ids, chunk.replace(MARK, " "))

    def code(self, text: str) -> tuple:
        """The text's ids, packed, and what they decode to."""
        if not text:
            return self.glue[:0], ""
        if not self.can_cut:
            ids = self.model.encode(text)
            return self._packed(ids), self.model.decode(ids)
        try:
            return self.glue.join(map(self.words.__getitem__, text.replace("\n", " \n").split(" "))), text
        except Odd:
            found = [self.chunks[c] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]
            # the first marker is the one that encode() adds: decode() drops it again
            return self.glue.join([i for i, _ in found]), "".join([t for _, t in found])[1:]


def codec(path: str, as_text: bool) -> Codec:
    """The worker's codec for a model file."""
    if (path, as_text) not in _codecs:
        _codecs[path, as_text] = Codec(path, as_text)
    return _codecs[path, as_text]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of a few rows at a time: Python objects exist for one slice only."""
    for part in slices(batches):
        yield part.column("doc_id"), [t or "" for t in part.column("text").to_pylist()]


def digest_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path, True)
    for doc_id, texts in _slices(batches):
        n, ids, decoded = [], [], []
        for text in texts:
            coded, back = c.code(text)
            n.append(coded.count(",") + 1 if coded else 0)
            ids.append(hashlib.sha256(coded.encode()).hexdigest())
            decoded.append(hashlib.sha256(back.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [doc_id, pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path, False)
    for doc_id, texts in _slices(batches):
        coded, decoded = zip(*map(c.code, texts), strict=True)
        ends = np.cumsum([0, *(len(i) // 4 for i in coded)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), dtype=np.int32)))
        yield pa.RecordBatch.from_arrays([doc_id, lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encode(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and the decoded text of every row."""
    run = workers.batches(__name__, "encode_batches", model)
    return _keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; the ids themselves don't leave the task."""
    run = workers.batches(__name__, "digest_batches", model)
    return _keyed(docs, doc_id, text).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def decode_batches(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    c = codec(path, False)
    for frame in batches:
        texts = [c.model.decode([int(i) for i in ids]) if ids is not None else "" for ids in frame["ids"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts})


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    run = workers.batches(__name__, "decode_batches", model)
    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
