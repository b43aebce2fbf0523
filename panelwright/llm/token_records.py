"""Token ids as length-delimited binary records with an offset index.

A shard holds one record per document, in ascending order of the id:

    8 bytes  length of the payload (little endian)
    4 bytes  masked CRC-32 of those 8 bytes
    payload  1 byte that is 1 where the document has an id, the id (8 bytes, signed), then the token ids (2 bytes each
             for vocabularies up to 65,536, else 4)
    4 bytes  masked CRC-32 of the payload

The mask is ``rotate_right(crc, 15) + 0xA282EAD8``, so a checksum stored in data that is itself checksummed stays
safe.  Beside each shard an index holds one (has an id, document id, offset, tokens) row of four 8-byte numbers per record.
``index`` reads it, and ``shuffled`` reads the records in a seeded random order with one seek each.

Documents are range-partitioned by id, each partition sorts and writes one shard through a temporary name, and the
rows that the writing job returns are the manifest: a shard that isn't in the manifest doesn't exist, so a retried or
speculative task does no harm.  Positions of shards in the whole come from sums over the manifest.

Tokens come from the tokenizers library.  A text is cut before a single space, or a lone line end, that stands between two
other characters: no token of the byte-level pre-tokenizer reaches over that point, so a word is encoded once while the
worker's bounded table holds it, and its ids are joined back by position.

Defined results: a null text holds the end id only; null ids come first; repeated rows are repeated records; rows of one
id are ordered by a hash of their text; very long texts are one record each; extra columns are ignored, whatever their
names; an empty table gives an empty manifest and no shard.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright import workers
from panelwright.llm._slices import slices
from panelwright.llm._store import commit, file_system, keep, make_dir, new_dir, new_file
from panelwright.llm._table import Odd, Table

MASK_DELTA = 0xA282EAD8
#: Words of one generation of the table, about 200 bytes each; two generations are held.
TABLE_ROWS = 300_000
#: Records that a loader reads at a time.
SLICE_ROWS = 512
_HEAD = struct.Struct("<QI")
_LEAD = struct.Struct("<Bq")

#: A word of which every run of letters, of digits and of other signs is one pre-token, the first with the space before it.
#: The apostrophe is left out: some of its suffixes are pre-tokens of their own.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
LETTERS_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+")

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long, width int"

_coders: dict[str, "Coder"] = {}


def masked(data: bytes) -> int:
    """Masked CRC-32."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def _alphabet() -> str:
    """The byte-level alphabet: printable Latin-1 signs stand for themselves, other bytes for the letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class Coder:
    """One tokenizer with its tables of words."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 65536 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.can_cut = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.code = "H" if self.size <= 65536 else "I"
        self.alphabet = _alphabet()
        self.space = self.alphabet[32]
        #: Words behind a space or with the line end before them, and what stands alone: first words and runs inside a word.
        self.table, self.bare = Table(self._word, TABLE_ROWS), Table(self._bare, TABLE_ROWS)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _run(self, run: str, space: str) -> bytes:
        """Ids of one pre-token, straight from the model."""
        spelled = run if run.isascii() else codecs.charmap_decode(run.encode(), "strict", self.alphabet)[0]
        return array(self.code, [t.id for t in self.model.tokenize(space + spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        m = LETTERS_SIGNS(word)
        if m is not None:
            letters, signs = m.groups()
            return self.table[letters] + self.bare[signs] if signs else self._run(word, self.space)
        if not word or word[-1].isspace() or (word[0].isspace() and (word[0] != "\n" or word[1].isspace())):
            raise Odd
        if word[0] == "\n":
            return self.bare["\n"] + self.bare[word[1:]]
        if PLAIN.fullmatch(word):
            first, *rest = RUNS.findall(word)
            if not rest:
                return self._run(word, self.space)
            return self.table[first] + b"".join(map(self.bare.__getitem__, rest))
        return self._encode([" " + word])[0]

    def _bare(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            runs = RUNS.findall(word)
            return self._run(word, "") if len(runs) == 1 else b"".join(map(self.bare.__getitem__, runs))
        return self._encode([word])[0]

    def _cut(self, text: str) -> list[str]:
        """Chunks of any text, each but the first with the space that precedes it."""
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            last = out[-1]
            # only a lone space between two characters that aren't white space is a cut
            if p and last and not p[0].isspace() and not last[-1].isspace():
                out.append(" " + p)
            else:
                out[-1] = last + " " + p
        return out

    def ids(self, text: str) -> bytes:
        """Ids of a text as bytes of ``dtype``."""
        if not text:
            return b""
        if not self.can_cut or any(s in text for s in self.special):
            return self._encode([text])[0]
        # a lone line end is a token too: a word that follows one has it instead of the space
        words = text.replace("\n", " \n").split(" ")
        first = words[0]
        if first and not first[-1].isspace():
            try:
                return self.bare[first] + b"".join(map(self.table.__getitem__, words[1:]))
            except Odd:
                pass
        return b"".join(self._encode(self._cut(text)))


def coder(path: str) -> Coder:
    """The worker's coder for a tokenizer file."""
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _coders[path] = Coder(path)
    return _coders[path]


def write_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Write the partition, which is sorted by id, as one shard; yield its row of the manifest."""
    from pyspark import TaskContext

    context = TaskContext.get()
    shard, c = context.partitionId(), coder(tokenizer)
    end, width = np.array([end_id], dtype=c.dtype).tobytes(), c.dtype.itemsize
    parts = slices(batches)
    part = next(parts, None)
    if part is None:
        return
    fs, root = file_system(folder)
    name, temporary = f"{root}/shard-{shard:06d}.rec", f"{root}/_temporary-{shard}-{context.taskAttemptId()}.rec"
    offset = n_docs = n_tokens = 0
    with new_file(fs, f"{temporary}.idx") as places, new_file(fs, temporary) as out:
        while part is not None:
            lines = array("q")
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                payload = b"".join((_LEAD.pack(doc is not None, doc or 0), c.ids(text or ""), end))
                n = len(payload)
                head = n.to_bytes(8, "little")
                out.write(b"".join((head, masked(head).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little"))))
                count = (n - _LEAD.size) // width
                lines.extend((doc is not None, doc or 0, offset, count))
                offset += n + 16
                n_docs += 1
                n_tokens += count
            places.write(np.array(lines, dtype="<i8").tobytes())
            part = next(parts, None)
    commit(fs, f"{temporary}.idx", f"{name}.idx")
    commit(fs, temporary, name)
    row = {"shard": shard, "path": f"{folder}/shard-{shard:06d}.rec", "n_docs": n_docs, "n_tokens": n_tokens, "n_bytes": offset, "width": width}
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all rows under ``folder`` and return the manifest with ``first_token``, the tokens of all shards before.

    The text breaks ties of the id, so a group of rows of one id is spread over ranges and has one order.
    """
    make_dir(docs.sparkSession, folder)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    run = workers.batches(__name__, "write_batches", tokenizer, end_id, folder)
    manifest = keep(ordered.mapInArrow(run, MANIFEST), "token-manifest")
    # one row per shard
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def records(stream, width: int) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(offset, document id, token ids) of every record of an open shard; a damaged record raises ValueError."""
    offset = 0
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != _HEAD.unpack(head)[1]:
            raise ValueError(f"damaged length at {offset}")
        n = _HEAD.unpack(head)[0]
        payload, check = stream.read(n), stream.read(4)
        if len(payload) < n or len(check) < 4 or masked(payload) != struct.unpack("<I", check)[0]:
            raise ValueError(f"damaged record at {offset}")
        named, doc = _LEAD.unpack_from(payload)
        yield offset, doc if named else None, np.frombuffer(payload, dtype=f"<u{width}", offset=_LEAD.size)
        offset += n + 16


def read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest every record of the shards named by the manifest's rows."""
    columns = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset"]
    for frame in batches:
        for row in frame.itertuples():
            fs, path = file_system(row.path)
            start, out, n_docs = row.first_token, [], 0
            with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                for offset, doc, ids in records(stream, row.width):
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    out.append((doc, start, len(ids), crc, row.shard, offset))
                    start += len(ids)
                    n_docs += 1
                    if len(out) == 10_000:
                        yield _typed(out, columns)
                        out = []
            if n_docs != row.n_docs:
                raise ValueError(f"{row.path} holds {n_docs} records, its manifest names {row.n_docs}")
            yield _typed(out, columns)


def _typed(rows: list, columns: list) -> pd.DataFrame:
    parts = dict(zip(columns, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in columns}
    return pd.DataFrame({c: pd.array(parts[c], dtype="Int64") for c in columns})


def _spread(manifest: DataFrame) -> DataFrame:
    """A shard to a task: the count keeps the small manifest from being read, and all files with it, by one task."""
    return manifest.repartitionByRange(max(1, manifest.count()), "shard")


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard and offset of every record, read from the files."""
    return _spread(manifest).mapInPandas(
        workers.batches(__name__, "read_batches"), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long"
    )


def read_record(path: str, offset: int, width: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index."""
    fs, name = file_system(path)
    with fs.open_input_file(name) as f:
        f.seek(offset)
        return next((doc, ids) for _, doc, ids in records(f, width))


_PLACES = "path string, width int, doc_id long, offset long, n_tokens long"


def index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in batches:
        for row in frame.to_pandas().itertuples():
            fs, path = file_system(row.path)
            with fs.open_input_stream(f"{path}.idx", compression=None, buffer_size=1 << 20) as stream:
                while data := stream.read(32 * 10_000):
                    named, doc, offset, count = np.frombuffer(data, dtype="<i8").reshape(-1, 4).T
                    n = len(named)
                    columns = [pa.array([row.path] * n), pa.array([row.width] * n, pa.int32()), pa.array(doc, pa.int64(), mask=named == 0), pa.array(offset), pa.array(count)]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "width", "doc_id", "offset", "n_tokens"])


def index(manifest: DataFrame) -> DataFrame:
    """path, width, doc_id, offset and n_tokens of every record, read from the index files alone."""
    return _spread(manifest).mapInArrow(workers.batches(__name__, "index_batches"), _PLACES)


def seek_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of the places, in their order; the last few shards stay open."""
    opened: dict = {}
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = []
                for path, width, offset in zip(*(part.column(c).to_pylist() for c in ("path", "width", "offset")), strict=True):
                    f = opened.pop(path, None)
                    if f is None:
                        fs, name = file_system(path)
                        f = fs.open_input_file(name)
                    opened[path] = f
                    if len(opened) > 64:
                        opened.pop(next(iter(opened))).close()
                    f.seek(offset)
                    found.append(next(ids for _, _, ids in records(f, width)))
                ends = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("doc_id"), lists], ["place", "doc_id", "ids"])
    finally:
        for f in opened.values():
            f.close()


def shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """(place, doc_id, ids) of every record in a seeded random order; ``place`` is the row's key in that order.

    Only the index is shuffled; each record is then read with one seek by the task that yields it.
    """
    places = index(manifest).withColumn("place", F.xxhash64(F.lit(seed), "path", "offset"))
    ordered = places.repartitionByRange("place").sortWithinPartitions("place")
    return ordered.mapInArrow(workers.batches(__name__, "seek_batches"), "place long, doc_id long, ids array<int>")


def fresh_folder(spark) -> str:
    return new_dir(spark, "token-records")
