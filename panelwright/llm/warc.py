"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id; each shard is written as gzip members, one per record, into files that roll at a
compressed size and begin with a warcinfo record.  Headers and digests are made anew from the payload, record ids are
name-based UUIDs and the date is a parameter.  The number of shards follows from the payloads' bytes, and the cuts between
them from weighted quantiles of a sample that a hash of (page id, digest) picks, so neither depends on how the rows are
partitioned: the same rows give the same files, byte for byte, in any session.

A file is written under a temporary name and renamed when it is whole; the rows that the writing job returns are the
manifest, and readers open only the files that it names, so retried or speculative tasks do no harm.

Of records with equal payloads of at least ``least`` bytes the one with the largest page id is the response and the
others are revisits that refer to it and carry no payload; so is a null page id, which counts as the least of all.
The largest id of each digest is found by a partial aggregation, and a digest that more than a thousandth of the pages
share is joined by broadcast, so no group of copies is gathered.

Defined results: a null html has an empty payload, a null url an empty one; repeated rows of one page id are all written, and
each is the response if its id is; every record has an id of its own; very long payloads are written whole; extra columns are
ignored, whatever their names; an empty table gives an empty manifest and no file.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import workers
from panelwright.llm._skew import bounds, join_hot, place
from panelwright.llm._store import commit, file_system, keep, make_dir, new_dir

NAMESPACE = uuid.UUID("6f0d3c52-6f43-5b0e-9d38-2f0f6d1c7a11")
DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
#: Payload bytes of a shard; a small table has up to ``LEAST_SHARDS`` shards of at least 4 MB, a large one ``MOST_SHARDS``.
SHARD_BYTES, SMALL_SHARD_BYTES = 128 << 20, 4 << 20
LEAST_SHARDS, MOST_SHARDS = 32, 20_000
#: Keys of the sample per shard.
SAMPLE = 100
MANIFEST = "shard int, roll int, path string, n_records long, n_bytes long, sha256 string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page, payload_digest: str, k: int = 0) -> str:
    """Name of the k-th record of a page and payload."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}/{payload_digest}/{k}')}>"


def _clean(uri: str) -> str:
    """A header value holds no line ends: what can't be printed is percent-encoded, byte by byte of its UTF-8 form."""
    if uri.isprintable() and " " not in uri:
        return uri
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def info(name: str) -> bytes:
    """The record that begins a file."""
    block = f"software: panelwright\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    lines = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, name)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Filename: {name}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page, uri: str, payload: bytes, refers_to, payload_digest: str, k: int = 0) -> bytes:
    """One record: a response, or a revisit when ``refers_to`` names another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, payload_digest, k)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(uri)}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-ID: {page}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, payload_digest)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Files:
    """The files of one shard: at most one is open, and one that fails is deleted."""

    def __init__(self, folder: str, shard: int, attempt: int, roll_bytes: int):
        self.folder, self.shard, self.attempt, self.roll_bytes = folder, shard, attempt, roll_bytes
        self.fs, self.root = file_system(folder)
        self.roll, self.stream = 0, None

    def _name(self) -> str:
        return f"part-{self.shard:06d}-{self.roll:05d}.warc.gz"

    def _put(self, data: bytes) -> None:
        data = _member(data)
        self.stream.write(data)
        self.size += len(data)
        self.sha.update(data)

    def add(self, data: bytes) -> None:
        if self.stream is None:
            self.temporary = f"{self.root}/_temporary-{self.shard}-{self.roll}-{self.attempt}"
            self.stream = self.fs.open_output_stream(self.temporary, compression=None, buffer_size=1 << 20)
            self.n, self.size, self.sha = 0, 0, hashlib.sha256()
            self._put(info(self._name()))
        self._put(data)
        self.n += 1

    def full(self) -> bool:
        return self.stream is not None and self.size >= self.roll_bytes

    def close(self) -> Iterator[pd.DataFrame]:
        if self.stream is None:
            return
        self.stream.close()
        self.stream = None
        commit(self.fs, self.temporary, f"{self.root}/{self._name()}")
        columns = ["shard", "roll", "path", "n_records", "n_bytes", "sha256"]
        yield pd.DataFrame([(self.shard, self.roll, f"{self.folder}/{self._name()}", self.n, self.size, self.sha.hexdigest())], columns=columns)
        self.roll += 1

    def drop(self) -> None:
        """Delete the open file."""
        if self.stream is not None:
            with contextlib.suppress(OSError):
                self.stream.close()
            with contextlib.suppress(OSError):
                self.fs.delete_file(self.temporary)


def write_batches(batches: Iterator[pd.DataFrame], folder: str, roll_bytes: int) -> Iterator[pd.DataFrame]:
    """Write a partition's records, sorted already, and yield a manifest row for each file.

    A row with tag 0 says what the next rows of its page and digest refer to.
    """
    from pyspark import TaskContext

    files, mark, last, k = None, None, None, 0
    try:
        for frame in batches:
            columns = (frame[c] for c in ("shard", "page_id", "url", "payload", "refers_to", "tag", "digest"))
            for shard, page, url, html, refers, tag, sha1 in zip(*columns, strict=True):
                if tag == 0:
                    mark = (page, sha1, refers)
                    continue
                if files is None or files.shard != shard:
                    if files is not None:
                        yield from files.close()
                    files = _Files(folder, shard, TaskContext.get().taskAttemptId(), roll_bytes)
                refers = mark[2] if mark and mark[:2] == (page, sha1) else None
                k = k + 1 if last == (page, sha1) else 0
                last = (page, sha1)
                files.add(record(page or "", url or "", bytes(html), refers, sha1, k))
                if files.full():
                    yield from files.close()
        if files is not None:
            yield from files.close()
    finally:
        if files is not None:
            files.drop()


def revisits(rows: DataFrame, least: int) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages that are revisits, from a written table (page_id, sha1, size)."""
    # Only digests that several rows share matter: a small table next to the payloads.
    shared = (
        rows.where(F.col("size") >= least)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and largest is not null")
        .select("sha1", "largest")
    )
    shared = keep(shared, "warc-shared")
    found = join_hot(rows.select("page_id", "sha1"), shared, "sha1").where("page_id <> largest or page_id is null")
    return found.groupBy("page_id", "sha1").agg(F.first("largest").alias("refers_to"))


def _key(page: str = "page_id", sha1: str = "sha1"):
    """Sort key of a record: null pages first, rows of one page by their payload."""
    return F.struct(
        F.col(page).isNotNull().cast("int").alias("named"), F.coalesce(F.col(page), F.lit(0)).cast("long").alias("page"), F.xxhash64(sha1).alias("tie")
    )


def cuts(rows: DataFrame) -> list[tuple]:
    """The keys at which shards begin, from a written table (page_id, sha1, size).

    The sample depends on the rows alone: a key is in it if its hash says so, and counts with the bytes of all its rows.  It
    has about ``SAMPLE`` keys a shard, whatever the size of the table.
    """
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.col("size") + 512)).first()
    if not n:
        return []
    shards = min(MOST_SHARDS, max(-(-size // SHARD_BYTES), min(LEAST_SHARDS, -(-size // SMALL_SHARD_BYTES))))
    every = max(1, n // (SAMPLE * shards))
    picked = rows.where(F.pmod(F.xxhash64(F.lit(5), "page_id", "sha1"), F.lit(every)) == 0)
    found = picked.groupBy(_key().alias("key")).agg(F.sum(F.col("size") + 512).alias("weight")).select("key.*", "weight").collect()
    return bounds([tuple(r[:3]) for r in found], [r.weight for r in found], shards)


def write(pages: DataFrame, folder: str, *, least: int = 0, roll_bytes: int = ROLL_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all rows under ``folder`` and return the manifest.

    The payloads are shuffled once: the rows that name a revisit's response are sorted along with the payloads and come
    right before the page that they belong to.
    """
    make_dir(pages.sparkSession, folder)
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    # 60 bytes a row, read for the digests, the sample and the revisits instead of the payloads
    addresses = keep(rows.select("page_id", "sha1", F.length("payload").cast("long").alias("size")), "warc-addresses")
    begins = cuts(addresses)
    marks = revisits(addresses, least)
    tagged = rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("tag", F.lit(1))
    both = tagged.unionByName(marks.withColumn("tag", F.lit(0)), allowMissingColumns=True)
    limits = F.array(*[F.struct(F.lit(a).alias("named"), F.lit(b).cast("long").alias("page"), F.lit(c).cast("long").alias("tie")) for a, b, c in begins])
    placed = both.withColumn("shard", place(limits, len(begins), _key()).cast("int"))
    ordered = placed.repartitionById(len(begins) + 1, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), F.xxhash64("sha1"), "sha1", "tag", "url")
    # ids travel as text: pandas has no integers beside nulls
    ordered = ordered.select(
        "shard", F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"), "tag", base32_of_hex(F.col("sha1")).alias("digest")
    )
    run = workers.batches(__name__, "write_batches", folder, roll_bytes)
    return keep(ordered.mapInPandas(run, MANIFEST), "warc-manifest")


def base32_of_hex(hexed):
    """RFC 4648 base32 of a 40-digit hex string, by groups of 5 digits: 20 bits are 4 letters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    letters = []
    for g in range(8):
        number = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(alphabet, F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def members(stream) -> Iterator[bytes]:
    """Uncompressed gzip members of an open file, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            if parts:
                raise ValueError("the last record is cut off")
            return
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
        else:
            data = b""


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises ValueError when lengths or digests don't fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(headers["Content-Length"])
    if not lines[0].startswith("WARC/") or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    if headers["WARC-Block-Digest"] != f"sha1:{digest(rest[:n])}":
        raise ValueError("wrong block digest")
    return headers, rest[:n]


def read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

    def frame_of(rows):
        parts = dict(zip(columns, zip(*rows, strict=True), strict=True))
        whole = {c: pd.array(parts[c], dtype="Int64") for c in ("page_id", "refers_to")}
        return pd.DataFrame({c: whole.get(c, list(parts[c])) for c in columns})

    for frame in batches:
        for path, n_records in zip(frame["path"], frame["n_records"], strict=True):
            fs, name = file_system(path)
            rows, size, n = [], 0, 0
            with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                for data in members(stream):
                    h, block = parse(data)
                    kind = h["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]
                    if payload is not None and h["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
                        raise ValueError("wrong payload digest")
                    page, refers = h["X-Page-ID"], h.get("X-Refers-To-Page")
                    rows.append(
                        (int(page) if page else None, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], kind, int(refers) if refers else None, h["WARC-Target-URI"], payload)
                    )
                    n += 1
                    size += len(data)
                    if size > 8 << 20:
                        yield frame_of(rows)
                        rows, size = [], 0
            if n != n_records:
                raise ValueError(f"{path} holds {n} records, its manifest names {n_records}")
            if rows:
                yield frame_of(rows)


def digest_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in read_batches(batches):
        yield frame.drop(columns=["url", "payload"])


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _spread(manifest: DataFrame) -> DataFrame:
    """A file to a task: the count keeps the small manifest from being read, and all files with it, by one task."""
    return manifest.select("path", "n_records").repartitionByRange(max(1, manifest.count()), "path")


def read(manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files; a revisit's payload is null."""
    spread = _spread(manifest)
    return spread.mapInPandas(workers.batches(__name__, "read_batches"), f"{_READ}, url string, payload binary")


def read_digests(manifest: DataFrame) -> DataFrame:
    """The records without their payloads, which are checked and stay in the task."""
    spread = _spread(manifest)
    return spread.mapInPandas(workers.batches(__name__, "digest_batches"), _READ)


def fresh_folder(spark) -> str:
    return new_dir(spark, "warc")
