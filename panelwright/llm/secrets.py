"""Secret scans with an incremental blob ledger.

A text is addressed by the SHA-256 of its content.  The ledger holds the findings of every (blob, rule version)
pair that was ever scanned, and every (path, revision) at which a blob was met.  A run scans only pairs that the ledger
lacks, each blob once however many rows, revisions or paths hold it, and joins findings back to all rows.  Raising
``RULE_VERSION`` scans everything anew and keeps the old findings; ``history`` tells the findings of all paths and revisions
ever met.

Each run writes a part to a folder of its own, and an empty file with the name of the part says that it is whole: a failed
job's part is never read.  Two runs at once may scan the same blob; readers take one row of a blob.

A blob that more than a thousandth of the rows hold is joined by broadcast (``join_hot``): fewer than 1000 rows.

Defined results: a null text is an empty blob without findings; a row whose id is null is returned like any
other; repeated rows are returned row by row; very long texts are scanned whole; extra columns are ignored, whatever their
names; an empty table adds nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import workers
from panelwright.llm._skew import join_hot
from panelwright.llm._store import keep, new_dir

RULE_VERSION = 1

#: Kinds in the order in which spans of the same start are listed: the three of the contract, then the method's own.
#: Fixed values: (kind, pattern, group that must be long enough, its least length).
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 0, 36),
    ("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")
_ORDER = {rule[0]: i for i, rule in enumerate(RULES)}
_COMPILED = [(kind, re.compile(p), group, least) for kind, p, group, least in RULES]
#: A run of 16 or more is found faster than all runs; a greedy run that is long enough begins at the same place.
_COMPILED[2] = ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16)
#: Text without any of these has no match of the rule: one pass of plain substring search.
_NEEDLE = {"access": "AKIA", "github": "gh", "jwt": "eyJ", "pem": "-----BEGIN"}

_PARTS = re.compile(r"[A-Za-z0-9_-]+")


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the ``jwt`` rule, in one pass over the runs of its letters: the pattern itself would read a run without a dot
    anew for each ``eyJ`` in it."""
    a = b = None  # the last two runs, if a lone dot joins them to the next
    for m in _PARTS.finditer(text):
        start, end = m.span()
        if b is not None and not (start == b[1] + 1 and text[b[1]] == "."):
            a = b = None
        if a is not None and end - start >= 16 and b[1] - b[0] >= 11 and text.startswith("eyJ", b[0]):
            first = text.find("eyJ", a[0], max(a[1] - 8, 0))
            if first >= 0:
                yield first, end
                a = b = None
                continue
        a, b = b, (start, end)


FINDINGS = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind in the order of ``RULES``."""
    out = []
    for kind, pattern, group, least in _COMPILED:
        if kind in _NEEDLE and _NEEDLE[kind] not in text:
            continue
        if kind == "jwt":
            out += [(kind, *span) for span in web_tokens(text)]
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for blob, text in zip(frame["blob"], frame["text"], strict=True):
            spans = find(text or "")
            base = [s for s in spans if s[0] in BASE]
            counts = [sum(s[0] == k for s in base) for k in BASE]
            rows.append((blob, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        yield pd.DataFrame(rows, columns=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def blobs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``blob``, the address of the row's content."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


class Ledger:
    """A folder of parts: ``findings/version=N/<part>`` and ``places/<part>``, whole where ``whole/<part>`` exists."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _parts(self, folder: str) -> list[str]:
        """Whole parts of a folder: as many names as there were runs."""
        names = []
        for path in (folder, "whole"):
            fs, p = self._fs(path)
            names.append({s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set())
        return sorted(names[0] & names[1])

    def _read(self, folder: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/{folder}/{name}" for name in self._parts(folder)]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def findings(self, version: int) -> DataFrame:
        """A row per blob that was scanned with the rules of ``version``."""
        folder = f"findings/version={version}"
        rows = self._read(folder, FINDINGS)
        # one part holds a blob once
        return rows if len(self._parts(folder)) < 2 else rows.dropDuplicates(["blob"])

    def places(self) -> DataFrame:
        """(path, revision, blob) of everything that ``add_places`` has recorded, each once."""
        return self._read("places", PLACES).distinct()

    def _append(self, rows: DataFrame, folder: str, part: str) -> None:
        rows.write.parquet(f"{self.path}/{folder}/{part}")

    def _commit(self, part: str) -> None:
        fs, p = self._fs(f"whole/{part}")
        fs.create(p).close()

    def scan(self, docs: DataFrame, text: str, version: int) -> None:
        """Scan the blobs of ``docs`` that the ledger lacks for ``version``, each once, and append them."""
        rows = blobs(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")))
        # Copies fold on the map side, so a group of copies sends one row from each task.
        unseen = rows.dropDuplicates(["blob"])
        if self._parts(f"findings/version={version}"):
            unseen = unseen.join(self.findings(version).select("blob"), "blob", "left_anti")
        part = uuid.uuid4().hex
        self._append(unseen.mapInPandas(workers.batches(__name__, "scan_batches"), FINDINGS), f"findings/version={version}", part)
        self._commit(part)

    def add_places(self, places: DataFrame) -> None:
        part = uuid.uuid4().hex
        self._append(places.distinct(), "places", part)
        self._commit(part)


PLACES = "path string, revision string, blob string"


def scan(docs: DataFrame, ledger: str, *, doc_id: str = "doc_id", text: str = "text", version: int = RULE_VERSION) -> DataFrame:
    """Scan what the ledger at path ``ledger`` lacks, append it, and return the findings of every row."""
    book = Ledger(docs.sparkSession, ledger)
    book.scan(docs, text, version)
    rows = keep(blobs(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "blob"), "secret-rows")
    return join_hot(rows, book.findings(version), "blob")


def scan_history(
    revisions: DataFrame, ledger: str, *, path: str = "path", revision: str = "revision", text: str = "text", version: int = RULE_VERSION
) -> None:
    """Record the places of every historical version of every path and scan the contents that the ledger lacks."""
    book = Ledger(revisions.sparkSession, ledger)
    addressed = blobs(revisions.select(F.col(path).cast("string").alias("path"), F.col(revision).cast("string").alias("revision"), F.col(text).alias("text")))
    book.add_places(addressed.select("path", "revision", "blob"))
    book.scan(revisions, text, version)


def history(spark, ledger: str, *, version: int = RULE_VERSION) -> DataFrame:
    """path, revision and findings of every place that the ledger knows and whose content was scanned with ``version``."""
    book = Ledger(spark, ledger)
    return join_hot(keep(book.places(), "secret-places"), book.findings(version), "blob")


def fresh_ledger(spark) -> str:
    """A ledger of its own in the shared folder."""
    return new_dir(spark, "secret-ledger")
