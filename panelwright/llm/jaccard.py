"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of hashed ``SHINGLE``-word shingles; two are linked when the Jaccard similarity of their sets is
``THRESHOLD`` or more.  A document of fewer words is one shingle; one without words is linked to nothing.

1. Profile: one pass over the texts gives the set's digest and ``HASHES`` MinHash values.
2. Equal sets are one node; copies are counted, never paired.
3. Candidates share one of ``BANDS`` bands of ``ROWS`` values; a pair at the threshold is missed with a probability of
   (1 - 0.8 ** 4) ** 32 = 5e-8.  Bands that gather the same nodes are compared once.
4. Prune: ``STEP`` values at a time are compared.  A pair is dropped as soon as the posterior probability, under a uniform
   prior, that it reaches the threshold falls below ``TOLERANCE``.
5. Verify: what survives is verified on the whole sets.
6. Links fold to a count per node and a spanning forest per unit; classes are the connected components.

A band with more than ``BLOCK`` nodes, or more than ``BLOCK_SHINGLES`` shingles, is cut into blocks and each pair of blocks is
a unit of its own, so no task holds more than two blocks of one group.  The surviving pairs of a unit travel as positions in
it, or as bits where that is shorter: never more than 512 bytes for a node and unit.  The number of links of a document is part
of the result, so within a group of m different texts that are all alike m * m / 2 pairs are compared.
A pair that shares several bands is treated only in the first, so links are counted once.

Each phase is written to the shared folder, which is where a job restarts after losing executors.

``tolerance=0`` drops no candidate before its sets are compared, which is the measure of what pruning loses.

Defined results: rows with a null id belong to no class; a null text has no words; rows of one id with different texts
are different documents; of several least ids of a class the one whose text's hash is least stays; repeated rows of the one
that stays fold to one; very long texts are compared whole; extra columns are ignored by ``classes`` and kept by
``representatives``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import workers
from panelwright.llm._skew import join_hot
from panelwright.llm._slices import slices
from panelwright.llm._store import discard, keep

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
STEP = 32
TOLERANCE = 1e-7
BLOCK = 2048
BLOCK_SHINGLES = 2_000_000
#: Pairs compared at a time inside a task.
CHUNK_PAIRS = 1 << 16
#: Candidate keys are broadcast to the second pass over the texts up to this count (24 bytes each), joined beyond it.
BROADCAST_ROWS = 200_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_COEFFICIENTS = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]


class _Hashes(dict):
    """Word -> 64-bit hash, bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 100_000:
            self.clear()
        self[word] = value
        return value


_hashes = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = WORD.findall((text or "").lower())
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) == 0:
        return h
    if len(h) < SHINGLE:
        h = np.concatenate((h, np.zeros(SHINGLE - len(h), dtype=np.uint64)))
    n = len(h) - SHINGLE + 1
    mixed = h[:n] * _COEFFICIENTS[0]
    for k in range(1, SHINGLE):
        mixed = mixed + h[k : k + n] * _COEFFICIENTS[k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a set that isn't empty."""
    x = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 4096):
        out = np.minimum(out, (x[None, at : at + 4096] * _A + _B).min(axis=1))
    return out


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For STEP, 2 STEP, .. values: the least matches with which the posterior still reaches the tolerance.

    The posterior of the similarity after m of n matches is Beta(m + 1, n - m + 1); its tail above the threshold is
    P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


# --- on the executors ------------------------------------------------------------------------------------------


def profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        n, twin, sig = [], [], []
        for text in part.column("text").to_pylist():
            s = shingles(text)
            n.append(len(s))
            twin.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sig.append(signature(s).tobytes() if len(s) else b"")
        columns = [part.column("doc_id"), part.column("th"), pa.array(n, pa.int64()), pa.array(twin, pa.binary()), pa.array(sig, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n", "twin", "sig"])


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[list[pd.DataFrame]]:
    """Runs of whole groups of a stream that is sorted by ``key``."""
    rest: pd.DataFrame | None = None
    for frame in batches:
        if not len(frame):
            continue
        frame = frame if rest is None else pd.concat((rest, frame), ignore_index=True)
        keys = frame[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield frame.iloc[:cut]
        rest = frame.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def _pairs(unit: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (a, b) of the pairs of every unit, in chunks."""
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    ends = np.concatenate((starts[1:], [len(unit)]))
    left, right, held = [], [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if low[s] == high[s]:
            if e - s <= 256:
                a, b = np.triu_indices(e - s, 1)
                parts = [(a + s, b + s)]
            else:
                own = np.arange(s, e)
                parts = ((np.full(e - k - 1, k), own[k - s + 1 :]) for k in range(s, e - 1))
        else:
            ours, theirs = np.flatnonzero(block[s:e] == low[s]) + s, np.flatnonzero(block[s:e] == high[s]) + s
            step = max(1, CHUNK_PAIRS // max(1, len(theirs)))
            parts = (
                (np.repeat(ours[k : k + step], len(theirs)), np.tile(theirs, len(ours[k : k + step]))) for k in range(0, len(ours), step)
            )
        for a, b in parts:
            left.append(a)
            right.append(b)
            held += len(a)
            if held >= CHUNK_PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _packed(mates: np.ndarray, size: int) -> bytes:
    """Sorted positions below ``size`` as 16-bit numbers, or as bits where those are shorter (32-bit beyond 65,536)."""
    if size > 65536:
        return b"L" + mates.astype("<u4").tobytes()
    if 16 * len(mates) <= size:
        return b"S" + mates.astype("<u2").tobytes()
    bits = np.zeros(size, dtype=np.uint8)
    bits[mates] = 1
    return b"B" + np.packbits(bits).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    kind = data[:1]
    if kind == b"B":
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=1)))
    return np.frombuffer(data, dtype="<u2" if kind == b"S" else "<u4", offset=1).astype(np.int64)


def prune_batches(batches: Iterator[pd.DataFrame], least: list[int]) -> Iterator[pd.DataFrame]:
    """Rows (unit, pos, node, partners): nodes of surviving pairs with their position in the unit, each pair listed with its
    first node as the position of the other."""
    for frame in _groups(batches, "unit"):
        sig = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint32).reshape(len(frame), HASHES)
        unit, band = frame["unit"].to_numpy(), frame["band"].to_numpy()
        node = frame["node"].to_numpy()
        lefts, rights = [], []
        for a, b in _pairs(unit, frame["block"].to_numpy(), frame["low"].to_numpy(), frame["high"].to_numpy()):
            same = np.zeros(len(a), dtype=np.int64)
            for k, need in enumerate(least):
                cols = slice(k * STEP, (k + 1) * STEP)
                same += (sig[a, cols] == sig[b, cols]).sum(axis=1)
                stay = same >= need
                a, b, same = a[stay], b[stay], same[stay]
            if len(a):
                first = (sig[a] == sig[b]).reshape(len(a), BANDS, ROWS).all(axis=2).argmax(axis=1)
                stay = first == band[a]
                lefts.append(a[stay].astype(np.int32))
                rights.append(b[stay].astype(np.int32))
        if not lefts:
            continue
        a, b = np.concatenate(lefts), np.concatenate(rights)
        if not len(a):
            continue
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        rows = np.unique(np.concatenate((a, b)))
        # positions count from 0 in each unit
        starts = np.flatnonzero(np.concatenate(([True], unit[rows][1:] != unit[rows][:-1])))
        sizes = np.diff(np.concatenate((starts, [len(rows)])))
        pos = np.arange(len(rows)) - np.repeat(starts, sizes)
        other = pos[np.searchsorted(rows, b)]
        begin, end = np.searchsorted(a, rows, "left"), np.searchsorted(a, rows, "right")
        of_unit = np.repeat(sizes, sizes).tolist()
        partners = [_packed(other[x:y], n) for x, y, n in zip(begin.tolist(), end.tolist(), of_unit, strict=True)]
        yield pd.DataFrame({"unit": unit[rows], "pos": pos.astype(np.int32), "node": node[rows], "partners": partners})


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        sets = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])


def verify_batches(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows (node, texts, docs, root) of each unit: links to other sets, to their documents, and the forest's root."""
    for frame in _groups(batches, "unit"):
        out = []
        unit = frame["unit"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(unit)], strict=True):
            part = frame.iloc[s:e].sort_values("pos")
            nodes, copies = part["node"].to_numpy(), part["copies"].to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part["shingles"]]
            sizes = np.array([len(x) for x in sets])
            names, flat = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(sizes)
            begins = ends - sizes
            seen = np.zeros(len(names), dtype=bool)
            texts, docs = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
            parent = list(range(len(nodes)))
            for i, partners in enumerate(part["partners"]):
                js = _unpacked(partners)
                if not len(js):
                    continue
                own = flat[begins[i] : ends[i]]
                seen[own] = True
                shared = np.array([int(np.count_nonzero(seen[flat[begins[j] : ends[j]]])) for j in js.tolist()])
                seen[own] = False
                # J >= t, in whole numbers but for t itself
                linked = js[shared >= threshold * (sizes[i] + sizes[js] - shared) - 1e-9]
                texts[i] += len(linked)
                docs[i] += copies[linked].sum()
                texts[linked] += 1
                docs[linked] += copies[i]
                for j in linked.tolist():
                    a, b = _find(parent, i), _find(parent, j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
            hit = np.flatnonzero(texts)
            out.append(
                pd.DataFrame({"node": nodes[hit], "texts": texts[hit], "docs": docs[hit], "root": [nodes[_find(parent, i)] for i in hit.tolist()]})
            )
        yield pd.concat(out, ignore_index=True)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


# --- plans -----------------------------------------------------------------------------------------------------


def _bands(nodes: DataFrame) -> DataFrame:
    keys = [F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)]
    return nodes.select("node", "n", F.posexplode(F.array(*keys)).alias("band", "key"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for all nodes of ``edges`` (a, b).

    Alternating large-star and small-star steps; each takes one aggregation and one join on the node and is written out.
    The loop ends when a round changes nothing.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(t):
        r = t.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        return (r.n, r.x)

    now = state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, e = e, keep(small.distinct(), "edges")
        discard(old)
        before, now = now, state(e)
        if before == now:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def join(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """``(profile, nodes)``: the first has a row per document, the second a row per distinct set with its links and class.

    The threshold can be raised above ``THRESHOLD``; below it the bands would miss pairs.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"the threshold is {THRESHOLD} or more")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    rows = rows.where("doc_id is not null")
    profile = keep(
        rows.mapInArrow(workers.batches(__name__, "profile_batches"), "doc_id long, th long, n long, twin binary, sig binary"), "profile"
    )
    first = F.min(F.struct("doc_id", "th"))
    nodes = profile.where("n > 0").groupBy("twin", "sig").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    # Written once, so the node numbers hold from here on.
    nodes = keep(nodes.select(F.monotonically_increasing_id().alias("node"), "twin", "sig", "first", "copies", "n"), "nodes")

    bands = _bands(nodes)
    shared = bands.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(node))").alias("members"), F.min("node").alias("least"), F.sum("n").alias("size")
    )
    shared = (
        shared.where("m > 1")
        .groupBy("m", "members", "least", "size")
        .agg(F.min(F.struct("band", "key")).alias("b"))
        .select("m", "size", F.col("b.band").alias("band"), F.col("b.key").alias("key"))
    )
    shared = keep(shared, "shared")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.least(F.ceil(F.col("size") / BLOCK_SHINGLES), F.col("m"))).cast("long")
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))
    units = (
        bands.join(shared, ["band", "key"])
        .withColumn("blocks", blocks)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .select("node", "band", "block", "low", "high", F.xxhash64("band", "key", "low", "high").alias("unit"))
    )
    with_sig = units.join(nodes.select("node", "sig"), "node")
    survivors = keep(
        with_sig.repartition("unit")
        .sortWithinPartitions("unit")
        .mapInPandas(workers.batches(__name__, "prune_batches", needed(threshold, tolerance)), "unit long, pos int, node long, partners binary"),
        "survivors",
    )
    candidates = keep(
        survivors.select("node").distinct().join(nodes.select("node", "first"), "node").select("node", F.col("first.doc_id").alias("d"), F.col("first.th").alias("h")),
        "candidates",
    )
    few = candidates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    picked = rows.join(F.broadcast(candidates) if few else candidates, (F.col("doc_id") == F.col("d")) & (F.col("th") == F.col("h")))
    sets = picked.select("node", "text").mapInArrow(workers.batches(__name__, "set_batches"), "node long, shingles binary")
    # a repeated row would repeat its set
    sets = keep(sets, "sets")
    verified = (
        survivors.join(sets.dropDuplicates(["node"]), "node")
        .join(nodes.select("node", "copies"), "node")
        .repartition("unit")
        .sortWithinPartitions("unit")
        .mapInPandas(workers.batches(__name__, "verify_batches", threshold), "node long, texts long, docs long, root long")
    )
    verified = keep(verified, "verified")
    links = verified.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = nodes.drop("sig", "n").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = keep(linked, "linked")
    classes = linked.groupBy("root").agg(F.min("first").alias("class"))
    classes = keep(linked.join(classes, "root"), "classes")
    # what is left is the profile and the classes; the rest served its purpose
    discard(nodes, shared, survivors, candidates, sets, verified, linked)
    return profile, classes


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A row per document: doc_id, class_id (least id of its component), set_id (least id of its set's copies), n_copies
    (documents of the same set, itself included), n_links (other documents at the threshold or above, copies included)
    and n_set_links (other sets)."""
    profile, nodes = join(docs, doc_id=doc_id, text=text, threshold=threshold, tolerance=tolerance)
    info = nodes.select(
        "twin",
        F.col("class.doc_id").alias("class_id"),
        F.col("first.doc_id").alias("set_id"),
        F.col("copies").alias("n_copies"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_set_links"),
    )
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    out = ("class_id", "set_id", "n_copies", "n_links", "n_set_links")
    linked = join_hot(profile.where("n > 0").select("doc_id", "twin"), info, "twin").select("doc_id", *out)
    alone = profile.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), one.alias("n_copies"), none.alias("n_links"), none.alias("n_set_links"))
    null = F.lit(None).cast("long")
    unnamed = docs.where(F.col(doc_id).isNull()).select(*[null.alias(c) for c in ("doc_id", "class_id", "set_id")], one.alias("n_copies"), none.alias("n_links"), none.alias("n_set_links"))
    return linked.unionByName(alone).unionByName(unnamed)


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the document with the least id, and rows outside any class."""
    profile, nodes = join(docs, doc_id=doc_id, text=text, threshold=threshold)
    key = F.struct("doc_id", "th")
    members = join_hot(profile.where("n > 0").select("doc_id", "th", "twin"), nodes.select("twin", "class"), "twin")
    losers = members.where(key != F.col("class")).select("doc_id", "th").distinct()
    losers = keep(losers.withColumnsRenamed({"doc_id": "__pw_doc", "th": "__pw_text"}), "losers")
    repeated = profile.where("n > 0").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    repeated = keep(repeated.select(F.col("doc_id").alias("__pw_doc"), F.col("th").alias("__pw_text")), "repeated")

    def sized(t):
        return F.broadcast(t) if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else t

    same = (F.col(doc_id) == F.col("__pw_doc")) & (F.xxhash64(F.col(text)) == F.col("__pw_text"))
    stay = docs.join(sized(losers), same, "left_anti")
    if repeated.isEmpty():
        return stay
    once = stay.join(sized(repeated), same, "left_semi").withColumn("__pw_text", F.xxhash64(F.col(text))).dropDuplicates([doc_id, "__pw_text"]).drop("__pw_text")
    return stay.join(sized(repeated), same, "left_anti").unionByName(once)
