"""Hilbert-curve sharding: rows that are near in several metadata dimensions share a shard.

Each dimension is quantised to at most ``2 ** bits`` levels, the levels give the row's index on a Hilbert curve, and
the curve is cut into runs of equal row counts.  A shard then covers a small box of every dimension.  Levels keep the
dimension's order: they are cut at quantiles of the sizes and of the labels themselves, so a shard's least and greatest label prune
files whatever the labels look like.  A label's quantiles come from counts per distinct label, sorted by ranges and summed up
over the ranges; only the cuts reach the driver.

The global order needs no total sort and no single-partition window over rows: counts per curve cell (at most
``2 ** (bits * dimensions)`` of them, a bound by parameter) are summed up along the curve; a row's rank is its
cell's offset plus its rank in the cell.  A cell that holds more than ``1 / SPLIT`` of all rows, or more than
``PIECE_ROWS``, is cut into pieces by a salted hash of the row, so a hot source, a large group of copies and one repeated row
spread over many tasks.  Inside a cell rows have no order of their own: it is the curve's finest step.

DataFrame functions only.  Defined results: a null label comes before all others; a null text counts 0 bytes and has
the CRC of the empty string; a null key is kept like any other; repeated rows each get a slot; a very long text is one row;
an empty table gives an empty result; columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm._native import let
from panelwright.llm._skew import place
from panelwright.llm._store import discard, keep

#: A cell with more than this share of all rows, or more rows than ``PIECE_ROWS``, is cut into pieces.
SPLIT = 400
PIECE_ROWS = 500_000
#: Parts into which equal rows may fall.
SALTS = 1 << 16
#: Bytes that every row counts besides its text.
ROW_BYTES = 16
#: Quantiles of sizes are right to one part in this many.
ACCURACY = 10_000


def label_key(label: Column) -> Column:
    """A text in the order of the labels, null before all of them."""
    return F.coalesce(F.concat(F.lit("1"), label.cast("string")), F.lit(""))


def label_cuts(docs: DataFrame, labels: tuple[str, ...], parts: int) -> list[list[str]]:
    """Per label the keys, fewer than ``parts``, at which a ``parts``-th of the rows has gone by: exact weighted quantiles."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), label_key(F.col(c)).alias("k")) for i, c in enumerate(labels)]))
    counts = keep(docs.select(each.alias("_l")).groupBy("_l.i", "_l.k").agg(F.count(F.lit(1)).alias("n")), "label-counts")
    ranges = keep(counts.repartitionByRange("i", "k").withColumn("part", F.spark_partition_id()), "label-ranges")
    before, total = [], [0] * len(labels)
    for r in ranges.groupBy("i", "part").agg(F.sum("n").alias("n")).orderBy("i", "part").collect():  # no more rows than ranges and labels
        before.append((r.i, r.part, total[r.i]))
        total[r.i] += r.n
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "i int, part int, b long"))
    whole = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(total)), "i int, a long"))
    line = Window.partitionBy("i", "part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("b") + F.coalesce(F.sum("n").over(line), F.lit(0))
    steps = lambda rows: F.ceil(rows * parts / F.col("a"))
    cut = ranges.join(offsets, ["i", "part"]).join(whole, "i").select("i", "k", steps(here).alias("from"), steps(here + F.col("n")).alias("to"))
    out: list[list[str]] = [[] for _ in labels]
    for r in cut.where(F.greatest(F.col("from"), F.lit(1)) < F.col("to")).orderBy("i", "k").collect():
        out[r.i].append(r.k)
    discard(counts, ranges)
    return out


def level(code: Column, cuts: list, bits: int) -> Column:
    """Level of a size or a label's key: how many cuts it has reached, spread over all levels."""
    at = place(F.array(*[F.lit(c).cast("long") if isinstance(c, int) else F.lit(c) for c in cuts]), len(cuts), code).cast("long")
    return F.floor(at * (1 << bits) / (len(cuts) + 1)).cast("long")


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve through the grid of ``levels``, each below ``2 ** bits``.

    The axes are turned into the transposed index by folds over the (bit plane, axis) steps, which keeps
    the expression's size independent of ``bits``: undo the reflections and exchanges of each plane from the
    top, Gray-encode, then interleave the bits.
    """
    n = len(levels)
    if n < 2 or bits < 1 or n * bits > 62:
        raise ValueError("two dimensions or more, and at most 62 bits in all")
    planes = [(1 << b, axis) for b in range(bits - 1, 0, -1) for axis in range(n)]

    def turn(x, step):
        q, axis = step["q"], step["axis"]
        low = q - 1
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, axis)).bitwiseAND(low)
        flip = F.get(x, axis).bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, j: F.when(flip, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
                F.when((j == 0) | (j == axis), v.bitwiseXOR(F.when(axis == 0, F.lit(0).cast("long")).otherwise(swap))).otherwise(v)
            ),
        )

    steps = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(a).alias("axis")) for q, a in planes])
    axes = F.array(*levels)
    turned = F.aggregate(steps, axes, turn) if planes else axes

    def gray(x):
        return F.transform(
            x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0).cast("long"), lambda a, y: a.bitwiseXOR(y))
        )

    def settle(x):
        last = F.get(x, F.lit(n - 1))
        t = F.aggregate(
            F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>"),
            F.lit(0).cast("long"),
            lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a),
        )
        return let(t, lambda k: F.transform(x, lambda v: v.bitwiseXOR(k)))

    def interleave(x):
        total = F.lit(0).cast("long")
        for b in range(bits):
            for j in range(n):
                bit = F.shiftright(F.get(x, F.lit(j)), b).bitwiseAND(F.lit(1).cast("long"))
                total = total.bitwiseOR(F.shiftleft(bit, b * n + (n - 1 - j)))
        return total

    return let(turned, lambda a: let(gray(a), lambda g: let(settle(g), interleave)))


def shards(
    docs: DataFrame,
    n_shards: int,
    *,
    key: str = "doc_id",
    text: str = "text",
    labels: tuple[str, ...] = ("lang", "source"),
    bits: int = 4,
) -> DataFrame:
    """``key``, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) and the curve index of every row.

    Shards differ by one row at most.  ``slot`` counts from 0 in each shard along the curve.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(body).cast("long") + F.lit(ROW_BYTES)
    cuts = label_cuts(docs, labels, 1 << bits)
    # About 60 bytes a row: the texts are read once, not once for each use below.
    rows = keep(
        docs.select(
            F.col(key),
            size.alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            *[level(label_key(F.col(c)), q, bits).alias(f"_c{i}") for i, (c, q) in enumerate(zip(labels, cuts, strict=True))],
            F.xxhash64(F.col(key), body).alias("_h"),
            F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_salt"),
        ),
        "shard-codes",
    )
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    sizes = sorted(set(rows.agg(F.percentile_approx("size", shares, ACCURACY)).first()[0] or []))
    levels = [*(F.col(f"_c{i}") for i in range(len(labels))), level(F.col("size"), sizes, bits)]
    rows = rows.select(key, "size", "text_crc32", "_h", "_salt", hilbert_index(levels, bits).alias("curve"))
    per_cell = rows.groupBy("curve").agg(F.count(F.lit(1)).alias("_n"))
    # One row per curve cell at most: 2 ** (bits * dimensions), whatever the size of the table.
    whole = Window.partitionBy(F.lit(0))
    cells = per_cell.select("curve", F.sum("_n").over(whole).alias("_all"), "_n").select(
        "curve",
        "_all",
        F.greatest(F.ceil(F.col("_n") * SPLIT / F.col("_all")), F.ceil(F.col("_n") / PIECE_ROWS)).cast("long").alias("_pieces"),
    )
    placed = rows.join(F.broadcast(cells), "curve").withColumn("_piece", F.pmod(F.xxhash64("_h", "_salt"), F.col("_pieces")))
    per_piece = placed.groupBy("curve", "_piece", "_all").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(F.lit(0)).orderBy("curve", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_piece.select("curve", "_piece", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("curve", "_piece").orderBy("_h", key, "_salt")
    rank = F.col("_before") + F.row_number().over(inside) - 1
    return (
        placed.join(F.broadcast(offsets), ["curve", "_piece"])
        .withColumn("_rank", rank)
        .withColumn("shard", F.expr(f"int(_rank * {n_shards} div _all)"))
        .select(
            key,
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            # the first rank of shard s is the least r with r * n_shards >= s * all
            (F.col("_rank") - F.expr(f"(shard * _all + {n_shards - 1}) div {n_shards}")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "curve",
        )
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as Parquet, a folder per shard, each in the order of the curve.

    ``assigned`` is what ``shards`` gave for these rows.  Rows of one key are told apart by their text's size and CRC; rows
    that are equal in all of it lie together.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    names = {"size": F.octet_length(body).cast("long") + F.lit(ROW_BYTES), "text_crc32": F.crc32(F.encode(body, "UTF-8"))}
    plan = assigned.groupBy(F.col(key).alias("_k"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc")).agg(F.min(F.struct("shard", "slot")).alias("_at"))
    marked = docs.drop("shard", "slot").withColumn("_size2", names["size"]).withColumn("_crc2", names["text_crc32"])
    same = marked[key].eqNullSafe(plan["_k"]) & (F.col("_size2") == F.col("_size")) & (F.col("_crc2") == F.col("_crc"))
    (
        marked.join(plan, same)
        .select(*[c for c in docs.columns if c not in ("shard", "slot")], F.col("_at.shard").alias("shard"), F.col("_at.slot").alias("slot"))
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
