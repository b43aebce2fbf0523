"""A Merkle tree over a dataset: a digest per row, a tree per group, a tree over the groups, and proofs.

A leaf is the SHA-256, in hexadecimal, of the row's columns, each written as its length in bytes, a colon and its value, or
``-`` where it is null.  Leaves of a group stand in order; while several nodes remain, every ``ARITY`` consecutive ones
become their digest.  The groups' last nodes, in order of the group, form a tree in the same way; its last node is the root.

A level is a window: partitioned by group and parent index and ordered by index, a ``collect_list`` over the whole frame gives
a run of nodes, which is at once the preimage of the parent and the siblings of each member.  Of the rows below a node
one, the first, carries it to the next level, so parents are counted once.  Windows of ``LEVELS`` levels share one
shuffle, on the group and the index of the ancestor ``LEVELS`` up; a task's unit is ``ARITY ** LEVELS`` leaves however large
the group.  The ancestors are written and climb on as nodes of a table ``ARITY ** LEVELS`` times smaller, and on the
way back each table's paths are joined to those of the table below.  The driver learns the size of the largest group,
nothing else.

Defined results: rows with equal keys in a group are ordered by their leaf, so repeated rows and ties give one tree; null
keys come first; null is a group like any other and comes first; an empty group doesn't exist and an empty table has no rows;
a null text differs from an empty one; very long texts are hashed whole; extra columns don't take part, whatever their
names.  A row without any sibling (one leaf in one group) has the digest of nothing as proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm._rank import ranked
from panelwright.llm._store import keep

ARITY = 3
#: Levels that share a shuffle: 3 ** 4 = 81 nodes are a unit.
LEVELS = 4
UNIT = ARITY**LEVELS
#: Columns of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column | str) -> Column:
    """Lower-case hexadecimal SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: list[Column]) -> Column:
    """Digest of a row, by the values of ``columns``."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def climb(nodes: DataFrame, group: list[str]) -> DataFrame:
    """``LEVELS`` levels over (group, rank, size, node): each row's ``path`` to its ancestor, and ``above`` on the first row of each.

    ``path`` holds, per level that the group has, what stands left and right of the row's own ancestor in its run.
    """
    rows = nodes.withColumn("__pw_unit", F.expr(f"rank div {UNIT}")).withColumn("__pw_h", F.col("node"))
    # every window below, and the join with the paths above, asks for no finer partitioning than this one
    rows = rows.repartition(*group, "__pw_unit")
    steps = []
    for k in range(LEVELS):
        below, span = ARITY**k, ARITY ** (k + 1)
        rows = rows.withColumn("__pw_parent", F.expr(f"rank div {span}"))
        frame = Window.partitionBy(*group, "__pw_unit", "__pw_parent").orderBy("rank")
        frame = frame.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("__pw_run", F.collect_list("__pw_h").over(frame))
        place = F.expr(f"int(rank div {below} % {ARITY})")
        step = F.struct(
            F.concat_ws("", F.slice("__pw_run", F.lit(1), place)).alias("left"),
            F.concat_ws("", F.slice("__pw_run", place + 2, F.lit(ARITY))).alias("right"),
        )
        many = F.col("size") > below
        parent = F.when(many, F.sha2(F.concat_ws("", "__pw_run"), 256)).otherwise(F.col("__pw_h"))
        steps.append(f"__pw_step{k}")
        rows = rows.withColumn(steps[-1], F.when(many, step)).withColumn("__pw_h", F.when(F.col("rank") % span == 0, parent))
    path = F.filter(F.array(*steps), lambda s: s.isNotNull())
    return rows.withColumn("path", path).withColumn("above", F.col("__pw_h")).select(*nodes.columns, "__pw_unit", "path", "above")


def floors(nodes: DataFrame, group: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Written tables of nodes, ``LEVELS`` levels apart, of one tree per group over (group, rank, size, node, ...); the last nodes.

    The last table of nodes has at most ``UNIT`` rows of a group.
    """
    most = nodes.agg(F.max("size")).first()[0] or 0
    tables = [nodes]
    while True:
        at = climb(tables[-1], group).where(F.col("above").isNotNull())
        up = F.expr(f"rank div {UNIT}").alias("rank"), F.expr(f"(size + {UNIT - 1}) div {UNIT}").alias("size")
        ancestors = keep(at.select(*group, *up, F.col("above").alias("node")), "merkle-nodes")
        most = -(-most // UNIT)
        if most <= 1:
            return tables, ancestors.select(*group, "node")
        tables.append(ancestors)


def paths(tables: list[DataFrame], group: list[str], crown: DataFrame) -> DataFrame:
    """Rows of the first table with their ``path`` to the top of their tree and on through ``crown``'s, and its other columns.

    ``crown`` has one row per group.  It is joined to the last table, which holds few rows of any group, and comes down with
    the paths from there, so a large group is never one key of a join.
    """
    top, *lower = reversed(tables)
    carried = [c for c in crown.columns if c not in (*group, "path")]
    crown = crown.withColumnRenamed("path", "__pw_path")
    rows = climb(top, group)
    rows = rows.join(crown, group) if group else rows.crossJoin(F.broadcast(crown))  # without a group the crown is one row
    rows = rows.withColumn("path", F.concat("path", "__pw_path"))
    for table in lower:
        upper = rows.select(*group, F.col("rank").alias("__pw_unit"), F.col("path").alias("__pw_path"), *carried)
        rows = climb(table, group).join(upper, [*group, "__pw_unit"]).withColumn("path", F.concat("path", "__pw_path"))
    return rows.select(*tables[0].columns, *carried, "path")


def manifest(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``path``; ``leaf`` holds the digests, ``group`` a text, ``order`` what orders a group.

    ``path`` is the proof: per level, from the leaf to the root, the digests to the left and to the right.
    """
    # a key that isn't null and sorts as the group does, null first
    named = leaves.withColumn("__pw_key", F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))).withColumnRenamed("leaf", "node")
    placed = keep(ranked(named, ["__pw_key"], [*order, "node"], "merkle-leaves"), "merkle-ranks")
    tables, tops = floors(placed, ["__pw_key"])
    subroots = keep(ranked(tops, [], ["__pw_key"], "merkle-groups"), "merkle-subroots")
    above, last = floors(subroots, [])
    root = last.select(F.col("node").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    crown = paths(above, [], root).select("__pw_key", F.col("node").alias("subroot"), "root", "path")
    return paths(tables, ["__pw_key"], crown).withColumnRenamed("node", "leaf").select(*leaves.columns, "subroot", "root", "path")


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, node, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf's to the root's, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def verify(rows: DataFrame, delivered: Column) -> DataFrame:
    """``rows`` of a manifest with ``folded_root``, from the delivered leaf and the manifest's path, and ``verified``."""
    out = rows.withColumn("folded_root", fold(delivered, F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without its line ends where 2 divides the CRC-32 of the decimal id, else as it is."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and what verifying copies finds, of which every second one has lost its line ends."""
    columns = {c: F.col(c) for c in FIELDS}
    altered = columns | {"text": tampered_text(F.col("doc_id"), F.col("text"))}
    # of the texts, only digests travel
    leaves = keep(
        docs.select(
            "doc_id", "source", leaf(list(columns.values())).alias("leaf"),
            F.when(altered["text"] != F.col("text"), leaf(list(altered.values()))).alias("delivered"),
        ),
        "merkle-digests",
    )
    found = verify(manifest(leaves, "source", ["doc_id"]), F.coalesce("delivered", "leaf"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
