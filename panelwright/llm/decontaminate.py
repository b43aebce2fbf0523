"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed to ``K``-grams.  Of every ``W`` consecutive k-grams the one with the
least hash is a fingerprint, so any shared span of ``K + W - 1`` words holds a fingerprint that both sides
selected.  Fingerprints are joined, and each hit is extended word by word along its diagonal; only a run of at
least ``WINDOW`` equal words counts, so a fingerprint alone never marks a document.

An item of fewer than ``WINDOW`` words is one window of its own length.  Winnowing can't promise to select a
k-gram in so short a span, so for each such length that occurs every document window of that length is a
fingerprint.

One scan of the documents.  A fingerprint carries its ``2 * W + K - 2`` neighbouring word hashes, which is all
that the extension needs, so no text is shuffled.  The benchmark's fingerprints are written once, a row of at most 200
bytes each; the items that hold them are joined to the hits alone, by the fingerprint's number.

Up to ``BROADCAST_ROWS`` fingerprints are broadcast.  Beyond, both sides are shuffled, and up to ``FILTER_GRAMS`` distinct
grams of the benchmark go ahead to drop the document rows that can't match before they are.

DataFrame functions only.  Words are compared by 64-bit hashes, ten in a row at least.

Defined results: a null or wordless text has no words, and neither hits nor is hit; a null document id is returned like any
other; documents of the same id and text are judged alike and each is returned; rows of one id with different texts are judged one
by one; repeated benchmark items count once; the words of an item with a null id hit, but it isn't named, so ``n_items`` and
``item_ids`` leave it out; an empty benchmark hits nothing; extra columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm._native import let, lower_ascii, numbers
from panelwright.llm._store import keep

WINDOW = 10
K = 5
W = WINDOW - K + 1
#: Separators of words, after A-Z were lower-cased.  Fixed values.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A benchmark with more fingerprints than this is joined by a shuffle.  200 bytes a row: 100 MB.
BROADCAST_ROWS = 500_000
#: Up to this many distinct grams, 8 bytes each and some 30 in the hash table, go ahead of that shuffle.
FILTER_GRAMS = 4_000_000


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)
    return let(
        parts,
        lambda p: F.when(
            (F.element_at(p, 1) == "") | (F.element_at(p, -1) == ""), F.filter(p, lambda w: w != "")
        ).otherwise(p),
    )


def _around(hashes: Column, at: Column, before: int, count: int) -> Column:
    """``count`` word hashes from ``at - before`` on; null beyond either end."""
    inside = (at >= before) & (at - before + count <= F.size(hashes))
    return F.when(inside, F.slice(hashes, F.greatest(at - before, F.lit(0)) + 1, count)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.when(at - before + i >= 0, F.get(hashes, F.greatest(at - before + i, F.lit(0)))))
    )


def _gram(hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(hashes, at + k) for k in range(n)])


def _winnowed(hashes: Column) -> Column:
    """Selected k-grams: ``[(len, at, gram, ctx)]``.  All equal least hashes of a window are selected, so
    the choice doesn't depend on what stands around a shared span."""

    def select(grams):
        def least(i):
            return F.least(*[F.get(grams, i + k) for k in range(W)])

        def chosen(lows):
            # a k-gram is the least of some window iff it equals the largest of the minima that cover it
            def top(i):
                return F.greatest(*[F.get(lows, F.greatest(i - k, F.lit(0))) if k else F.get(lows, i) for k in range(W)])

            spots = F.filter(numbers(F.lit(0), F.size(grams) - 1), lambda i: F.get(grams, i) == top(i))
            return F.transform(
                spots,
                lambda i: F.struct(
                    F.lit(0).alias("len"), i.alias("at"), F.get(grams, i).alias("gram"), _around(hashes, i, W - 1, 2 * (W - 1) + K).alias("ctx")
                ),
            )

        return let(F.transform(numbers(F.lit(0), F.size(grams) - W), least), chosen)

    grams = F.transform(numbers(F.lit(0), F.size(hashes) - K), lambda i: _gram(hashes, i, K))
    return F.when(F.size(hashes) >= WINDOW, let(grams, select)).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<len:int,at:int,gram:bigint,ctx:array<bigint>>>")


def _short(hashes: Column, n: int) -> Column:
    """Every window of ``n`` words."""
    return F.transform(
        numbers(F.lit(0), F.size(hashes) - n),
        lambda i: F.struct(F.lit(n).alias("len"), i.alias("at"), _gram(hashes, i, n).alias("gram"), F.slice(hashes, i + 1, n).alias("ctx")),
    )


def _run(left: Column, right: Column, start: int, step: int) -> Column:
    """Equal words from ``start`` on in the direction of ``step``, up to the end of the context."""
    end = 2 * (W - 1) + K if step > 0 else -1
    total = F.lit(0)
    for i in reversed(range(start, end, step)):
        same = F.coalesce(F.get(left, F.lit(i)) == F.get(right, F.lit(i)), F.lit(False))
        total = F.when(same, total + 1).otherwise(F.lit(0))
    return total


def benchmark_prints(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(len, gram, ctx, print, item): fingerprints of the benchmark, numbered, with each item that holds them."""
    hashed = items.select(
        F.col(item_id).cast("string").alias("item"), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("hs")
    ).withColumn("n", F.size("hs"))
    prints = _winnowed(F.col("hs"))
    for n in range(1, WINDOW):
        prints = F.when(F.col("n") == n, _short(F.col("hs"), n)).otherwise(prints)
    found = hashed.select("item", F.explode(prints).alias("f")).select("item", "f.len", "f.gram", "f.ctx").distinct()
    return found.withColumn("print", F.xxhash64("len", "gram", "ctx"))


def contamination(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids (sorted array), spans (hit runs), contaminated."""
    named = keep(benchmark_prints(items, item_id, item_text), "benchmark-prints")
    prints = named.select(F.col("len").alias("item_len"), F.col("gram").alias("item_gram"), F.col("ctx").alias("item_ctx"), "print").distinct()
    small = prints.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # at most WINDOW - 1 rows
    lengths = sorted(r.len for r in named.where("len > 0").select("len").distinct().collect())

    def fingerprints(hashes, key):
        found = [_winnowed(hashes), *[_short(hashes, n) for n in lengths]]
        size = F.struct(F.lit(-1).alias("len"), F.size(hashes).alias("at"), key.alias("gram"), F.lit(None).cast("array<bigint>").alias("ctx"))
        return F.concat(F.array(size), *found)

    # The row with len -1 carries the number of words, so documents without a hit stay.  It joins nothing; its
    # gram is the text's hash, which spreads these rows when the join is a shuffle.
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("body"))
    rows = rows.select(
        "doc",
        "text_key",
        F.explode(let(F.transform(words(F.col("body")), lambda w: F.xxhash64(w)), lambda h: fingerprints(h, F.col("text_key")))).alias("f"),
    ).select("doc", "text_key", "f.len", "f.at", "f.gram", "f.ctx")
    if not small:
        grams = prints.select(F.col("item_gram").alias("known")).distinct()
        if grams.limit(FILTER_GRAMS + 1).count() <= FILTER_GRAMS:
            rows = rows.join(F.broadcast(grams), F.col("gram") == F.col("known"), "left").where("len = -1 or known is not null").drop("known")
    size = W - 1
    left, right = _run(F.col("ctx"), F.col("item_ctx"), size - 1, -1), _run(F.col("ctx"), F.col("item_ctx"), size + K, 1)
    same = F.slice("ctx", size + 1, K) == F.slice("item_ctx", size + 1, K)
    hits = (
        rows.join(F.broadcast(prints) if small else prints, (F.col("gram") == F.col("item_gram")) & (F.col("len") == F.col("item_len")), "left")
        .where("len = -1 or item_gram is not null")
        .withColumn("left", F.when(F.col("len") == 0, left))
        .withColumn("right", F.when(F.col("len") == 0, right))
    )
    long_run = (F.col("len") == 0) & same & (F.col("left") + F.col("right") + K >= WINDOW)
    short_run = (F.col("len") > 0) & (F.col("ctx") == F.col("item_ctx"))
    head = F.col("len") == -1
    a = F.when(F.col("len") == 0, F.col("at") - F.col("left")).otherwise(F.col("at"))
    b = F.when(F.col("len") == 0, F.col("at") + K + F.col("right")).otherwise(F.col("at") + F.col("len"))
    # Equal rows and repeats of a passage in a document fold on the map side.
    joined = (
        hits.where(head | long_run | short_run)
        .select("doc", "text_key", "len", "at", a.alias("a"), b.alias("b"), "print")
        .groupBy("doc", "text_key")
        .agg(
            F.max(F.when(head, F.col("at"))).alias("n_words"),
            F.sum(head.cast("long")).alias("copies"),
            F.collect_set(F.when(~head, F.struct("a", "b"))).alias("runs"),
            F.collect_set(F.when(~head, F.col("print"))).alias("prints"),
        )
    )
    # The items of the hits: rows of documents that are hit only.
    few_names = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    names = named.where("item is not null").select("print", "item").distinct()
    joined = keep(joined, "benchmark-hits")
    hit = joined.where(F.size("prints") > 0).select("doc", "text_key", F.explode("prints").alias("print"))
    listed = (
        hit.join(F.broadcast(names) if few_names else names, "print")
        .groupBy(F.col("doc").alias("hit_doc"), F.col("text_key").alias("hit_key"))
        .agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )
    same_row = F.col("doc").eqNullSafe(F.col("hit_doc")) & F.col("text_key").eqNullSafe(F.col("hit_key"))
    clean = joined.where(F.size("prints") == 0).withColumn("item_ids", F.array().cast("array<string>"))
    marked = joined.where(F.size("prints") > 0).join(listed, same_row, "left").drop("hit_doc", "hit_key")
    joined = clean.unionByName(marked).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))

    # a run is shorter than two windows, so its positions are as many as its words
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["a"], r["b"] - 1)))))

    def spans(at):
        """Sorted disjoint runs, from the sorted positions."""
        first = F.filter(at, lambda p, i: (i == 0) | (F.get(at, F.greatest(i - 1, F.lit(0))) != p - 1))
        last = F.filter(at, lambda p, i: F.coalesce(F.get(at, i + 1) != p + 1, F.lit(True)))
        return F.zip_with(first, last, lambda x, y: F.struct(x.alias("a"), (y + 1).alias("b")))

    return joined.withColumn("hit_places", places).select(
        F.col("doc").alias(doc_id),
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hit_places").cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        let(F.col("hit_places"), spans).alias("spans"),
        (F.size("runs") > 0).alias("contaminated"),
        "text_key",
    )
