"""Rule bitmask ledger: every quality rule is evaluated once per document.

``ledger`` adds the measurements and ``fail_bits``, one bit per failed rule.  A policy is a versioned set of
rules, i.e. a mask: ``apply_policy`` keeps a document when ``fail_bits & mask`` is 0, so a new policy never
reads the text again.  ``ablation`` tells what each rule costs a policy by bitwise aggregation over the ledger.

``store`` writes the ledger under the rules' version, and policies and ablations go on from there.

Everything is a DataFrame expression: one scan, no shuffle of rows, no Python on the executors.

Defined results: a null text measures like an empty one; a row with a null id is judged like any other; equal rows are measured row by
row; a very long text is measured whole; a column of the input that clashes with an added one is replaced by it; an empty table
gives an empty ledger.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm._native import let, numbers

#: White space that parts words.  Fixed values.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; ``bit`` is the rule's place in the ledger."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a changed rule gets a new bit, so old ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
)

#: Version -> names of the rules that it enforces.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def _covered(starts: Column) -> Column:
    """Words under windows that begin at the sorted ``starts``."""

    def gap(start, k):
        return F.coalesce(F.least(F.get(starts, k + 1) - start, F.lit(WINDOW)), F.lit(WINDOW))

    return F.aggregate(F.transform(starts, gap), F.lit(0), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    """Words in ``WINDOW``-word windows that occur twice or more in the text."""

    def windows(hashes):
        at = numbers(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def repeated(grams):
        def starts(ordered):
            twice = F.filter(
                ordered,
                lambda x, k: F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(ordered, F.greatest(k - 1, F.lit(0)))["h"] == x["h"], F.lit(False)) & (k > 0),
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(
            let(ordered, lambda o: let(starts(o), _covered))
        )

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), repeated))
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of ``MEASURES`` (long) to every row."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def of(t):
        def both(words, lines):
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(t, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).cast("long").alias("n_repeat_words"),
                F.size(lines).cast("long").alias("n_lines"),
            )

        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
        return let(_words(t), lambda w: let(lines, lambda x: both(w, x)))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*MEASURES, "__pw_measures")]
    return docs.select(*kept, let(whole, of).alias("__pw_measures")).select(
        *kept, *[F.col("__pw_measures")[m].alias(m) for m in MEASURES]
    )


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements of every document and ``fail_bits`` (long), the rules that it fails."""
    if len({r.bit for r in rules}) != len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own from 0 to 62")
    measured = measure(docs.drop("fail_bits"), text)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def version(rules: tuple[Rule, ...] = RULES) -> str:
    """Digest of what the rules are; ledgers of other rules have other versions."""
    return hashlib.sha256(json.dumps([[r.name, r.bit, r.fails] for r in rules]).encode()).hexdigest()[:16]


def store(docs: DataFrame, folder: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Evaluate the rules once, write the ledger without its texts under ``folder`` and the rules' version, and return it.

    A version that is stored already is not overwritten: Spark raises.
    """
    book = ledger(docs, text, rules).drop(text)
    path = f"{folder.rstrip('/')}/rules-{version(rules)}"
    book.write.mode("errorifexists").parquet(path)
    return docs.sparkSession.read.schema(book.schema).parquet(path)


def stored(spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger that ``store`` wrote for these rules: policies and ablations of it read no text."""
    return spark.read.parquet(f"{folder.rstrip('/')}/rules-{version(rules)}")


def mask(policy: str, rules: tuple[Rule, ...] = RULES, policies: dict = POLICIES) -> int:
    """The rule bits that a policy enforces."""
    by_name = {r.name: r.bit for r in rules}
    return sum(1 << by_name[n] for n in policies[policy])


def apply_policy(book: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES, policies: dict = POLICIES) -> DataFrame:
    """Add ``policy`` (its version) and ``kept``."""
    bits = F.lit(mask(policy, rules, policies)).cast("long")
    return book.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("fail_bits").bitwiseAND(bits) == 0)


def ablation(book: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES, policies: dict = POLICIES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that stay if it is dropped.

    One aggregation whose groups are the distinct failure masks, at most ``2 ** len(rules)`` rows; the
    figures of all rules come from those counts.
    """
    whole = mask(policy, rules, policies)
    masks = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    named = [r for r in rules if r.name in policies[policy]]
    each = F.explode(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in named])
    )
    bit = F.col("r.bit")
    return (
        masks.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0, F.col("n")).otherwise(0)).alias(
                "n_kept_without"
            ),
        )
    )


def with_ablation(book: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES, policies: dict = POLICIES) -> DataFrame:
    """Add ``sole_rule``, the only rule of the policy that a document fails (null for none or several), and ``n_sole`` (long),
    how many documents come back if that rule is dropped.  The joined table has a row per rule."""
    here = F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules, policies)).cast("long"))
    sole = F.lit(None).cast("string")
    for r in rules:
        if r.name in policies[policy]:
            sole = F.when(here == (1 << r.bit), F.lit(r.name)).otherwise(sole)
    effect = ablation(book, policy, rules, policies).select(F.col("rule").alias("sole_rule"), F.col("n_failed_alone").cast("long").alias("n_sole"))
    return book.withColumn("sole_rule", sole).drop("n_sole").join(F.broadcast(effect), "sole_rule", "left")
