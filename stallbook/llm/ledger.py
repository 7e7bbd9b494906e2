"""Quality rules: every rule is evaluated once into a ledger of failure bits; policies are bit masks over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.functions.text import once
from stallbook.llm.base import WORD, let


@dataclass(frozen=True)
class Rule:
    """Fails where `fails`, SQL over the measurements, holds. Its bit never changes and is never given anew."""

    bit: int
    name: str
    fails: str


#: Integer comparisons only, so that every engine gives the same bits.
RULES = [
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 12 * n_words"),
    Rule(5, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(6, "few_letters", "100 * n_letter_words < 80 * n_words"),
    Rule(7, "shouting", "100 * n_upper_words > 50 * n_words"),
    Rule(8, "exclaiming", "100 * n_marks > 50 * n_words"),
    Rule(9, "bullets", "100 * n_bullets > 90 * n_lines and n_lines > 1"),
]


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force: a document is kept if none of their bits is set."""

    version: int
    rules: tuple[str, ...]

    def mask(self, rules: list[Rule]) -> int:
        return sum(1 << r.bit for r in rules if r.name in self.rules)


BASE = Policy(1, ("few_words", "repeated_words"))
CURRENT = Policy(2, tuple(r.name for r in RULES))

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_upper_words", "n_marks", "n_bullets"]


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, hashed=F.xxhash64) -> Column:
    """How many words lie in windows of three words that occur at least twice in the array.

    The windows are sorted by hash, the position packed into the low bits, and neighbours with equal hashes are
    compared word by word: n log n in place of a pair of loops, and no rows leave the document. Where neighbours
    with one hash differ, the windows of that document are sorted by their words instead.
    """
    def neighbours(order: Column, twins) -> Column:
        return F.zip_with(F.slice(order, 1, F.size(order) - 1), F.slice(order, 2, F.size(order) - 1), twins)

    def spread(i: Column, j: Column) -> Column:
        return F.array(i, i + 1, i + 2, j, j + 1, j + 2)

    none = F.array().cast("array<int>")

    def by_words(n: Column) -> Column:
        window = lambda i: F.struct(words[i - 1].alias("a"), words[i].alias("b"), words[i + 1].alias("c"), i.alias("at"))
        order = F.sort_array(F.transform(F.sequence(F.lit(1), n.cast("int") - 2), window))
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return let(order, lambda o: F.flatten(neighbours(o, lambda x, y: F.when(same(x, y), spread(x["at"], y["at"])).otherwise(none))))

    def counted(n: Column) -> Column:
        low = F.length(F.bin(n)).cast("int")
        place = F.expr("0L")

        def packed(low: Column) -> Column:
            hashes = F.transform(F.sequence(F.lit(1), n.cast("int") - 2), lambda i: _shift(hashed(
                words[i - 1], words[i], words[i + 1]), low).bitwiseOR(i.cast("long")))
            return F.sort_array(hashes)

        def covered(order: Column, low: Column) -> Column:
            at = lambda x: (x - _shift(x, low)).cast("int")  # noqa: E731  the position, from 1

            def twins(x: Column, y: Column) -> Column:
                i, j = at(x), at(y)
                alike = (words[i - 1] == words[j - 1]) & (words[i] == words[j]) & (words[i + 1] == words[j + 1])
                met = _shift(x, low) == _shift(y, low)
                return F.when(met & alike, spread(i, j)).when(met, F.lit(None)).otherwise(none)

            # A null among the parts makes the whole null: two windows under one hash.
            return let(F.flatten(neighbours(order, twins)), lambda found: F.size(F.array_distinct(
                F.when(found.isNull(), by_words(n)).otherwise(found))).cast("long"))

        return F.when(n >= 4, let(low, lambda bits: let(packed(bits), lambda order: covered(order, bits)))).otherwise(place)

    return let(F.size(words).cast("long"), counted)


def _shift(x: Column, low: Column) -> Column:
    """x with its low bits cleared."""
    return F.call_function("shiftleft", F.call_function("shiftright", x, low), low)


def ledger(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the measurements, failed BIGINT): bit r.bit of `failed` is set if rule r fails.

    Words are runs of non-blank characters of the whole text. Null and empty texts have no words and fail what
    asks for words. Rows that repeat an id, and null ids, get a row each. An empty table gives no rows. Other columns
    are not read. Everything is measured inside the row: there is no shuffle.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), once(F.struct(
        value.alias("text"),
        F.regexp_extract_all(value, F.lit(WORD), 0).alias("words"),
        F.filter(F.split(value, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))).alias("d"))
    words, lines = F.col("d.words"), F.col("d.lines")
    part = lambda keep: F.size(F.filter(words, keep)).cast("long")
    rows = rows.select("doc_id", once(F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _count(F.col("d.text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        part(lambda w: w.rlike(r"[\p{L}\p{M}]")).alias("n_letter_words"),
        part(lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1)).alias("n_upper_words"),
        _count(F.col("d.text"), "!").cast("long").alias("n_marks"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long").alias("n_bullets"),
    )).alias("m")).select("doc_id", "m.*")
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), 1 << rule.bit).otherwise(0).cast("long"))
    return rows.withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: Policy, rules: list[Rule] = RULES, name: str = "kept") -> DataFrame:
    """The ledger with a verdict under a policy; other versions can be applied to the same ledger without a new scan."""
    return rows.withColumn(name, F.col("failed").bitwiseAND(policy.mask(rules)) == 0)


def ablations(rows: DataFrame, policy: Policy, rules: list[Rule] = RULES) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): per rule of the policy, how many documents fail it, how many only it,
    and how many would be kept without it.

    The ledger is first summed by its bits, at most 2 ** rules rows, and the rules are then read off these.
    """
    mask = policy.mask(rules)
    sums = rows.groupBy(F.col("failed").bitwiseAND(mask).alias("bits")).count()
    named = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in policy.rules))
    each = sums.select("bits", "count", F.explode(named).alias("r")).select("bits", "count", "r.*")
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    total = lambda where: F.sum(F.when(where, F.col("count")).otherwise(0)).alias
    return each.groupBy("rule").agg(total(hit)("n_failed"), total(hit & (rest == 0))("n_only"), total(rest == 0)("n_kept_without"))
