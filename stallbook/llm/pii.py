"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.functions.text import once
from stallbook.llm.base import let

#: How many characters before and after a span are read for context, and the least score of a span of the added kinds.
NEARBY = 40
LEAST_SCORE = 0.5


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Is the Luhn sum of a string of digits divisible by ten?"""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(
        d.cast("int") * (F.lit(1) + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(account: Column) -> Column:
    """Is an account number, its first four characters put last and letters read as 10 to 35, 1 modulo 97?"""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: let(F.conv(c, 36, 10).cast("int"), lambda v: F.when(
        v < 10, a * 10 + v).otherwise(a * 100 + v) % 97)) == 1


def _confirmed_card(match: Column) -> Column:
    return let(digits_of(match), lambda d: F.length(d).between(13, 19) & F.when(F.length(d) <= 19, luhn(d)).otherwise(False))


#: Characters of an account number (ISO 13616) by country.
ACCOUNT_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "VG": 24, "XK": 20,
}


def account_pattern() -> str:
    """Account numbers end where their country's length says, whatever capitals come next."""
    lengths = sorted(set(ACCOUNT_LENGTHS.values()))
    each = ("(?:" + "|".join(c for c, n in ACCOUNT_LENGTHS.items() if n == length) + rf")[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length in lengths)
    return rf"\b(?:{'|'.join(each)})\b"


def _confirmed_account(match: Column) -> Column:
    return mod_97(F.replace(match, F.lit(" "), F.lit("")))


def _confirmed_address(match: Column) -> Column:
    return F.forall(F.split(match, "[.]"), lambda x: x.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


@dataclass(frozen=True)
class Kind:
    """What a kind of span looks like and what confirms it.

    The patterns of base kinds are possessive and start at the first character of a run, which finds the same leftmost matches in
    time linear in the text. `needs` is a cheap test before the search. A confirmed checksum gives 0.4 over the
    0.4 of a pattern, a word of `context` nearby 0.2. Spans of base kinds stay at any score.
    """

    name: str
    pattern: str
    needs: str
    confirmed: Callable[[Column], Column]
    checksum: bool
    context: str
    base: bool = True


NUMBER_WORDS = "(?i)passport|social security|ssn|tax id|driving licen|national id|identity card|ausweis|pasaporte|passeport"
SECRET_WORDS = "(?i)api.?key|access.?key|token|secret|password|bearer"

KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), False, "(?i)mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _confirmed_address, False, r"(?i)\bip\b|address|server|host"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _confirmed_card, True, "(?i)card|visa|credit|payment|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(digits_of(m)).between(9, 15), False, r"(?i)phone|call|\btel|mobile|fax"),
    Kind("iban", account_pattern(), "", _confirmed_account, True, "(?i)iban|account|bank|konto|compte|cuenta", False),
    # No checksum: only a word nearby makes these personal data.
    Kind("number", r"\b(?:[A-Z]{0,3}[0-9]{6,12}|[0-9]{3}-[0-9]{2}-[0-9]{4})\b", "", lambda m: F.lit(True), False, NUMBER_WORDS, False),
    Kind("secret", r"\b[A-Za-z0-9_]{16,64}\b", "", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), False, SECRET_WORDS, False),
]


def _found(text: Column, kind: Kind) -> Column:
    """All matches with their place in code points: the pieces between matches give the distances."""
    def placed(hits: Column) -> Column:
        between = F.slice(F.split(text, kind.pattern, -1), 1, F.size(hits))
        empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
        steps = F.zip_with(between, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
        return F.aggregate(
            steps, F.struct(F.lit(0).alias("at"), empty.alias("spans")),
            lambda a, s: F.struct(
                (a["at"] + s["gap"] + F.length(s["hit"])).alias("at"),
                F.concat(a["spans"], F.array(F.struct(
                    (a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + F.length(s["hit"])).alias("end"), s["hit"].alias("match")))).alias("spans")),
            lambda a: a["spans"])

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), 0), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none) if kind.needs else found


def _scored(text: Column, kind: Kind) -> Column:
    near = lambda s: F.concat(
        F.substring(text, F.greatest(s["start"] - NEARBY + 1, F.lit(1)), F.least(s["start"], F.lit(NEARBY))), F.lit(" "),
        F.substring(text, s["end"] + 1, F.lit(NEARBY)))
    spans = F.filter(_found(text, kind), lambda s: kind.confirmed(s["match"]))
    spans = F.transform(spans, lambda s: F.struct(
        F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind.base).alias("base"),
        (F.lit(0.8 if kind.checksum else 0.4) + F.when(near(s).rlike(kind.context), 0.2).otherwise(0.0)).alias("score")))
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)


def all_spans(text: Column, kinds: list[Kind] = KINDS) -> Column:
    """Array of (kind, start, end, base, score), by kind as listed and then by start; code points, end exclusive."""
    return F.concat(*(_scored(text, kind) for kind in kinds))


def find_spans(docs: DataFrame, kinds: list[Kind] = KINDS, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """The rows with the array `into` of all personal data in the whole text.

    Per kind the leftmost matches that do not overlap are proposed; those that fail their check are dropped and not
    tried again from a later place. Null and empty texts have none. Each row is read alone: nothing is shuffled, and
    repeated rows, null ids, empty tables and further columns pass as they are. A column named `into` is replaced.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != into]
    return docs.select(*others, once(all_spans(F.coalesce(F.col(text), F.lit("")), kinds)).alias(into))


def redact(docs: DataFrame, kinds: list[Kind] = KINDS, text: str = "text") -> DataFrame:
    """The same rows and columns; each span of the text is replaced by its kind in brackets.

    Spans that overlap become one, named after the first. Null stays null.
    """
    spans = f"_spans_{len(docs.columns)}"
    while spans in docs.columns:
        spans += "_"
    value = F.col(text)
    order = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(
        order, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(a["out"], F.array(F.substring(value, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(value, a["at"] + 1, F.length(value) - a["at"])))
    clean = F.when(F.size(spans) > 0, done).otherwise(value)
    found = find_spans(docs, kinds, text, spans)
    return found.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
