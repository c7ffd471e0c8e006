"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

All work is one projection of built-in functions: no shuffle and no Python. For each kind, the matches
of a pattern and the gaps between them give the positions (in code points, end exclusive). Matches of
the base kinds stay if their check holds; those of the further kinds stay if their score, of the
pattern, the checksum and the context, reaches ``MIN_SCORE``.

Two kinds are secrets: values that a name such as ``token`` or ``password`` introduces, and keys in a
known public form.

Defined cases: a null text has no span; spans of different kinds may overlap; equal spans of different
kinds are sorted by kind; repeated rows and other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.llm.common import let

CONTEXT = 40
MIN_SCORE = 0.5
BONUS, MALUS = 0.3, 0.3

# The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}
# The check letters of Spanish identity numbers, by the number modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def always(value: Column) -> Column:
    return F.lit(True)


def luhn(value: Column) -> Column:
    """Whether 12 to 19 digits have a valid check digit."""

    def total(number: Column) -> Column:
        size = F.length(number)

        def add(s: Column, i: Column) -> Column:
            digit = number.substr(size - i + 1, F.lit(1)).cast("int")
            double = digit * 2
            return s + F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

        return size.between(12, 19) & (F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0)

    return let(digits(value), total)


def small_parts(value: Column) -> Column:
    """Whether all four numbers are at most 255."""
    return value.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")


def phone_length(value: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def mod97(value: Column) -> Column:
    """Whether an account number has a valid check number."""

    def total(plain: Column) -> Column:
        moved = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))

        def add(s: Column, i: Column) -> Column:
            code = F.ascii(moved.substr(i, F.lit(1)))
            return F.when(code < 65, (s * 10 + code - 48) % 97).otherwise((s * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(plain)), F.lit(0), add) == 1

    return let(F.replace(value, F.lit(" "), F.lit("")), total)


def dni_letter(value: Column) -> Column:
    number = value.substr(1, 8).cast("int")
    return F.lit(DNI_LETTERS).substr(number % 23 + 1, F.lit(1)) == value.substr(9, 1)


@dataclass(frozen=True)
class Kind:
    name: str
    #: Java pattern. Possessive repeats keep long runs linear and off the stack.
    pattern: str
    check: Callable[[Column], Column]
    score: float
    #: Words nearby that make the kind more likely, or less.
    near: str
    against: str = "(?!)"
    base: bool = False
    #: A text without this string has no match.
    needs: str | None = None


def iban_pattern() -> str:
    by_length: dict[int, list[str]] = {}
    for country, length in IBAN_LENGTHS.items():
        by_length.setdefault(length, []).append(country)
    forms = [f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items())]
    return f"(?=[A-Z]{{2}}[0-9]{{2}})(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


def mixed(value: Column) -> Column:
    """Whether a value has letters and at least two digits, as a generated one has and a word hasn't."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9].*[0-9]")


#: Names before a value that make it a secret, and the characters of such values.
SECRET_NAME = r"(?:tokens?|secrets?|passwords?|passwd|pwd|credentials?|(?:api|access|secret|private|auth|account)[_ -]?key)"
SECRET = "[A-Za-z0-9_+/.-]"
SECRET_PATTERN = (
    rf"(?<!{SECRET})(?={SECRET}{{16}})(?<=(?i:{SECRET_NAME})[\"']?[\x20\t]{{0,3}}(?:[:=]|:=|=>)[\x20\t]{{0,3}}[\"']?)"
    rf"{SECRET}++={{0,2}}+"
)
#: Words that announce a made-up value; as a part of an address or a name they don't.
NO_SECRET = r"(?<![\w.@-])(?:example|placeholder|dummy|sample)(?![\w.@-])"
# The public forms of keys that carry their issuer's prefix, signed web tokens and private key blocks.
KEY_PATTERN = (
    "(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36}(?![0-9A-Za-z])"
    "|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"
    r"|eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"
    "|-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----"
)

LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

#: In the order in which equal starts are sorted. A local part starts where no other can, or where the last match ended.
KINDS = [
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++", always, 0.9, "e-?mail|correo|courriel|contact|kontakt", base=True, needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", small_parts, 0.6, r"\bip\b|host|server|address", "version|release", base=True, needs="."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", luhn, 0.6, "card|visa|master|credit|karte|tarjeta|carte", "order|isbn|serial", base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", phone_length, 0.6, "phone|tel|call|mobile|fax|anruf|móvil", base=True, needs="+"),
    Kind("iban", iban_pattern(), mod97, 0.8, "iban|account|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", always, 0.3, r"\bssn\b|social security", needs="-"),
    Kind("dni", r"(?<![A-Za-z0-9])[0-9]{8}[A-Z](?![A-Za-z0-9])", dni_letter, 0.4, r"\bdni\b|\bnif\b|identidad|identity", "serial|order|part"),
    Kind("secret", SECRET_PATTERN, mixed, 0.6, "bearer|auth|login|secret|private", NO_SECRET),
    Kind("key", KEY_PATTERN, always, 0.9, "key|token|secret|private", NO_SECRET),
]

SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,text:string,score:double>"


def score(kind: Kind, text: Column, start: Column, end: Column) -> Column:
    """Score of a confirmed span, from its kind and the words around it."""
    first = F.greatest(start - CONTEXT, F.lit(0))
    around = F.lower(text.substr((first + 1).cast("int"), (end - first + CONTEXT).cast("int")))
    bonus = F.when(around.rlike(kind.near), BONUS).otherwise(0.0)
    malus = F.when(around.rlike(kind.against), MALUS).otherwise(0.0)
    return F.round(F.least(F.lit(kind.score) + bonus - malus, F.lit(1.0)), 2)


def spans_of(kind: Kind, rank: int, text: Column, found: Column) -> Column:
    """Confirmed spans among the matches of a kind. Matches that fail only move the position."""

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        rated = score(kind, text, start, end)
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), end.alias("end"),
            x["match"].alias("text"), rated.alias("score"),
        ).cast(SPAN)
        stays = kind.check(x["match"]) if kind.base else kind.check(x["match"]) & (rated >= MIN_SCORE)
        spans = F.when(stays, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.cast("bigint").alias("at"), spans.alias("spans"))

    none = F.array().cast(f"array<{SPAN}>")
    gaps = F.slice(F.split(text, kind.pattern, -1), 1, F.size(found))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step)["spans"]).otherwise(none)


def find_pii(docs: DataFrame, *, text_col: str = "text", into: str = "pii", kinds: list[Kind] = KINDS) -> DataFrame:
    """``docs`` with the array ``into`` of spans, sorted by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    matches = {}
    for kind in kinds:
        found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
        if kind.needs:
            found = F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(F.array().cast("array<string>"))
        matches[f"_{into}_{kind.name}"] = found
    spans = [spans_of(kind, rank, text, F.col(name)) for rank, (kind, name) in enumerate(zip(kinds, matches))]
    return docs.withColumns(matches).withColumn(into, F.array_sort(F.concat(*spans))).drop(*matches)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *names: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*names))


def redact(docs: DataFrame, *, text_col: str = "text", pii_col: str = "pii") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first counts."""

    def step(state: Column, s: Column) -> Column:
        between = F.col(text_col).substr((state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        done = F.concat(state["done"], between, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.when(fresh, s["end"]).otherwise(F.greatest(state["at"], s["end"])).alias("at"),
            F.when(fresh, done).otherwise(state["done"]).alias("done"),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done"))
    text = F.col(text_col)
    cleaned = let(
        F.aggregate(F.col(pii_col), zero, step),
        lambda s: F.concat(s["done"], text.substr((s["at"] + 1).cast("int"), F.length(text))),
    )
    return docs.withColumn(text_col, F.when(F.size(pii_col) > 0, cleaned).otherwise(text))
