"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Built from SQL functions alone. A pattern's matches and the gaps between them (``regexp_extract_all``
and ``split`` with one pattern) give all positions by summing up lengths. Patterns begin only where a run
of their characters begins and use possessive repeats, so that each text is read once whatever it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, table, unpacked, whole_row

#: characters to each side of a span in which context words count
NEAR = 40
#: kinds that need context are kept from this score on
LEAST_SCORE = 0.5
#: spans whose positions are summed up together
CHUNK = 128


@dataclass(frozen=True)
class Kind:
    name: str
    #: a text without this character (or string) has no match
    needs: str | None
    pattern: str
    score: float
    words: str
    base: bool = True


OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: in the order in which spans of one start are listed
KINDS = [
    Kind(
        "email", "@",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9, "mail|contact|write|kontakt|contacto|adresse|correo",
    ),
    Kind("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|addr|login"),
    # the whole run of digits, if it has 14 to 19
    Kind(
        "card", None, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
        0.8, "card|visa|credit|debit|carte|karte|tarjeta|cvv",
    ),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile|fax|anruf|appel|llama"),
    Kind(
        "iban", None,
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        0.9, "iban|bank|account|konto|compte|cuenta", False,
    ),
    Kind(
        "ssn", "-", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        0.3, "ssn|social security|tax id|sozialversicherung|seguridad social", False,
    ),
]
BASE = [kind.name for kind in KINDS if kind.base]


def running_totals(numbers: Column) -> Column:
    """Sums of an array of integers up to each element, chunk by chunk, as appending copies an array."""

    def totals(array: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(
            array,
            start,
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["sums"], a["sum"] + x).alias("sums")),
            lambda a: a["sums"],
        )

    last = F.floor((F.size(numbers) - 1) / CHUNK).cast("int")
    # the one-element array around the numbers computes them once, not once for each chunk
    chunks = F.flatten(F.transform(F.array(numbers), lambda n: F.transform(
        F.sequence(F.lit(0), last), lambda c: totals(F.slice(n, c * CHUNK + 1, CHUNK)))))
    whole = F.transform(F.array(chunks), lambda parts: F.flatten(F.zip_with(
        parts, totals(F.transform(parts, lambda c: F.element_at(c, -1))),
        lambda c, end: F.transform(c, lambda x: x + end - F.element_at(c, -1)))))
    return F.when(F.size(numbers) > 0, F.get(whole, 0)).otherwise(F.array().cast("array<int>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def characters(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substr(value, i, F.lit(1)))


def luhn(number: Column) -> Column:
    """Whether digits, every second from the right doubled, sum up to a multiple of ten."""
    doubled = F.transform(
        F.reverse(characters(number)),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters put last and letters counted from 10, leaves 1."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    alphabet = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def step(rest: Column, letter: Column) -> Column:
        value = F.position(letter, alphabet) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(characters(moved), F.lit(0), step) == 1


def confirmed(kind: Kind, value: Column) -> Column:
    if kind.name == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind.name == "card":
        return luhn(digits(value))
    if kind.name == "phone":
        return F.length(digits(value)).between(10, 15)
    if kind.name == "iban":
        return mod97(F.regexp_replace(value, " ", ""))
    return F.lit(True)


def spans_of(kind: Kind, number: int, text: Column, found: Column, ends: Column) -> Column:
    """Confirmed spans of one kind: start, order of the kind, end, kind, score."""

    def span(match: Column, end: Column) -> Column:
        start = end - F.length(match)
        before = F.substr(text, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR)))
        around = F.lower(F.concat_ws(" ", before, F.substr(text, end + 1, F.lit(NEAR))))
        near = F.when(around.rlike(rf"\b(?:{kind.words})"), 0.3).otherwise(0.0)
        score = F.round(F.least(F.lit(kind.score) + near, F.lit(1.0)), 2)
        return F.struct(
            start.alias("start"), F.lit(number).alias("order"), end.alias("end"), F.lit(kind.name).alias("kind"),
            F.when(confirmed(kind, match), score).alias("score"),
        )

    # gaps are one more than matches: the total after the last gap has no match
    paired = F.zip_with(found, F.slice(ends, 1, F.size(found)), span)
    return F.filter(paired, lambda s: s["score"] >= (0.0 if kind.base else LEAST_SCORE))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with ``pii``: an array of spans ``start, order, end, kind, score``, sorted.

    Positions count code points, ends are exclusive. A null text has no spans, as an empty one; long texts are
    searched whole. An input column ``pii`` is replaced. Nothing is shuffled; an empty table gives an empty result.
    """
    none = F.array().cast("array<string>")
    df = docs.select(whole_row(docs).alias("row"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    for kind in KINDS:
        matches = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
        if kind.needs:
            matches = F.when(F.contains("text", F.lit(kind.needs)), matches).otherwise(none)
        df = df.withColumn(f"found_{kind.name}", matches)
    for kind in KINDS:
        found = F.col(f"found_{kind.name}")
        gaps = F.when(F.size(found) > 0, F.split("text", kind.pattern, -1)).otherwise(none)
        lengths = F.zip_with(gaps, found, lambda gap, match: F.length(gap) + F.coalesce(F.length(match), F.lit(0)))
        df = df.withColumn(f"ends_{kind.name}", running_totals(lengths))
    spans = [
        spans_of(kind, i, F.col("text"), F.col(f"found_{kind.name}"), F.col(f"ends_{kind.name}"))
        for i, kind in enumerate(KINDS)
    ]
    return unpacked(df.withColumn("pii", F.array_sort(F.concat(*spans))), "row", ["pii"])


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    pii = F.col("pii")

    def count(name: str) -> Column:
        return F.size(F.filter(pii, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(listed(F.filter(pii, lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"),
        listed(pii).alias("spans"),
        F.concat_ws(",", F.transform(pii, lambda s: s["score"].cast("string"))).alias("scores"),
    )
