"""Checksums and validators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, spans


def chars(text: Column) -> Column:
    """The characters of a string; an empty array for an empty one."""
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: i <= F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def is_luhn(text: Column) -> Column:
    """Luhn over the digits; spaces and dashes are ignored, another character or fewer than two digits is false."""
    digits = F.translate(text, " -", "")
    return digits.rlike("^[0-9]{2,}$") & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


#: What a card number can stand in: digits, blanks and dashes.
CARD_RUN = "[0-9][0-9 -]{11,}[0-9]"


def card_spans(run: Column) -> Column:
    """(start, end) of the card numbers in a run of digits, blanks and dashes, in order and without overlap.

    A card number is one or more whole groups of digits with one blank or dash between them, of 13 to 19 digits in all, that
    pass Luhn. A group that is one by itself is taken first, whatever stands beside it; of the rest the leftmost, then the longest.
    """
    fits = lambda digits: F.length(digits).between(13, 19) & is_luhn(digits)

    def windows(groups: Column) -> Column:
        def window(i: Column, n: Column) -> Column:
            of = F.slice(groups, i + 1, n)
            first, last = F.get(groups, i), F.get(groups, i + n - 1)
            return F.struct(first["start"].alias("start"), last["end"].alias("end"), n.alias("n"), F.array_join(F.transform(of, lambda g: g["value"]), "").alias("digits"))

        sizes = F.sequence(F.lit(19), F.lit(1), F.lit(-1))
        tried = F.flatten(F.transform(groups, lambda g, i: F.transform(F.filter(sizes, lambda n: i + n <= F.size(groups)), lambda n: window(i, n))))
        return F.filter(tried, lambda w: (w["end"] - w["start"] == F.length(w["digits"]) + w["n"] - 1) & fits(w["digits"]))

    def chosen(found: Column) -> Column:
        alone = F.filter(found, lambda w: w["n"] == 1)
        free = F.filter(found, lambda w: (w["n"] == 1) | ~F.exists(alone, lambda a: (a["start"] >= w["start"]) & (a["end"] <= w["end"])))
        zero = F.array().cast("array<struct<start:int,end:int>>")
        taken = lambda acc, w: F.when(F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)) <= w["start"], F.array_append(acc, F.struct(w["start"].alias("start"), w["end"].alias("end")))).otherwise(acc)
        return F.aggregate(free, zero, taken)

    return once(once(spans(run, "[0-9]+"), windows), chosen)


def mod97(text: Column) -> Column:
    """Remainder modulo 97 of a string of digits and capital letters (A is 10)."""
    digits = text
    for i in range(26):
        digits = F.replace(digits, F.lit(chr(65 + i)), F.lit(str(10 + i)))

    def fold(t: Column) -> Column:
        """18 digits at a time: a remainder before them is at most 96 * 10**18 % 97 and fits."""
        parts = F.sequence(F.lit(0), F.floor((F.length(t) - 1) / 18).cast("int"))
        padded = F.lpad(t, (F.floor((F.length(t) + 17) / 18) * 18).cast("int"), "0")
        return F.aggregate(parts, F.lit(0).cast("long"), lambda rem, i: (rem * (10**18 % 97) + F.substring(padded, i * 18 + 1, F.lit(18)).try_cast("long") % 97) % 97).cast("int")

    return once(digits, lambda t: F.when(t == "", F.lit(0)).otherwise(fold(t)))


def _iban(text: Column) -> Column:
    def good(t: Column) -> Column:
        shaped = F.length(t).between(15, 34) & t.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
        return shaped & F.coalesce(mod97(F.when(shaped, F.concat(F.substring(t, 5, 40), F.substring(t, 1, 4)))) == 1, F.lit(False))

    return once(text, good)


def is_iban_for_redaction(text: Column) -> Column:
    """Spaces and dashes are dropped first."""
    return _iban(F.upper(F.translate(text, " -", "")))


def is_iban_for_correction(text: Column) -> Column:
    """White space of any kind is dropped first, dashes are not."""
    return _iban(F.upper(F.regexp_replace(text, r"(?U)\s", "")))


#: What recognition takes a character of an IBAN for (1 also for L).
LOOK_ALIKE, TAKEN_FOR = "0O1IL2Z5S6G8B9QUV", "O0I11Z2S5G6B8Q9VU"


def _grouped(compact: Column) -> Column:
    return F.trim(F.regexp_replace(compact, "(.{4})", "$1 "))


def normalize_iban(text: Column, grouped: bool = False) -> Column:
    """(status, value): ``valid`` as it stands, ``fixed`` (rewritten, or one look-alike exchanged, the leftmost that
    passes), ``invalid`` (the trimmed text), or null for a text that is not shaped like an IBAN."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    compact = F.upper(F.regexp_replace(trimmed, r"(?U)\s", ""))
    claimed = F.length(compact).between(15, 34) & compact.rlike("^[A-Z0125689]{2}[0-9OQDIZSGTB]{2}[A-Z0-9]+$")

    def exchanged(c: Column, i: Column) -> Column:
        others = F.filter(F.array(F.translate(c, LOOK_ALIKE, TAKEN_FOR), F.when(c == "1", F.lit("L"))), lambda o: o != c)
        return F.transform(others, lambda o: F.concat(F.substring(compact, F.lit(1), i), o, F.substring(compact, i + 2, F.lit(40))))

    repaired = F.get(F.filter(F.flatten(F.transform(chars(compact), exchanged)), _iban), F.lit(0))
    right = F.when(_iban(compact), compact).otherwise(repaired)
    value = _grouped(right) if grouped else right
    status = F.when(value.isNull(), "invalid").when(value == trimmed, "valid").otherwise("fixed")
    return F.when(claimed, F.struct(status.alias("status"), F.coalesce(value, trimmed).alias("value")))


def is_ssn(text: Column) -> Column:
    """US social security number: dashed, spaced or compact, from an issued range."""
    return text.rlike(r"^(?!000|666|9)[0-9]{3}([- ]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}$")


def mrz_check_digit(text: Column) -> Column:
    """Weights 7, 3, 1; the filler counts 0 and A is 10; -1 where another character stands."""
    value = lambda c: F.when(c == "<", F.lit(0)).when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    weight = lambda i: F.when(i % 3 == 0, F.lit(7)).when(i % 3 == 1, F.lit(3)).otherwise(F.lit(1))
    total = F.aggregate(F.transform(chars(text), lambda c, i: value(c) * weight(i)), F.lit(0), lambda a, x: a + x)
    return F.when(text.rlike("^[A-Z0-9<]*$"), total % 10).otherwise(F.lit(-1))


def confidence_100(confidence: Column) -> Column:
    """0-1 to an integer 0-100, half to even."""
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * 100).cast("int")
