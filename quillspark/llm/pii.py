"""Format-preserving pseudonyms for personal data.

One regular expression finds e-mail addresses and runs: numbers and words of capitals with short separators between them. Inside
a run the values are looked for between its atoms (digits, capitals), so what stands beside a value is not taken for a part of it:
first, from the left and the longest at each place, IBANs (modulo 97), IPv4 addresses (octets), calendar dates, US social
security numbers (issued ranges) and payment cards (13 to 19 digits, Luhn); then phone numbers (7 to 15 digits) between these. A phone number
has the North American form, or begins with a plus, or is all the digits that separators join. The search goes on behind a value.

A valid value is replaced by another of its format: a keyed Feistel network permutes its digits (or the octets, the
day number, the mailbox characters), separators stay where they are, and check digits are computed anew. The permutation depends
on key, kind and length alone, so equal values get equal pseudonyms in every document, different values
different ones, and the holder of the key can invert it. Dates go to any day from 1900 to 2099: the format is kept, the age is not.
Only DataFrame functions are used.

Defined results: null text stays null with no finds; text without finds is returned as it is. Ids may be null or
repeat, rows are treated one by one, all other columns are kept as they are (but for one named as the result column, which is
replaced). An empty table gives an empty result. Mailbox names of over 64 characters, the limit of RFC 5321, are no addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, running, table, text_or_empty

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "card", "phone")
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: Seven characters at least; the first atom has or ends before a digit. Possessive repeats keep the search linear and without recursion.
RUN = r"(?<![A-Z0-9])[+(./-]{0,3}+(?=[A-Z]*+[0-9])(?=(?:[ ().+/-]{0,3}[A-Z0-9]){7})[A-Z0-9]++(?:[ ().+/-]{1,3}+(?![A-Za-z0-9._%+-]*+@)[A-Z0-9]++)*+"
PATTERN = f"{EMAIL}|{RUN}"
ATOM = "[0-9]+|[A-Z]+"
#: Usual ways of writing a card number; in others the number must be all the digits that blanks or dashes join.
CARD = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}\2[0-9]{3}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{4,5})$"
NANP = r"^(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$"
#: The atoms and characters that a value has at most (an IBAN of 34 characters with a blank after each).
MOST_ATOMS, MOST_CHARS = 34, 67
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 250, 292  # 73,000 days: to 2099-11-13
SSN_AREAS, SSN_REST = 898, 99 * 9999


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _numbers(digits: Column) -> Column:
    """The digits of a string that is not empty, as integers."""
    return bind(digits, lambda d: F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.substring(d, i, F.lit(1)).cast("int")))


def _digest(key: str, kind: str, round_: Column, size: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), size.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 256)


def _noise(digest: Column, i: Column) -> Column:
    """The i-th 28-bit number that the round's digest of the other half gives."""
    return F.conv(F.substring(digest, (i % 9) * 7 + 1, F.lit(7)), 16, 10).cast("long")


def feistel(values: Column, radix: int | tuple[int, int], key: str, kind: str, inverse: bool = False) -> Column:
    """Permutes arrays of integers below ``radix`` (a pair: the radix of the first and of the second half) of each length of two or more."""
    ra, rb = radix if isinstance(radix, tuple) else (radix, radix)
    sign = -1 if inverse else 1
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def permuted(values: Column) -> Column:
        size = F.size(values)
        half = F.floor(size / 2).cast("int")
        zero = F.struct(F.slice(values, F.lit(1), half).alias("a"), F.slice(values, half + 1, size - half).alias("b"))

        def mix(r: Column, part: Column, other: Column, radix_: int) -> Column:
            moved = lambda digest: F.transform(part, lambda x, i: F.pmod(x + sign * _noise(digest, i), F.lit(radix_)).cast("int"))
            return bind(_digest(key, kind, r, size, other), moved)

        def step(acc: Column, r: Column) -> Column:
            return F.when(r % 2 == 0, F.struct(mix(r, acc["a"], acc["b"], ra).alias("a"), acc["b"].alias("b"))).otherwise(F.struct(acc["a"].alias("a"), mix(r, acc["b"], acc["a"], rb).alias("b")))

        return F.when(size >= 2, F.aggregate(rounds, zero, step, lambda acc: F.concat(acc["a"], acc["b"]))).otherwise(values)

    return bind(values, permuted)


def _text_of(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), "")


def refill(shape: Column, chars: Column, takes: str) -> Column:
    """``shape`` with its characters that match ``takes`` replaced, in order, by those of ``chars``."""
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def filled(both: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            c = F.substring(both["shape"], i, F.lit(1))
            hit = c.rlike(takes)
            return F.struct(F.concat(acc["out"], F.when(hit, F.substring(both["chars"], acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + hit.cast("int")).alias("at"))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(both["shape"]), F.lit(1))), zero, step, lambda acc: acc["out"])

    return bind(F.struct(shape.alias("shape"), chars.alias("chars")), filled)


def _luhn_digit(numbers: Column) -> Column:
    doubled = F.transform(F.reverse(numbers), lambda x, i: F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return (10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10


def _mod97(text: Column) -> Column:
    def remainder(text: Column) -> Column:
        def step(rem: Column, i: Column) -> Column:
            c = F.substring(text, i, F.lit(1))
            return F.when(c.rlike("[0-9]"), (rem * 10 + F.ascii(c) - 48) % 97).otherwise((rem * 100 + F.ascii(c) - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), F.lit(0), step)

    return bind(text, remainder)


def _valid_card(m: Column) -> Column:
    d = _numbers(_digits(m))
    n = F.size(d)
    return m.rlike("^[0-9](?:[ -]?[0-9]){12,18}$") & (_luhn_digit(F.slice(d, F.lit(1), n - 1)) == F.element_at(d, -1))


def _new_card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = feistel(_numbers(F.substring(d, F.lit(1), F.length(d) - 1)), 10, key, "card")
    return refill(m, bind(body, lambda b: F.concat(_text_of(b), _luhn_digit(b).cast("string"))), "[0-9]")


def _valid_iban(m: Column) -> Column:
    c = F.replace(m, F.lit(" "), F.lit(""))
    return m.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$") & F.length(c).between(15, 34) & (_mod97(F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))) == 1)


def _new_iban(m: Column, key: str) -> Column:
    c = F.replace(m, F.lit(" "), F.lit(""))
    land, body = F.substring(c, 1, 2), F.substring(c, 5, 40)
    new = refill(body, _text_of(feistel(_numbers(_digits(body)), 10, key, "iban")), "[0-9]")
    check = lambda n: F.lpad((98 - _mod97(F.concat(n, land, F.lit("00")))).cast("string"), 2, "0")
    return refill(m, bind(new, lambda n: F.concat(land, check(n), n)), "[A-Z0-9]")


def _valid_ip(m: Column) -> Column:
    return m.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")


def _new_ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(feistel(octets, 256, key, "ip"), lambda x: x.cast("string")), ".")


def _date(m: Column) -> tuple[Column, Column, Column]:
    """The date (null if there is none), whether the year leads, whether the day leads."""
    year_first = m.rlike("^[0-9]{4}")
    p = F.split(m, "[/.-]")
    made = lambda y, mo, d: F.try_to_date(F.concat_ws("-", F.get(p, y), F.get(p, mo), F.get(p, d)), "yyyy-MM-dd")
    day_first = made(F.lit(2), F.lit(1), F.lit(0))
    return F.when(year_first, made(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.coalesce(day_first, made(F.lit(2), F.lit(0), F.lit(1)))), year_first, day_first.isNotNull()


def _valid_date(m: Column) -> Column:
    shape = m.rlike(r"^(?:[0-9]{4}([/.-])[0-9]{2}\1[0-9]{2}|[0-9]{2}([/.-])[0-9]{2}\2[0-9]{4})$")
    days = F.datediff(F.when(shape, _date(m)[0]), F.lit(FIRST_DAY).cast("date"))
    return F.coalesce(days.between(0, DAYS_A * DAYS_B - 1), F.lit(False))


def _new_date(m: Column, key: str) -> Column:
    day, year_first, day_first = _date(m)
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    new = feistel(F.array((n / DAYS_B).cast("int"), (n % DAYS_B).cast("int")), (DAYS_A, DAYS_B), key, "date")
    when = F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(new, 0) * DAYS_B + F.get(new, 1))
    # written in the order it was read: day first only where that is how a reader would take it again
    y, mo, d = F.date_format(when, "yyyy"), F.date_format(when, "MM"), F.date_format(when, "dd")
    text = F.when(year_first, F.concat(y, mo, d)).when(day_first, F.concat(d, mo, y)).otherwise(F.concat(mo, d, y))
    return refill(m, text, "[0-9]")


def _valid_ssn(m: Column) -> Column:
    return m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def _new_ssn(m: Column, key: str) -> Column:
    d = _digits(m)
    part = lambda a, n: F.substring(d, a, n).cast("int")
    area = part(1, 3) - 1 - (part(1, 3) > 666).cast("int")
    new = feistel(F.array(area, (part(4, 2) - 1) * 9999 + part(6, 4) - 1), (SSN_AREAS, SSN_REST), key, "ssn")
    a, rest = F.get(new, 0) + 1, F.get(new, 1)
    a = a + (a >= 666).cast("int")
    return F.format_string("%03d-%02d-%04d", a, F.floor(rest / 9999).cast("int") + 1, rest % 9999 + 1)


def _valid_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(7, 15) & m.rlike(r"^\+|[ ().-]") & m.rlike(r"^[+(]{0,2}[0-9](?:[ ().-]{0,2}[0-9])*$") & ~m.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}([/.-])[0-9]{2}\1[0-9]{2}|[0-9]{2}([/.-])[0-9]{2}\2[0-9]{4})$")


def _new_phone(m: Column, key: str) -> Column:
    """The digits behind a leading +, one digit and a separator (a country code) are permuted; else all are."""
    d = _digits(m)
    keep = F.when(m.rlike(r"^\+[0-9][ (.-]"), F.lit(1)).otherwise(F.lit(0))
    new = _text_of(feistel(_numbers(F.substring(d, keep + 1, F.length(d))), 10, key, "phone"))
    return refill(m, F.concat(F.substring(d, F.lit(1), keep), new), "[0-9]")


def _valid_email(m: Column) -> Column:
    """A mailbox name of at most 64 characters (the limit of RFC 5321) that has a letter or digit, before a domain."""
    return (F.length(F.substring_index(m, "@", 1)) <= 64) & m.rlike(r"^[A-Za-z0-9._%+-]*[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$")


def _new_email(m: Column, key: str) -> Column:
    box, at = F.lower(F.substring_index(m, "@", 1)), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    used = F.regexp_replace(box, "[^a-z0-9]", "")
    values = bind(used, lambda u: F.transform(F.sequence(F.lit(1), F.greatest(F.length(u), F.lit(1))), lambda i: F.instr(F.lit(LETTERS), F.substring(u, i, F.lit(1))) - 1))
    # a mailbox of one character has nothing to be permuted with: it is paired with a constant
    new = F.when(F.size(values) >= 2, feistel(values, 36, key, "email")).otherwise(F.slice(feistel(F.concat(values, F.array(F.lit(0))), 36, key, "email"), 1, 1))
    letters = F.array_join(F.transform(new, lambda x: F.substring(F.lit(LETTERS), x + 1, F.lit(1))), "")
    return F.concat(refill(box, letters, "[a-z0-9]"), at)


_VALID = {"email": _valid_email, "iban": _valid_iban, "ip": _valid_ip, "date": _valid_date, "ssn": _valid_ssn, "card": _valid_card, "phone": _valid_phone}
_NEW = {"email": _new_email, "iban": _new_iban, "ip": _new_ip, "date": _new_date, "ssn": _new_ssn, "card": _new_card, "phone": _new_phone}


#: A span: its start, minus its end and kind, its first and last atom, its text, and how much of that stands before the first atom.
_SPAN = "array<struct<start:int,other:int,back:int,kind:string,first:int,last:int,value:string,lead:int>>"


def _atoms(m: Column) -> Column:
    """The atoms of a run: their place, text, start and end, the separators on both sides, and their neighbours."""
    cut = F.struct(F.regexp_extract_all(m, F.lit(ATOM), F.lit(0)).alias("atoms"), F.split(m, ATOM, -1).alias("gaps"))

    def ended(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["atoms"])), x["atoms"], lambda g, a: F.length(g) + F.length(a))
        return F.struct(x["atoms"].alias("atoms"), x["gaps"].alias("gaps"), running(sizes, lambda a, b: a + b).alias("ends"))

    def described(x: Column) -> Column:
        atom = lambda i: F.coalesce(F.get(x["atoms"], i), F.lit(""))
        return F.transform(
            x["atoms"],
            lambda a, i: F.struct(
                i.alias("i"), a.alias("a"), (F.get(x["ends"], i) - F.length(a)).alias("s"), F.get(x["ends"], i).alias("e"),
                F.get(x["gaps"], i).alias("before"), F.get(x["gaps"], i + 1).alias("after"), atom(i - 1).alias("prev"), atom(i + 1).alias("next"),
            ),
        )

    return bind(bind(cut, ended), described)


def _ends(atoms: Column, x: Column, most: int, tried) -> Column:
    """``tried(y, v)`` for each atom y that a value from atom x may end with; v is the text from x to y."""
    near = F.filter(F.slice(atoms, x["i"] + 1, F.lit(most)), lambda y: y["e"] - x["s"] <= MOST_CHARS)

    def over(near: Column) -> Column:
        # the text is put together from the atoms nearby: cutting it from the run would take a walk through the run each time
        local = F.array_join(F.transform(near, lambda y: F.concat(y["a"], y["after"])), "")
        return bind(local, lambda t: F.transform(near, lambda y: bind(F.substring(t, F.lit(1), y["e"] - x["s"]), lambda v: tried(y, v))))

    return bind(near, over)


def _is_digits(a: Column) -> Column:
    return a.rlike("^[0-9]")


def _span(x: Column, y: Column, kind: Column, value: Column, lead: Column, other: Column) -> Column:
    """Sorted by start, then ``other``, then the longest first."""
    return F.struct((x["s"] - F.length(lead)).alias("start"), other.alias("other"), (-y["e"]).alias("back"), kind.alias("kind"), x["i"].alias("first"), y["i"].alias("last"), value.alias("value"), F.length(lead).alias("lead"))


def _in_order(spans: Column) -> Column:
    """Of sorted spans, those that do not overlap an earlier one that stays."""
    zero = F.struct(F.lit(0).alias("free"), F.array().cast(_SPAN).alias("out"))
    step = lambda acc, x: F.when(x["start"] >= acc["free"], F.struct((-x["back"]).alias("free"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc)
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["out"])


def _specific(atoms: Column) -> Column:
    """The spans of IBANs, addresses, dates, social security and card numbers."""

    def from_atom(x: Column) -> Column:
        def tried(y: Column, v: Column) -> Column:
            goes_on = lambda separators: y["after"].isin(*separators) & _is_digits(y["next"])
            begun = lambda separators: x["before"].rlike(f"[{separators}]$")
            alone = ((x["i"] == 0) | (x["before"] != "")) & ((y["next"] == "") | (y["after"] != ""))
            apart = ~(_is_digits(x["prev"]) & x["before"].isin(" ", "-")) & ~(_is_digits(y["next"]) & y["after"].isin(" ", "-"))
            kind = (
                F.when(F.length(v) < 7, "")
                .when(alone & _valid_iban(v), "iban")
                .when(~_is_digits(x["a"]) | ~_is_digits(y["a"]), "")
                .when(~begun(".") & ~goes_on(".") & _valid_ip(v), "ip")
                .when(~begun("/.-") & ~goes_on("/.-") & _valid_date(v), "date")
                .when(~begun("-") & ~goes_on("-") & _valid_ssn(v), "ssn")
                .when((apart | v.rlike(CARD)) & _valid_card(v), "card")
                .otherwise("")
            )
            return _span(x, y, kind, v, F.lit(""), F.lit(0))

        able = _is_digits(x["a"]) | ((F.length(x["a"]) == 2) & (x["after"] == "") & _is_digits(x["next"]))
        return F.when(able, F.filter(_ends(atoms, x, MOST_ATOMS, tried), lambda t: t["kind"] != "")).otherwise(F.array().cast(_SPAN))

    return _in_order(F.flatten(F.transform(atoms, from_atom)))


def _phones(atoms: Column) -> Column:
    """The spans of phone numbers in a text without other values."""
    joins = r"^[ ().-]{1,2}$"

    def from_atom(x: Column) -> Column:
        lead = F.regexp_extract(x["before"], r"[+(]{1,2}$", 0)
        first = ~_is_digits(x["prev"]) | ~x["before"].rlike(joins)

        def tried(y: Column, v: Column) -> Column:
            number = F.concat(lead, v)
            last = ~_is_digits(y["next"]) | ~y["after"].rlike(joins)
            whole = number.rlike(NANP)
            good = _valid_phone(number) & (whole | lead.startswith("+") | (first & last))
            return _span(x, y, F.when(good, "phone").otherwise(""), number, lead, (~whole).cast("int"))

        return F.when(_is_digits(x["a"]), F.filter(_ends(atoms, x, 15, tried), lambda t: t["kind"] != "")).otherwise(F.array().cast(_SPAN))

    return _in_order(F.flatten(F.transform(atoms, from_atom)))


_PIECE = "array<struct<pre:string,kind:string,value:string>>"


def _piece(pre: Column, kind: Column, value: Column) -> Column:
    return F.struct(pre.alias("pre"), kind.alias("kind"), value.alias("value"))


def _cut(atoms: Column, spans: Column) -> tuple[Column, Column]:
    """(pieces, rest) of a text with these atoms: each span behind the text that precedes it, and what is left; every atom is visited once."""

    def text_of(first: Column, behind: Column) -> Column:
        return F.array_join(F.transform(F.slice(atoms, first + 1, F.greatest(behind - first, F.lit(0))), lambda q: F.concat(q["before"], q["a"])), "")

    behind = lambda k: F.coalesce(F.get(spans, k)["last"] + 1, F.lit(0))

    def piece(x: Column, k: Column) -> Column:
        before = F.get(atoms, x["first"])["before"]
        return _piece(F.concat(text_of(behind(k - 1), x["first"]), F.substring(before, F.lit(1), F.length(before) - x["lead"])), x["kind"], x["value"])

    rest = F.concat(text_of(behind(F.size(spans) - 1), F.size(atoms)), F.element_at(atoms, -1)["after"])
    return F.transform(spans, piece), rest


def _with_phones(text: Column) -> Column:
    """The pieces of a text without other values; the last one has no value."""

    def cut(atoms: Column) -> Column:
        def pieces(spans: Column) -> Column:
            found, rest = _cut(atoms, spans)
            return F.concat(found, F.array(_piece(rest, F.lit(""), F.lit(""))))

        return bind(_phones(atoms), pieces)

    plain = F.array(_piece(text, F.lit(""), F.lit("")))
    return F.when((F.length(text) >= 7) & text.rlike("[0-9]"), bind(_atoms(text), cut)).otherwise(plain)


def values_in(m: Column) -> Column:
    """A match of ``PATTERN`` in pieces (pre, kind, value): texts without values have no kind."""

    def cut(atoms: Column) -> Column:
        def pieces(spans: Column) -> Column:
            found, rest = _cut(atoms, spans)
            by_span = F.transform(found, lambda p: F.concat(_with_phones(p["pre"]), F.array(_piece(F.lit(""), p["kind"], p["value"]))))
            return F.concat(F.flatten(by_span), _with_phones(rest))

        return bind(_specific(atoms), pieces)

    none = F.lit("")
    return (
        F.when(m.contains("@") & _valid_email(m), F.array(_piece(none, F.lit("email"), m)))
        .when(m.rlike("[0-9]"), bind(_atoms(m), cut))
        .otherwise(F.array(_piece(m, none, none)))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``text`` rewritten and ``out``: an array of (kind, start, end, value, pseudonym), offsets in code points of the original."""
    body = text_or_empty(text)

    def renamed(p: Column) -> Column:
        new = p["value"]
        for k in reversed(KINDS):
            new = F.when(p["kind"] == k, _NEW[k](p["value"], key)).otherwise(new)
        return F.struct(p["pre"].alias("pre"), p["kind"].alias("kind"), p["value"].alias("value"), new.alias("pseudonym"))

    def pieces(x: Column) -> Column:
        gap = F.array(_piece(x["gap"], F.lit(""), F.lit("")))
        return F.transform(F.when(x["match"].isNull(), gap).otherwise(F.concat(gap, values_in(x["match"]))), renamed)

    hit = body.rlike("[0-9@]") & body.rlike(PATTERN)  # every match has a digit or an at sign
    matches = F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))
    parts = F.zip_with(F.split(body, PATTERN, -1), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    empty = F.array().cast("array<struct<pre:string,kind:string,value:string,pseudonym:string>>")
    rows = docs.withColumn("__qs_cut", F.when(hit, F.flatten(F.transform(parts, pieces))).otherwise(empty))
    written = F.array_join(F.transform("__qs_cut", lambda p: F.concat(p["pre"], p["pseudonym"])), "")
    ends = running(F.transform("__qs_cut", lambda p: F.length(p["pre"]) + F.length(p["value"])), lambda a, b: a + b)
    span = lambda p, end: F.struct(p["kind"].alias("kind"), (end - F.length(p["value"])).alias("start"), end.alias("end"), p["value"].alias("value"), p["pseudonym"].alias("pseudonym"))
    spans = F.filter(F.zip_with("__qs_cut", ends, span), lambda x: x["kind"] != "")
    return rows.withColumn(out, spans).withColumn(text, F.when(F.size(out) > 0, written).otherwise(F.col(text))).drop("__qs_cut")


#: The setting that holds the key. Without it a published one is used, whose pseudonyms anybody can invert: for tests only.
KEY_SETTING, TEST_KEY = "spark.quillspark.pii.key", "quillspark"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, TEST_KEY))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.array_join(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"), x["pseudonym"])), ",")
    return out.select("doc_id", *(count(k) for k in KINDS), spans.alias("pseudonyms"), "text")
