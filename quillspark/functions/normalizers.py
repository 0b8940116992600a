"""Normalisers of fields: dates, amounts, machine-readable zones. Each gives (status, value) or null where it does not apply.

``status`` is ``valid`` (the text as it stands), ``fixed`` (rewritten) or ``invalid`` (claimed, but wrong: the text trimmed).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: Letters that recognition gives for digits.
LETTERS, DIGITS = "OoQDIil|ZzSsGTtBgqb", "0000111122556778996"
#: What a capital or digit of a zone is taken for (1 also for L).
ALTERNATIVES = {"0": "O", "O": "0", "1": "IL", "I": "1", "L": "1", "2": "Z", "Z": "2", "5": "S", "S": "5", "6": "G", "G": "6", "8": "B", "B": "8", "9": "Q", "Q": "9", "U": "V", "V": "U"}
_LOOSE = "[0-9OoQIilLZzSsGgTtBb]"
DATE = rf"^({_LOOSE}{{1,4}})([./-])({_LOOSE}{{1,2}})\2({_LOOSE}{{1,4}})$"
_MARK = r"[$€£¥₹₽¢]|[A-Z]{3}"
AMOUNT = rf"^(-)?(\()?\s*({_MARK})?\s*({_LOOSE}(?:{_LOOSE}|[.,'’\x20\u00A0\u202F])*?)\s*({_MARK})?\s*\)?$"


def to_digits(text: Column) -> Column:
    return F.translate(text, LETTERS, DIGITS)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _outcome(claimed: Column, value: Column, text: Column) -> Column:
    status = F.when(value.isNull(), "invalid").when(value == text, "valid").otherwise("fixed")
    return F.when(claimed, F.struct(status.alias("status"), F.coalesce(value, text).alias("value")))


def normalize_date(text: Column, order: str = "auto", form: str = "yyyy-MM-dd") -> Column:
    """Three numbers with one separator, rewritten as ``form``. ``order``: auto, ymd, mdy or dmy.

    Of itself a first number of four places is the year; of the others the one over 12 is the day, and the day comes first where
    neither is. Years of two places up to 68 are of this century, later ones of the last. Three true digits make a date.
    """
    three_digits = "(?:[^0-9]*[0-9]){3}"

    def parts(t: Column) -> Column:
        cells = F.split(F.when(t.rlike(DATE) & t.rlike(three_digits), t), "[./-]")
        return once(cells, lambda c: F.struct(t.alias("t"), *(x for i, n in enumerate("abc") for x in (F.get(c, F.lit(i)).alias(n), F.length(F.get(c, F.lit(i))).alias(f"l{n}")))))

    def numbers(x: Column) -> Column:
        year_first = x["la"] == 4
        shaped = F.when(year_first, x["lc"] <= 2).otherwise(x["lc"].isin(2, 4))
        return F.struct(x["t"].alias("t"), F.coalesce(shaped, F.lit(False)).alias("shaped"), year_first.alias("year_first"), *(to_digits(x[n]).try_cast("int").alias(n) for n in "abc"))

    def outcome(x: Column) -> Column:
        a, b, c, year_first = x["a"], x["b"], x["c"], x["year_first"]
        if order == "auto":
            month_first = ~year_first & (b > 12) & (a <= 12)
        else:
            year_first, month_first = F.lit(order == "ymd"), F.lit(order == "mdy")
        year = F.when(year_first, a).otherwise(c)
        month = F.when(month_first, a).otherwise(b)
        day = F.when(year_first, c).when(month_first, b).otherwise(a)
        year = once(year, lambda y: F.when(y <= 68, y + 2000).when(y < 100, y + 1900).otherwise(y))
        value = F.try_to_date(F.concat_ws("-", *(F.when(n < 10**w, F.lpad(n.cast("string"), w, "0")) for n, w in ((year, 4), (month, 2), (day, 2)))), "yyyy-MM-dd")
        return F.when(x["shaped"], once(F.date_format(value, form), lambda v: _outcome(F.lit(True), v, x["t"])))

    return once(once(once(_trimmed(text), parts), numbers), outcome)


def normalize_amount(text: Column, keep_mark: bool = True) -> Column:
    """A number with a currency sign or code of three capitals on either side, with two places behind the point.

    Parentheses or a minus before make it negative. Of point and comma the last one is the decimal mark; one that stands alone is
    that only if it occurs once and not three places before the end.
    """

    def parts(t: Column) -> Column:
        found = [F.regexp_extract(t, AMOUNT, i) for i in range(1, 6)]
        plain = to_digits(F.regexp_replace(found[3], r"['’\x20\u00A0\u202F]", ""))
        return F.struct(t.alias("t"), (found[0] != "").alias("minus"), (found[1] != "").alias("paren"), found[2].alias("before"), found[3].rlike("[0-9]").alias("digit"), found[4].alias("after"), plain.alias("plain"), F.regexp_extract(plain, r"([.,])[^.,]*$", 1).alias("mark"), F.regexp_extract(plain, r"[.,]([^.,]*)$", 1).alias("behind"))

    def amount(x: Column) -> Column:
        plain, mark, behind = x["plain"], x["mark"], x["behind"]
        alone = F.instr(plain, ",") * F.instr(plain, ".") == 0
        count = F.length(plain) - F.length(F.replace(plain, mark, F.lit("")))
        decimal = (mark != "") & (~alone | ((count == 1) & (F.length(behind) != 3)))
        whole = F.translate(F.when(decimal, F.substring(plain, F.lit(1), F.length(plain) - F.length(behind) - 1)).otherwise(plain), ".,", "")
        odd = decimal & ~alone & (count > 1)  # the decimal mark twice is no number
        digits = F.when(~odd, F.concat(whole, F.when(decimal, F.concat(F.lit("."), behind)).otherwise(F.lit(""))))
        number = once(digits, lambda n: F.when(n.rlike(r"^[0-9]*(?:\.[0-9]*)?$") & n.rlike("[0-9]"), F.round(n.try_cast("decimal(38,10)"), 2)))
        return F.struct(x.alias("x"), number.alias("n"))

    def written(y: Column) -> Column:
        x, plainly = y["x"], F.call_function("format_number", F.when(y["x"]["minus"] | y["x"]["paren"], -y["n"]).otherwise(y["n"]), F.lit("0.00"))

        def marked(p: Column) -> Column:
            if not keep_mark:
                return p
            sign = F.when(p.startswith("-"), "-").otherwise("")
            return F.when(x["before"] != "", F.concat(sign, x["before"], F.regexp_replace(p, "^-", ""))).otherwise(F.concat(p, F.lit(" "), x["after"]))

        claimed = x["t"].rlike(AMOUNT) & ((x["before"] != "") | (x["after"] != "")) & x["digit"]
        return F.when(claimed, once(once(plainly, marked), lambda v: _outcome(F.lit(True), v, x["t"])))

    return once(once(once(_trimmed(text), parts), amount), written)


def check_digit(field: str) -> int:
    """Weights 7, 3, 1; the filler counts 0 and A is 10; -1 where another character stands."""
    if re.search("[^A-Z0-9<]", field):
        return -1
    return sum((0 if c == "<" else int(c, 36)) * (7, 3, 1)[i % 3] for i, c in enumerate(field)) % 10


_to_digit = str.maketrans(LETTERS, DIGITS)
#: Start, length, place of the check digit and whether only digits stand there, for the fields that the last lines of two-line zones share.
_LOWER = [(0, 9, 9, False), (13, 6, 19, True), (21, 6, 27, True)]


def _layout(shape: tuple[int, ...]):
    """Fields (line, start, length, line and place of the check digit, digits only), the composite's parts and check digit, by the lengths of the lines."""
    line = len(shape) - 1
    if shape in ((44, 44), (44,), (36, 36), (36,)):
        long = shape[-1] == 44
        fields = [(line, s, n, line, c, d) for s, n, c, d in [*_LOWER, *([(28, 14, 42, False)] if long else [])]]
        return fields, [(line, 0, 10), (line, 13, 7), (line, 21, 22 if long else 14)], (line, shape[-1] - 1)
    if shape == (30, 30, 30):
        return [(0, 5, 9, 0, 14, False), (1, 0, 6, 1, 6, True), (1, 8, 6, 1, 14, True)], [(0, 5, 25), (1, 0, 7), (1, 8, 7), (1, 18, 11)], (1, 29)
    if shape == (30,):
        return [(0, 0, 6, 0, 6, True), (0, 8, 6, 0, 14, True)], [], None
    return None


def mrz(text: str | None) -> tuple[str, str] | None:
    """The machine-readable zone of an identity document: three lines of 30, two of 36 or 44, or the last of these alone.

    Fillers and digits are restored, and one look-alike of a field where its check digit asks for it. A wrong composite
    digit is never repaired: the zone is invalid then, whatever was found in its fields.
    """
    t = (text or "").strip()
    lines = [re.sub("[ «‹]", "<", x.strip().upper()) for x in t.split("\n") if x.strip()]
    layout = _layout(tuple(map(len, lines))) if lines and not any(re.search("[^A-Z0-9<]", x) for x in lines) else None
    if layout is None:
        return None
    fields, parts, last = layout
    checks = [(f[3], f[4]) for f in fields] + ([last] if last else [])
    if not all(re.fullmatch("[0-9<]", lines[row][at].translate(_to_digit)) for row, at in checks):
        return None
    rows = [list(x) for x in lines]
    for row, at in checks:
        rows[row][at] = rows[row][at].translate(_to_digit)
    for row, start, n, check_row, at, digits in fields:
        own = rows[row][start : start + n]
        if digits:
            own = [c.translate(_to_digit) if c.translate(_to_digit).isdigit() else c for c in own]
        printed = rows[check_row][at]
        if set(own) == {"<"}:
            if printed not in "<0":
                return "invalid", t
        elif printed == "<":
            return "invalid", t
        elif check_digit("".join(own)) != int(printed):
            tries = (own[:i] + [o] + own[i + 1 :] for i, c in enumerate(own) for o in ALTERNATIVES.get(c, "") if o.isdigit() or not digits)
            own = next((x for x in tries if check_digit("".join(x)) == int(printed)), None)
            if own is None:
                return "invalid", t
        rows[row][start : start + n] = own
    if last:
        whole = "".join("".join(rows[row][s : s + n]) for row, s, n in parts)
        if rows[last[0]][last[1]] == "<" or check_digit(whole) != int(rows[last[0]][last[1]]):
            return "invalid", t
    out = "\n".join(map("".join, rows))
    return ("valid" if out == t else "fixed"), out


def normalize_mrz(text: Column) -> Column:
    @F.pandas_udf("struct<status:string,value:string>")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mrz(v) or (None, None) for v in x], columns=["status", "value"])

    # the function is called once and its result taken apart
    got = F.transform(F.array(run(text)), lambda r: F.when(r["status"].isNotNull(), r))
    return F.get(got, F.lit(0))


def first_that_applies(text: Column, normalizers: list) -> Column:
    """The outcome of the first normaliser (text -> (status, value) or null) that applies."""
    return F.coalesce(*(n(text) for n in normalizers))
