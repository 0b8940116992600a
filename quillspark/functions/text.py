"""Text functions: normalisation, tokens, case, delete variants, error rates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of characters that recognition confuses, lower-case, the lesser first.
CONFUSABLE = ["0o", "0q", "1i", "1l", "2z", "5s", "6g", "8b", "9q", "ce", "il", "uv"]


def once(value: Column, body) -> Column:
    """``body`` of the value, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column, lower: bool = True, punctuation: bool = True, white_space: bool = True) -> Column:
    """Lower case, then punctuation stripped, then white space collapsed."""
    if lower:
        text = F.lower(text)
    if punctuation:
        text = F.regexp_replace(text, r"\p{P}", "")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) if white_space else text


def token_core(token: Column) -> Column:
    """The token without the characters before its first and behind its last letter or digit."""
    return F.regexp_extract(token, r"^[^\p{L}\p{Nd}]*(.*?)[^\p{L}\p{Nd}]*$", 1)


def adopt_case(source: Column, term: Column) -> Column:
    """The term in the letter case of the source: all upper (over one character), all lower, initial upper (the rest is lower then), else as it is."""
    upper, lower, first = F.upper(source), F.lower(source), F.substring(source, 1, 1)
    capital = F.concat(F.upper(F.substring(term, 1, 1)), F.lower(F.substring(term, F.lit(2), F.length(term))))
    return (
        F.when(upper == lower, term)
        .when((source == upper) & (F.length(source) > 1), F.upper(term))
        .when(source == lower, F.lower(term))
        .when(first != F.lower(first), capital)
        .otherwise(term)
    )


def delete_variants(term: Column, distance: int = 1) -> Column:
    """The term and what is left of it after deleting up to ``distance`` characters, without repeats."""
    out = F.array(term)
    for _ in range(distance):
        shorter = F.flatten(F.transform(out, lambda t: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: i <= F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def is_confusable(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return F.concat(F.least(a, b), F.greatest(a, b)).isin(CONFUSABLE)


def error_rate(edits: Column, reference_length: Column) -> Column:
    """Edits over the reference's length; for an empty reference 0 without edits and 1 with."""
    return F.when(reference_length == 0, F.when(edits == 0, 0.0).otherwise(1.0)).otherwise(edits / reference_length)


def mask_matches(text: Column, pattern: str, keep=None, mask: str = "█") -> Column:
    """Each character of every match (for which ``keep`` holds) replaced by the mask character."""
    hide = lambda m: F.repeat(F.lit(mask), F.length(m)) if keep is None else F.when(keep(m), F.repeat(F.lit(mask), F.length(m))).otherwise(m)
    masked = lambda t: F.when(t.rlike(pattern), replace_matches(t, pattern, lambda m, i: hide(m))).otherwise(t)
    return once(text, masked)  # a text that is made in the same step is made once


def replace_matches(text: Column, pattern: str, make) -> Column:
    """Every match replaced by what ``make`` gives for it and its number."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = F.transform(found, lambda m, i: make(m, i))
    return F.array_join(F.zip_with(gaps, made, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def split_words(line: Column, x0: Column, width: Column) -> Column:
    """(word, x0, w) of the words of a line that has no word boxes: its width divided in proportion to their characters."""
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    total = F.length(F.regexp_replace(line, r"(?U)\s+", ""))
    zero = F.struct(F.lit(0).alias("at"), total.alias("total"), F.array().cast("array<struct<word:string,x0:double,w:double>>").alias("out"))

    def step(acc: Column, word: Column) -> Column:
        box = F.struct(word.alias("word"), (x0 + width * acc["at"] / acc["total"]).alias("x0"), (width * F.length(word) / acc["total"]).alias("w"))
        return F.struct((acc["at"] + F.length(word)).alias("at"), acc["total"].alias("total"), F.array_append(acc["out"], box).alias("out"))

    return F.aggregate(words, zero, step, lambda acc: acc["out"])


def xml_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def csv_field(text: Column, delimiter: str = ",") -> Column:
    """RFC 4180: quoted only where the delimiter, a quote or a line end stands in it."""
    needs = text.contains(delimiter) | text.contains('"') | text.contains("\r") | text.contains("\n")
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def unicode_form(text: Column, form: str = "NFKC") -> Column:
    """The text in a Unicode normal form."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    return run(text)


def units(text: Column, unit: str = "grapheme") -> Column:
    """The text's graphemes, runes (code points), UTF-16 units (as hexadecimal numbers) or words, as an array."""
    if unit == "grapheme":
        return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))
    if unit == "rune":
        return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    if unit == "utf16":
        return F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    if unit == "word":
        return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))
    raise ValueError(f"no unit is named {unit}")


def spans(text: Column, pattern: str, keep=None) -> Column:
    """(start, end, value) of every match that is not empty and that ``keep`` accepts; offsets in code points, ends exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value"))), lambda p: p["value"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"))).alias("out"))

    out = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    return F.filter(out, lambda x: (x["value"] != "") & (keep(x["value"]) if keep else F.lit(True)))


def word_spans(text: Column) -> Column:
    return spans(text, r"(?U)\S+")


def keyword_spans(text: Column, keyword: str, case_sensitive: bool = False) -> Column:
    return spans(text, ("" if case_sensitive else "(?i)") + "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in keyword))


def touched(words: Column, matches: Column) -> Column:
    """The words (spans) that overlap a match: half-open spans."""
    return F.filter(words, lambda w: F.exists(matches, lambda m: (m["start"] < w["end"]) & (w["start"] < m["end"])))


def mask_spans(text: Column, matches: Column, mask: str = "█") -> Column:
    """Every character inside a match replaced; matches may overlap."""
    hidden = lambda i: F.exists(matches, lambda m: (i >= m["start"]) & (i < m["end"]))
    runes = units(text, "rune")
    return F.when(F.size(matches) == 0, text).otherwise(F.array_join(F.transform(runes, lambda c, i: F.when(hidden(i), F.lit(mask)).otherwise(c)), ""))


def mask_in_order(text: Column, matches: Column, mask: str = "█") -> Column:
    """As ``mask_spans``, for matches in order that do not overlap."""
    before = lambda i: F.when(i > 0, F.get(matches, i - 1)["end"]).otherwise(0)
    pieces = F.transform(matches, lambda m, i: F.concat(F.substring(text, before(i) + 1, m["start"] - before(i)), F.repeat(F.lit(mask), m["end"] - m["start"])))
    return F.concat(F.array_join(pieces, ""), F.substring(text, before(F.size(matches)) + 1, F.length(text)))


def languages(codes: Column) -> Column:
    """Codes without blanks, trimmed, in lower case, each once; an error if none is left."""
    out = F.array_distinct(F.filter(F.transform(codes, lambda c: F.lower(F.trim(c))), lambda c: c != ""))
    return F.when(F.size(out) == 0, F.raise_error(F.lit("no language is given")).cast("array<string>")).otherwise(out)


def allowed_characters(characters: str, allow: str | None = None, block: str | None = None) -> list[bool] | None:
    """Which characters of a vocabulary may be read: those of ``allow``, else all but those of ``block``; None for no mask."""
    if allow:
        return [c in allow for c in characters]
    return [c not in block for c in characters] if block else None


def byte_size(n: Column, largest: str = "GB") -> Column:
    """A number of bytes for reading, with one place behind the point from a KiB on (of two as near the even one), in units up to ``largest``; null for null."""
    units = ("KB", "MB", "GB")
    size = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for i, unit in enumerate(units[: units.index(largest) + 1], 1):
        fits = n.isNotNull() if unit == largest else n < 1024 ** (i + 1)
        size = size.when(fits, F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / 1024**i, 1)))
    return size


def fraction(done: Column, total: Column) -> Column:
    """Progress from 0 to 1; null where the total is not known."""
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total)))


def explanation(anchor: Column, similarity: Column, kind: Column, distance: Column, score: Column) -> Column:
    """Why a field's value was taken, in a line."""
    return F.format_string("'%s' matched at %.2f similarity; value taken %s at %.2f line-heights; score %.3f.", F.coalesce(anchor, F.lit("(none)")), similarity, kind, distance, score)
