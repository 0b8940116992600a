"""Correction of recognised text by a lexicon.

Tokens are corrected as rows: distinct words that may be wrong meet the lexicon through shared delete variants, once however often
they occur, and what is chosen goes back to the tokens by a join; white space stays as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics

GATE, MIN_LENGTH, CERTAIN = 0.75, 3, 0.5
_CORE = r"^([^\p{L}\p{Nd}]*)(.*?)([^\p{L}\p{Nd}]*)$"


def token_confidence(start: Column, end: Column, ordinal: Column, chars: Column, words: Column, line: Column) -> Column:
    """The least of the token's characters, else its word's, else the line's. ``chars``: one confidence for each character of the text, or null."""
    own = F.array_min(F.slice(chars, start + 1, F.greatest(end - start, F.lit(1))))
    return F.coalesce(F.when(end <= F.size(chars), own), F.get(words, ordinal), line)


def lexicon_index(lexicon: DataFrame, distance: int = 1) -> DataFrame:
    """(variant, term, low, ord) of a lexicon (term, ord): blanks dropped, the first spelling of each word kept."""
    words = lexicon.select(F.trim("term").alias("term"), "ord").filter("term <> ''").withColumn("low", F.lower("term"))
    words = words.groupBy("low").agg(F.min_by("term", "ord").alias("term"), F.min("ord").alias("ord"))
    return words.withColumn("variant", F.explode(T.delete_variants(F.col("low"), distance)))


def suggestions(words: DataFrame, index: DataFrame, distance: int = 1) -> DataFrame:
    """(core, found): for each distinct word the terms within the distance, sorted by weighted distance, distance and place in the lexicon."""
    asked = words.select("core").distinct().withColumn("_low", F.lower("core"))
    pairs = asked.withColumn("variant", F.explode(T.delete_variants(F.col("_low"), distance))).join(index, "variant").select("core", "_low", "term", "low", "ord").distinct()
    near = pairs.withColumn("edits", F.levenshtein("_low", "low")).filter(F.col("edits") <= distance)
    near = near.withColumn("score", metrics.weighted_distance_of(F.col("_low"), F.col("low")))
    return near.groupBy("core").agg(F.array_sort(F.collect_list(F.struct("score", "edits", "ord", "term"))).alias("found"))


def choose(core: Column, found: Column, chars: Column, start: Column, gate: float = GATE) -> Column:
    """The best term: each character that was read with confidence and that a term of the same length would rewrite costs ``CERTAIN`` more."""
    at = lambda i: F.get(chars, start + i)
    letter = lambda s, i: F.lower(F.substring(s, i + 1, F.lit(1)))

    def cost(s: Column) -> Column:
        rewritten = F.filter(F.sequence(F.lit(0), F.length(core) - 1), lambda i: F.coalesce(at(i) >= gate, F.lit(False)) & (letter(core, i) != letter(s["term"], i)))
        return s["score"] + F.when(F.length(s["term"]) == F.length(core), F.size(rewritten) * CERTAIN).otherwise(F.lit(0.0))

    return F.array_min(F.transform(found, lambda s, i: F.struct(cost(s).alias("cost"), i.alias("i"), s["term"].alias("term"))))["term"]


def correct_lines(
    lines: DataFrame, lexicon: DataFrame | None = None, key: str = "line_id", replacements: dict[str, str] | None = None, normalizers: tuple = (), distance: int = 1,
    gate: float = GATE, min_length: int = MIN_LENGTH, with_digits: bool = False, keep_case: bool = True,
) -> DataFrame:
    """(key, text, corrected) of lines (key, text, confidence) and optionally char_conf and word_conf (arrays).

    ``normalizers`` take a column and give (status, value) or null: the first that applies to the whole line decides it, else to a token.
    A token is then replaced by ``replacements``, or, where its confidence is below the gate, it is long enough, has no digit and
    is not in the lexicon, by the best term near it, in its own letter case.
    """
    if not 1 <= distance <= 3:
        raise ValueError("the distance is 1 to 3")
    rows = lines.select(
        F.col(key).alias("_key"), "text", F.col("confidence").cast("double").alias("_line"),
        (F.col("char_conf") if "char_conf" in lines.columns else F.lit(None)).cast("array<double>").alias("_chars"),
        (F.col("word_conf") if "word_conf" in lines.columns else F.lit(None)).cast("array<double>").alias("_words"),
    )
    rows = rows.withColumn("_chars", F.when(F.size("_chars") == F.length("text"), F.col("_chars")))
    outcome = F.coalesce(*(n(F.col("text")) for n in normalizers)) if normalizers else F.lit(None).cast("struct<status:string,value:string>")
    rows = rows.withColumn("_whole", F.when(F.col("text").rlike(r"(?U)\S"), outcome))
    parts = rows.filter(F.col("_whole").isNull()).select("_key", "_line", "_chars", "_words", F.col("text").rlike(r"(?U)^\s").alias("_blank"), F.posexplode(T.spans(F.col("text"), r"(?U)\s+|\S+")).alias("pos", "s"))
    parts = parts.select("*", "s.start", "s.end", F.col("s.value").alias("part")).drop("s")
    # tokens and white space take turns, so a token's number follows from its place
    ordinal = F.floor((F.col("pos") - F.col("_blank").cast("int")) / 2).cast("int")
    parts = parts.withColumn("lead", F.regexp_extract("part", _CORE, 1)).withColumn("core", F.regexp_extract("part", _CORE, 2)).withColumn("tail", F.regexp_extract("part", _CORE, 3))
    parts = parts.withColumn("_conf", token_confidence(F.col("start"), F.col("end"), ordinal, F.col("_chars"), F.col("_words"), F.col("_line")))
    is_token = (F.col("core") != "") & ~F.col("part").rlike(r"(?U)^\s")
    literal = F.lit(None).cast("string")
    if replacements:
        literal = F.element_at(F.create_map(*(F.lit(x) for pair in replacements.items() for x in pair)), F.col("core"))
    own = F.coalesce(*(n(F.col("core")) for n in normalizers)) if normalizers else F.lit(None).cast("struct<status:string,value:string>")
    parts = parts.withColumn("_new", F.when(is_token, literal)).withColumn("_own", F.when(is_token & F.col("_new").isNull(), own))
    eligible = is_token & F.col("_new").isNull() & F.col("_own").isNull() & (F.col("_conf") < gate) & (F.length("core") >= min_length)
    if not with_digits:
        eligible = eligible & ~F.col("core").rlike(r"\p{Nd}")
    term = F.lit(None).cast("string")
    if lexicon is not None:
        index = lexicon_index(lexicon, distance)
        asked = parts.filter(eligible).select("core").distinct()
        unknown = asked.join(index.select(F.col("low")).distinct(), F.lower("core") == F.col("low"), "left_anti")
        parts = parts.join(suggestions(unknown, index, distance).withColumnRenamed("core", "_asked"), F.when(eligible, F.col("core")) == F.col("_asked"), "left")
        best = choose(F.col("core"), F.col("found"), F.col("_chars"), F.col("start") + F.length("lead"), gate)
        term = F.when(F.col("found").isNotNull(), T.adopt_case(F.col("core"), best) if keep_case else best)
    valid = F.when(F.col("_own.status") != "invalid", F.col("_own.value"))
    new = F.coalesce("_new", valid, term)
    parts = parts.withColumn("_out", F.when(is_token & new.isNotNull(), F.concat("lead", new, "tail")).otherwise(F.col("part")))
    joined = parts.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_out"))), lambda p: p["_out"]), "").alias("_joined"))
    whole = F.when(F.col("_whole").isNotNull(), F.when(F.col("_whole.status") != "invalid", F.col("_whole.value")).otherwise(F.col("text")))
    out = rows.join(joined.withColumnRenamed("_key", "_k"), F.col("_key") == F.col("_k"), "left")
    return out.select(F.col("_key").alias(key), "text", F.coalesce(whole, "_joined", "text").alias("corrected"))


def rebuilt_words(before: Column, after: Column, words: Column) -> Column:
    """A line's words (text, ...) with the corrected texts; none where the numbers of tokens and words differ."""
    old, new = T.units(before, "word"), T.units(after, "word")
    same = (F.size(old) == F.size(new)) & (F.size(new) == F.size(words))
    return F.when(same, F.zip_with(words, new, lambda w, t: w.withField("text", t))).otherwise(F.slice(words, 1, 0))
