"""Fields of a page: labels (anchors) are found among its lines, and values beside, below, left of, above or behind them.

Lines are rows (page, line_no, text, confidence, box). All definitions go through one pass: the lines are read for anchors once, anchors
meet the lines of their page in one equi-join, and every candidate's score is column arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import explanation, once

SAME_LINE, RIGHT, BELOW, LEFT, ABOVE = 1, 2, 4, 8, 16
STANDARD, ALL = SAME_LINE | RIGHT | BELOW, 31
#: What is stripped before an inline value, and around any value.
SEPARATORS, TRIMMED = ":=-–—#|.… \t\r\n\u00a0", " \t.,;:|\u00a0"
#: How far a value's place is trusted, and the weights of a score.
BIAS = {"Inline": 1.0, "Right": 0.98, "Below": 0.94, "Left": 0.86, "Above": 0.82}
WEIGHTS = (1.0, 1.0, 0.75, 0.5)
MIN_SIMILARITY, MIN_SCORE = 0.72, 0.35


@dataclass(frozen=True)
class Field:
    """``value``: an expression that a value must match; its group ``value_group`` (0: the whole match) is taken."""

    name: str
    anchors: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    directions: int = STANDARD
    value: str | None = None
    value_group: int = 0
    max_distance: float = 6.0
    band: float = 0.75
    occurrence: str = "best"
    similarity: float | None = None
    max_lines: int = 1

    def __post_init__(self):
        if not self.name.strip() or self.occurrence not in ("best", "first", "last"):
            raise ValueError("a field needs a name, and takes its best, first or last occurrence")


#: Expressions for values.
AMOUNT = r"[-+]?\s?[$€£¥₹]?\s?\d+(?:[., ]\d{3})*(?:[.,]\d{1,2})?"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
DATE = rf"(?i)\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}|\d{{1,2}}(?:st|nd|rd|th)?\s*{_MONTH},?\s*\d{{2,4}}|{_MONTH}\s*\d{{1,2}}(?:st|nd|rd|th)?,?\s*\d{{2,4}}"
IDENTIFIER = r"(?=[A-Za-z0-9][-A-Za-z0-9/_]*\d)[A-Za-z0-9][-A-Za-z0-9/_]{2,}"
CURRENCY = r"(?i)USD|EUR|GBP|JPY|INR|CAD|AUD|CHF|CNY|SEK|NZD|SGD|AED|ZAR|[$€£¥₹]"
#: The labels of the usual fields.
INVOICE_NUMBER = Field("InvoiceNumber", ("Invoice Number", "Invoice No", "Invoice Num", "Invoice ID", "Invoice Ref", "Bill Number", "Bill No", "Document Number", "Document No", "Receipt Number", "Receipt No"), value=IDENTIFIER, occurrence="first", max_distance=8.0)
PURCHASE_ORDER = Field("PurchaseOrderNumber", ("Purchase Order", "PO Number", "PO No", "Order Number", "Order No", "Order ID"), value=IDENTIFIER, occurrence="first", max_distance=8.0)
INVOICE_DATE = Field("InvoiceDate", ("Invoice Date", "Date of Issue", "Issue Date", "Issued On", "Bill Date", "Date"), value=DATE, occurrence="first", max_distance=8.0)
DUE_DATE = Field("DueDate", ("Due Date", "Payment Due", "Date Due", "Pay By", "Payable By"), value=DATE, occurrence="first", max_distance=8.0)
SUBTOTAL = Field("Subtotal", ("Subtotal", "Sub Total", "Net Amount", "Net Total", "Amount Excl Tax"), value=AMOUNT)
TAX = Field("Tax", ("Tax", "VAT", "GST", "Sales Tax", "Tax Amount", "Tax Total", "HST"), value=AMOUNT)
TOTAL = Field("Total", ("Total", "Total Due", "Total Amount", "Amount Due", "Balance Due", "Grand Total", "Amount Payable", "Total Payable", "Amount Paid"), value=AMOUNT, occurrence="last")
CURRENCY_FIELD = Field("Currency", ("Currency", "Currency Code", "Paid In", "Total", "Amount Due"), value=CURRENCY, occurrence="last")
INVOICE = (INVOICE_NUMBER, PURCHASE_ORDER, INVOICE_DATE, DUE_DATE, SUBTOTAL, TAX, TOTAL, CURRENCY_FIELD)
RECEIPT = (INVOICE_DATE, SUBTOTAL, TAX, TOTAL, CURRENCY_FIELD)


def _plain(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{Nd}]", ""))


def tokens(text: Column) -> Column:
    """(word, end) of the words of a text: letters and digits in lower case, and where the word ends in the text."""
    gaps, words = F.split(text, r"(?U)\S+", -1), F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["gap"]) + F.length(p["word"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(_plain(p["word"]).alias("word"), end.alias("end"))).alias("out"))

    pairs = F.filter(F.zip_with(gaps, words, lambda g, w: F.struct(g.alias("gap"), w.alias("word"))), lambda p: p["word"].isNotNull())
    return F.filter(F.aggregate(pairs, zero, step, lambda acc: acc["out"]), lambda t: t["word"] != "")


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edits over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _needles(f: Field) -> list[tuple[str, str, int]]:
    out = []
    for anchor in f.anchors:
        words = [w for w in ("".join(c for c in x if c.isalnum()).lower() for x in anchor.split()) if w]
        if words:
            out.append((anchor, "".join(words), len(words)))
    return out


def anchor(text: Column, words: Column, f: Field) -> Column:
    """(similarity, end, anchor) of the best anchor of a line, the first of equals; null if none is similar enough."""
    least = min(1.0, max(0.0, MIN_SIMILARITY if f.similarity is None else f.similarity))

    needles = _needles(f)
    sizes = sorted({n for _, _, n in needles})

    def windows(n: int) -> Column:
        """The runs of n words, without blanks, with their places and ends."""
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: i + n <= F.size(words))
        run = lambda i: F.get(words, i)["word"] if n == 1 else F.array_join(F.transform(F.slice(words, i + 1, F.lit(n)), lambda t: t["word"]), "")
        made = F.transform(starts, lambda i: F.struct(run(i).alias("t"), i.alias("i"), F.get(words, i + n - 1)["end"].alias("end")))
        return F.transform(made, lambda w: F.struct(F.length(w["t"]).alias("n"), *(w[c].alias(c) for c in ("t", "i", "end"))))

    def of(n: int) -> Column:
        """The needles of n words that a run is long enough for: the difference of the lengths alone bounds the similarity."""
        reach = lambda k: (int(k * least) - 1, int(k / least) + 1 if least else 2**30)
        rows = [(no, name, needle, *reach(len(needle))) for no, (name, needle, size) in enumerate(needles) if size == n]
        listed = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("no", "name", "needle", "lo", "hi"), r))) for r in rows))

        def tried(w: Column) -> Column:
            near = F.filter(listed, lambda x: (x["lo"] <= w["n"]) & (x["hi"] >= w["n"]))
            return F.transform(near, lambda x: F.struct(similarity(x["needle"], w["t"]).alias("s"), (-(w["i"] + 1000 * x["no"])).cast("int").alias("order"), w["end"].alias("end"), x["name"].alias("anchor")))

        return F.flatten(F.transform(windows(n), tried))

    def best_of(tried: Column) -> Column:
        best = F.array_max(F.filter(tried, lambda t: (t["s"] >= least) & (t["s"] > 0)))
        return once(best, lambda b: F.when(b.isNotNull(), F.struct(b["s"].alias("similarity"), b["end"].alias("end"), b["anchor"].alias("anchor"))))

    found = F.lit(None).cast("struct<similarity:double,end:int,anchor:string>")
    if needles:
        found = once(F.concat(*map(of, sizes)), best_of)
    for pattern in reversed(f.patterns):
        end = F.length(F.get(F.split(text, pattern, 2), F.lit(0))) + F.length(F.regexp_extract(text, pattern, 0))
        by_pattern = F.struct(F.lit(1.0).alias("similarity"), end.alias("end"), F.regexp_extract(text, pattern, 0).alias("anchor"))
        found = F.when((found.isNull() | (found["similarity"] < 1)) & text.rlike(pattern), by_pattern).otherwise(found)
    return found


def clean_value(text: Column, f: Field) -> Column:
    """(value, coverage) of a text, null if it is no value: what the expression finds, or the text, without what is trimmed around it."""
    whole = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    if f.value is None:
        raw, coverage = whole, F.lit(1.0)
    else:
        raw = F.when(whole.rlike(f.value), F.regexp_extract(whole, f.value, f.value_group))
        coverage = F.length(F.regexp_extract(whole, f.value, 0)) / F.greatest(F.length(whole), F.lit(1))
    made = F.struct(F.btrim(raw, F.lit(TRIMMED)).alias("value"), coverage.cast("double").alias("coverage"))
    return once(made, lambda m: F.when(F.length(m["value"]) > 0, m))


def place(a: Column, b: Column, height: Column, f: Field) -> Column:
    """(kind, distance, offset) of box b seen from an anchor's box a, in heights of the anchor's line; null where no value may stand."""
    middle = lambda x: (x["min_y"] + x["max_y"]) / 2
    across, along = F.abs(middle(b) - middle(a)) / height, geometry.horizontal_gap(a, b) / height
    in_row, in_column = across <= f.band, along <= f.band
    allowed = lambda d: F.lit(bool(f.directions & d))
    at = lambda kind, gap, offset: F.struct(F.lit(kind).alias("kind"), (F.greatest(F.lit(0.0), gap) / height).alias("distance"), offset.alias("offset"))
    seen = (
        F.when(in_row & allowed(RIGHT) & (b["min_x"] >= a["max_x"] - height * 0.25), at("Right", b["min_x"] - a["max_x"], across))
        .when(in_row & allowed(LEFT) & (b["max_x"] <= a["min_x"] + height * 0.25), at("Left", a["min_x"] - b["max_x"], across))
        .when(in_column & allowed(BELOW) & (b["min_y"] >= a["max_y"] - height * 0.35), at("Below", b["min_y"] - a["max_y"], along))
        .when(in_column & allowed(ABOVE) & (b["max_y"] <= a["min_y"] + height * 0.35), at("Above", a["min_y"] - b["max_y"], along))
    )
    able = ~geometry.is_empty(a) & ~geometry.is_empty(b) & (height > 0)
    return once(F.when(able, seen), lambda s: F.when(s["distance"] <= f.max_distance, s))


def score(similar: Column, distance: Column, offset: Column, coverage: Column, kind: Column, f: Field, weights: tuple[float, ...] = WEIGHTS) -> Column:
    inside = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    parts = [inside(similar), 1 - inside(distance / max(f.max_distance, 1e-6)), 1 - inside(offset / max(f.band, 1e-6)), F.lit(0.85) if f.value is None else 0.5 + inside(coverage) * 0.5]
    kept = [max(0.0, w) for w in weights]
    if not sum(kept):
        return F.lit(0.0)
    mean = reduce(lambda x, y: x + y, (p * w for p, w in zip(parts, kept))) / sum(kept)
    bias = F.lit(0.82)
    for name, b in BIAS.items():
        bias = F.when(kind == name, b).otherwise(bias)
    return inside(mean * bias)


def _with(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` of a costly value that is then filtered: it is worked out once, not in the filter and again behind it."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name)).filter(F.col(name).isNotNull())


def candidates(lines: DataFrame, fields: tuple[Field, ...], page: str = "page") -> DataFrame:
    """(page, field_no, anchor_line, value_line (-1: inline), kind, value, score, distance, similarity, anchor, height) of every value that any field may take."""
    heights = Window.partitionBy(page)
    own = F.col("box")["max_y"] - F.col("box")["min_y"]
    sizes = F.array_sort(F.collect_list(F.when(own > 0, own)).over(heights))
    upper_median = F.coalesce(F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")), F.lit(1.0))
    # the work on a page is more than its bytes tell, so its partitions are not joined by their size
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.repartition(parts, page).withColumn("_height", F.when(own > 0, own).otherwise(upper_median)).withColumn("_words", tokens(F.col("text")))
    hits = F.array(*(F.struct(F.lit(i).alias("no"), anchor(F.col("text"), F.col("_words"), f).alias("hit")) for i, f in enumerate(fields)))
    anchors = rows.select(F.col(page).alias("_page"), F.col("line_no").alias("anchor_line"), F.col("box").alias("_box"), "_height", F.col("text").alias("_text"), F.explode_outer(F.filter(hits, lambda h: h["hit"].isNotNull())).alias("_h")).filter("_h is not null")
    pick = lambda make: reduce(lambda rest, x: F.when(F.col("_h.no") == x[0], make(x[1])).otherwise(rest), enumerate(fields), F.lit(None))
    shared = ["_page", F.col("_h.no").alias("field_no"), "anchor_line"]
    told = [F.col("_h.hit.similarity").alias("similarity"), F.col("_h.hit.anchor").alias("anchor"), F.col("_height").alias("height"), F.col("_box").alias("anchor_box")]
    similar = F.col("_h.hit.similarity")

    behind = F.ltrim(F.substring(F.col("_text"), F.col("_h.hit.end") + 1, F.length("_text")), F.lit(SEPARATORS))
    zero = F.lit(0.0)
    inline = _with(anchors, "_v", pick(lambda f: clean_value(behind, f) if f.directions & SAME_LINE else F.lit(None).cast("struct<value:string,coverage:double>")))
    inline = inline.withColumn("_score", pick(lambda f: score(similar, zero, zero, F.col("_v.coverage"), F.lit("Inline"), f)))
    inline = inline.select(*shared, F.lit(-1).alias("value_line"), F.lit("Inline").alias("kind"), F.col("_v.value").alias("value"), F.col("_score").alias("score"), zero.alias("distance"), *told)

    others = rows.select(F.col(page).alias("_other"), F.col("line_no").alias("value_line"), F.col("box").alias("_b"), F.col("text").alias("_t")).filter(F.col("_t").rlike(r"(?U)\S"))
    pairs = anchors.join(others, (F.col("_page") == F.col("_other")) & (F.col("anchor_line") != F.col("value_line")))
    pairs = _with(pairs, "_p", pick(lambda f: place(F.col("_box"), F.col("_b"), F.col("_height"), f)))
    pairs = _with(pairs, "_v", pick(lambda f: clean_value(F.col("_t"), f)))
    pairs = pairs.withColumn("_score", pick(lambda f: score(similar, F.col("_p.distance"), F.col("_p.offset"), F.col("_v.coverage"), F.col("_p.kind"), f)))
    beside = pairs.select(*shared, "value_line", F.col("_p.kind").alias("kind"), F.col("_v.value").alias("value"), F.col("_score").alias("score"), F.col("_p.distance").alias("distance"), *told)
    return inline.unionByName(beside).withColumnRenamed("_page", page)


def winners(found: DataFrame, fields: tuple[Field, ...], page: str = "page", min_score: float = MIN_SCORE) -> DataFrame:
    """Each page's candidate of each field: of the first, the last or any anchor the best, then the first seen; none if the one chosen scores too low."""
    sign = reduce(lambda rest, x: F.when(F.col("field_no") == x[0], {"first": 1, "last": -1, "best": 0}[x[1].occurrence]).otherwise(rest), enumerate(fields), F.lit(0))
    order = Window.partitionBy(page, "field_no").orderBy(F.col("anchor_line") * sign, F.desc("score"), "anchor_line", "value_line")
    return found.withColumn("_n", F.row_number().over(order)).filter((F.col("_n") == 1) & (F.col("score") >= min_score)).drop("_n")


def extract_fields(lines: DataFrame, fields: tuple[Field, ...] = INVOICE, page: str = "page", min_score: float = MIN_SCORE) -> DataFrame:
    """(page, field_no, name, value, confidence, score, kind, anchor, similarity, distance, anchor_line, n_lines, box, explanation), one row for each field found.

    A value below its anchor that no expression has to match goes on over the next lines, up to ``max_lines``, while they are
    aligned with the line before and near it.
    """
    won = winners(candidates(lines, fields, page), fields, page, min_score)
    by_field = lambda value, none: reduce(lambda rest, x: F.when(F.col("field_no") == x[0], F.lit(value(x[1]))).otherwise(rest), enumerate(fields), F.lit(none))
    won = won.withColumn("_first", F.when(F.col("value_line") < 0, F.col("anchor_line")).otherwise(F.col("value_line")))
    goes_on = by_field(lambda f: f.value is None, False) & (F.col("kind") == "Below")
    won = won.withColumn("_last", F.col("_first") + F.when(goes_on, by_field(lambda f: f.max_lines, 1)).otherwise(F.lit(1)) - 1).withColumn("_band", by_field(lambda f: float(f.band), 0.0))
    before = Window.partitionBy("_lp").orderBy("_no")
    rows = lines.select(F.col(page).alias("_lp"), F.col("line_no").alias("_no"), F.col("text").alias("_t"), F.col("confidence").alias("_c"), F.col("box").alias("_b"))
    rows = rows.withColumn("_before", F.lag("_b").over(before))
    parts = won.join(rows, (F.col(page) == F.col("_lp")) & F.col("_no").between(F.col("_first"), F.col("_last")))
    tall = F.col("_before")["max_y"] - F.col("_before")["min_y"]
    gap = F.col("_b")["min_y"] - F.col("_before")["max_y"]
    text = F.btrim(F.regexp_replace("_t", r"(?U)^\s+|\s+$", ""), F.lit(TRIMMED))
    near = (F.length(text) > 0) & ~geometry.is_empty(F.col("_b")) & ~geometry.is_empty(F.col("_before")) & (geometry.horizontal_gap(F.col("_before"), F.col("_b")) <= F.col("_band") * F.col("height")) & gap.between(tall * -0.35, tall * 1.5)
    chain = Window.partitionBy(page, "field_no").orderBy("_no")
    parts = parts.withColumn("_on", F.min(F.when(F.col("_no") == F.col("_first"), F.lit(1)).otherwise(F.coalesce(near.cast("int"), F.lit(0)))).over(chain)).filter("_on = 1")
    parts = parts.withColumn("_part", F.when(F.col("_no") == F.col("_first"), F.col("value")).otherwise(text))
    one = ["score", "kind", "anchor", "similarity", "distance", "anchor_line"]
    whole = parts.groupBy(page, "field_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_part"))), lambda p: p["_part"]), " ").alias("value"),
        F.avg("_c").alias("confidence"),
        *(F.first(c).alias(c) for c in one),
        F.count(F.lit(1)).alias("n_lines"),
        F.struct(*(f(F.col(f"_b.{c}")).alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y")))).alias("box"),
    )

    told = explanation(F.col("anchor"), F.col("similarity"), F.col("kind"), F.col("distance"), F.col("score"))
    return whole.withColumn("name", by_field(lambda f: f.name, None)).withColumn("explanation", told)


def value_map(found: DataFrame, page: str = "page") -> DataFrame:
    """(page, values): a map from name to value, the first definition of a name wins."""
    first = found.groupBy(page, "name").agg(F.min_by("value", "field_no").alias("value"))
    return first.groupBy(page).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("values"))
