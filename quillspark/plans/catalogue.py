"""The queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checksums, geometry, text
from ..operators import decode, layout, metrics, scores, tables
from ..sources.tables import LAYOUT_SQL
from ..sources.tables import layout as boxes
from ..sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _luhn_sql(digits: str) -> str:
    return f"(list_sum([CASE WHEN i % 2 = 1 THEN CAST({digits}[length({digits}) + 1 - i] AS INT) ELSE [0,2,4,6,8,1,3,5,7,9][CAST({digits}[length({digits}) + 1 - i] AS INT) + 1] END for i in range(1, length({digits}) + 1)]) % 10 = 0)"


# --- personal data ---------------------------------------------------------------------------------------

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}"
PHONE = r"\+?[0-9][0-9 ().-]{5,}[0-9]"


@query(
    f"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, string_split_regex(text, '[0-9]+') AS g, regexp_extract_all(text, '[0-9]+') AS m FROM documents WHERE regexp_matches(text, '[0-9][0-9 -]{{11,}}[0-9]')),
    i AS (SELECT k, g, m, unnest(range(1, len(m) + 1)) AS i FROM t), c AS (SELECT k, i, i + n - 1 AS j, array_to_string(m[i:i + n - 1], '') AS c FROM i, range(1, 20) r(n) WHERE i + n - 1 <= len(m) AND len(list_filter(g[i + 1:i + n - 1], lambda x: x NOT IN (' ', '-'))) = 0),
    v AS (SELECT k, i, j FROM (SELECT * FROM c WHERE length(c) BETWEEN 13 AND 19) WHERE {_luhn_sql('c')}), a AS (SELECT k, list(i) AS a FROM v WHERE i = j GROUP BY k),
    w AS (SELECT v.k, list([{{'i': i, 'j': j}}] ORDER BY i, j DESC) AS w FROM v LEFT JOIN a ON v.k = a.k WHERE i = j OR a.a IS NULL OR len(list_filter(a.a, lambda x: x BETWEEN i AND j)) = 0 GROUP BY v.k),
    s AS (SELECT k, list_reduce(w, lambda x, y: CASE WHEN x[len(x)].j < y[1].i THEN list_concat(x, y) ELSE x END) AS s FROM w),
    o AS (SELECT doc_id, len(s) AS n, array_to_string([CASE WHEN len(list_filter(s, lambda x: x.i < q AND q <= x.j)) > 0 THEN repeat('█', length(g[q])) ELSE g[q] END || CASE WHEN q > len(m) THEN '' WHEN len(list_filter(s, lambda x: q BETWEEN x.i AND x.j)) > 0 THEN repeat('█', length(m[q])) ELSE m[q] END for q in range(1, len(g) + 1)], '') AS masked FROM t JOIN s ON t.k = s.k)
    SELECT doc_id, CAST(n AS BIGINT) AS n_cards, sha256(masked) AS masked FROM o"""
)
def redact_card(spark, d):
    """Card numbers, in groups or not and whatever stands beside them: how many, and the text with each masked."""
    docs = table(spark, d, "documents").filter(F.col("text").rlike(checksums.CARD_RUN))
    runs = F.regexp_extract_all(F.col("text"), F.lit(checksums.CARD_RUN), F.lit(0))
    docs = docs.select("doc_id", "text", F.transform(runs, checksums.card_spans).alias("cards"))
    docs = docs.withColumn("n_cards", F.aggregate("cards", F.lit(0).cast("long"), lambda a, c: a + F.size(c))).filter("n_cards > 0")
    masked = text.replace_matches(F.col("text"), checksums.CARD_RUN, lambda r, i: text.mask_in_order(r, F.get("cards", i)))
    return docs.select("doc_id", "n_cards", F.sha2(masked, 256).alias("masked"))


def _masked_sql(pattern: str, keep: str = "TRUE") -> str:
    p = pattern.replace("'", "''")
    return f"""WITH t AS (SELECT doc_id, text, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m FROM documents WHERE regexp_matches(text, '{p}')),
      u AS (SELECT doc_id, len(list_filter(m, lambda x: {keep})) AS n, array_to_string([g[i] || CASE WHEN i <= len(m) THEN CASE WHEN list_contains(list_filter(m, lambda x: {keep}), m[i]) THEN repeat('█', length(m[i])) ELSE m[i] END ELSE '' END for i in range(1, len(g) + 1)], '') AS s FROM t)
      SELECT doc_id, CAST(n AS BIGINT) AS n_found, sha256(s) AS masked FROM u WHERE n > 0"""


def _redact(spark, d, pattern: str, keep=None) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("text").rlike(pattern))
    found = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
    n = F.size(F.filter(found, keep) if keep else found).cast("long")
    return docs.select("doc_id", n.alias("n_found"), F.sha2(text.mask_matches(F.col("text"), pattern, keep), 256).alias("masked")).filter("n_found > 0")


@query(_masked_sql(EMAIL))
def redact_email(spark, d):
    return _redact(spark, d, EMAIL)


@query(_masked_sql(PHONE, "length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 7 AND 15"))
def redact_phone(spark, d):
    return _redact(spark, d, PHONE, lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(7, 15))


@query(_masked_sql("[0-9]{6,}"))
def redact_digit_run(spark, d):
    return _redact(spark, d, "[0-9]{6,}")


@query(_masked_sql(r"(?:the|und|que)"))
def mask_keywords(spark, d):
    return _redact(spark, d, r"(?:the|und|que)")


@query(
    """WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 18, '0') AS b FROM customer),
    k AS (SELECT *, CAST(98 - CAST(b || '131400' AS HUGEINT) % 97 AS INT) AS good FROM c),
    i AS (SELECT c_custkey, 'DE' || lpad(CAST((good + c_custkey % 2) AS VARCHAR), 2, '0') || b AS iban, b, good + c_custkey % 2 AS chk FROM k)
    SELECT c_custkey, iban, CAST(b || '1314' || lpad(CAST(chk AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 AS valid FROM i"""
)
def iban_mod97(spark, d):
    body = F.lpad(F.col("c_custkey").cast("string"), 18, "0")
    good = 98 - checksums.mod97(F.concat(body, F.lit("131400"))) + F.col("c_custkey") % 2
    iban = F.concat(F.lit("DE"), F.lpad(good.cast("string"), 2, "0"), body)
    return spread(table(spark, d, "customer").select("c_custkey")).select("c_custkey", iban.alias("iban")).withColumn("valid", checksums.is_iban_for_redaction(F.col("iban")))


@query(
    """WITH s AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000 AS VARCHAR), 3, '0') AS a, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS g, lpad(CAST(c_custkey * 31 % 10000 AS VARCHAR), 4, '0') AS n FROM customer)
    SELECT c_custkey, a || '-' || g || '-' || n AS ssn, a NOT IN ('000', '666') AND a < '900' AND g <> '00' AND n <> '0000' AS valid FROM s"""
)
def redact_ssn(spark, d):
    k = F.col("c_custkey")
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    out = table(spark, d, "customer").select("c_custkey", F.concat_ws("-", pad(k * 7919 % 1000, 3), pad(k % 100, 2), pad(k * 31 % 10000, 4)).alias("ssn"))
    return out.withColumn("valid", checksums.is_ssn(F.col("ssn")))


@query(f"WITH k AS (SELECT o_orderkey, CAST(o_orderkey * 7919 + o_custkey AS VARCHAR) AS s FROM orders) SELECT o_orderkey, s, length(s) > 1 AND {_luhn_sql('s')} AS valid FROM k")
def luhn_check(spark, d):
    s = (F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string")
    return table(spark, d, "orders").select("o_orderkey", s.alias("s"), checksums.is_luhn(s).alias("valid"))


@query(
    """WITH k AS (SELECT c_custkey, upper(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g')) || '<' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 10 = 0 THEN '!' ELSE '' END AS f FROM customer)
    SELECT c_custkey, f AS field, CASE WHEN NOT regexp_full_match(f, '[A-Z0-9<]*') THEN -1 ELSE CAST(list_sum([CASE WHEN f[i] = '<' THEN 0 WHEN f[i] BETWEEN '0' AND '9' THEN ascii(f[i]) - 48 ELSE ascii(f[i]) - 55 END * [7, 3, 1][(i - 1) % 3 + 1] for i in range(1, length(f) + 1)]) % 10 AS INT) END AS check_digit FROM k"""
)
def mrz_check_digit(spark, d):
    field = F.concat(F.upper(F.regexp_replace("c_mktsegment", "[^A-Za-z]", "")), F.lit("<"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 10 == 0, F.lit("!")).otherwise(F.lit("")))
    return table(spark, d, "customer").select("c_custkey", field.alias("field"), checksums.mrz_check_digit(field).alias("check_digit"))


# --- text ------------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, levenshtein(p_name, replace(replace(p_name, 'a', 'o'), 'e', '')) AS edits,
    round(levenshtein(p_name, replace(replace(p_name, 'a', 'o'), 'e', '')) / length(p_name), 6) AS cer FROM part"""
)
def cer_pairs(spark, d):
    edits = F.levenshtein("p_name", F.replace(F.replace("p_name", F.lit("a"), F.lit("o")), F.lit("e"), F.lit("")))
    return table(spark, d, "part").select("p_partkey", edits.cast("long").alias("edits"), F.round(text.error_rate(edits, F.length("p_name")), 6).alias("cer"))


@query(
    r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '\p{P}', '', 'g'), '[\s\x{85}\x0B\x{A0}\x{2028}\x{2029}]+', ' ', 'g'))) AS normalized FROM documents"""
)
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("normalized"))


@query("SELECT doc_id, CAST(i - 1 AS INT) AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def line_explode(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS full_text, count(*) AS lines FROM conversations WHERE text <> '' GROUP BY conv_id")
def full_text(spark, d):
    lines = F.array_sort(F.collect_list(F.struct("turn", "text")))
    c = table(spark, d, "conversations").filter("text <> ''").groupBy("conv_id")
    return c.agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["text"]), "\n"), 256).alias("full_text"), F.count(F.lit(1)).alias("lines"))


_WORDS_SQL = "w AS (SELECT p_partkey, i, string_split(p_name, ' ')[i] AS word FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)), lex AS (SELECT lower(word) AS term, min(p_partkey * 100 + i) AS ord FROM w WHERE word <> '' GROUP BY 1)"


def _lexicon(spark, d) -> DataFrame:
    words = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "word")).filter("word <> ''")
    return words.groupBy(F.lower("word").alias("term")).agg(F.min(F.col("p_partkey") * 100 + F.col("i") + 1).alias("ord"))


@query(f"WITH {_WORDS_SQL} SELECT term, ord FROM lex")
def lexicon_dedupe(spark, d):
    return _lexicon(spark, d)


@query(f"WITH {_WORDS_SQL} SELECT DISTINCT term, v AS variant FROM (SELECT term, unnest([term] || [left(term, i - 1) || substr(term, i + 1) for i in range(1, length(term) + 1)]) AS v FROM lex)")
def delete_variants(spark, d):
    return _lexicon(spark, d).select("term", F.explode(text.delete_variants(F.col("term"))).alias("variant"))


@query(
    f"""WITH {_WORDS_SQL}, q AS (SELECT term AS token, left(term, 1) || substr(term, 3) AS seen, ord FROM lex WHERE length(term) > 3),
    m AS (SELECT q.seen, lex.term, levenshtein(q.seen, lex.term) AS dist, lex.ord FROM q JOIN lex ON levenshtein(q.seen, lex.term) <= 1)
    SELECT DISTINCT seen, first_value(term) OVER (PARTITION BY seen ORDER BY dist, ord) AS best FROM m"""
)
def lexicon_lookup(spark, d):
    """Tokens with a letter lost, looked up by shared delete variants and then by true distance."""
    lexicon = _lexicon(spark, d)
    known = lexicon.select("term", "ord", F.explode(text.delete_variants(F.col("term"))).alias("variant"))
    seen = lexicon.filter("length(term) > 3").select(F.concat(F.substring("term", 1, 1), F.expr("substring(term, 3)")).alias("seen")).distinct()
    hits = seen.select("seen", F.explode(text.delete_variants(F.col("seen"))).alias("variant")).join(known, "variant")
    hits = hits.select("seen", "term", "ord", F.levenshtein("seen", "term").alias("dist")).filter("dist <= 1").distinct()
    return hits.groupBy("seen").agg(F.min_by("term", F.struct("dist", "ord")).alias("best"))


@query(
    "WITH p AS (SELECT lower(left(p_name, 1)) AS a, lower(substr(p_name, 2, 1)) AS b FROM part UNION ALL SELECT 'o', '0' UNION ALL SELECT 'S', '5' UNION ALL SELECT 'x', 'y' UNION ALL SELECT 'Q', '0' UNION ALL SELECT '9', 'g') "
    "SELECT a, b, count(*) AS n, least(lower(a), lower(b)) || greatest(lower(a), lower(b)) IN ('0o', '0q', '1i', '1l', '2z', '5s', '6g', '8b', '9q', 'ce', 'il', 'uv') AS confusable FROM p GROUP BY a, b"
)
def confusable_pairs(spark, d):
    pairs = table(spark, d, "part").select(F.lower(F.substring("p_name", 1, 1)).alias("a"), F.lower(F.substring("p_name", 2, 1)).alias("b"))
    pairs = pairs.unionAll(spark.createDataFrame([("o", "0"), ("S", "5"), ("x", "y"), ("Q", "0"), ("9", "g")], "a string, b string"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("confusable", text.is_confusable(F.col("a"), F.col("b")))


def _tokens(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("token")).filter("token <> ''")


@query(
    r"""WITH t AS (SELECT unnest(string_split_regex(text, '[ \t\n\x0B\f\r]+')) AS token FROM documents)
    SELECT regexp_extract(token, '^[^\p{L}\p{Nd}]*(.*?)[^\p{L}\p{Nd}]*$', 1) AS core, count(*) AS n FROM t WHERE token <> '' GROUP BY 1"""
)
def token_core(spark, d):
    often = _tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))  # an expression runs once for a distinct token
    return often.groupBy(text.token_core(F.col("token")).alias("core")).agg(F.sum("n").alias("n"))


@query(
    """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS source FROM documents)
    SELECT source, CASE WHEN source = upper(source) AND length(source) > 1 THEN 'INVOICE' WHEN source = lower(source) THEN 'invoice'
      WHEN left(source, 1) = upper(left(source, 1)) THEN 'Invoice' ELSE 'invoice' END AS adopted FROM t"""
)
def case_adopt(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("source")).distinct()
    return words.select("source", text.adopt_case(F.col("source"), F.lit("invoice")).alias("adopted"))


# --- geometry and layout ---------------------------------------------------------------------------------


@query(f"WITH {LAYOUT_SQL} SELECT page, min(x0) AS min_x, min(y0) AS min_y, max(x0 + w) AS max_x, max(y0 + h) AS max_y, count(*) AS n FROM lay GROUP BY page")
def bbox(spark, d):
    return boxes(spark, d).groupBy("page").agg(F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max(F.col("x0") + F.col("w")).alias("max_x"), F.max(F.col("y0") + F.col("h")).alias("max_y"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {LAYOUT_SQL}, p AS (SELECT a.page, a.box_id AS a, b.box_id AS b, greatest(least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0), 0) * greatest(least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0), 0) AS i, a.w * a.h + b.w * b.h AS s FROM lay a JOIN lay b ON a.page = b.page AND a.box_id < b.box_id)
    SELECT page, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i > 0"""
)
def iou_pairs(spark, d):
    one = boxes(spark, d)
    a, b = ({c: F.col(f"{t}.{c}") for c in layout.BOX} for t in ("l", "r"))
    pairs = one.alias("l").join(one.alias("r"), (F.col("l.page") == F.col("r.page")) & (F.col("l.box_id") < F.col("r.box_id")))
    return pairs.select("l.page", F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b"), F.round(geometry.iou(a, b), 6).alias("iou")).filter("iou > 0")


@query(f"WITH {LAYOUT_SQL} SELECT page, median(h) AS median_height, list_sort(list(h))[len(list(h)) // 2 + 1] AS upper_median FROM lay WHERE h > 0 GROUP BY page")
def median_height(spark, d):
    """The averaging median, and the upper one."""
    listed = F.array_sort(F.collect_list("h"))
    return boxes(spark, d).filter("h > 0").groupBy("page").agg(F.median("h").alias("median_height"), F.element_at(listed, (F.floor(F.size(listed) / 2) + 1).cast("int")).alias("upper_median"))


@query(
    f"""WITH {LAYOUT_SQL}, a AS (SELECT *, median(h) OVER (PARTITION BY page) AS m, max(x0 + w) OVER (PARTITION BY page ORDER BY x0, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM lay),
    b AS (SELECT *, sum(CASE WHEN x0 - r > greatest(20, 1.5 * m) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, box_id ROWS UNBOUNDED PRECEDING) AS column_no, greatest(4, 0.5 * m) AS tol FROM a)
    SELECT page, box_id, CAST(column_no AS BIGINT) AS column_no, CAST(row_number() OVER (PARTITION BY page ORDER BY column_no, round_even(y0 / tol, 0) * tol, x0, box_id) AS INT) AS read_no FROM b"""
)
def reading_order(spark, d):
    return layout.reading_order(boxes(spark, d)).select("page", "box_id", "column_no", "read_no")


@query(
    f"""WITH {LAYOUT_SQL}, r AS (SELECT *, 90 * (box_id % 4) AS deg FROM lay)
    SELECT page, box_id, CASE deg WHEN 90 THEN y0 WHEN 180 THEN 1200 - x0 WHEN 270 THEN 1200 - y0 ELSE x0 END AS x, CASE deg WHEN 90 THEN 900 - x0 WHEN 180 THEN 900 - y0 WHEN 270 THEN x0 ELSE y0 END AS y FROM r"""
)
def rotate_back(spark, d):
    x, y = geometry.rotate_back(F.col("x0"), F.col("y0"), F.col("box_id") % 4 * 90, F.lit(1200), F.lit(900))
    return boxes(spark, d).select("page", "box_id", x.alias("x"), y.alias("y"))


@query(f"WITH {LAYOUT_SQL} SELECT page, box_id, x0 - 120 AS x, y0 - 30 AS y FROM lay WHERE x0 >= 120 AND y0 >= 30 AND x0 + w <= 840 AND y0 + h <= 210")
def roi_filter(spark, d):
    """Boxes inside a region given in fractions of a 1200 x 300 page, moved to its origin."""
    left, top, right, bottom = geometry.resolve_region(*(F.lit(v) for v in (0.1, 0.1, 0.6, 0.6)), F.lit(1200), F.lit(300))
    inside = geometry.is_region(left, top, right, bottom) & (F.col("x0") >= left) & (F.col("y0") >= top) & (F.col("x0") + F.col("w") <= right) & (F.col("y0") + F.col("h") <= bottom)
    return boxes(spark, d).filter(inside).select("page", "box_id", (F.col("x0") - left).alias("x"), (F.col("y0") - top).alias("y"))


@query()
def nms(spark, d):
    return layout.suppress_duplicates(boxes(spark, d), 0.1)


@query()
def line_grouping(spark, d):
    return layout.group_lines(boxes(spark, d))


@query()
def paragraphs(spark, d):
    lines = layout.group_lines(boxes(spark, d)).groupBy("page", "line_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), (F.max(F.col("x0") + F.col("w")) - F.min("x0")).alias("w"), (F.max(F.col("y0") + F.col("h")) - F.min("y0")).alias("h")
    )
    return layout.group_paragraphs(lines)


# --- decoding --------------------------------------------------------------------------------------------

ALPHABET = "abcdefg"


@query(
    f"""WITH s AS (SELECT vec_id, t, embedding[t * 8 + 1 : t * 8 + 8] AS v FROM (SELECT vec_id, embedding, unnest(range(0, 8)) AS t FROM embeddings)),
    p AS (SELECT vec_id, t, list_position(v, list_max(v)) - 1 AS c FROM s), q AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM p)
    SELECT vec_id, coalesce(string_agg(CASE WHEN c > 0 AND (before IS NULL OR c <> before) THEN '{ALPHABET}'[c] END, '' ORDER BY t), '') AS decoded FROM q GROUP BY vec_id"""
)
def ctc_greedy(spark, d):
    return table(spark, d, "embeddings").select("vec_id", decode.ctc_text(decode.best_classes(F.col("embedding"), 8), ALPHABET).alias("decoded"))


@query("SELECT vec_id, pos, value FROM (SELECT vec_id, i - 1 AS pos, embedding[i] AS value, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i] DESC, i) AS r FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)) WHERE r <= 5".replace("i - 1 AS pos", "CAST(i - 1 AS INT) AS pos"))
def topk_logits(spark, d):
    flat = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return flat.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("value"), "pos"))).filter("r <= 5").drop("r")


@query()
def beam_ctc(spark, d):
    return decode.beam_decode(table(spark, d, "embeddings"), "vec_id", "embedding", 8, ALPHABET).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {LAYOUT_SQL} SELECT page, y0 // 30 AS place, pack, conf, box_id FROM (SELECT *, row_number() OVER (PARTITION BY page, y0 // 30 ORDER BY conf DESC, pack, box_id) AS r FROM lay) WHERE r = 1")
def best_pack(spark, d):
    rows = boxes(spark, d).withColumn("place", F.expr("y0 div 30")).withColumn("_o", F.struct("pack", "box_id"))
    return decode.best_reading(rows, ["page", "place"], F.col("conf"), "_o").select("page", "place", "pack", "conf", "box_id")


@query(f"WITH {LAYOUT_SQL}, s AS (SELECT page, pack, round(sum(CAST(conf AS DECIMAL(10, 4)) * w), 4) AS score FROM lay GROUP BY page, pack) SELECT page, arg_min(pack, (-score, pack)) AS pack, CAST(max(score) AS DOUBLE) AS score FROM s GROUP BY page")
def dominant_pack(spark, d):
    """The pack with the largest sum of confidence times length (the box's width stands for it), the first of equals."""
    s = boxes(spark, d).groupBy("page", "pack").agg(F.sum(F.col("conf").cast("decimal(10,4)") * F.col("w")).alias("score"))
    return s.groupBy("page").agg(F.min_by("pack", F.struct((-F.col("score")).alias("s"), "pack")).alias("pack"), F.max("score").cast("double").alias("score"))


_PACKS = [("en", "latin"), ("de", "latin"), ("fr", "latin"), ("es", "latin"), ("ru", "cyrillic"), ("ja", "japanese")]


@query(f"WITH r(code, pack) AS (VALUES {', '.join(str(p) for p in _PACKS)}) SELECT lang, pack, count(*) AS n FROM documents LEFT JOIN r ON code = lower(lang) GROUP BY lang, pack")
def pack_lookup(spark, d):
    registry = spark.createDataFrame(_PACKS, "code string, pack string")
    docs = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(F.broadcast(registry), F.lower("lang") == F.col("code"), "left").select("lang", "pack", "n")


@query(f"WITH r(code, pack) AS (VALUES {', '.join(str(p) for p in _PACKS)}) SELECT code, pack FROM r WHERE code NOT IN (SELECT lower(lang) FROM documents WHERE lang IS NOT NULL)")
def missing_models(spark, d):
    have = table(spark, d, "documents").select(F.lower("lang").alias("code")).distinct()
    return spark.createDataFrame(_PACKS, "code string, pack string").join(have, "code", "left_anti")


# --- fields ----------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '31.02.' || strftime(o_orderdate, '%Y') END AS seen,
    CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderkey % 3 < 2 AS valid FROM orders"""
)
def date_normalize(spark, d):
    """Day first, or year first, by one separator; an impossible date is claimed but not valid."""
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    seen = F.when(k == 0, F.date_format(day, "dd/MM/yyyy")).when(k == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(F.lit("31.02."), F.date_format(day, "yyyy")))
    rows = table(spark, d, "orders").select("o_orderkey", seen.alias("seen"))
    part = lambda i: F.regexp_extract("seen", r"^([0-9]+)([./-])([0-9]+)\2([0-9]+)$", i)
    year_first = F.length(part(1)) == 4
    iso = F.concat_ws("-", F.when(year_first, part(1)).otherwise(part(4)), F.lpad(part(3), 2, "0"), F.lpad(F.when(year_first, part(4)).otherwise(part(1)), 2, "0"))
    return rows.withColumn("day", F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd")).withColumn("valid", F.col("day").isNotNull())


@query(
    """WITH s AS (SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS amount FROM orders)
    SELECT o_orderkey, CAST(amount AS VARCHAR) AS amount, amount < 0 AS negative FROM s"""
)
def currency_normalize(spark, d):
    """Amounts written with either decimal mark and with groups, read back."""
    amount = F.round("o_totalprice", 2).cast("decimal(18,2)")
    plain = amount.cast("string")
    grouped = F.regexp_replace(plain, r"(?<=[0-9])(?=(?:[0-9]{3})+\.)", ",")
    seen = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("$"), grouped)).otherwise(F.concat(F.translate(grouped, ",.", ".,"), F.lit(" EUR")))
    rows = table(spark, d, "orders").select("o_orderkey", seen.alias("seen"))
    body = F.regexp_replace("seen", r"[^0-9.,-]", "")
    mark = F.regexp_extract(body, r"([.,])[0-9]*$", 1)
    other = F.when(mark == ",", F.lit(".")).otherwise(F.lit(","))
    number = F.replace(F.replace(body, other, F.lit("")), F.when(mark == "", F.lit(",")).otherwise(mark), F.lit("."))
    return rows.select("o_orderkey", number.alias("n")).select("o_orderkey", F.col("n").cast("decimal(18,2)").cast("string").alias("amount"), (F.col("n").cast("decimal(18,2)") < 0).alias("negative"))


@query(
    """SELECT o_orderkey, 'Total' AS anchor, CASE WHEN o_orderkey % 4 = 0 THEN 'T0tal' WHEN o_orderkey % 4 = 1 THEN 'Totai' WHEN o_orderkey % 4 = 2 THEN 'TOTAL' ELSE 'Notes' END AS seen,
    round(1 - levenshtein(lower(CASE WHEN o_orderkey % 4 = 0 THEN 'T0tal' WHEN o_orderkey % 4 = 1 THEN 'Totai' WHEN o_orderkey % 4 = 2 THEN 'TOTAL' ELSE 'Notes' END), 'total') / 5.0, 6) AS similarity,
    o_orderkey % 4 < 3 AS matched FROM orders"""
)
def anchor_match(spark, d):
    """Similarity of a label to an anchor; 0.72 makes a match."""
    k = F.col("o_orderkey") % 4
    seen = F.when(k == 0, "T0tal").when(k == 1, "Totai").when(k == 2, "TOTAL").otherwise("Notes")
    token = F.regexp_replace(F.lower("seen"), r"[^\p{L}\p{Nd}]", "")
    near = F.round(1 - F.levenshtein(token, F.lit("total")) / F.greatest(F.length(token), F.lit(5)), 6)
    return table(spark, d, "orders").select("o_orderkey", F.lit("Total").alias("anchor"), seen.alias("seen")).withColumn("similarity", near).withColumn("matched", F.col("similarity") >= 0.72)


@query(
    f"""WITH {LAYOUT_SQL}, p AS (SELECT a.page, a.box_id AS anchor, b.box_id AS candidate, b.x0 - (a.x0 + a.w) AS gap, abs((a.y0 + a.h / 2) - (b.y0 + b.h / 2)) AS off, a.h AS h, b.y0 - (a.y0 + a.h) AS below, abs(a.x0 - b.x0) AS shift
      FROM lay a JOIN lay b ON a.page = b.page AND a.box_id <> b.box_id WHERE a.pack = 0),
    s AS (SELECT *, CASE WHEN gap >= -0.25 * h AND off <= 2 * h THEN 0.98 * (1 - greatest(gap, 0) / 1200.0) WHEN below >= -0.35 * h AND shift <= 10 * h THEN 0.94 * (1 - greatest(below, 0) / 1200.0) END AS score FROM p)
    SELECT page, anchor, arg_min(candidate, (-round(score, 9), candidate)) AS winner FROM s WHERE score IS NOT NULL GROUP BY page, anchor"""
)
def field_winner(spark, d):
    """Of the boxes right of an anchor or below it, the one that scores best."""
    one = boxes(spark, d)
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))  # noqa: E741
    pairs = one.filter("pack = 0").alias("l").join(one.alias("r"), (l("page") == r("page")) & (l("box_id") != r("box_id")))
    gap, off = r("x0") - (l("x0") + l("w")), F.abs((l("y0") + l("h") / 2) - (r("y0") + r("h") / 2))
    below, shift = r("y0") - (l("y0") + l("h")), F.abs(l("x0") - r("x0"))
    score = F.when((gap >= -0.25 * l("h")) & (off <= 2 * l("h")), 0.98 * (1 - F.greatest(gap, F.lit(0)) / 1200)).when((below >= -0.35 * l("h")) & (shift <= 10 * l("h")), 0.94 * (1 - F.greatest(below, F.lit(0)) / 1200))
    scored = pairs.select(l("page").alias("page"), l("box_id").alias("anchor"), r("box_id").alias("candidate"), score.alias("score")).filter("score is not null")
    return scored.groupBy("page", "anchor").agg(F.min_by("candidate", F.struct((-F.round("score", 9)).alias("s"), "candidate")).alias("winner"))


# --- export ----------------------------------------------------------------------------------------------


@query(f"WITH {LAYOUT_SQL} SELECT page, box_id, concat_ws(chr(9), 5, 1, 1, 1, row_number() OVER (PARTITION BY page ORDER BY y0, x0, box_id, h, conf), 1, x0, y0, w, h, CAST(round_even(greatest(0, least(1, conf)) * 100, 0) AS INT), 'w' || box_id) AS tsv FROM lay")
def tsv_words(spark, d):
    line = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "box_id", "h", "conf"))
    cells = [F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), line, F.lit("1"), F.col("x0"), F.col("y0"), F.col("w"), F.col("h"), checksums.confidence_100(F.col("conf")), F.concat(F.lit("w"), F.col("box_id").cast("string"))]
    return boxes(spark, d).select("page", "box_id", F.concat_ws("\t", *(c.cast("string") for c in cells)).alias("tsv"))


@query(f"""WITH {LAYOUT_SQL} SELECT page, string_agg('<span class=''ocrx_word'' title=''bbox ' || x0 || ' ' || y0 || ' ' || (x0 + w) || ' ' || (y0 + h) || '; x_wconf ' || CAST(round_even(greatest(0, least(1, conf)) * 100, 0) AS INT) || '''>w' || box_id || '</span>', '' ORDER BY y0, x0, box_id, h, conf) AS hocr FROM lay GROUP BY page""")
def hocr_words(spark, d):
    s = lambda c: c.cast("string")
    word = F.concat(
        F.lit("<span class='ocrx_word' title='bbox "), s(F.col("x0")), F.lit(" "), s(F.col("y0")), F.lit(" "), s(F.col("x0") + F.col("w")), F.lit(" "), s(F.col("y0") + F.col("h")),
        F.lit("; x_wconf "), s(checksums.confidence_100(F.col("conf"))), F.lit("'>w"), s(F.col("box_id")), F.lit("</span>"),
    )
    rows = boxes(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "box_id", "h", "conf", word.alias("word")))).alias("words"))
    return rows.select("page", F.array_join(F.transform("words", lambda x: x["word"]), "").alias("hocr"))


@query(
    f"""WITH {LAYOUT_SQL} SELECT page, string_agg('<String CONTENT="w' || box_id || '" HPOS="' || x0 || '" VPOS="' || y0 || '" WIDTH="' || w || '" HEIGHT="' || h || '"/>', '' ORDER BY y0, x0, box_id, h, conf) AS alto FROM lay GROUP BY page"""
)
def alto_strings(spark, d):
    s = lambda c: F.col(c).cast("string")
    word = F.concat(F.lit('<String CONTENT="w'), s("box_id"), F.lit('" HPOS="'), s("x0"), F.lit('" VPOS="'), s("y0"), F.lit('" WIDTH="'), s("w"), F.lit('" HEIGHT="'), s("h"), F.lit('"/>'))
    rows = boxes(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "box_id", "h", "conf", word.alias("word")))).alias("words"))
    return rows.select("page", F.array_join(F.transform("words", lambda x: x["word"]), "").alias("alto"))


@query(
    """SELECT doc_id, sha256(CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || lang || chr(13) || chr(10)) AS csv FROM documents"""
)
def csv_rows(spark, d):
    row = F.concat(text.csv_field(F.col("text")), F.lit(","), text.csv_field(F.col("lang")), F.lit("\r\n"))
    return table(spark, d, "documents").select("doc_id", F.sha2(row, 256).alias("csv"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS xml FROM documents")
def xml_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.xml_escape(F.col("text")), 256).alias("xml"))


@query(f"WITH {LAYOUT_SQL} SELECT page, CAST(to_json({{'page': page, 'boxes': list({{'box_id': box_id, 'x0': x0, 'y0': y0, 'w': w, 'h': h}} ORDER BY box_id)}}) AS VARCHAR) AS json FROM lay GROUP BY page")
def page_json(spark, d):
    rows = boxes(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("box_id", "x0", "y0", "w", "h"))).alias("boxes"))
    return rows.select("page", F.to_json(F.struct("page", "boxes")).alias("json"))


@query(
    """WITH t AS (SELECT p_partkey, CAST(p_partkey % 100 AS DOUBLE) AS x, CAST(p_size * 10 AS DOUBLE) AS width, regexp_extract_all(p_name, '[^ ]+') AS ws FROM part),
    u AS (SELECT *, unnest(range(1, len(ws) + 1)) AS i, length(array_to_string(ws, '')) AS total FROM t)
    SELECT p_partkey, ws[i] AS word, round(x + width * length(coalesce(array_to_string(ws[1:i-1], ''), '')) / total, 6) AS x0, round(width * length(ws[i]) / total, 6) AS w FROM u"""
)
def word_split(spark, d):
    words = text.split_words(F.col("p_name"), (F.col("p_partkey") % 100).cast("double"), (F.col("p_size") * 10).cast("double"))
    return table(spark, d, "part").select("p_partkey", F.explode(words).alias("b")).select("p_partkey", "b.word", F.round("b.x0", 6).alias("x0"), F.round("b.w", 6).alias("w"))


# --- scores ----------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT l_orderkey AS page, CAST(l_linenumber % 4 * 90 AS INT) AS degrees, round(sum((1 - l_discount * 5) * length(CAST(l_partkey AS VARCHAR))), 6) AS score FROM lineitem GROUP BY ALL)
    SELECT page, arg_max(degrees, {'s': score, 't': -degrees}) AS degrees, max(score) AS score FROM s GROUP BY page"""
)
def orientation_score(spark, d):
    readings = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 4 * 90).cast("int").alias("degrees"), F.col("l_partkey").cast("string").alias("text"), (1 - F.col("l_discount") * 5).alias("conf")
    )
    return scores.best_orientation(readings)


@query(
    f"""WITH {LAYOUT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, box_id) AS place FROM lay), s AS (SELECT page, pack, round(avg(conf), 6) AS score FROM r WHERE place <= 5 GROUP BY ALL)
    SELECT page, pack, score FROM s QUALIFY max(score) OVER (PARTITION BY page) > 0 AND score >= greatest(0.35, 0.85 * max(score) OVER (PARTITION BY page))"""
)
def language_score(spark, d):
    return scores.dominant_packs(boxes(spark, d).withColumn("text", F.lit("read")))


# --- numeric arrays --------------------------------------------------------------------------------------

_GREY = "g AS (SELECT vec_id, i, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 4) * 32) AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings))"


def _grey(spark, d) -> DataFrame:
    flat = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return flat.select("vec_id", F.col("i").cast("long").alias("i"), F.floor((F.col("e").cast("double") + 4) * 32).alias("v"))


@query(f"WITH {_GREY} SELECT vec_id, i, sum(v) OVER w // count(*) OVER w AS blurred FROM g WINDOW w AS (PARTITION BY vec_id, i // 8 ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)".replace("sum(v) OVER w // count(*) OVER w", "CAST(sum(v) OVER w // count(*) OVER w AS BIGINT)"))
def box_blur(spark, d):
    w = Window.partitionBy("vec_id", F.expr("i div 8")).orderBy("i").rowsBetween(-2, 2)
    return _grey(spark, d).withColumn("s", F.sum("v").over(w)).withColumn("c", F.count(F.lit(1)).over(w)).select("vec_id", "i", F.expr("s div c").alias("blurred"))


@query(f"WITH {_GREY} SELECT vec_id, (i // 8) // 4 AS r, (i % 8) // 4 AS c, CAST(sum(v) // count(*) AS BIGINT) AS mean FROM g GROUP BY ALL")
def block_mean(spark, d):
    g = _grey(spark, d).groupBy("vec_id", F.expr("(i div 8) div 4").alias("r"), F.expr("(i % 8) div 4").alias("c"))
    return g.agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).select("vec_id", "r", "c", F.expr("s div n").alias("mean"))


@query(f"WITH {_GREY}, r AS (SELECT vec_id, i // 8 AS row_no, sum(v) AS ink FROM g GROUP BY 1, 2) SELECT vec_id, round(var_pop(ink), 6) AS variance FROM r GROUP BY vec_id")
def row_variance(spark, d):
    rows = _grey(spark, d).groupBy("vec_id", F.expr("i div 8").alias("row_no")).agg(F.sum("v").alias("ink"))
    return rows.groupBy("vec_id").agg(F.round(F.var_pop("ink"), 6).alias("variance"))


@query(f"WITH {_GREY}, s AS (SELECT vec_id, list_sort(list(v)) AS l FROM g GROUP BY vec_id) SELECT vec_id, l[CAST(floor(0.1 * 63) AS INT) + 1] AS low, l[CAST(floor(0.9 * 63) AS INT) + 1] AS high FROM s")
def grey_percentile(spark, d):
    rows = _grey(spark, d).groupBy("vec_id").agg(F.array_sort(F.collect_list("v")).alias("l"))
    at = lambda q: F.element_at("l", (F.floor(F.lit(q) * (F.size("l") - 1)) + 1).cast("int"))
    return rows.select("vec_id", at(0.1).alias("low"), at(0.9).alias("high"))


# --- rows only -------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT p_partkey, CAST(length(p_name) AS INT) AS n, CAST(length(p_name) - length(replace(p_name, 'a', '')) AS INT) AS a, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INT) AS e, CAST(len(list_filter(string_split(p_name, ' '), lambda w: regexp_matches(w, '[ae]'))) AS INT) AS w FROM part)
    SELECT p_partkey, n - a - e AS hits, a AS substitutions, CAST(0 AS INT) AS insertions, e AS deletions, w AS word_substitutions FROM c"""
)
def align_counts(spark, d):
    seen = F.replace(F.replace("p_name", F.lit("a"), F.lit("o")), F.lit("e"), F.lit(""))
    return table(spark, d, "part").select("p_partkey", metrics.align_characters(F.col("p_name"), seen).alias("c"), metrics.align_words(F.col("p_name"), seen).alias("w")).select("p_partkey", "c.*", F.col("w.substitutions").alias("word_substitutions"))


@query("SELECT p_partkey, round(0.4 * (length(p_name) - length(replace(p_name, 'm', ''))) + 0.3 * (length(p_name) - length(replace(p_name, 'l', ''))), 6) AS distance FROM part")
def weighted_distance(spark, d):
    seen = F.replace(F.replace("p_name", F.lit("m"), F.lit("rn")), F.lit("l"), F.lit("1"))
    return spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", F.round(metrics.weighted_distance_of(F.col("p_name"), seen), 6).alias("distance"))


@query("""SELECT p_partkey, '[["key","name"],["' || p_partkey || '","' || p_name || '"],["' || p_partkey || '","' || p_brand || '"]]' AS rows, true AS has_header FROM part""")
def table_grid(spark, d):
    html = F.concat(F.lit("<table><tr><th>key<th>name</tr><tr><td rowspan=2>"), F.col("p_partkey").cast("string"), F.lit("<td>"), F.col("p_name"), F.lit("</tr><tr><td>"), F.col("p_brand"), F.lit("</table>"))
    return table(spark, d, "part").select("p_partkey", tables.table_grid(html).alias("t")).select("p_partkey", F.to_json("t.rows").alias("rows"), "t.has_header")

