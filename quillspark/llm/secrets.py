"""Secret scans through a trigram inverted index.

Each rule is a regular expression. From its parse tree a Boolean query over trigrams of the lower-cased
text is derived: every text that matches the expression satisfies the query. Posting lists are built for
the trigrams that some query names (those of no query are never looked up, so they are not stored), the
lists are intersected and united as the queries say in one grouped pass over document ids, and only the
candidates are verified with the expression. A rule whose query is always true (no mandatory trigram)
scans every text.

Matches are leftmost and do not overlap within a rule; offsets are code points, ends exclusive. Only
DataFrame functions are used.

Defined results: null text counts as empty and has no spans; the ids join null-safely and need not be
unique (postings of rows with the same id unite, and each row is verified on its own text). An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, in_runs, materialise, running, table, text_or_empty

ALWAYS = True


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; one counts if its group ``group`` has at least ``least`` characters.

    ``counted``: an expression that finds the counted matches alone, where one exists (a match is then the whole run
    of its class, so lengthening the repetition finds the same runs without the short ones).
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    counted: str | None = None


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, True, r"[0-9a-f]{16,}"),
)
RULES = BASE_RULES + (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
)


def _both(a, b):
    return b if a is ALWAYS else a if b is ALWAYS or a == b else ("and", a, b)


def _either(queries):
    if any(q is ALWAYS for q in queries):
        return ALWAYS
    unique = list(dict.fromkeys(queries))
    return unique[0] if len(unique) == 1 else ("or", *unique)


def _of_strings(strings):
    """The query that one of the given strings occurs."""
    queries = []
    for s in sorted(strings):
        q = ALWAYS
        for i in range(len(s) - 2):
            q = _both(q, s[i : i + 3])
        queries.append(q)
    return _either(queries)


def _item(op, arg, most):
    """(exact strings or None, query) of one node."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ALWAYS
    if op is sre.IN:
        if len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}, ALWAYS
        return None, ALWAYS
    if op is sre.AT:
        return {""}, ALWAYS
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1], most)
    if op is sre.BRANCH:
        parts = [_sequence(x, most) for x in arg[1]]
        if all(e is not None for e, _ in parts):
            exact = set().union(*(e for e, _ in parts))
            if len(exact) <= most:
                return exact, ALWAYS
        return None, _either([_of_strings(e) if e is not None else q for e, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        exact, query = _sequence(body, most)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, ALWAYS
        if low == high == 1:
            return exact, query
        return None, ALWAYS if low == 0 else _of_strings(exact) if exact is not None else query
    return None, ALWAYS


def _sequence(nodes, most):
    run, query, flushed = {""}, ALWAYS, False
    for op, arg in nodes:
        exact, own = _item(op, arg, most)
        if exact is None:
            query, run, flushed = _both(_both(query, _of_strings(run)), own), {""}, True
        elif len(joined := {a + b for a in run for b in exact}) > most:
            query, run, flushed = _both(query, _of_strings(run)), exact, True
        else:
            run = joined
    return (None, _both(query, _of_strings(run))) if flushed else (run, ALWAYS)


def trigram_query(pattern: str, most: int = 64):
    """A nested ("and" | "or", ...) tuple of trigrams that every match's lower-cased text satisfies, or ALWAYS."""
    exact, query = _sequence(sre_parser.parse(pattern), most)
    return _of_strings(exact) if exact is not None else query


def _trigrams(query) -> set[str]:
    if query is ALWAYS:
        return set()
    return {query} if isinstance(query, str) else set().union(*(_trigrams(q) for q in query[1:]))


def _holds(query, found: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(found, query)
    parts = [_holds(q, found) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def postings(docs: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """(trigram, id) for each document that has the trigram in its lower-cased text."""
    low = F.lower(text_or_empty(text))
    return docs.select(F.col(key).alias("__qs_id"), low.alias("low")).select(
        F.explode(F.filter(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)), lambda t: t.isNotNull())).alias("trigram"), "__qs_id"
    )


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Array of (start, order, end) of the rule's counted matches."""
    pattern = rule.counted or rule.pattern
    cut = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else whole
    # one pass over the parts: an index into them inside a lambda would search the text anew for each match
    parts = F.zip_with(cut, whole, lambda c, m: F.struct(F.length(c).alias("gap"), F.length(m).alias("len")))
    parts = F.filter(F.zip_with(parts, F.transform(sizes, F.length), lambda p, n: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), n.alias("counted"))), lambda p: p["len"].isNotNull())

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["gap"] + x["len"]), lambda a, b: a + b)
        spans = F.zip_with(p, ends, lambda x, end: F.when(x["counted"] >= rule.least, F.struct((end - x["len"]).alias("start"), F.lit(order).alias("ord"), end.alias("end"))))
        return F.filter(spans, lambda x: x.isNotNull())

    return bind(parts, placed)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", out: str = "found") -> DataFrame:
    """The rows of ``docs`` with a column ``out``: an array of (start, ord, end) in text order, ``ord`` the rule's place."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*(_trigrams(q) for q in queries)))
    body, none = text_or_empty(text), F.array().cast("array<struct<start:int,ord:int,end:int>>")
    if wanted:
        lists = materialise(postings(docs, wanted, key, text), "postings").groupBy("__qs_id").agg(F.collect_set("trigram").alias("__qs_has"))
        able = [(i, q) for i, q in enumerate(queries) if q is not ALWAYS]
        candidates = lists.select("__qs_id", *(_holds(q, F.col("__qs_has")).alias(f"__qs_try{i}") for i, q in able))
        any_rule = F.lit(False)
        for i, _ in able:
            any_rule = any_rule | F.col(f"__qs_try{i}")
        candidates = materialise(candidates.filter(any_rule), "candidates")
        rows = docs.join(candidates, docs[key].eqNullSafe(candidates["__qs_id"]), "left").drop("__qs_id")
    else:
        able, rows = [], docs
    tried = {i for i, _ in able}
    lists = []
    for i, rule in enumerate(rules):
        quick = body.rlike(rule.counted or rule.pattern)
        run = F.col(f"__qs_try{i}") & quick if i in tried else quick
        lists.append(F.when(run, _spans(rule, i, body)).otherwise(none))
    return rows.withColumn(out, F.array_sort(F.concat(*lists))).drop(*(f"__qs_try{i}" for i in tried))


def mask_secrets(docs: DataFrame, found: str = "found", text: str = "text") -> Column:
    """The text with each found span replaced by ``[SECRET]``; overlapping spans become one."""
    body, spans = text_or_empty(text), F.col(found)
    # a span is written where the furthest end before it has been passed; the text is cut once for a run of spans
    at = F.concat(F.array(F.lit(0)), running(F.transform(spans, lambda s: s["end"]), F.greatest))

    def written(run: Column) -> Column:
        base = F.element_at(run, 1)["at"]
        near = F.substring(body, base + 1, F.greatest(F.element_at(run, -1)["start"] - base, F.lit(0)))
        one = lambda near: F.transform(run, lambda s: F.when(s["start"] >= s["at"], F.concat(F.substring(near, s["at"] - base + 1, s["start"] - s["at"]), F.lit("[SECRET]"))).otherwise(""))
        return F.array_join(bind(near, one), "")

    def masked(at: Column) -> Column:
        pairs = F.zip_with(F.slice(at, F.lit(1), F.size(spans)), spans, lambda a, s: F.struct(a.alias("at"), s["start"].alias("start")))
        return F.concat(F.array_join(F.transform(in_runs(pairs), written), ""), F.substring(body, F.element_at(at, -1) + 1, F.length(body)))

    return F.when(F.size(found) == 0, F.col(text)).otherwise(bind(at, masked))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    n_base = len(BASE_RULES)
    base = F.filter("found", lambda s: s["ord"] < n_base)
    count = lambda i: F.size(F.filter("found", lambda s: s["ord"] == i)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)),
        F.sha2(_joined(base, RULES), 256).alias("base_sha256"),
        _joined(F.col("found"), RULES).alias("spans"),
    )


def _sql_spans(rule: Rule, order: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""list_filter([{{'start': list_sum(list_transform(c[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
      'ord': {order}, 'end': list_sum(list_transform(c[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))), 'n': length(w[i])}}
      for i in range(1, len(m) + 1)], lambda s: s.n >= {rule.least})
      FROM (SELECT doc_id AS id, t, string_split_regex(t, '{p}') AS c, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {rule.group}) AS w FROM d)"""


def _op9_sql() -> str:
    ctes = ",\n".join(f"k{i} AS (SELECT id, {_sql_spans(r, i).replace('FROM (SELECT', 'AS s FROM (SELECT', 1)})" for i, r in enumerate(RULES))
    joins = " ".join(f"JOIN k{i} ON k{i}.id = d.doc_id" for i in range(len(RULES)))
    every = " || ".join(f"k{i}.s" for i in range(len(RULES)))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    name = f"lambda x: {kinds}[CAST(x.ord AS INT) + 1] || ':' || CAST(x.start AS BIGINT) || ':' || CAST(x.end AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{ctes},
j AS (SELECT doc_id, list_sort({every}) AS s, len(k0.s) AS a, len(k1.s) AS b, len(k2.s) AS c FROM d {joins})
SELECT doc_id, CAST(a AS BIGINT) AS n_assign, CAST(b AS BIGINT) AS n_access, CAST(c AS BIGINT) AS n_hex,
       sha256(coalesce(array_to_string(list_transform(list_filter(s, lambda x: x.ord < {len(BASE_RULES)}), {name}), ','), '')) AS base_sha256,
       coalesce(array_to_string(list_transform(s, {name}), ','), '') AS spans
FROM j"""


OP9_SQL = _op9_sql()
