"""The core functions on literals, and every catalogued query against its SQL."""

import itertools
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import checksums, text
from quillspark.operators import decode, layout, metrics, tables
from quillspark.plans import catalogue
from quillspark.sources import tables as tables_source
from quillspark.streaming import files


def value(spark, make, v):
    return spark.createDataFrame([(v,)], "v string").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_gives_what_its_sql_gives(spark, sf_dir, name):
    ours = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    theirs = con.sql(catalogue.ORACLE[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("number, good", [("4111 1111 1111 1111", True), ("378282246310005", True), ("4111111111111112", False), ("0", False), ("12a4", False)])
def test_luhn(spark, number, good):
    assert value(spark, checksums.is_luhn, number) is good


@pytest.mark.parametrize("iban, redaction, correction", [("GB82 WEST 1234 5698 7654 32", True, True), ("DE89370400440532013000", True, True), ("DE89-3704-0044-0532-0130-00", True, False), ("GB82WEST12345698765433", False, False), ("DE89", False, False)])
def test_iban(spark, iban, redaction, correction):
    assert value(spark, checksums.is_iban_for_redaction, iban) is redaction and value(spark, checksums.is_iban_for_correction, iban) is correction


@pytest.mark.parametrize(
    "iban, result",
    [
        ("GB82WEST12345698765432", ("valid", "GB82WEST12345698765432")), (" gb82 west 1234 5698 7654 32", ("fixed", "GB82WEST12345698765432")), ("GB82WE5T12345698765432", ("fixed", "GB82WEST12345698765432")),
        ("DE8937O400440532013000", ("fixed", "DE89370400440532013000")), ("GB82WEST12345698765433", ("invalid", "GB82WEST12345698765433")), ("some long ordinary text", None), ("", None), (None, None),
    ],
)
def test_iban_repair(spark, iban, result):
    got = value(spark, checksums.normalize_iban, iban)
    assert (got and tuple(got)) == result


@pytest.mark.parametrize("field, digit", [("L898902C3", 6), ("740812", 2), ("120415", 9), ("ZE184226B<<<<<", 1), ("", 0), ("AB!", -1)])
def test_mrz(spark, field, digit):
    assert value(spark, checksums.mrz_check_digit, field) == digit


@pytest.mark.parametrize("ssn, good", [("123-45-6789", True), ("123 45 6789", True), ("123456789", True), ("000-12-3456", False), ("666-12-3456", False), ("912-12-3456", False), ("123-00-4567", False), ("123-45-0000", False)])
def test_ssn(spark, ssn, good):
    assert value(spark, checksums.is_ssn, ssn) is good


@pytest.mark.parametrize("source, adopted", [("invoce", "invoice"), ("Invoce", "Invoice"), ("INVOCE", "INVOICE"), ("iNvOce", "invoice")])
def test_case(spark, source, adopted):
    assert value(spark, lambda c: text.adopt_case(c, F.lit("invoice")), source) == adopted


def test_text(spark):
    assert value(spark, text.token_core, "(«naïve»!)") == "naïve"
    assert set(value(spark, text.delete_variants, "abc")) == {"abc", "ab", "ac", "bc"}
    assert len(value(spark, lambda c: text.delete_variants(c, 2), "abcd")) == 1 + 4 + 6
    assert value(spark, text.normalize, "  Hello,\n WORLD! $5 ") == "hello world $5"
    assert value(spark, text.csv_field, 'a"b,c') == '"a""b,c"' and value(spark, text.csv_field, "plain") == "plain"
    assert value(spark, text.xml_escape, "<a href='x'>&\"") == "&lt;a href=&apos;x&apos;&gt;&amp;&quot;"
    assert value(spark, lambda c: text.mask_matches(c, "[0-9]+"), "a12b345") == "a██b███"


def _naive(a, b):
    cost = np.add.outer(np.arange(len(a) + 1), np.arange(len(b) + 1))
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        cost[i, j] = min(cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    return int(cost[-1, -1])


def test_alignment():
    words = ["", "a", "kitten", "sitting", "saturday", "sunday", "flaw", "lawn", "abcabc", "cabcab"]
    for a, b in itertools.product(words, words):
        h, s, i, d = metrics.align(list(a), list(b))
        assert s + i + d == _naive(a, b) and h + s + d == len(a) and h + s + i == len(b)
    with pytest.raises(ValueError):
        metrics.align(list("abc" * 10), list("xyz" * 10), budget=100)
    assert metrics.weighted_distance("modern", "rnodern") == pytest.approx(0.4) and metrics.weighted_distance("t0tal", "total") == pytest.approx(0.3)


@pytest.mark.parametrize(
    "html, rows, header",
    [
        ("<table><tr><th>a<th>b</tr><tr><td>1<td>2</table>", [["a", "b"], ["1", "2"]], True),
        ("<table><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr></table>", [["x", "1"], ["x", "2"]], False),
        ("<table><tr><td colspan='2'>w</td></tr><tr><td>1</td><td>a<br>b &amp; <b>c</b></td></tr><tr></tr></table>", [["w", "w"], ["1", "a b & c"]], False),
        ("<table><tr><td colspan=-1 title='a>b'>q</td></tr></table><table><tr><td>no</td></tr></table>", [["q"]], False),
        (None, [], False),
        ("no table", [], False),
    ],
)
def test_tables(html, rows, header):
    assert tables.parse_table(html) == (rows, header)


def test_layout(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 50, 10), (1, 2, 300, 1, 50, 10), (1, 3, 0, 60, 50, 10), (1, 4, 1, 1, 49, 9)], "page long, box_id long, x0 long, y0 long, w long, h long")
    assert [r.box_id for r in layout.reading_order(boxes.filter("box_id < 4")).orderBy("read_no").collect()] == [1, 3, 2]
    assert {r.box_id for r in layout.suppress_duplicates(boxes).collect()} == {1, 2, 3}
    lines = {r.box_id: r.line_no for r in layout.group_lines(boxes).collect()}
    assert lines[1] == lines[2] == lines[4] != lines[3]


def test_ctc(spark):
    logits = np.full((6, 4), -4.0)
    for t, c in enumerate([1, 1, 0, 1, 3, 3]):
        logits[t, c] = 4
    flat = [float(x) for x in logits.ravel()]
    df = spark.createDataFrame([(1, flat)], "id long, v array<double>")
    assert df.select(decode.ctc_text(decode.best_classes(F.col("v"), 4), "abc").alias("t")).first().t == "aac"
    assert decode.beam_decode(df, "id", "v", 4, "abc").first().text == "aac"


def test_split_words_on_blank_and_single(spark):
    one = lambda v: [tuple(b) for b in value(spark, lambda c: text.split_words(c, F.lit(10.0), F.lit(60.0)), v)]
    assert one(" ") == [] and one(" abc ") == [("abc", 10.0, 60.0)] and one("ab  cdef") == [("ab", 10.0, 20.0), ("cdef", 30.0, 40.0)]


def test_recognised_files_and_stream_agree(spark, tmp_path):
    def _reader():
        def read(content):
            return [(i, line) for i, line in enumerate(content.decode("utf-8").splitlines())]

        return read

    for i, content in enumerate([b"first\nsecond", b"", b"\xff"]):
        (tmp_path / f"{i}.bin").write_bytes(content)
    rows = [(r.path[-5], r.line, r.text, bool(r.error)) for r in files.in_order(tables_source.recognised_files(spark, str(tmp_path), _reader, "line int, text string"), "path", "line")]
    assert rows == [("0", 0, "first", False), ("0", 1, "second", False), ("2", None, None, True)]
    stream = files.recognised_stream(spark, str(tmp_path), _reader, "line int, text string", files_per_batch=1)
    run = stream.writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert [(r.path[-5], r.line, r.text, bool(r.error)) for r in files.in_order(spark.table("lines"), "path", "line")] == rows
