"""Whole pages as hOCR, ALTO, tab-separated values, and tables with named columns.

Words are rows (page, line_no, word_no, text, conf, box) and lines (page, line_no, box); boxes are (min_x, min_y, max_x, max_y). Both are moved
once, by their page and as they are; the texts are made where a page's rows have met. Lines that hold their words already are not moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import confidence_100
from ..functions.text import csv_field, xml_escape

PRODUCER = "quillspark"
HEADER = "\t".join(("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"))


def _whole(x: Column) -> Column:
    return F.rint(x).cast("int").cast("string")


def _s(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x.cast("string")


def _join(*parts) -> Column:
    return F.concat(*(_s(p) for p in parts))


def page_size(lines: DataFrame, page: str = "page") -> DataFrame:
    """(page, width, height): the furthest edges of the page's lines, rounded up."""
    edge = lambda c: F.ceil(F.greatest(F.lit(0.0), F.max(F.col(f"box.{c}").cast("double")))).cast("int")
    return lines.groupBy(page).agg(edge("max_x").alias("width"), edge("max_y").alias("height"))


def _title(box: Column) -> Column:
    return F.concat_ws(" ", F.lit("bbox"), *(_whole(box[c]) for c in ("min_x", "min_y", "max_x", "max_y")))


def _place(box: Column) -> Column:
    values = box["min_x"], box["min_y"], box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]
    return F.concat_ws(" ", *(_join(f'{n}="', _whole(v), '"') for n, v in zip(("HPOS", "VPOS", "WIDTH", "HEIGHT"), values)))


def lines_with_words(lines: DataFrame, words: DataFrame, page: str = "page") -> DataFrame:
    """(page, line_no, box, words): each line with its words in order. The rows lie by page, so that pages are put together without another exchange."""
    box = lambda: F.struct(*(F.col(f"box.{c}").cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))
    word = F.struct(F.col("word_no"), F.col("text").cast("string").alias("text"), F.col("conf").cast("double").alias("conf"), box().alias("box"))
    own = lines.select(page, "line_no", box().alias("box"), F.lit(None).cast(words.select(word.alias("w")).schema["w"].dataType).alias("_word"))
    rows = own.unionByName(words.select(page, "line_no", F.lit(None).cast(own.schema["box"].dataType).alias("box"), word.alias("_word"))).repartition(F.col(page))
    # a line's own row is the one without a word
    whole = rows.groupBy(page, "line_no").agg(F.max(F.when(F.col("_word").isNull(), F.col("box"))).alias("box"), F.sort_array(F.collect_list("_word")).alias("words"), F.bool_or(F.col("_word").isNull()).alias("_line"))
    return whole.filter("_line").drop("_line")


def _pages(rows: DataFrame, page: str, word, line) -> DataFrame:
    """(page, body, width, height): the lines' texts ``line(line_no, box, words' text)``, of words' texts ``word(line_no, word)``, joined in order."""
    inner = F.array_join(F.transform("words", lambda w: word(F.col("line_no"), w)), "")
    whole = rows.select(page, "line_no", "box", line(F.col("line_no"), F.col("box"), inner).alias("_line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_line"))), lambda x: x["_line"]), "")
    edge = lambda c: F.ceil(F.greatest(F.lit(0.0), F.max(F.col(f"box.{c}").cast("double")))).cast("int")
    return whole.groupBy(page).agg(body.alias("body"), edge("max_x").alias("width"), edge("max_y").alias("height"))


def hocr(lines: DataFrame, words: DataFrame, page: str = "page", image: str = "") -> DataFrame:
    """(page, hocr): an hOCR page with its lines and words."""
    return hocr_of(lines_with_words(lines, words, page), page, image)


def hocr_of(rows: DataFrame, page: str = "page", image: str = "") -> DataFrame:
    """``hocr`` of lines that hold their words."""
    word = lambda no, w: _join("      <span class='ocrx_word' id='word_", no, "_", w["word_no"], "' title='", _title(w["box"]), "; x_wconf ", confidence_100(w["conf"]), "'>", xml_escape(w["text"]), "</span>\n")
    line = lambda no, box, inner: _join("    <span class='ocr_line' id='line_", no, "' title='", _title(box), "'>\n", inner, "    </span>\n")
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">\n'
        '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en">\n<head>\n  <meta http-equiv="Content-Type" content="text/html;charset=utf-8"/>\n'
        f"  <meta name='ocr-system' content='{PRODUCER}'/>\n  <meta name='ocr-capabilities' content='ocr_page ocr_line ocrx_word'/>\n</head>\n<body>\n"
    )
    pages = _pages(rows, page, word, line)
    return pages.select(page, _join(head + "  <div class='ocr_page' id='page_1' title='image \"", xml_escape(F.lit(image)), "\"; bbox 0 0 ", F.col("width"), " ", F.col("height"), "'>\n", F.col("body"), "  </div>\n</body>\n</html>\n").alias("hocr"))


def alto(lines: DataFrame, words: DataFrame, page: str = "page", image: str = "") -> DataFrame:
    """(page, alto): an ALTO 4 document with one block of lines and strings."""
    return alto_of(lines_with_words(lines, words, page), page, image)


def alto_of(rows: DataFrame, page: str = "page", image: str = "") -> DataFrame:
    """``alto`` of lines that hold their words."""
    places = lambda c: F.coalesce(c.try_cast("decimal(30,3)").cast("string"), F.format_string("%.3f", c))
    conf = lambda c: F.rtrim(F.rtrim(places(c), F.lit("0")), F.lit("."))
    word = lambda no, w: _join('            <String ID="string_', no, "_", w["word_no"], '" ', _place(w["box"]), ' WC="', conf(w["conf"]), '" CONTENT="', xml_escape(w["text"]), '"/>\n')
    line = lambda no, box, inner: _join('          <TextLine ID="line_', no, '" ', _place(box), ">\n", inner, "          </TextLine>\n")
    size = _join(' WIDTH="', F.col("width"), '" HEIGHT="', F.col("height"), '">\n')
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#">\n  <Description>\n    <MeasurementUnit>pixel</MeasurementUnit>\n    <sourceImageInformation><fileName>'
    step = f'</fileName></sourceImageInformation>\n    <OCRProcessing ID="ocr_1"><ocrProcessingStep><processingSoftware><softwareName>{PRODUCER}</softwareName></processingSoftware></ocrProcessingStep></OCRProcessing>\n  </Description>\n  <Layout>\n    <Page ID="page_1" PHYSICAL_IMG_NR="1"'
    tail = "        </TextBlock>\n      </PrintSpace>\n    </Page>\n  </Layout>\n</alto>\n"
    pages = _pages(rows, page, word, line)
    return pages.select(page, _join(head, xml_escape(F.lit(image)), step, size, '      <PrintSpace HPOS="0" VPOS="0"', size, '        <TextBlock ID="block_1">\n', F.col("body"), tail).alias("alto"))


_ALTO_READ = "Layout struct<Page:struct<PrintSpace:struct<TextBlock:struct<TextLine:array<struct<String:array<struct<_ID:string,_HPOS:string,_WIDTH:string,_CONTENT:string>>>>>>>>"


def read_alto(document: Column) -> Column:
    """The lines of an ALTO document, each with its strings: it is parsed once (XPath parses it for each expression). An error if it is not well formed."""
    read = F.from_xml(document, F.lit(_ALTO_READ), {"mode": "FAILFAST", "attributePrefix": "_"})
    return F.coalesce(read["Layout"]["Page"]["PrintSpace"]["TextBlock"]["TextLine"], F.array())


def tsv(lines: DataFrame, words: DataFrame, page: str = "page") -> DataFrame:
    """(page, tsv): a header and a row for each word; tabs in a word are blanks."""
    return tsv_of(lines_with_words(lines, words, page), page)


def tsv_of(rows: DataFrame, page: str = "page") -> DataFrame:
    """``tsv`` of lines that hold their words."""

    def word(no: Column, w: Column) -> Column:
        b = w["box"]
        cells = ["5", "1", "1", "1", no, w["word_no"], _whole(b["min_x"]), _whole(b["min_y"]), _whole(b["max_x"] - b["min_x"]), _whole(b["max_y"] - b["min_y"]), confidence_100(w["conf"]), F.translate(w["text"], "\t", " ")]
        return F.concat(F.concat_ws("\t", *(_s(c) for c in cells)), F.lit("\n"))

    return _pages(rows, page, word, lambda no, box, inner: inner).select(page, F.concat(F.lit(HEADER + "\n"), "body").alias("tsv"))


def csv_table(rows: Column, delimiter: str = ",", header: Column | None = None) -> Column:
    """RFC 4180 text of an array of rows; the first row is left out where ``header`` is false and the table has one."""
    kept = rows if header is None else F.when(header, rows).otherwise(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))))
    return F.array_join(F.transform(kept, lambda r: F.concat(F.array_join(F.transform(r, lambda c: csv_field(c, delimiter)), delimiter), F.lit("\r\n"))), "")


def unique_names(names: Column, blank: str = "Column", joiner: str = "_") -> Column:
    """Names that differ in any letter case: blank ones are ``Column1``, ..., later ones of a name get ``_2``, ``_3``, ... until none has it."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("used"))
    numbered = F.transform(names, lambda n, i: F.when(F.coalesce(n, F.lit("")) == "", F.concat(F.lit(blank), (i + 1).cast("string"))).otherwise(n))

    def step(acc: Column, n: Column) -> Column:
        tries = F.concat(F.array(n), F.transform(F.sequence(F.lit(2), F.size(names) + 2), lambda k: F.concat(n, F.lit(joiner), k.cast("string"))))
        free = F.get(F.filter(tries, lambda t: ~F.array_contains(acc["used"], F.lower(t))), F.lit(0))
        return F.struct(F.array_append(acc["out"], free).alias("out"), F.array_append(acc["used"], F.lower(free)).alias("used"))

    return F.aggregate(numbered, zero, step, lambda acc: acc["out"])


def named_rows(grids: DataFrame, key: str = "key", rows: str = "rows", has_header: str = "has_header") -> DataFrame:
    """(key, row_no, col_no, name, value): the cells of tables (rows of cells, whether the first is a header) under unique names."""
    first = F.when(F.col(has_header), F.get(rows, F.lit(0))).otherwise(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit("")))
    body = F.when(F.col(has_header), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(F.col(rows))
    named = grids.filter(F.size(rows) > 0).select(F.col(key), unique_names(first).alias("_names"), F.posexplode(body).alias("row_no", "_cells"))
    cells = named.select(key, "row_no", "_cells", F.posexplode("_names").alias("col_no", "name"))
    return cells.select(key, "row_no", "col_no", "name", F.coalesce(F.get("_cells", F.col("col_no")), F.lit("")).alias("value"))
