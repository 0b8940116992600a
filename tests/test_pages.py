"""Page operators on literals and against brute force."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import checksums, geometry, normalizers, text
from quillspark.operators import arrays, correction, decode, exports, fields, metrics, words
from quillspark.plans import catalogue, page_queries
from quillspark.sources import tables


def values(spark, make, given):
    rows = spark.createDataFrame(list(enumerate(given)), "i int, v string").select("i", make(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r if r.r is None or not hasattr(r.r, "status") else (r.r.status, r.r.value) for r in rows]


def test_dates(spark):
    given = ["01/02/68", "01/02/69", "31.12.2024", "2024-02-30", "13/14/2020", "12/13/2020", "O1/l2/2O24", "1/2/3", "2024-1-2", " 5.1.24 ", "01-02/2020", "", None]
    want = [("fixed", "2068-02-01"), ("fixed", "1969-02-01"), ("fixed", "2024-12-31"), ("invalid", "2024-02-30"), ("invalid", "13/14/2020"), ("fixed", "2020-12-13"), ("fixed", "2024-12-01"), None, ("fixed", "2024-01-02"), ("fixed", "2024-01-05"), None, None, None]
    assert values(spark, normalizers.normalize_date, given) == want
    assert values(spark, lambda c: normalizers.normalize_date(c, "mdy", "dd.MM.yyyy"), ["01/02/2020"]) == [("fixed", "02.01.2020")]


def test_amounts(spark):
    given = ["$1,234", "$1.5", "1.234,5 EUR", "(12.30 USD)", "-€5", "$1.234.567", "€1,2,3.4", "42.00", "$l0.SO", "USD", "£1 234.5", "$1,2.3,4"]
    want = [("fixed", "$1234.00"), ("fixed", "$1.50"), ("fixed", "1234.50 EUR"), ("fixed", "-12.30 USD"), ("fixed", "-€5.00"), ("fixed", "$1234567.00"), ("fixed", "€123.40"), None, ("fixed", "$10.50"), None, ("fixed", "£1234.50"), ("invalid", "$1,2.3,4")]
    assert values(spark, normalizers.normalize_amount, given) == want


def test_zones(spark):
    td1 = "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"
    td2 = "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nD231458907UTO7408122F1204159<<<<<<<6"
    given = [td1, td1.replace("D231458907", "D23I458907"), td2, td2.replace("7408122", "7408123"), td2.split("\n")[1], "7408122F1204159UTO<<<<<<<<<<<6", "x" * 44, None]
    want = [("valid", td1), ("fixed", td1), ("valid", td2), ("invalid", given[3]), ("valid", given[4]), ("valid", given[5]), None, None]
    assert values(spark, normalizers.normalize_mrz, given) == want


def test_confusable_pairs(spark):
    pairs = {"0o", "0q", "1i", "1l", "2z", "5s", "6g", "8b", "9q", "ce", "il", "uv"}
    letters = "0123456789abcdefghijklmnopqrstuvwxyz"
    for a, b in itertools.product(letters, letters):
        assert (metrics.weighted_distance(a, b.upper()) == 0.3) == ("".join(sorted(a + b)) in pairs)


def test_correction_by_confidence(spark):
    lexicon = spark.createDataFrame([("Total", 1), ("total", 2), ("form", 3), ("from", 4), ("farm", 5), ("invoice", 6)], "term string, ord int")
    lines = spark.createDataFrame(
        [
            ("a", "Totai  (INVOCE), fxrm 12a ok", 0.1, None, None),  # fxrm is one edit from form and farm; form stands first
            ("b", "fxrm", 0.1, [0.1, 0.9, 0.1, 0.1], None),  # x was read with confidence, so both cost more
            ("c", "invoce invoce", 0.1, None, [0.9, 0.2]),
            ("d", "invoce", 0.9, None, None),
            ("e", " $1,5 ", 0.1, None, None),
            ("f", "", 0.1, None, None),
            ("g", "pay 1,5EUR now $1,234", 0.9, None, None),
        ],
        "line_id string, text string, confidence double, char_conf array<double>, word_conf array<double>",
    )
    out = correction.correct_lines(lines, lexicon, replacements={"ok": "okay"}, normalizers=(normalizers.normalize_amount,))
    got = {r.line_id: r.corrected for r in out.collect()}
    assert got == {"a": "Total  (INVOICE), form 12a okay", "b": "form", "c": "invoce invoice", "d": "invoce", "e": "$1.50" , "f": "", "g": "pay 1.50 EUR now $1,234"}
    words_ = F.array(F.struct(F.lit("a").alias("text"), F.lit(1).alias("x")), F.struct(F.lit("b").alias("text"), F.lit(2).alias("x")))
    row = spark.range(1).select(correction.rebuilt_words(F.lit("a b"), F.lit("A  B"), words_).alias("w"), correction.rebuilt_words(F.lit("a b"), F.lit("ab"), words_).alias("n")).first()
    assert [tuple(w) for w in row.w] == [("A", 1), ("B", 2)] and row.n == []


def test_anchors_and_directions(spark):
    box = lambda x, y, w=60: {"min_x": float(x), "min_y": float(y), "max_x": float(x + w), "max_y": float(y + 20)}
    schema = "page int, line_no int, text string, confidence double, box struct<min_x:double,min_y:double,max_x:double,max_y:double>"
    cross = [(1, 0, "up", 0.5, box(100, 40)), (1, 1, "left", 0.5, box(0, 100)), (1, 2, "Total", 0.9, box(100, 100)), (1, 3, "right", 0.5, box(200, 100)), (1, 4, "down", 0.5, box(100, 160))]
    page = spark.createDataFrame(cross, schema)
    for d, want in ((fields.RIGHT, "right"), (fields.LEFT, "left"), (fields.BELOW, "down"), (fields.ABOVE, "up"), (fields.ALL, "right")):
        row = fields.extract_fields(page, (fields.Field("T", ("Total",), directions=d),)).first()
        assert (row.value, row.name, row.n_lines) == (want, "T", 1) and row.explanation.startswith("'Total' matched at 1.00 similarity")
    seen = ["Totai", "T0tal", "TOTAL :", "total-", "Notes", "Tenant", "Postal"]
    lines = spark.createDataFrame([(i, 0, s + " 7", 0.9, box(0, 0)) for i, s in enumerate(seen)], schema)
    found = {r.page for r in fields.extract_fields(lines, (fields.Field("T", ("Total",), value=r"\d+"),)).collect()}
    assert found == {0, 1, 2, 3}
    by_pattern = fields.extract_fields(page.limit(0).unionAll(spark.createDataFrame([(1, 0, "Ref#: A-1", 0.9, box(0, 0))], schema)), (fields.Field("R", patterns=("Ref#",)),)).first()
    assert (by_pattern.value, by_pattern.kind, by_pattern.similarity) == ("A-1", "Inline", 1.0)
    repeated = spark.createDataFrame([(1, i, f"Total: {i}", 0.9, box(0, 30 * i)) for i in range(3)], schema)
    take = lambda how: fields.extract_fields(repeated, (fields.Field("T", ("Total",), occurrence=how, directions=fields.SAME_LINE),)).first().value
    assert (take("first"), take("last"), take("best")) == ("0", "2", "0")
    with pytest.raises(ValueError):
        fields.Field(" ")


def test_components_and_dilation():
    rng = np.random.default_rng(3)
    for _ in range(20):
        mask = rng.random((9, 11)) < 0.5
        labels, n = arrays.components(mask)
        grown = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
        while True:  # the least number of each part spreads
            p = np.pad(grown, 1)
            near = np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
            new = np.where(mask, np.where(near > 0, near, 10**6).min(axis=0), 0)
            if (new == grown).all():
                break
            grown = new
        assert n == len(np.unique(grown[mask])) and len({(a, b) for a, b in zip(labels[mask], grown[mask])}) == n
        assert sum(b[4] for b in arrays.component_boxes(labels, n)) == mask.sum()
        for side in (1, 2, 3, 4):
            want = np.zeros_like(mask)
            for y, x in np.ndindex(mask.shape):
                want[y, x] = any(mask[i, j] for i in range(max(0, y - side // 2), min(9, y - side // 2 + side)) for j in range(max(0, x - side // 2), min(11, x - side // 2 + side)))
            assert (arrays.dilate(mask, side) == want).all()
        grey = rng.integers(0, 255, (7, 9))
        rows = np.array([[grey[y, max(0, x - 2) : x + 3].sum() // len(grey[y, max(0, x - 2) : x + 3]) for x in range(9)] for y in range(7)])
        assert (arrays.box_blur(grey, 2) == np.array([[rows[max(0, y - 2) : y + 3, x].sum() // len(rows[max(0, y - 2) : y + 3, x]) for x in range(9)] for y in range(7)])).all()


def test_rectangles_and_polygons():
    rng = np.random.default_rng(5)
    for _ in range(10):
        a = rng.random() * np.pi
        turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        corners = np.array([(0, 0), (8, 0), (8, 3), (0, 3)]) @ turn.T + 20
        inside = np.vstack([corners, [corners[0] + (corners[1] - corners[0]) * u + (corners[3] - corners[0]) * v for u, v in rng.random((30, 2))]])
        got = arrays.min_area_rectangle(inside)
        assert np.allclose(sorted(map(tuple, got.round(6))), sorted(map(tuple, corners.round(6)))) and got.sum(axis=1).argmin() == 0
        filled = {(x, y) for y, p, q in arrays.polygon_spans([tuple(c) for c in corners], 40, 40) for x in range(p, q + 1)}
        local = lambda x, y: (np.array([x + 0.5, y + 0.5]) - 20) @ turn  # noqa: E731, B023
        assert filled == {(x, y) for x in range(40) for y in range(40) if 0 < local(x, y)[0] < 8 and 0 < local(x, y)[1] < 3}
        h = arrays.homography(corners, [(0, 0), (1, 0), (1, 1), (0, 1)])
        u, v, w = h @ [*corners[2], 1]
        assert np.allclose((u / w, v / w), (1, 1))
    assert arrays.polygon_spans([(0, 0), (1, 1)], 5, 5) == [] and np.array_equal(arrays.min_area_rectangle([(1, 1), (3, 1)]), [(1, 1), (3, 1), (3, 1), (1, 1)])
    image = np.arange(48).reshape(6, 8)
    assert np.allclose(arrays.warp(image, [(1, 1), (5, 1), (5, 4), (1, 4)], 5, 4), image[1:5, 1:6])
    heat = np.zeros((30, 30))
    heat[10:14, 5:25] = 0.9
    (quad,) = arrays.heat_boxes(heat, np.zeros((30, 30)), (2.0, 2.0), (60, 60))
    assert quad.min(axis=0)[0] <= 10 and quad.max(axis=0)[0] >= 48 and arrays.heat_boxes(heat * 0.5, heat * 0, (1, 1), (30, 30)) == []
    for how in ("fill", "blur", "pixelate"):
        out = arrays.redacted(image, [(1, 1), (5, 1), (5, 4), (1, 4)], how, 2)
        assert (out[0] == image[0]).all() and (out[1:4, 1:5] != image[1:4, 1:5]).any()


def test_readings():
    logits = np.full((7, 4), -4.0)
    for t, c in enumerate([1, 1, 0, 1, 3, 3, 0]):
        logits[t, c] = 4
    got, confidence, alignment = decode.greedy(logits, "abc")
    p = 1 / (1 + 3 * np.exp(-8))
    assert got == "aac" and confidence == pytest.approx(np.exp(2 / np.sqrt(5) * 5 * np.log(p))) and [(c, a, b) for c, _, a, b in alignment] == [("a", 0, 1), ("a", 3, 3), ("c", 4, 5)]
    assert decode.greedy(logits, "abc", decode_mask := text.allowed_characters("abc", block="c"))[0] == "aa" and decode_mask == [True, True, False]
    assert decode.uniform_alignment("ab", 0.5, 5) == [("a", 0.5, 0, 1), ("b", 0.5, 2, 4)] and decode.uniform_alignment("", 1.0, 5) == []
    known = decode.prefixes(["cat"])
    assert [decode.may_follow(known, t, c) for t, c in (("", "c"), ("", "x"), ("ca", "t"), ("ca", "x"), ("x", "y"), ("cat ", "c"), ("cat", " "))] == [True, False, True, False, True, True, True]
    made, parts = words.geometry([(0, 0), (100, 0), (100, 10), (0, 10)], [("a", 0.8, 0, 1), (" ", 0.5, 2, 2), ("b", 0.6, 3, 4), ("c", 1.0, 5, 5)], 10, 80, 100)
    assert [(w, round(c, 6)) for w, c, _ in made] == [("a", 0.8), ("bc", 0.8)] and len(parts) == 4 and np.allclose(made[1][2], [(37.5, 0), (75, 0), (75, 10), (37.5, 10)])
    assert words.to_crop(0.25, 0.5, (40, 20), (20, 40), 90) == pytest.approx((0.5, 0.75)) and words.content_width(100, 50, 64, 100) == 100 and words.content_width(0, 5, 64, 9) == 0
    steps = {(): [0.0, 2.0, 1.0], (1,): [0.0, 0.0, 0.0], (2,): [9.0, 0.0, 0.0]}
    model = lambda ids: steps.get(tuple(ids[1:]), [])
    assert decode.sequence(model, 9, 0)[0] == [1] and decode.sequence(model, 9, 0, width=2)[0] == [2] and decode.sequence(model, 9, 5, most=1)[2] is True
    tokens = decode.vocabulary('{"model": {"vocab": {"<s>": 0, "\u0120caf": 1, "\u00c3\u00a9": 2}}}')
    assert decode.decode_ids([0, 1, 2, 77], tokens) == " café" and decode.vocabulary('["a", 1]') == ["a", None] and decode.characters('"ab\\n"') == "ab\n" and decode.characters("ab\n") == "ab"


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    chars = lambda s: F.array(*(F.struct(F.lit(c).alias("value")) for c in s))
    named = lambda *ws: F.array(*(F.struct(F.lit(w).alias("text")) for w in ws))
    assert [[c.value for c in g] for g in one(words.by_word(chars("ab c"), named("ab", "c")))] == [["a", "b"], ["c"]] and one(words.by_word(chars("ab c"), named("ab", "d"))) is None
    assert one(exports.unique_names(F.array(*map(F.lit, ("a", "A", "", "a_2", "Column3"))))) == ["a", "A_2", "Column3", "a_2_2", "Column3_2"]
    assert one(exports.csv_table(F.array(F.array(F.lit("a"), F.lit('b"')), F.array(F.lit("1"), F.lit("x,y"))))) == 'a,"b""",\r\n1,"x,y"\r\n'.replace('",\r', '"\r')
    assert one(F.size(text.units(F.lit("é👍🏽x"), "utf16"))) == 6 and one(text.units(F.lit("👍🏽x"))) == ["👍🏽", "x"] and one(text.unicode_form(F.lit("ﬁ①"))) == "fi1"
    assert one(text.mask_spans(F.lit("abcdef"), F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")), F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"))))) == "a███ef"
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(c) for c, x in zip(("min_x", "min_y", "max_x", "max_y"), v)))
    assert one(geometry.contains(box(0, 0, 10, 10), box(-0.5, 0, 10.4, 9))) and not one(geometry.contains(box(0, 0, 10, 10), box(-1, 0, 5, 5))) and one(geometry.is_empty(box(3, 3, 3, 2)))
    triangle = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (6, 0), (3, 9))))
    assert one(geometry.padded(triangle, 0.1))[2].y == pytest.approx(9.9) and one(geometry.shape(F.slice(triangle, 1, 2), box(0, 0, 0, 4))) is None
    assert one(text.byte_size(F.lit(1536))) == "1.5 KB" and one(text.fraction(F.lit(3), F.lit(0))) is None
    with pytest.raises(Exception, match="no language"):
        one(text.languages(F.array(F.lit(" "))))


def test_byte_sizes(spark):
    given = [0, 1023, 1024, 1280, 1792, 2304, 2**20, 5 * 2**18, 5 * 2**28, None]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, n long").orderBy("i")
    got = rows.select(text.byte_size(F.col("n")).alias("a"), text.byte_size(F.col("n"), "KB").alias("k")).collect()
    assert [r.a for r in got] == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "2.2 KB", "1.0 MB", "1.2 MB", "1.2 GB", None]
    assert [r.k for r in got[6:]] == ["1024.0 KB", "1280.0 KB", "1310720.0 KB", None]


def test_file_digests_of_odd_texts(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT n AS doc_id, repeat('a', n) AS text FROM (SELECT unnest([0, 1, 1023, 1024, 1048575, 1048576, 1048832, 3145728]) AS n UNION SELECT 256 * unnest(range(4, 100)))")
    con.execute("INSERT INTO documents VALUES (-1, NULL), (-2, repeat('é', 640)), (-3, repeat('😀', 320))")
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    ours = page_queries.file_digests(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, ours)) == sorted(con.sql(catalogue.ORACLE["file_digests"]).fetchall())


def test_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (70000).to_bytes(4, "big") + (70000).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + (20).to_bytes(2, "big") + (30).to_bytes(2, "big") + b"\0" * 9
    (tmp_path / "sub").mkdir()
    for name, content in (("b.png", png), ("a.jpg", jpeg), ("c.txt", b"x"), ("sub/d.PNG", b"")):
        (tmp_path / name).write_bytes(content)
    base = str(tmp_path)
    assert tables.image_size(png) == (70000, 70000) and tables.image_size(jpeg) == (30, 20) and tables.image_size(b"x") is None
    short = lambda found: [f[len(base) + 1 :] for f in found]
    assert short(tables.resolve_paths([base])) == ["a.jpg", "b.png"] and short(tables.resolve_paths([base + "/*.png", base], True)) == ["b.png", "a.jpg", "sub/d.PNG"]
    assert short(tables.resolve_paths([base + "/c.txt", base + "/b.*"])) == ["c.txt", "b.png"]
    with pytest.raises(FileNotFoundError):
        tables.resolve_paths([base + "/none*"])
    files = spark.createDataFrame([(name, bytearray((tmp_path / name).read_bytes())) for name in ("b.png", "a.jpg", "c.txt", "sub/d.PNG")], "path string, content binary")
    got = {r.path: (r.error, r.content is None) for r in tables.guarded(files).collect()}
    assert got == {"b.png": ("70000 x 70000 pixels are too many", True), "a.jpg": (None, False), "c.txt": (None, False), "sub/d.PNG": ("the file is empty", True)}


def test_planted_cards_are_found(spark):
    rng = random.Random(1)
    line = " ".join(str(rng.randrange(100)) for _ in range(5)) + ", card 4111-1111-1111-1111."
    masked = spark.createDataFrame([(line,)], "v string").select(text.mask_matches(F.col("v"), page_queries.CARD, lambda m: F.length(m) > 15).alias("r")).first().r
    assert masked.endswith("card " + "█" * 19 + ".")


def _cards(line):
    """Brute force: (start, end) of the card numbers in a text."""
    groups = [m.span() for m in re.finditer("[0-9]+", line)]
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda i, j: "".join(line[a:b] for a, b in groups[i : j + 1])
    joined = lambda i, j: all(line[groups[k][1] : groups[k + 1][0]] in (" ", "-") for k in range(i, j))
    fits = lambda i, j: 13 <= len(digits(i, j)) <= 19 and luhn(digits(i, j)) and joined(i, j)
    alone, out, i = {k for k in range(len(groups)) if fits(k, k)}, [], 0
    while i < len(groups):
        ends = [j for j in range(min(len(groups), i + 19) - 1, i - 1, -1) if fits(i, j) and (i == j or not alone & set(range(i, j + 1)))]
        if ends:
            out.append((groups[i][0], groups[ends[0]][1]))
        i = ends[0] + 1 if ends else i + 1
    return out


def _card_texts():
    rng = random.Random(4)
    bits = ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "378282246310005", "4451718024887799", "27.65.9", "12/27", "123", "7", "(836) 555-9331", "x", "é█", "4111111111111112", "- 1", "--2", "\n"]
    made = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "-", "  ", ", "]) for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    return made + ["4451718024887799 27.65.93", "4.106.61 4080166431094600 E", "card 4111 1111 1111 1111 12/27", "4111111111111111 123", "po 4111 1111 1111", "1 " * 3000, "9" * 3000, "", None]


def test_cards_beside_other_numbers(spark, tmp_path):
    given = _card_texts()
    spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_cards for r in catalogue.redact_card(spark, str(tmp_path)).collect()}
    assert got == {i: len(_cards(t)) for i, t in enumerate(given) if t and _cards(t)} and got[300] == got[301] == got[302] == got[303] == 1


def test_cards_are_masked(spark, tmp_path):
    given = _card_texts()
    spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in enumerate(given):
        if t and _cards(t):
            hidden = {k for a, b in _cards(t) for k in range(a, b)}
            want.add((i, len(_cards(t)), hashlib.sha256("".join("█" if k in hidden else c for k, c in enumerate(t)).encode()).hexdigest()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert set(map(tuple, catalogue.redact_card(spark, str(tmp_path)).collect())) == want == set(con.sql(catalogue.ORACLE["redact_card"]).fetchall())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_move_their_rows_once(spark, sf_dir):
    for query in (page_queries.page_hocr, page_queries.page_alto, page_queries.page_tsv):
        plan = _plan(query(spark, sf_dir))
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("xpath") == 0


def test_lines_and_words_become_pages(spark):
    box = "box struct<min_x:double,min_y:double,max_x:double,max_y:double>"
    lines = spark.createDataFrame([(1, 2, (0.0, 30.0, 9.5, 40.0)), (1, 1, (0.0, 0.0, 8.0, 10.0)), (2, 1, (1.0, 1.0, 2.0, 2.0))], f"page long, line_no int, {box}")
    words = spark.createDataFrame([(1, 1, 2, "b", 1.0, (4.0, 0.0, 8.0, 10.0)), (1, 1, 1, "a<", 0.12345, (0.0, 0.0, 3.0, 10.0)), (1, 7, 1, "lost", 0.5, (0.0, 0.0, 1.0, 1.0)), (2, 1, 1, "c", 0.0, (1.0, 1.0, 2.0, 2.0))], f"page long, line_no int, word_no int, text string, conf double, {box}")
    one = {r.page: r for r in exports.hocr(lines, words).join(exports.alto(lines, words), "page").join(exports.tsv(lines, words), "page").collect()}
    assert _plan(exports.alto(lines, words)).count("Exchange hashpartitioning") == 1
    assert "bbox 0 0 10 40" in one[1].hocr and one[1].hocr.index("line_1'") < one[1].hocr.index(">a&lt;<") < one[1].hocr.index(">b<") < one[1].hocr.index("line_2'") and "lost" not in one[1].hocr
    assert [x in one[1].alto for x in ('WC="0.123" CONTENT="a&lt;"', 'WC="1" CONTENT="b"')] == [True, True] and 'WC="0" CONTENT="c"' in one[2].alto
    assert one[1].tsv.split("\n")[1:] == ["5\t1\t1\t1\t1\t1\t0\t0\t3\t10\t12\ta<", "5\t1\t1\t1\t1\t2\t4\t0\t4\t10\t100\tb", ""]


def test_mod97_of_any_length(spark):
    rng = random.Random(7)
    given = ["".join(rng.choice("0123456789ABCXYZ" if i % 2 else "0123456789") for _ in range(n)) for i, n in enumerate([*range(1, 60), 200, 701])] + ["0" * 40, "", None]
    got = spark.createDataFrame(list(enumerate(given)), "i int, v string").select("i", checksums.mod97(F.col("v")).alias("r")).orderBy("i").collect()
    want = [None if v is None else int("".join(str(int(c, 36)) for c in v) or "0") % 97 for v in given]
    assert [r.r for r in got] == want


@pytest.mark.parametrize("name", ["redact_iban", "iban_mod97"])
def test_one_row_group_is_spread(spark, sf_dir, name):
    assert "RoundRobinPartitioning" in _plan(catalogue.QUERIES[name](spark, sf_dir))


def test_card_texts_are_spread_and_made_once(spark, sf_dir):
    plan = _plan(page_queries.redact_card_text(spark, sf_dir))
    assert "RoundRobinPartitioning" in plan and plan.count("lpad(") == 1


def test_dates_are_spread_and_made_once(spark, sf_dir):
    plan = _plan(page_queries.date_repair(spark, sf_dir))
    assert "RoundRobinPartitioning" in plan and plan.count("31.02.") == 1
    assert values(spark, lambda c: normalizers.normalize_date(c, "mdy"), ["1234/5/20", "L/2/2020", "12/1234"]) == [("invalid", "1234/5/20"), ("invalid", "L/2/2020"), None]


def test_weighted_distances_of_many(spark, sf_dir):
    rng = random.Random(9)
    letters = "rnmcldvwio0O1lIzZ2é İKſΣaRN"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(9)))
    pairs = [(word(), word()) for _ in range(2000)] + [("x" * 90, "yx" * 30), ("rn" * 40, "m" * 50)]
    assert list(metrics.weighted_distances(pairs)) == [metrics.weighted_distance(*p) for p in pairs]
    assert "RoundRobinPartitioning" in _plan(catalogue.weighted_distance(spark, sf_dir))


def test_costly_candidates_are_not_filtered_by_a_second_run(spark, sf_dir):
    lines = page_queries.invoice_lines(spark, sf_dir)
    plan = fields.candidates(lines, (fields.TOTAL,))._jdf.queryExecution().optimizedPlan().toString()
    kept = [x for x in plan.split("\n") if x.strip(" :+-|").startswith(("Filter", "Join"))]
    assert not any("levenshtein" in x or "Inline" in x or "Below" in x for x in kept)
