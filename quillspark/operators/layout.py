"""Layout: columns, reading order, suppression of duplicates, lines and paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOX = ["x0", "y0", "w", "h"]


def reading_order(boxes: DataFrame, page: str = "page", tie: list[str] | None = None) -> DataFrame:
    """``boxes`` with column_no (from 0) and read_no (from 1).

    A column begins where a box lies further right of all before it than ``max(20, 1.5 * median height)``; inside a
    column boxes go by bands of ``max(4, 0.5 * median height)``, rounded half to even, then from the left.
    """
    tie = tie or ["box_id"]
    page_window = Window.partitionBy(page)
    median = F.coalesce(F.median(F.when(F.col("h") > 0, F.col("h"))).over(page_window), F.lit(0.0))
    by_x = page_window.orderBy("x0", *tie)
    right = F.max(F.col("x0") + F.col("w")).over(by_x.rowsBetween(Window.unboundedPreceding, -1))
    rows = boxes.withColumn("_median", median).withColumn("_right", right)
    opens = F.coalesce((F.col("x0") - F.col("_right")) > F.greatest(F.lit(20.0), F.col("_median") * 1.5), F.lit(False)).cast("int")
    rows = rows.withColumn("_opens", opens).withColumn("column_no", F.sum("_opens").over(by_x.rowsBetween(Window.unboundedPreceding, 0)))
    tolerance = F.greatest(F.lit(4.0), F.col("_median") * 0.5)
    rows = rows.withColumn("_band", F.rint(F.col("y0") / tolerance) * tolerance)
    return rows.withColumn("read_no", F.row_number().over(page_window.orderBy("column_no", "_band", "x0", *tie))).drop("_median", "_right", "_opens", "_band")


def per_page(rows: DataFrame, page: str, work, added: str = "") -> DataFrame:
    """``rows`` through ``work(list of row dicts) -> list of row dicts`` for each page.

    Pages meet by one shuffle on the page and are cut out of the sorted partition as it streams by, so memory holds
    one page and one Arrow batch; a call for each group through pandas would cost milliseconds a page.
    """
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + (f", {added}" if added else "")
    out_names = names + [x.split()[0] for x in added.split(", ") if x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        done: list[dict] = []
        kinds = None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], kinds[n] if n in kinds else pa.int32()) for n in out_names], out_names)

        for batch in batches:
            kinds = kinds or {f.name: f.type for f in batch.schema}
            for row in batch.to_pylist():
                if held and row[page] != held[0][page]:
                    done += work(held)
                    held = []
                held.append(row)
            if len(done) >= 20_000:
                yield flush()
                done = []
        if held:
            done += work(held)
        if done:
            yield flush()

    return rows.repartition(page).sortWithinPartitions(page).mapInArrow(run, schema)


def _suppress(limit: float):
    def work(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for row in sorted(rows, key=lambda r: (-r["w"] * r["h"], r["box_id"])):
            for other in kept:
                x = min(row["x0"] + row["w"], other["x0"] + other["w"]) - max(row["x0"], other["x0"])
                y = min(row["y0"] + row["h"], other["y0"] + other["h"]) - max(row["y0"], other["y0"])
                both = max(x, 0) * max(y, 0)
                union = row["w"] * row["h"] + other["w"] * other["h"] - both
                if union > 0 and both / union > limit:
                    break
            else:
                kept.append(row)
        return kept

    return work


def suppress_duplicates(boxes: DataFrame, limit: float = 0.6, page: str = "page") -> DataFrame:
    """Greedy suppression: the largest box first (then the least box_id); a box goes if it overlaps a kept one by more than ``limit``."""
    return per_page(boxes, page, _suppress(limit))


def _lines(rows: list[dict]) -> list[dict]:
    centre = lambda r: r["y0"] + r["h"] / 2
    middle = lambda r: r["x0"] + r["w"] / 2
    line, current = -1, []
    out = []
    for row in sorted(rows, key=lambda r: (centre(r), r["x0"], r["box_id"])):
        joins = False
        if current:
            mean_c = sum(map(centre, current)) / len(current)
            mean_h = sum(r["h"] for r in current) / len(current)
            dx, dy = abs(middle(row) - middle(current[-1])), abs(centre(row) - centre(current[-1]))
            joins = abs(mean_c - centre(row)) < 0.5 * mean_h or (dx > mean_h and dy <= 0.1 * dx)
        if not joins:
            current, line = [], line + 1
        current.append(row)
        out.append(row | {"line_no": line})
    return out


def group_lines(boxes: DataFrame, page: str = "page") -> DataFrame:
    """``boxes`` with line_no: by vertical centre against the running mean of the line, or along a gentle slope."""
    return per_page(boxes, page, _lines, "line_no int")


def _paragraphs(reach: float):
    def near(row: dict, last: dict) -> bool:
        gap = row["y0"] - (last["y0"] + last["h"])
        left, right = max(row["x0"], last["x0"]), min(row["x0"] + row["w"], last["x0"] + last["w"])
        return -last["h"] <= gap <= reach * last["h"] and (right - left > 0.2 * min(row["w"], last["w"]) or left - right <= reach * last["h"])

    def work(rows: list[dict]) -> list[dict]:
        lasts: list[dict] = []
        out = []
        for row in sorted(rows, key=lambda r: (r["y0"], r["x0"], r["line_no"])):
            number = next((i for i, last in enumerate(lasts) if near(row, last)), len(lasts))
            lasts[number : number + 1] = [row]
            out.append(row | {"paragraph_no": number})
        return out

    return work


def group_paragraphs(lines: DataFrame, reach: float = 1.0, page: str = "page") -> DataFrame:
    """``lines`` with paragraph_no: a line joins the first paragraph whose last line is near above it."""
    return per_page(lines, page, _paragraphs(reach), "paragraph_no int")
