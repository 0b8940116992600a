"""HTML tables to rectangular grids."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROWS, MAX_COLUMNS, MAX_SPAN, MAX_CELLS = 4096, 1024, 512, 262_144


class _Grid(HTMLParser):
    """Collects the cells of the first table; tags inside a cell are dropped, a line break is a space."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int, int, bool]]] = []
        self.cell: list[str] | None = None
        self.depth, self.done = 0, False

    def _close(self) -> None:
        if self.cell is not None:
            self.rows[-1].append((" ".join("".join(self.cell).split()), *self.span))
            self.cell = None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self._close()
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append([])
            named = dict(attrs)
            size = lambda v: min(MAX_SPAN, int(v)) if v and v.strip().isdigit() and int(v) > 0 else 1
            self.span, self.cell = (size(named.get("colspan")), size(named.get("rowspan")), tag == "th"), []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if self.done or not self.depth:
            return
        if tag == "table":
            if self.depth == 1:
                self._close()
                self.done = True
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None and not self.done:
            self.cell.append(data)


def parse_table(fragment: str | None) -> tuple[list[list[str]], bool]:
    """(rows, whether the first row is all header cells); spans repeat their value, short rows are padded, empty rows at the end go."""
    parser = _Grid()
    parser.feed(fragment or "")
    parser.close()
    parser._close() if parser.rows else None
    grid: list[dict[int, str]] = []
    pending: dict[tuple[int, int], str] = {}
    header = bool(parser.rows and parser.rows[0]) and all(c[3] for c in parser.rows[0])
    cells = 0
    for r, row in enumerate(parser.rows[:MAX_ROWS]):
        line: dict[int, str] = {c: v for (rr, c), v in pending.items() if rr == r}
        at = 0
        for text, wide, tall, _ in row:
            while at in line:
                at += 1
            for k in range(wide):
                if at + k >= MAX_COLUMNS or cells >= MAX_CELLS:
                    break
                line[at + k] = text
                cells += 1
                for d in range(1, tall):
                    pending[(r + d, at + k)] = text
            at += wide
        grid.append(line)
    width = max((max(line) + 1 for line in grid if line), default=0)
    rows = [[line.get(c, "") for c in range(width)] for line in grid]
    while rows and not any(rows[-1]):
        rows.pop()
    return rows, header and bool(rows)


def table_grid(html: Column) -> Column:
    @F.pandas_udf("struct<rows:array<array<string>>,has_header:boolean>")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_table(h) for h in x], columns=["rows", "has_header"])

    return run(html)
