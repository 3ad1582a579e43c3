"""Tables of pages as grids: spans expanded, rows padded, written as Markdown or LaTeX."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The ten characters that LaTeX reserves.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
#: Columns that a cell may span at most, as HTML itself cuts `colspan`; rows are not bounded, as a span ends with its table.
MOST_COLUMNS = 1000


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int, int]]] = []
        self.open: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append([])
            span = lambda k: max(1, int(v)) if (v := dict(attrs).get(k) or "").isdecimal() else 1
            self.open = [[], span("rowspan"), min(MOST_COLUMNS, span("colspan"))]
        elif tag == "br" and self.open:
            self.open[0].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[0].append(data)

    def _close(self) -> None:
        if self.open:
            self.rows[-1].append((" ".join("".join(self.open[0]).split()), self.open[1], self.open[2]))
            self.open = None


def grid_of(html: str | None) -> list[list[str]]:
    """The cells of a table, each repeated over its spans, short rows padded."""
    parser = _Cells()
    parser.feed(html or "")
    parser._close()
    hanging: dict[int, tuple[str, int]] = {}
    rows = []
    for cells in parser.rows:
        row: list[str] = []
        todo = list(cells)
        while todo or any(c >= len(row) for c in hanging):
            c = len(row)
            if c in hanging:
                text, left = hanging.pop(c)
                row.append(text)
                if left > 1:
                    hanging[c] = (text, left - 1)
                    if not todo and all(k < len(row) for k in hanging):
                        break
            elif todo:
                text, down, across = todo.pop(0)
                for k in range(across):
                    if down > 1:
                        hanging[c + k] = (text, down - 1)
                    row.append(text)
            else:
                row.append("")
        rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def table_grid(html: pd.Series) -> pd.Series:
    return html.map(grid_of)


def padded(grid: Column) -> Column:
    """Rows filled up with empty cells to the longest."""
    width = F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))
    return F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def grid_markdown(grid: Column) -> Column:
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(grid, 1), lambda _: F.lit("---")), " | "), F.lit(" |"))
    rows = F.transform(grid, line)
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.size(rows))), "\n")).otherwise("")


def latex_escaped(text: Column) -> Column:
    """Each reserved character once: the text is taken apart, so no escape is escaped."""
    table = F.create_map(*[F.lit(x) for kv in LATEX.items() for x in kv])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def grid_latex(grid: Column) -> Column:
    rows = F.transform(grid, lambda r: F.concat(F.array_join(F.transform(r, latex_escaped), " & "), F.lit(r" \\")))
    columns = F.repeat(F.lit("l"), F.size(F.element_at(grid, 1)))
    return F.when(F.size(grid) > 0, F.concat(F.lit(r"\begin{tabular}{"), columns, F.lit("}\n"), F.array_join(rows, "\n"), F.lit("\n\\end{tabular}"))).otherwise("")
