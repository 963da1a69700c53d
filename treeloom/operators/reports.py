"""Report sinks over small results: LaTeX and text tables, checksum lists; observed counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, functions as F

#: The most rows a rendered table takes to the driver.
MOST_ROWS = 1000


def _rows(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report of over {MOST_ROWS} rows is a table to be written, not rendered")
    return rows


def decimal_comma(x: float, places: int = 1) -> str:
    """A number with a decimal comma and dots between thousands."""
    return f"{x:,.{places}f}".translate(str.maketrans(",.", ".,"))


def latex_table(df: DataFrame, group: str, order: str, headings: dict[str, str]) -> str:
    """A tabular of the columns in ``headings``, with a line where ``group`` changes."""
    out, before = [f"\\begin{{tabular}}{{{'l' * len(headings)}}}", " & ".join(headings.values()) + r" \\ \hline"], object()
    for r in _rows(df.orderBy(order)):
        if r[group] != before:
            before = r[group]
            out.append(rf"\multicolumn{{{len(headings)}}}{{l}}{{\textit{{{before}}}}} \\")
        cells = [decimal_comma(r[c]) if isinstance(r[c], float) else "" if r[c] is None else str(r[c]) for c in headings]
        out.append(" & ".join(x.replace("&", r"\&").replace("_", r"\_") for x in cells) + r" \\")
    return "\n".join([*out, r"\end{tabular}", ""])


def text_report(sections: Iterable[tuple[str, DataFrame]]) -> str:
    """Titled sections of tab-separated rows; the frames come ordered and limited."""
    out = []
    for title, df in sections:
        out += [title, "=" * len(title), "\t".join(df.columns)]
        out += ["\t".join("" if v is None else str(v) for v in r) for r in _rows(df)]
        out.append("")
    return "\n".join(out)


def checksum_list(digests: DataFrame) -> str:
    """``sha256  name`` lines by name; empty if there are no files."""
    return "".join(f"{r.sha256}  {r.name}\n" for r in _rows(digests.orderBy("name")))


def percentages_add_up(df: DataFrame, columns: list[str], within: float = 0.3) -> DataFrame:
    """Rows whose rounded percentages miss 100 by more than ``within``."""
    return df.where(F.abs(sum((F.col(c) for c in columns), F.lit(0.0)) - 100) > within)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of ``metrics``, counted as its rows pass: progress and totals cost no pass of their own."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen
