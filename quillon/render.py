"""Rows as text: aligned columns, or one record below another."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame

from quillon import types


def shown(value) -> str:
    if value is None:
        return "[NULL]"
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value)


#: Rows that are shown at most; of more, these and a note.
MOST = 10_000


def _cells(df: DataFrame, most: int):
    rows = df.limit(most + 1).collect()
    return df.columns, [[shown(v) for v in row] for row in rows[:most]], len(rows) > most


def table(df: DataFrame, most: int = MOST) -> str:
    """Names are centred, numbers stand to the right, a count follows."""
    names, rows, more = _cells(df, most)
    right = [types.is_number(f.dataType) for f in df.schema]
    widths = [max([len(n), *(len(line) for r in rows for line in r[i].split("\n"))]) for i, n in enumerate(names)]
    lines = []
    if names:
        lines.append(" " + " | ".join(n.rjust(len(n) + (w - len(n)) // 2).ljust(w) for n, w in zip(names, widths)))
        lines.append("-" + "-+-".join("-" * w for w in widths) + "-")
    for r in rows if names else []:
        cells = [c.split("\n") for c in r]
        for i in range(max(map(len, cells))):
            parts = [c[i] if i < len(c) else "" for c in cells]
            lines.append(" " + " | ".join(p.rjust(w) if to else p.ljust(w) for p, w, to in zip(parts, widths, right)))
    lines.append(f"(the first {len(rows)} rows)" if more else f"({len(rows)} rows)")
    return "\n".join(lines) + "\n"


def expanded(df: DataFrame, most: int = MOST) -> str:
    names, rows, more = _cells(df, most)
    width = max(map(len, names), default=0)
    values = max((len(line) for r in rows for c in r for line in c.split("\n")), default=0)
    lines = []
    for i, r in enumerate(rows, 1):
        lines.append(f"-[ RECORD {i} ]".ljust(width + values + 3, "-"))
        for n, c in zip(names, r):
            first, *others = c.split("\n")
            lines.append(f"{n.ljust(width)} | {first}")
            lines += [f"{' ' * width} | {line}" for line in others]
    if more:
        lines.append(f"(the first {len(rows)} rows)")
    return "\n".join(lines) + "\n" if lines else "(0 rows)\n"
