"""Sinks: results as JSON files, console tables and LaTeX lines.  What is written is a few rows a method."""

from __future__ import annotations

import datetime
import json
import math

from pyspark.sql import DataFrame, SparkSession


def records(df: DataFrame) -> list[dict]:
    """A small table's rows as dicts."""
    return [r.asDict(recursive=True) for r in df.collect()]


def _strict(x):
    """Numbers that JSON has no form for become null."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: _strict(v) for k, v in x.items()}
    return [_strict(v) for v in x] if isinstance(x, (list, tuple)) else x


def write_json(spark: SparkSession, value, folder: str, name: str, stamp: str | None = None) -> str:
    """Writes value to folder/name_stamp.json, in whichever store that is; the path."""
    stamp = stamp or datetime.datetime.now().strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/{name}_{stamp}.json"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(_strict(value), indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()
    return path


def table(rows: list[dict], columns: list[str], title: str = "") -> str:
    """Rows under their columns' names, numbers with three places."""
    shown = [[f"{v:.3f}" if isinstance(v, float) else "-" if v is None else str(v) for v in (r.get(c) for c in columns)] for r in rows]
    width = [max(len(x) for x in col) for col in zip(columns, *shown, strict=True)]
    line = lambda cells: "  ".join(c.ljust(w) if k == 0 else c.rjust(w) for k, (c, w) in enumerate(zip(cells, width, strict=True)))
    rule = "-" * (sum(width) + 2 * (len(width) - 1))
    return "\n".join(([title, rule] if title else []) + [line(columns), rule, *map(line, shown)])


def latex(rows: list[dict], name: str, columns: list[str]) -> str:
    """A line for each row; the best value of each column is bold."""
    best = {c: max((r[c] for r in rows if isinstance(r.get(c), float)), default=None) for c in columns}
    cell = lambda r, c: "-" if r.get(c) is None else f"\\textbf{{{r[c]:.3f}}}" if r[c] == best[c] else f"{r[c]:.3f}"
    return "\n".join(" & ".join([str(r[name]), *(cell(r, c) for c in columns)]) + r" \\" for r in rows)


def improvements(rows: list[dict], ours: str, metric: str, name: str = "method") -> str:
    """How far one method is over the best of the others, in a line."""
    value = {r[name]: r[metric] for r in rows}
    base = max((m for m in value if m != ours and "Structural" not in m), key=lambda m: value[m], default=None)
    if ours not in value or base is None:
        return ""
    change = value[ours] - value[base]
    percent = f"{change / value[base] * 100:+.1f}%" if value[base] else "+inf%"
    return f"{metric}: {value[ours]:.3f} against {value[base]:.3f} of {base} ({change:+.3f}, {percent})"


def ablation(rows: list[dict], metric: str = "r_at_5", name: str = "method") -> str:
    """Effects of chunking and of retrieval on a metric, in a line; empty unless all four methods are there."""
    v = {r[name]: r[metric] for r in rows}
    need = ("Recursive + Dense", "Structural + Dense", "Naive Hybrid", "Structural + Hybrid")
    if any(n not in v for n in need):
        return ""
    a, b, c, d = (v[n] for n in need)
    return f"{metric}: chunking {b - a:+.3f}, retrieval {c - a:+.3f}, both {d - a:+.3f}"
