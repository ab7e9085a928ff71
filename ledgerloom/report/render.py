"""Results as JSON, plain text and one self-contained HTML page with inline SVG. Rows here are few: one a log, scale or day."""

from __future__ import annotations

import datetime as dt
import html
import json
import math
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1


def clean(x: Any) -> Any:
    """A value that strict JSON takes: infinities by name, not-a-number as null, dates in ISO form."""
    if isinstance(x, float):
        return None if math.isnan(x) else ("inf" if x > 0 else "-inf") if math.isinf(x) else x
    if isinstance(x, dict):
        return {str(k): clean(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [clean(v) for v in x]
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    return x


def records(d: DataFrame, most: int = 100_000) -> list[dict]:
    """Rows of a result table; more than `most` are no report."""
    rows = d.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows don't fit a report")
    return [r.asDict(recursive=True) for r in rows]


def to_json(sections: dict[str, Any]) -> str:
    return json.dumps(clean({"version": VERSION, **sections}), indent=2, allow_nan=False, sort_keys=False)


def save(path: str, text: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def money(x: float | None) -> str:
    return "-" if x is None or x != x else ("∞" if x > 0 else "-∞") if math.isinf(x) else f"-${-x:,.2f}" if x < 0 else f"${x:,.2f}"


def percent(x: float | None) -> str:
    return "-" if x is None or x != x else f"{100 * x:.1f}%"


def _cell(x: Any) -> str:
    if isinstance(x, bool) or x is None:
        return {True: "yes", False: "no", None: "-"}[x]
    if isinstance(x, float):
        return "-" if math.isnan(x) else f"{x:,.4g}"
    return str(x)


def table(rows: list[dict], title: str = "") -> str:
    """Rows as an aligned text table."""
    if not rows:
        return f"{title}\n  (no rows)\n" if title else "(no rows)\n"
    head = list(rows[0])
    body = [[_cell(r.get(c)) for c in head] for r in rows]
    w = [max(len(c), *(len(b[i]) for b in body)) for i, c in enumerate(head)]
    line = lambda xs: "  ".join(x.rjust(n) for x, n in zip(xs, w))
    return "\n".join([*([title] if title else []), line(head), line(["-" * n for n in w]), *map(line, body)]) + "\n"


# --- figures -------------------------------------------------------------------------------------------


def line_svg(series: dict[str, list[float]], width: int = 720, height: int = 240) -> str:
    """Lines over their index on one scale."""
    vals = [v for s in series.values() for v in s if v is not None and math.isfinite(v)]
    if not vals:
        return "<svg/>"
    lo, hi = min(vals), max(vals)
    span, n = (hi - lo) or 1.0, max(len(s) for s in series.values())
    out = [f'<svg viewBox="0 0 {width} {height}" role="img">']
    for k, (name, s) in enumerate(series.items()):
        pts = " ".join(f"{i * width / max(n - 1, 1):.1f},{height - (v - lo) * height / span:.1f}" for i, v in enumerate(s) if v is not None and math.isfinite(v))
        out.append(f'<polyline fill="none" stroke="hsl({k * 67 % 360},55%,40%)" stroke-width="1.5" points="{pts}"><title>{html.escape(name)}</title></polyline>')
    return "".join(out) + f'<text x="4" y="12" font-size="11">{hi:,.0f}</text><text x="4" y="{height - 4}" font-size="11">{lo:,.0f}</text></svg>'


def bars_svg(values: dict[str, float], width: int = 720, height: int = 200) -> str:
    """Bars from zero; negative ones hang."""
    v = {k: x for k, x in values.items() if x is not None and math.isfinite(x)}
    if not v:
        return "<svg/>"
    hi, lo = max(0.0, *v.values()), min(0.0, *v.values())
    span, step = (hi - lo) or 1.0, width / len(v)
    zero = height * hi / span
    out = [f'<svg viewBox="0 0 {width} {height + 16}" role="img">']
    for i, (k, x) in enumerate(v.items()):
        h = abs(x) * height / span
        out.append(f'<rect x="{i * step + 2:.1f}" y="{zero - h if x > 0 else zero:.1f}" width="{max(step - 4, 1):.1f}" height="{h:.1f}" fill="{"#2a7" if x > 0 else "#c54"}"><title>{html.escape(k)}: {x:,.2f}</title></rect>')
        out.append(f'<text x="{i * step + 3:.1f}" y="{height + 13}" font-size="10">{html.escape(k[:14])}</text>')
    return "".join(out) + "</svg>"


def histogram(d: DataFrame, column: str, bins: int = 40) -> dict[str, float]:
    """Counts of a column in equal bins between its extremes; nulls and infinities are left out."""
    v = d.where(F.col(column).isNotNull() & (F.abs(column) < float("inf"))).select(F.col(column).cast("double").alias("v"))
    r = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    if r["a"] is None:
        return {}
    if r["a"] == r["b"]:
        return {f"{r['a']:g}": float(v.count())}
    w = (r["b"] - r["a"]) / bins
    n = {x["i"]: x["n"] for x in v.groupBy(F.least(F.floor((F.col("v") - r["a"]) / w), F.lit(bins - 1)).alias("i")).agg(F.count("*").alias("n")).collect()}
    return {f"{r['a'] + i * w:.0f}": float(n.get(i, 0)) for i in range(bins)}


def waterfall(economics: dict) -> dict[str, float]:
    """The exact parts of the expected net, which they add up to."""
    parts = {"evaluation fees": economics["ev_eval_fees"], "payouts": economics["ev_payout_value"], "activation": economics["ev_activation"], "overheads": economics["ev_overheads"]}
    return parts | {"expected net": economics["expected_net"]}


def page(title: str, sections: list[tuple[str, str]]) -> str:
    """One HTML document; a section is a heading and a body (markup from line_svg or bars_svg, or plain text)."""
    body = "".join(f"<section><h2>{html.escape(h)}</h2>{b if b.startswith('<svg') else '<pre>' + html.escape(b) + '</pre>'}</section>" for h, b in sections)
    style = "body{font:14px system-ui;margin:2em auto;max-width:60em;padding:0 1em}pre{overflow:auto}svg{width:100%}"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'
