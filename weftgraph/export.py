"""A self-contained HTML picture of the mesh: services on a circle, edges as lines."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from .operators.graph import layout


def render(services: DataFrame, mesh: DataFrame, radius: int = 320, most: int = 2000) -> str:
    """HTML of at most ``most`` services in id order and the edges between them; the picture is for people."""
    shown = services.orderBy("id").limit(most)
    places = {r["id"]: (r["x"], r["y"]) for r in layout(shown, shown.count()).collect()}
    names = {r["id"]: r["name"] or r["id"] for r in shown.select("id", "name").collect()}
    point = lambda i: (radius * (1.3 + places[i][0]), radius * (1.3 + places[i][1]))
    lines, dots = [], []
    for r in mesh.select("from_id", "to_id", "confidence").orderBy("from_id", "to_id").limit(20 * most).collect():
        if r["from_id"] in places and r["to_id"] in places:
            (a, b), (c, d) = point(r["from_id"]), point(r["to_id"])
            lines.append(f'<line x1="{a:.1f}" y1="{b:.1f}" x2="{c:.1f}" y2="{d:.1f}" class="{html.escape(r["confidence"] or "")}"/>')
    for i, name in names.items():
        x, y = point(i)
        dots.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4"/><text x="{x + 6:.1f}" y="{y:.1f}">{html.escape(name)}</text>')
    size = 2.6 * radius
    style = "line{stroke:#99a;stroke-width:1}line.corroborated{stroke:#264}line.ambiguous,line.config{stroke-dasharray:4}text{font:10px sans-serif}"
    return f'<!doctype html><meta charset="utf-8"><style>{style}</style><svg viewBox="0 0 {size:.0f} {size:.0f}">{"".join(lines)}{"".join(dots)}</svg>'
