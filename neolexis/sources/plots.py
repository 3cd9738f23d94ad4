"""Plots as SVG, written without a plotting library: bars, panels of series, histograms.

Input is what a top-k, one token's series or a histogram returns: tens of rows.
"""

from __future__ import annotations

import os
from html import escape

WIDTH, LEFT, TOP = 900, 220, 50


def _write(path: str, height: float, title: str, body: list[str]) -> None:
    if folder := os.path.dirname(path):
        os.makedirs(folder, exist_ok=True)
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{height:.0f}" font-family="sans-serif" font-size="12">'
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([head, '<rect width="100%" height="100%" fill="white"/>', f'<text x="{WIDTH / 2}" y="24" text-anchor="middle" font-size="16">{escape(title)}</text>', *body, "</svg>"]))


def bars(rows: list[tuple[str, float]], title: str, label: str, path: str) -> None:
    """Horizontal bars, the largest on top."""
    rows = sorted(rows, key=lambda r: -r[1])
    most = max((abs(v) for _, v in rows), default=0) or 1
    body = []
    for i, (name, value) in enumerate(rows):
        y, w = TOP + 22 * i, (WIDTH - LEFT - 90) * max(value, 0) / most
        body += [f'<text x="{LEFT - 8}" y="{y + 13}" text-anchor="end">{escape(str(name))}</text>', f'<rect x="{LEFT}" y="{y}" width="{w:.1f}" height="17" fill="#4472a8"/>', f'<text x="{LEFT + w + 6:.1f}" y="{y + 13}">{value:.6g}</text>']
    bottom = TOP + 22 * len(rows)
    _write(path, bottom + 40, title, [*body, f'<text x="{(WIDTH + LEFT) / 2}" y="{bottom + 22}" text-anchor="middle">{escape(label)}</text>'])


def panels(times: list[str], panels_: list[tuple[str, dict[str, list[float | None]]]], title: str, path: str) -> None:
    """Panels below each other over the same times; each has named series, whose gaps are null."""
    height, body, colours = 180, [], ["#4472a8", "#c0504d", "#6a9a3a"]
    x = lambda i: LEFT + (WIDTH - LEFT - 40) * (i / max(1, len(times) - 1))
    for n, (label, series) in enumerate(panels_):
        top = TOP + n * (height + 20)
        known = [v for vs in series.values() for v in vs if v is not None]
        low, high = min(known, default=0.0), max(known, default=1.0)
        y = lambda v: top + height - 10 - (height - 30) * ((v - low) / ((high - low) or 1))  # noqa: B023, E731
        body += [f'<rect x="{LEFT}" y="{top}" width="{WIDTH - LEFT - 40}" height="{height}" fill="none" stroke="#999"/>', f'<text x="{LEFT - 60}" y="{top + height / 2}" text-anchor="end">{escape(label)}</text>', f'<text x="{LEFT - 6}" y="{top + 20}" text-anchor="end">{high:.4g}</text>', f'<text x="{LEFT - 6}" y="{top + height - 6}" text-anchor="end">{low:.4g}</text>']
        for k, (name, values) in enumerate(series.items()):
            run: list[str] = []
            for i, v in enumerate([*values, None]):
                if v is not None:
                    run.append(f"{x(i):.1f},{y(v):.1f}")
                    body.append(f'<circle cx="{x(i):.1f}" cy="{y(v):.1f}" r="3" fill="{colours[k % 3]}"/>')
                elif run:
                    body.append(f'<polyline points="{" ".join(run)}" fill="none" stroke="{colours[k % 3]}"/>')
                    run = []
            body.append(f'<text x="{LEFT + 8}" y="{top + 14 + 14 * k}" fill="{colours[k % 3]}">{escape(name)}</text>')
    bottom = TOP + len(panels_) * (height + 20)
    for i in range(0, len(times), max(1, len(times) // 12)):
        body.append(f'<text x="{x(i):.1f}" y="{bottom + 4}" text-anchor="middle">{escape(times[i])}</text>')
    _write(path, bottom + 30, title, body)


def histogram(counts: dict[int, int], bins: int, title: str, label: str, path: str) -> None:
    """Counts by bin over [0, 1]."""
    most, height, wide = max(counts.values(), default=0) or 1, 360, (WIDTH - 120) / bins
    body = []
    for b in range(bins):
        h = height * counts.get(b, 0) / most
        body.append(f'<rect x="{80 + b * wide:.1f}" y="{TOP + height - h:.1f}" width="{wide:.1f}" height="{h:.1f}" fill="#4472a8" stroke="black"/>')
    body += [f'<text x="{80 + (WIDTH - 120) * t:.0f}" y="{TOP + height + 18}" text-anchor="middle">{t:g}</text>' for t in (0, 0.25, 0.5, 0.75, 1)]
    _write(path, TOP + height + 50, title, [*body, f'<text x="74" y="{TOP + 12}" text-anchor="end">{most}</text>', f'<text x="{WIDTH / 2}" y="{TOP + height + 38}" text-anchor="middle">{escape(label)}</text>'])
