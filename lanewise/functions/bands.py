"""Discretisation with explicit edge rules."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import col

INF = float("inf")


def _banded(c: Column, edges, labels, inside) -> Column:
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        cond = inside(c, lo, hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def cut_right_closed(c, edges: Sequence[float], labels: Sequence, include_lowest: bool = False) -> Column:
    """Bands ``(lo, hi]``; values outside every band are missing."""
    c, first = col(c), edges[0]

    def inside(x, lo, hi):
        above = F.lit(True) if lo == -INF else (x >= lo if include_lowest and lo == first else x > lo)
        return above & (F.lit(True) if hi == INF else x <= hi) & x.isNotNull()

    return _banded(c, edges, labels, inside)


def cut_left_closed(c, edges: Sequence[float], labels: Sequence) -> Column:
    """Bands ``[lo, hi)``."""
    return _banded(col(c), edges, labels, lambda x, lo, hi: (x >= lo) & (x < hi))


def equal_width_bin(c, low, high, bins: int) -> Column:
    """0-based bin of ``[low, high]`` split into equal widths; the last bin is closed."""
    c = col(c)
    pos = F.floor((c - low) / ((high - low) / F.lit(float(bins)))).cast("int")
    return F.when((c >= low) & (c <= high), F.least(F.greatest(pos, F.lit(0)), F.lit(bins - 1)))


# Band edges and labels of the delivery reports.
REVIEW_EDGES, REVIEW_LABELS = [0, 2, 4, 5], ["Low (1-2)", "Mid (3-4)", "High (5)"]
LEAD_EDGES, LEAD_LABELS = [-INF, 14, 21, 28, INF], ["<= 14 days", "15-21 days", "22-28 days", "> 28 days"]
WINDOW_EDGES, WINDOW_LABELS = [-999, 11, 21, 31, 999], ["0–10 days", "11–20", "21–30", "31+"]
DISTANCE_EDGES = [0, 100, 300, 600, 1000, 2000, 99999]
DISTANCE_LABELS = ["< 100 km", "100–299", "300–599", "600–999", "1,000–1,999", "2,000+"]
EXPERIENCE_EDGES, EXPERIENCE_LABELS = [0, 1, 10, 50, 200, 1e9], ["New seller", "1–9", "10–49", "50–199", "200+"]
TRACK_EDGES, TRACK_LABELS = [0, 0.05, 0.10, 0.20, 1.01], ["< 5%", "5–10%", "10–20%", "20%+"]
