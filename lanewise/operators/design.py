"""Linear-model design as column expressions: expand, impute, scale, reference-code."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cyclic as cyclic_terms
from ..functions.scalars import log1p_checked
from .ordering import narrowed_quantiles

# Calendar periods, and the rare route level folded into its neighbour.
CYCLIC_PERIODS = {"order_approved_month": 12, "order_approved_day_of_week": 7}
ROUTE_MERGES = {"3. Mixed": "1. All interstate"}


def expanded_terms(num_cols: Sequence[str], log_cols: Sequence[str] = (), cyclic: bool = False) -> dict[str, tuple[str, Column]]:
    """term -> (raw feature, expression) for the numeric part of the design."""
    out = {}
    for c in num_cols:
        if cyclic and c in CYCLIC_PERIODS:
            s, k = cyclic_terms(c, CYCLIC_PERIODS[c])
            out[f"{c}_sin"], out[f"{c}_cos"] = (c, s), (c, k)
        elif c in log_cols:
            out[f"log_{c}"] = (c, log1p_checked(c))
        else:
            out[c] = (c, F.col(c).cast("double"))
    return out


def expand(df: DataFrame, num_cols: Sequence[str], log_cols: Sequence[str] = (), cyclic: bool = False,
           merge_mixed_route: bool = False) -> DataFrame:
    out = df.withColumns({t: e for t, (_, e) in expanded_terms(num_cols, log_cols, cyclic).items()})
    return out.replace(ROUTE_MERGES, subset=["route_type"]) if merge_mixed_route else out


@dataclass
class Design:
    """Fitted design: everything needed to encode any rows, all of it small."""
    num_cols: list[str]
    cat_cols: list[str]
    options: dict
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    references: dict[str, str] = field(default_factory=dict)
    scale: bool = True

    @property
    def terms(self) -> dict[str, tuple[str, Column]]:
        o = self.options
        return expanded_terms(self.num_cols, o.get("log_cols", ()), o.get("cyclic", False))

    def units_without_levels(self) -> dict[str, list[str]]:
        """raw numeric feature -> its terms."""
        out: dict[str, list[str]] = {}
        for term, (raw, _) in self.terms.items():
            out.setdefault(raw, []).append(term)
        return out

    @property
    def units(self) -> dict[str, list[str]]:
        """raw feature -> its encoded columns."""
        out = self.units_without_levels()
        for c in self.cat_cols:
            out[c] = [f"{c}_{v}" for v in self.levels[c] if v != self.references[c]]
        return out

    @property
    def columns(self) -> list[str]:
        return [t for ts in self.units.values() for t in ts]

    def encode(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Encoded columns plus ``keep``; unknown levels are all zero."""
        out = [F.col(c) for c in keep]
        for t, (_, e) in self.terms.items():
            x = F.coalesce(e, F.lit(self.medians[t]))
            if self.scale:
                sd = self.scales[t]
                x = (x - self.means[t]) / (sd if sd > 0 else 1.0)
            out.append(x.alias(t))
        merged = self.options.get("merge_mixed_route")
        for c in self.cat_cols:
            v = F.col(c)
            if merged and c == "route_type":
                for a, b in ROUTE_MERGES.items():
                    v = F.when(v == a, F.lit(b)).otherwise(v)
            out += [F.coalesce((v == level).cast("double"), F.lit(0.0)).alias(f"{c}_{level}")
                    for level in self.levels[c] if level != self.references[c]]
        return df.select(*out)


def category_counts(df: DataFrame, cat_cols: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """Levels with counts per categorical; the level lists are what a model must hold."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cat_cols)
    rows = df.selectExpr(f"stack({len(cat_cols)}, {pairs}) AS (f, v)").where("v IS NOT NULL").groupBy("f", "v").count().collect()
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in cat_cols}
    for f, v, n in rows:
        out[f].append((v, n))
    return {c: sorted(v) for c, v in out.items()}


def fit_design(df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], references: dict[str, str] | None = None,
               scale: bool = True, **options) -> Design:
    """Training medians, population moments after imputation, and category levels.

    A categorical without a named reference uses its most frequent level.
    """
    d = Design(list(num_cols), list(cat_cols), options, scale=scale)
    terms = d.terms
    flat = df.select(*[e.alias(t) for t, (_, e) in terms.items()])
    d.medians = {c: v["mid"] for c, v in narrowed_quantiles(flat, list(terms), {"mid": 0.5}).get(0, {}).items()} if terms else {}
    for t in terms:
        d.medians.setdefault(t, 0.0)
    if scale:
        filled = [F.coalesce(F.col(t), F.lit(d.medians[t])) for t in terms]
        row = flat.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)],
                       *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)]).first()
        d.means = {t: row[f"m{i}"] for i, t in enumerate(terms)}
        d.scales = {t: row[f"s{i}"] for i, t in enumerate(terms)}
    if cat_cols:
        source = df.replace(ROUTE_MERGES, subset=["route_type"]) if options.get("merge_mixed_route") and "route_type" in cat_cols else df
        for c, counts in category_counts(source, cat_cols).items():
            d.levels[c] = [v for v, _ in counts]
            named = (references or {}).get(c)
            d.references[c] = named if named in d.levels[c] else min(counts, key=lambda x: (-x[1], x[0]))[0]
    return d
