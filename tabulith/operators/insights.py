"""Rules that turn aggregates into findings.

Every number comes from a Spark aggregate whose result is bounded by the number of columns, or by
20 categories per column; the rules read those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.functions.columns import number
from tabulith.functions.kinds import numeric_columns, text_columns
from tabulith.operators.aggregation import kpis, mode_summary, pair_correlations, simple_agg, value_frequencies
from tabulith.operators.moments import moments, with_quantiles
from tabulith.operators.profiling import missing_correlation, null_counts
from tabulith.operators.windows import head_tail_change

SCHEMA = "position int, category string, subject string, severity string, value double, insight string"

_MAX_GROUPS = 20


class _Findings(list):
    def note(self, category: str, subject: str, severity: str, value: float, text: str) -> None:
        self.append((len(self) + 1, category, subject, severity, float(value), text))

    def warnings(self) -> int:
        return sum(f[3] in ("warning", "critical") for f in self)


def _quality(out: _Findings, completeness: float, duplicates: int) -> None:
    if completeness >= 98:
        out.note("Data Quality", "completeness", "positive", completeness, f"Excellent: {completeness}% complete")
    elif completeness >= 90:
        out.note("Data Quality", "completeness", "info", completeness, f"Good: {completeness}% complete")
    else:
        out.note("Data Quality", "completeness", "warning", completeness, f"Concern: {completeness}% complete")
    if duplicates > 0:
        out.note("Data Quality", "duplicates", "info", duplicates, f"{duplicates} duplicate row(s) removed")


@dataclass
class _Measures:
    """What several rules need, gathered once: row count, missing cells, moments of numbers and modes of texts."""
    rows: int
    missing: dict[str, int]
    stats: dict
    modes: dict


def _measures(df: DataFrame, numbers: Sequence[str], texts: Sequence[str]) -> _Measures:
    """One pass over the numbers and one over the texts; cells of other columns are counted with the rows only if there are any."""
    stats = {r["column"]: r for r in moments(df, numbers).collect()} if numbers else {}
    modes = {r["column"]: r for r in mode_summary(value_frequencies(df, texts)).collect()} if texts else {}
    others = df.select(*[c for c in df.columns if c not in stats and c not in texts])
    if stats and not others.columns:
        one = next(iter(stats.values()))
        rows, missing = one["n"] + one["nulls"], {}
    else:
        found = null_counts(others).collect() if others.columns else []
        rows = found[0]["rows"] if found else df.count()
        missing = {r["column"]: r["missing"] for r in found}
    missing |= {c: r["nulls"] for c, r in stats.items()}
    missing |= {c: rows - (modes[c]["rows"] if c in modes else 0) for c in texts}
    return _Measures(rows, missing, stats, modes)


def _numeric_rules(out: _Findings, df: DataFrame, columns: Sequence[str], order_by: Sequence[str], stats: dict) -> None:
    """The rules of each numeric column."""
    quart = {r["column"]: r for r in with_quantiles(df, columns, (0.25, 0.75), ("q1", "q3")).collect()}
    change = {r["column"]: r["change_pct"] for r in head_tail_change(df, order_by, columns).collect()}
    far = []
    for c in columns:
        if c in quart:
            q1, q3 = quart[c]["q1"], quart[c]["q3"]
            x, reach = number(c), 3 * (q3 - q1)
            far.append(F.count_if((x < q1 - reach) | (x > q3 + reach)).alias(c))
    extremes = df.agg(*far).first().asDict() if far else {}
    for c in columns:
        s = stats.get(c)
        if s is None or s["n"] < 3:
            continue
        cv = s["std"] / abs(s["mean"]) * 100 if abs(s["mean"]) > 1e-10 else 0.0
        if cv > 80:
            out.note("Variability", c, "warning", cv, f"{c} varies widely (CV {cv:.1f}%)")
        elif cv < 15 and s["n"] > 10:
            out.note("Stability", c, "positive", cv, f"{c} is stable (CV {cv:.1f}%)")
        skew = s["skew"]
        if abs(skew) > 1.5:
            out.note("Distribution", c, "info", skew,
                     f"{c} is skewed to the {'right' if skew > 0 else 'left'} ({skew:.2f}); prefer the median")
        moved = change.get(c)
        if moved is not None and moved > 15:
            out.note("Trend", c, "positive", moved, f"{c} rises by {moved:.1f}% from start to end")
        elif moved is not None and moved < -15:
            out.note("Trend", c, "warning", moved, f"{c} falls by {-moved:.1f}% from start to end")
        if extremes.get(c, 0) > 0:
            out.note("Extreme Values", c, "warning", extremes[c],
                     f"{c} has {extremes[c]} value(s) beyond 3 interquartile ranges")


def _category_rules(out: _Findings, modes: dict, columns: Sequence[str], rows: int) -> None:
    for c in columns:
        m = modes.get(c)
        distinct = m["unique_values"] if m else 0
        if distinct <= 1:
            out.note("Low Variance", c, "info", distinct, f"{c} has {distinct} distinct value(s)")
        elif distinct <= _MAX_GROUPS:
            top, low = m["most_common_count"] / rows * 100, m["least_common_count"] / rows * 100
            if top > 50:
                out.note("Dominance", c, "info", top, f"'{m['most_common']}' makes up {top:.1f}% of {c}")
            if top > 10 * low and distinct > 2:
                out.note("Imbalance", c, "warning", top,
                         f"{c}: '{m['most_common']}' {top:.0f}% against '{m['least_common']}' {low:.0f}%")


def _group_rules(out: _Findings, df: DataFrame, groups: dict[str, int], values: Sequence[str], stats: dict) -> None:
    """Pareto pattern and group effect over the categories and numbers."""
    if not groups or not values:
        return
    cells = [F.struct(F.lit(g).alias("_g"), F.col(g).alias("_k")) for g in groups]
    aggs = [a for i, v in enumerate(values)
            for a in (simple_agg("sum", v).alias(f"s{i}"), simple_agg("mean", v).alias(f"m{i}"))]
    # only categories with at most 20 values come here
    found = (df.select(F.explode(F.array(*cells)).alias("_c"), *values).select("_c.*", *values)
             .where("_k IS NOT NULL").groupBy("_g", "_k").agg(*aggs).collect())
    for g, distinct in groups.items():
        rows = [r for r in found if r["_g"] == g]
        for i, v in enumerate(values):
            sums = sorted((r[f"s{i}"] for r in rows), reverse=True)
            whole = sum(sums)
            if 3 <= distinct <= 20 and whole != 0:
                running, needed = 0.0, 1
                for s in sums:
                    running += s
                    needed += running / whole < 0.8
                if needed <= 0.4 * distinct:
                    out.note("Pareto Pattern", f"{g} & {v}", "info", needed,
                             f"{needed} of {distinct} values of {g} bring about 80% of {v}")
    for g, distinct in groups.items():
        rows = [r for r in found if r["_g"] == g]
        for i, v in enumerate(values):
            overall = stats[v]["mean"]
            means = [(r[f"m{i}"], r["_k"]) for r in rows if r[f"m{i}"] is not None]
            if 2 <= distinct <= 10 and means and overall is not None and abs(overall) > 1e-10:
                best = max(m for m, _ in means)
                who = min(k for m, k in means if m == best)
                off = (best - overall) / abs(overall) * 100
                if abs(off) > 30:
                    out.note("Group Analysis", f"{g} & {v}", "positive" if off > 0 else "warning", off,
                             f"{v} is {off:+.0f}% against the average where {g} is '{who}'")


def insights(df: DataFrame, order_by: Sequence[str], completeness: float | None = None, duplicates: int = 0,
             numbers: Sequence[str] | None = None, texts: Sequence[str] | None = None,
             group_by: Sequence[str] | None = None, group_values: Sequence[str] | None = None) -> DataFrame:
    """All findings in order: position, category, subject, severity, value, insight.

    The rules look at all numeric and text columns, or at the named ones; the group rules at all pairs of
    ``group_by`` and ``group_values``, by default all of them too.
    """
    out = _Findings()
    if completeness is not None:
        _quality(out, completeness, duplicates)
    numbers, texts = list(numbers or numeric_columns(df)), list(texts or text_columns(df))
    measures = _measures(df, numbers, texts)
    rows, stats, modes = measures.rows, measures.stats, measures.modes
    if numbers:
        _numeric_rules(out, df, numbers, order_by, stats)
    _category_rules(out, modes, texts, max(rows, 1))

    if len(numbers) >= 2:
        pairs = list(combinations(numbers, 2))
        strong = {(r["col1"], r["col2"]): r["r"] for r in
                  pair_correlations(df, pairs, {c: stats[c]["mean"] if c in stats else None for c in numbers}).where(F.abs("r") > 0.8).collect()}
        for a, b in [p for p in pairs if p in strong]:
            r = strong[a, b]
            out.note("Correlation", f"{a} & {b}", "info", r,
                     f"{a} and {b} correlate {'positively' if r > 0 else 'negatively'} ({r:.2f})")

    groups = {c: modes[c]["unique_values"] for c in group_by or texts
              if c in modes and 2 <= modes[c]["unique_values"] <= _MAX_GROUPS}
    _group_rules(out, df, groups, [v for v in group_values or numbers if v in stats], stats)

    if rows < 30:
        out.note("Sample Size", "rows", "warning", rows, f"Only {rows} rows")
    elif rows > 10_000:
        out.note("Dataset", "rows", "positive", rows, f"{rows:,} rows")
    if out.warnings() > 3:
        out.note("Recommendation", "warnings", "info", out.warnings(), f"{out.warnings()} areas need attention")

    holes = [c for c in df.columns if measures.missing[c] > 0]
    if len(holes) > 1:
        order = {c: i for i, c in enumerate(df.columns)}
        found = sorted(((r["col1"], r["col2"]) for r in missing_correlation(
            df.select(*holes), shares={c: measures.missing[c] / rows for c in holes}).collect()),
                       key=lambda p: (order[p[0]], order[p[1]]))
        if found:
            shown = ", ".join(f"{a} & {b}" for a, b in found)
            out.note("Missing Data Pattern", shown, "info", len(found), f"Gaps fall on the same rows in {shown}")
    return df.sparkSession.createDataFrame(list(out), SCHEMA)


def insight_summary(df: DataFrame, order_by: Sequence[str], found: DataFrame) -> DataFrame:
    """The numbers of the summary in one row; ``primary`` is the first numeric column."""
    numbers = numeric_columns(df)
    severity = F.col("severity")
    counts = found.agg(F.count_if(severity == "positive").alias("positive"),
                       F.count_if(severity.isin("warning", "critical")).alias("warnings"),
                       F.count(F.lit(1)).alias("total_insights")).first()
    rows = df.count()
    first = kpis(df, order_by, numbers[:1]).first() if numbers else None
    growth = first["growth_pct"] if first else None
    flag = None if growth is None else "growth" if growth > 5 else "decline" if growth < -5 else "steady"
    balance = ("healthy" if counts["positive"] > counts["warnings"]
               else "attention" if counts["warnings"] > counts["positive"] else "balanced")
    row = (rows, len(df.columns), numbers[0] if first else None, first["total"] if first else None,
           first["average"] if first else None, first["median"] if first else None, growth, flag,
           len(text_columns(df)), counts["positive"], counts["warnings"], balance, counts["total_insights"])
    return df.sparkSession.createDataFrame([row], (
        "rows long, columns int, primary_metric string, total double, average double, median double, "
        "growth_pct double, growth_flag string, categorical_columns int, positive long, warnings long, "
        "balance string, total_insights long"))
