"""SQL that fits ridge logistic models and calibrations by written-out Newton steps.

Each generator returns the CTEs of one fit, named with a prefix; the last one has one row: b0 (intercept), b1, ...
on standardized features, or slope and shift of a calibration.
"""

from __future__ import annotations

from collections.abc import Sequence

STEPS = 6


def logistic_ctes(prefix: str, source: str, features: Sequence[str], l2: float | Sequence[float] = 0.004, label: str = "label", steps: int = STEPS) -> list[str]:
    """Several penalties are fitted side by side; every model row carries its ``l2``."""
    k = len(features)
    span = range(k + 1)
    penalties = ", ".join(str(float(v)) for v in (l2 if isinstance(l2, (list, tuple)) else [l2]))
    out = [
        f"{prefix}_st AS MATERIALIZED (SELECT {', '.join(f'avg({f}) AS c{i}, CASE WHEN stddev_pop({f}) >= 1e-6 THEN stddev_pop({f}) ELSE 1.0 END AS s{i}' for i, f in enumerate(features, 1))} FROM {source})",
        f"{prefix}_x AS MATERIALIZED (SELECT 1.0 AS x0, {', '.join(f'({f} - c{i}) / s{i} AS x{i}' for i, f in enumerate(features, 1))}, CAST({label} AS DOUBLE) AS y FROM {source}, {prefix}_st)",
        f"{prefix}_b0 AS MATERIALIZED (SELECT unnest([{penalties}])::DOUBLE AS l2, {', '.join(f'0.0::DOUBLE AS b{i}' for i in span)})",
    ]
    score = " + ".join(f"b{i} * x{i}" for i in span)
    keep = ", ".join(f"b{i}" for i in span)
    for t in range(steps):
        out.append(f"{prefix}_p{t} AS (SELECT x.*, l2, {keep}, 1 / (1 + exp(-({score}))) AS p FROM {prefix}_x x, {prefix}_b{t})")
        ridge = lambda i: f" + l2 * any_value(b{i})" if i else ""
        sums = [f"avg((p - y) * x{i}){ridge(i)} AS a{i}_{k + 1}" for i in span]
        sums += [f"avg(p * (1 - p) * x{i} * x{j}){' + l2' if i == j and i else ''} AS a{i}_{j}" for i in span for j in span]
        out.append(f"{prefix}_e{t}_0 AS MATERIALIZED (SELECT l2, {', '.join(sums)}, {', '.join(f'any_value(b{i}) AS b{i}' for i in span)} FROM {prefix}_p{t} GROUP BY l2)")
        for d in span:
            row = [f"a{d}_{j} / a{d}_{d} AS a{d}_{j}" for j in range(k + 2)]
            rest = [f"a{i}_{j} - a{i}_{d} * a{d}_{j} / a{d}_{d} AS a{i}_{j}" for i in span if i != d for j in range(k + 2)]
            out.append(f"{prefix}_e{t}_{d + 1} AS MATERIALIZED (SELECT l2, {', '.join(row + rest)}, {keep} FROM {prefix}_e{t}_{d})")
        out.append(f"{prefix}_b{t + 1} AS MATERIALIZED (SELECT l2, {', '.join(f'b{i} - a{i}_{k + 1} AS b{i}' for i in span)} FROM {prefix}_e{t}_{k + 1})")
    return out


def logit_sql(prefix: str, features: Sequence[str], steps: int = STEPS) -> str:
    """Score of the fitted model; the query must read ``model_from``."""
    st, b = f"{prefix}_st", f"{prefix}_b{steps}"
    return f"({b}.b0 + " + " + ".join(f"{b}.b{i} * (({f} - {st}.c{i}) / {st}.s{i})" for i, f in enumerate(features, 1)) + ")"


def model_from(prefix: str, steps: int = STEPS) -> str:
    return f"{prefix}_st, {prefix}_b{steps}"


HALVINGS = [0.0] + [2.0**-i for i in range(14)]


def calibration_ctes(prefix: str, source: str, raw: str, pull: float = 0.002, label: str = "label", group: str = "0.0", steps: int = STEPS, damped: bool = False) -> list[str]:
    """l2, slope, shift of the last CTE ``<prefix>_c``, one row per value of ``group``; the slope is pulled towards one.

    With ``damped`` a step is halved until the loss does not rise: the losses at all halvings come from one aggregate, the
    largest good one is taken. Fits of several folds go without, as their text would be too deep for one statement.
    """
    out = [
        f"{prefix}_z AS MATERIALIZED (SELECT l2, z, y, CAST(count(*) AS DOUBLE) AS k FROM (SELECT {group} AS l2, {raw} AS z, CAST({label} AS DOUBLE) AS y FROM {source}) GROUP BY ALL)",
        f"{prefix}_k0 AS MATERIALIZED (SELECT DISTINCT l2, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {prefix}_z)",
    ]
    mean = lambda x: f"sum(k * {x}) / sum(k)"
    loss = "(greatest(u, 0) + ln(1 + exp(-abs(u))) - u * y)"
    for t in range(steps):
        out.append(f"{prefix}_q{t} AS (SELECT l2, z, y, k, a, b, 1 / (1 + exp(-(a * z + b))) AS p FROM {prefix}_z JOIN {prefix}_k{t} USING (l2))")
        out.append(
            f"{prefix}_s{t} AS MATERIALIZED (SELECT l2, any_value(a) AS a, any_value(b) AS b, {mean('(p - y) * z')} + {pull} * (any_value(a) - 1) AS ga, {mean('(p - y)')} AS gb, "
            f"{mean('p * (1 - p) * z * z')} + {pull} AS haa, {mean('p * (1 - p) * z')} AS hab, {mean('p * (1 - p)')} + 1e-12 AS hbb FROM {prefix}_q{t} GROUP BY l2)"
        )
        out.append(f"{prefix}_d{t} AS {'MATERIALIZED ' * damped}(SELECT l2, a, b, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS db FROM {prefix}_s{t})")
        if not damped:
            out.append(f"{prefix}_k{t + 1} AS MATERIALIZED (SELECT l2, a - da AS a, b - db AS b FROM {prefix}_d{t})")
            continue
        out.append(
            f"{prefix}_h{t} AS MATERIALIZED (SELECT l2, h, {mean(loss)} + 0.5 * {pull} * pow(any_value(a - h * da) - 1, 2) AS o FROM "
            f"(SELECT *, (a - h * da) * z + (b - h * db) AS u FROM {prefix}_z JOIN {prefix}_d{t} USING (l2), (SELECT unnest({HALVINGS})::DOUBLE AS h)) GROUP BY l2, h)"
        )
        out.append(
            f"{prefix}_k{t + 1} AS MATERIALIZED (SELECT l2, a - h * da AS a, b - h * db AS b FROM {prefix}_d{t} JOIN (SELECT x.l2, coalesce(max(x.h) FILTER (x.o <= y.o + 1e-15), {HALVINGS[-1]}) AS h "
            f"FROM {prefix}_h{t} x JOIN {prefix}_h{t} y ON x.l2 = y.l2 AND y.h = 0 WHERE x.h > 0 GROUP BY x.l2) USING (l2))"
        )
    out.append(f"{prefix}_c AS MATERIALIZED (SELECT l2, round(a, 6) AS slope, round(b, 6) AS shift FROM {prefix}_k{steps})")
    return out


def fold_ctes(prefix: str, features: Sequence[str], fold: int, rows: str = "rows_in", l2: float | Sequence[float] = 0.004, steps: int = STEPS) -> list[str]:
    """Rows of the test year with l2 and probability, as ``<prefix>_out``: fit before, calibrate on the year before."""
    out = [f"{prefix}_tr AS MATERIALIZED (SELECT * FROM {rows} WHERE yr < {fold - 1})", *logistic_ctes(prefix, f"{prefix}_tr", features, l2, steps=steps)]
    raw, b = logit_sql(prefix, features, steps), f"{prefix}_b{steps}"
    out.append(f"{prefix}_cal AS MATERIALIZED (SELECT r.label, {b}.l2 AS l2, {raw} AS raw FROM {rows} r, {model_from(prefix, steps)} WHERE yr = {fold - 1})")
    out += calibration_ctes(prefix, f"{prefix}_cal", "raw", group="l2", steps=steps)
    out.append(
        f"{prefix}_out AS MATERIALIZED (SELECT yr, label, {b}.l2 AS l2, 1 / (1 + exp(-(slope * {raw} + shift))) AS probability, {fold} AS fold "
        f"FROM {rows} r, {model_from(prefix, steps)} JOIN {prefix}_c ON {prefix}_c.l2 = {b}.l2 WHERE yr = {fold})"
    )
    return out
