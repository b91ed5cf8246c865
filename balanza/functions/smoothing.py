"""Exponential smoothing with a damped additive trend, and with an additive season, as column expressions.

A series is an array of doubles. One-step predictions are linear in the starting level, trend and season, so for
given weights the starts are a least-squares problem: folds over the array give the response of the predictions to each
start, their products give the normal equations, and an elimination solves them. A season start that is used j months
later has the same response, j months later, so one fold serves the whole season. The season's last start is 0: a
shift of all season values against the level changes no prediction.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, functions as F

from balanza.functions.plan import let

#: Halvings of the grid's width after the first, coarse pass.
ROUNDS = 5


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def weight_names(season: int) -> tuple[str, ...]:
    return ("level", "trend", "season") if season else ("level", "trend")


def _walk(y: Column, w: Column, phi: float, season: int, level: Column, trend: Column, year: Column | None) -> Column:
    """Predictions ``out`` for the months of ``y``, and the state after them, from a starting state."""
    a, b = F.get(w, 0), F.get(w, 1)
    start = {"level": level, "trend": trend, "out": F.array().cast("array<double>")}
    if season:
        start["year"] = year

    def step(s: Column, x: Column) -> Column:
        ahead = s["level"] + s["trend"] * phi
        now = F.get(s["year"], 0) if season else F.lit(0.0)
        new = a * (x - now) + (1 - a) * ahead
        state = {
            "level": new, "trend": b * (new - s["level"]) + (1 - b) * (s["trend"] * phi),
            "out": F.concat(s["out"], F.array(ahead + now)),
        }
        if season:
            c = F.get(w, 2)
            state["year"] = F.concat(F.slice(s["year"], 2, season - 1), F.array(c * (x - ahead) + (1 - c) * now))
        return F.struct(*[v.alias(k) for k, v in state.items()])

    return F.aggregate(y, F.struct(*[v.alias(k) for k, v in start.items()]), step)


def _starts(y: Column, w: Column, phi: float, season: int) -> Column:
    """Least-squares starts for given weights: struct (sse, start): level, trend, then the season without its last."""
    none = F.array_repeat(F.lit(0.0), season) if season else None
    zeros = F.transform(y, lambda _: F.lit(0.0))
    flat, nil, one = F.lit(0.0), F.lit(0.0), F.lit(1.0)
    parts = [
        _walk(zeros, w, phi, season, one, nil, none)["out"].alias("level"), _walk(zeros, w, phi, season, flat, one, none)["out"].alias("trend"),
        _walk(y, w, phi, season, flat, nil, none)["out"].alias("data"),
    ]
    if season:
        pulse = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), season - 1))
        parts.append(_walk(zeros, w, phi, season, flat, nil, pulse)["out"].alias("pulse"))

    def columns(r: Column) -> Column:
        own = F.array(r["level"], r["trend"])
        if not season:
            return own
        later = F.transform(F.sequence(F.lit(0), F.lit(season - 2)), lambda j: F.slice(F.concat(F.array_repeat(F.lit(0.0), j), r["pulse"]), 1, F.size(y)))
        return F.concat(own, later)

    def solved(s: Column) -> Column:
        rows = F.transform(s["x"], lambda u: F.concat(F.transform(s["x"], lambda v: dot(u, v)), F.array(dot(u, s["z"]))))
        k = 1 + season if season else 2

        def cleared(m: Column, i: Column) -> Column:
            """Column i of all other rows to 0; a start that the others determine stays at 0."""
            pivot = F.get(m, i)
            inverse = F.when(F.get(pivot, i) > 1e-10, F.lit(1.0) / F.get(pivot, i)).otherwise(0.0)
            return let(F.struct(pivot.alias("p"), inverse.alias("q")), lambda o: F.transform(
                m, lambda row, j: F.when(j == i, row).otherwise(let(F.get(row, i) * o["q"], lambda f: F.zip_with(row, o["p"], lambda x, y: x - f * y)))
            ))

        return let(rows, lambda g: let(F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), g, cleared), lambda m: let(
            F.transform(m, lambda row, i: F.when(F.get(row, i) > 1e-10, F.get(row, k) / F.get(row, i)).otherwise(0.0)),
            lambda start: F.struct(
                F.greatest(F.lit(0.0), dot(s["z"], s["z"]) - dot(start, F.transform(g, lambda row: F.get(row, k)))).alias("sse"), start.alias("start")
            ),
        )))

    return let(F.struct(*parts), lambda r: let(
        F.struct(columns(r).alias("x"), F.zip_with(y, r["data"], lambda u, v: u - v).alias("z")), solved
    ))


def best_weights(y: Column, phi: float, season: int) -> Column:
    """Weights of least squared error: a grid over the unit cube, then grids of half the width around the best point.

    Of equal points the one with smaller weights counts.
    """
    dims = len(weight_names(season))

    def lattice(steps) -> Column:
        return F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in product(steps, repeat=dims)])

    def at(centre: Column, width, offsets: Column) -> Column:
        points = F.transform(offsets, lambda o: F.zip_with(centre, o, lambda m, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), m + d * width))))
        return F.transform(points, lambda p: F.struct(_starts(y, p, phi, season)["sse"].alias("sse"), p.alias("w")))

    middle = F.array(*[F.lit(0.5)] * dims)
    coarse = let(F.array_min(at(middle, 0.5, lattice((-1, -0.5, 0, 0.5, 1)))), lambda best: F.struct(best["sse"].alias("sse"), best["w"].alias("w"), F.lit(0.125).alias("width")))
    around = lattice((-1, 0, 1))

    def narrowed(s: Column, _: Column) -> Column:
        return let(F.array_min(at(s["w"], s["width"], around)), lambda best: F.struct(best["sse"].alias("sse"), best["w"].alias("w"), (s["width"] / 2).alias("width")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), coarse, narrowed)["w"]


def smoothed_forecast(y: Column, w: Column, phi: float, season: int, horizon: int) -> Column:
    """struct (predicted, std): the next ``horizon`` months for given weights, and the deviation of the one-step errors."""
    def ahead(start: Column) -> Column:
        year = F.concat(F.slice(start, 3, season - 1), F.array(F.lit(0.0))) if season else None
        return _walk(y, w, phi, season, F.get(start, 0), F.get(start, 1), year)

    def told(s: Column) -> Column:
        damp = [sum(phi**k for k in range(1, h + 1)) for h in range(1, horizon + 1)]
        steps = [s["level"] + s["trend"] * d + (F.get(s["year"], i % season) if season else F.lit(0.0)) for i, d in enumerate(damp)]
        errors = F.zip_with(y, s["out"], lambda u, v: u - v)
        spread = let(errors, lambda e: let(dot(e, F.transform(e, lambda _: F.lit(1.0))) / F.size(e), lambda m: F.sqrt(
            F.aggregate(e, F.lit(0.0), lambda t, x: t + (x - m) * (x - m)) / F.size(e)
        )))
        return F.struct(F.array(*steps).alias("predicted"), spread.alias("std"))

    return let(_starts(y, w, phi, season)["start"], lambda start: let(ahead(start), told))
