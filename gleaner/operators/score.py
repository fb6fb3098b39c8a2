"""Additive scores with ordered caps, levels, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.operators.gates import truth

Step = tuple[str, str, Column, int]


def capped(start: int, steps: list[Step], low: int = 0, high: int = 100) -> Column:
    """Fold of steps ``(name, "add" or "cap", condition, points)`` in their order; a cap holds down what has been added before it. Clamped at the end."""
    score = F.lit(start)
    for _, kind, condition, points in steps:
        score = F.when(truth(condition), score + points if kind == "add" else F.least(score, F.lit(points))).otherwise(score)
    return F.greatest(F.lit(low), F.least(F.lit(high), score)).cast("int")


def reasons(steps: list[Step]) -> Column:
    return F.array_compact(F.array(*[F.when(truth(c), F.concat(F.lit(f"{name}:{'+' if kind == 'add' and points > 0 else '≤' if kind == 'cap' else ''}"), F.lit(str(points)))) for name, kind, c, points in steps]))


def flags(named: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(truth(c), F.lit(n)) for n, c in named]))


def level(score: Column, bounds: list[tuple[int, str]], otherwise: str) -> Column:
    out = F
    for least, name in bounds:
        out = out.when(score >= least, F.lit(name))
    return out.otherwise(otherwise)


def bonus(score: Column, rate: float, most: int) -> Column:
    return F.least(F.lit(most), F.round(score * rate)).cast("int")


def points(ladders: dict[str, list[tuple[Column, int]]]) -> Column:
    """``struct`` of each ladder's points, those of its first condition that holds, and their ``total``."""

    def of(rungs: list[tuple[Column, int]]) -> Column:
        return F.coalesce(*[F.when(truth(c), F.lit(p)) for c, p in rungs], F.lit(0))

    each = {name: of(rungs) for name, rungs in ladders.items()}
    return F.struct(*[c.alias(n) for n, c in each.items()], sum(each.values(), F.lit(0)).alias("total"))
