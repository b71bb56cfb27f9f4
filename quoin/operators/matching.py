"""One-to-one assignment and consistent tracks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Optimal assignment of rows to columns by shortest augmenting paths; the smaller side is all assigned."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in least_cost(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, dtype=int)  # 1-based; 0 is free
    for i in range(1, n + 1):
        row_of[0] = i
        col, reach, came, seen = 0, np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            seen[col] = True
            r = row_of[col]
            slack = cost[r - 1] - u[r] - v[1:]
            better = ~seen[1:] & (slack < reach[1:])
            reach[1:][better], came[1:][better] = slack[better], col
            nxt = int(np.argmin(np.where(seen[1:], np.inf, reach[1:]))) + 1
            step = reach[nxt]
            u[row_of[seen]] += step
            v[seen] -= step
            reach[~seen] -= step
            col = nxt
            if not row_of[col]:
                break
        while col:
            row_of[col] = row_of[came[col]]
            col = came[col]
    return sorted((int(row_of[c]) - 1, c - 1) for c in range(1, m + 1) if row_of[c])


def assign(pairs: DataFrame, by: list[str], left: str, right: str, cost: str, largest: bool = False) -> DataFrame:
    """The one-to-one pairs of least (or largest) total cost in each key; pairs not given can't be
    matched. A kernel for each key: keys are plans or scenes, whose sides are small."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, left, right)) + f", `{cost}` double"

    def solve(pdf):
        pdf = pdf.dropna(subset=[left, right, cost])
        a, b = sorted(pdf[left].unique()), sorted(pdf[right].unique())
        if not a or not b:
            return pdf[[*by, left, right, cost]].astype({cost: float})
        far = float(np.abs(pdf[cost]).sum()) * 2 + 1
        grid = np.full((len(a), len(b)), far)
        at_a, at_b = {x: i for i, x in enumerate(a)}, {x: i for i, x in enumerate(b)}
        for x, y, c in zip(pdf[left], pdf[right], pdf[cost], strict=True):
            grid[at_a[x], at_b[y]] = -c if largest else c
        chosen = {(a[i], b[j]) for i, j in least_cost(grid) if grid[i, j] < far}
        keep = [(x, y) in chosen for x, y in zip(pdf[left], pdf[right], strict=True)]
        return pdf[keep].drop_duplicates([left, right])[[*by, left, right, cost]].astype({cost: float})

    return pairs.select(*by, left, right, cost).groupBy(*by).applyInPandas(solve, schema)


def valid_tracks(observations: DataFrame, track: str, image: str) -> DataFrame:
    """Tracks of two observations or more, none twice in one image."""
    seen = observations.groupBy(track).agg(F.count_distinct(image).alias("n_img"), F.count("*").alias("n"))
    return seen.where("n >= 2 and n_img = n")
