"""Accuracy of a model over benchmark families, and searches for better parameters."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.kernels import family
from sparkloom.operators import msa, score
from sparkloom.plans import align


def accuracy(aligned: DataFrame, gold: DataFrame, mode: str = "strict", most_gaps: float = 1.0) -> DataFrame:
    """(msa_id, q, tc) of aligned rows (set_id, seq_id, row) against gold rows (set_id, seq_id, row)."""
    cells = lambda df: msa.to_cells(df.select(F.col("set_id").alias("msa_id"), "seq_id", "row"))
    return score.quality(cells(aligned), cells(gold), mode, most_gaps)


def bench(seqs: DataFrame, gold: DataFrame, consistency: int = 2, refine: int = 0, mode: str = "strict") -> DataFrame:
    """(n_sets, q, tc): every family aligned in parallel and scored, then averaged."""
    return score.directory_average(accuracy(align.align_families(seqs, consistency, refine), gold, mode))


def grid(axes: dict[str, list[float]]) -> list[dict[str, float]]:
    """All combinations of the values of the axes."""
    return [dict(zip(axes, values, strict=True)) for values in product(*axes.values())]


def scored_grid(seqs: DataFrame, gold: DataFrame, points: list[dict[str, float]]) -> list[dict[str, float]]:
    """points with q and tc, in one Spark job: each family is aligned once for each point.

    A point has `consistency` and `refine` and, as `seed`, the start of random choices; what it lacks
    is 0.
    """
    spark = seqs.sparkSession
    names = ("consistency", "refine", "seed")
    table = spark.createDataFrame([(i, *(int(p.get(n, 0)) for n in names)) for i, p in enumerate(points)], "point int, consistency int, refine int, seed int")
    many = seqs.select("set_id", "seq_id", "letters").join(F.broadcast(table))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        own = pdf.iloc[0]
        rows = family.align(list(pdf["letters"]), int(own["consistency"]), int(own["refine"]), int(own["seed"]), "none")
        return pd.DataFrame({"set_id": f"{key[1]}\t" + pdf["set_id"], "seq_id": pdf["seq_id"], "row": rows})

    aligned = many.groupBy("set_id", "point").applyInPandas(run, align.ROWS)
    golds = gold.select("set_id", "seq_id", "row").join(F.broadcast(table.select("point")))
    golds = golds.select(F.concat_ws("\t", F.col("point").cast("string"), "set_id").alias("set_id"), "seq_id", "row")
    point = F.split("msa_id", "\t")[0].cast("int")
    means = accuracy(aligned, golds).groupBy(point.alias("point")).agg(F.avg("q").alias("q"), F.avg("tc").alias("tc")).collect()
    by_point = {r["point"]: r for r in means}
    return [p | {"q": by_point[i]["q"], "tc": by_point[i]["tc"]} if i in by_point else p | {"q": None, "tc": None} for i, p in enumerate(points)]


def ranked(found: list[dict[str, float]], axes: list[str], most_drop: float = 0.01, least_apart: float = 0.0, most: int = 8) -> list[dict[str, float]]:
    """The best points by tc that stand apart: within a drop of the best and a distance from those already taken."""
    order = sorted((p for p in found if p["tc"] is not None), key=lambda p: -p["tc"])
    out: list[dict[str, float]] = []
    for p in order:
        apart = all(sum((p[a] - o[a]) ** 2 for a in axes) ** 0.5 >= least_apart for o in out)
        if p["tc"] >= order[0]["tc"] - most_drop and apart and len(out) < most:
            out.append(p)
    return out


def spatter(evaluate, start: dict[str, float], delta: dict[str, float], tries: int = 8, most_failures: int = 3, shrink: float = 0.8, seed: int = 1) -> dict[str, float]:
    """The best point of a random search: steps of 0.2 to 1 times delta either way around the best so far.

    evaluate takes a list of points and gives them with their `tc`, so that each round is one job.
    The first round tries four times as many; deltas shrink each round; it ends after so many rounds
    in a row without a better point.
    """
    rng = np.random.default_rng(seed)
    best = evaluate([start])[0]
    failures, step, turn = 0, dict(delta), 0
    while failures < most_failures:
        amount = tries * 4 if turn == 0 else tries
        points = [
            {k: best[k] + rng.choice((-1, 1)) * rng.uniform(0.2, 1.0) * step[k] for k in delta} | {k: best[k] for k in start if k not in delta}
            for _ in range(amount)
        ]
        top = max(evaluate(points), key=lambda p: p["tc"])
        better = top["tc"] > best["tc"]
        best, failures = (top, 0) if better else (best, failures + 1)
        step = {k: v * shrink for k, v in step.items()}
        turn += 1
    return best
