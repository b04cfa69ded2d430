"""Probability that each of several actions is the best, from counts of successes and failures (Beta posteriors)."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of the quadrature.
POINTS = 4097


def best_probabilities(successes: np.ndarray, failures: np.ndarray, points: int = POINTS) -> np.ndarray:
    """For each action, the integral over p of its Beta(s+1, f+1) density times the others' distribution functions.

    One grid serves all actions, denser near both ends; distribution functions are running sums of the densities.
    """
    a, b = np.asarray(successes, float)[:, None] + 1, np.asarray(failures, float)[:, None] + 1
    nodes, weights = np.polynomial.legendre.leggauss(16)
    edges = (1 - np.cos(np.linspace(0, np.pi, max(2, points // 16)))) / 2
    half = np.diff(edges)[:, None] / 2
    x = edges[:-1, None] + half * (nodes + 1)
    w = half * weights
    constant = np.array([lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(a[:, 0], b[:, 0])])
    density = np.exp((a[:, :, None] - 1) * np.log(x) + (b[:, :, None] - 1) * np.log1p(-x) + constant[:, None, None])
    cell = (density * w).sum(axis=2)
    before = np.concatenate([np.zeros((len(a), 1)), np.cumsum(cell, axis=1)[:, :-1]], axis=1)
    inner = np.array([[np.polynomial.legendre.Legendre(c).integ(lbnd=-1)(nodes) for c in np.eye(16)]])[0]
    fit = np.linalg.solve(np.polynomial.legendre.legvander(nodes, 15), np.eye(16)).T @ inner  # integrals up to each node
    distribution = before[:, :, None] + np.einsum("kcn,nm->kcm", density, fit) * half
    logs = np.log(np.clip(distribution, 1e-300, 1.0))
    others = np.exp(logs.sum(axis=0) - logs)
    out = (density * others * w).sum(axis=(1, 2))
    return out / out.sum()


def choice_probabilities(df: DataFrame, key: str, action: str, successes: str, failures: str) -> DataFrame:
    """Rows (key, action, probability): how likely each of a key's actions is the best. A key's actions fit one task."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(action)
        return pd.DataFrame({key: pdf[key], action: pdf[action], "probability": best_probabilities(pdf[successes].to_numpy(), pdf[failures].to_numpy())})

    kinds = dict(df.dtypes)
    own = df.select(key, action, F.col(successes).cast("double").alias(successes), F.col(failures).cast("double").alias(failures))
    return own.groupBy(key).applyInPandas(work, f"`{key}` {kinds[key]}, `{action}` {kinds[action]}, probability double")
