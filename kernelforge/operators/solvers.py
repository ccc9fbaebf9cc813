"""Krylov solvers, refinement and eigenpairs over operators that map (id, w) to (id, y).

Vectors are columns of a table keyed by id, written once a round, so that lineage ends there and a
lost executor costs one round. Only inner products come to the driver, all of a
round's in one aggregate. A Krylov basis is ``restart`` columns at most.

A zero right-hand side is solved by zero; ids on one side alone of a join drop out,
so the operator must return every id it was given.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelforge.shared import written

Operator = Callable[[DataFrame], DataFrame]


def identity(v: DataFrame) -> DataFrame:
    return v.select("id", F.col("w").alias("y"))


def chained(*operators: Operator) -> Operator:
    """The last is applied first; what one hands to the next is written, as that may read it more than once."""

    def apply(v: DataFrame) -> DataFrame:
        *first, last = reversed(operators)
        for f in first:
            v = v if f is identity else written(f(v).select("id", F.col("y").alias("w")))
        return last(v)

    return apply


def added(*terms: tuple[float, Operator]) -> Operator:
    """The sum of scaled operators."""

    def apply(v: DataFrame) -> DataFrame:
        parts = [f(v).select("id", (F.col("y") * F.lit(float(a))).alias("y")) for a, f in terms]
        return reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("y").alias("y"))

    return apply


def shifted(operator: Operator, by: float) -> Operator:
    return added((1.0, operator), (by, identity))


def _dots(df: DataFrame, *pairs: tuple[str, str]) -> list[float]:
    return [x or 0.0 for x in df.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"d{i}") for i, (a, b) in enumerate(pairs))).first()]


def _sum(scales, names) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(float(s)) * F.col(n) for s, n in zip(scales, names, strict=True)))


def _after(df: DataFrame, operator: Operator, of: str, into: str) -> DataFrame:
    """df with the operator's product with one of its columns, written."""
    made = operator(df.select("id", F.col(of).alias("w"))).select("id", F.col("y").alias(into))
    return written(df.join(made, "id"))


def _extend(basis: DataFrame, operator: Operator, k: int) -> tuple[DataFrame, np.ndarray, float]:
    """basis (id, v0 .. vk) with the next Krylov vector, its coefficients and norm.

    Gram-Schmidt against all columns at once, twice: as orthogonal as the column-by-column kind, in two aggregates.
    """
    names = [f"v{j}" for j in range(k + 1)]
    both, total = _after(basis, operator, names[-1], "q"), np.zeros(k + 1)
    before = _dots(both, ("q", "q"))[0] ** 0.5
    for _ in range(2):
        h = np.array(_dots(both, *((v, "q") for v in names)))
        both, total = both.withColumn("q", F.col("q") - _sum(h, names)), total + h
    norm = _dots(both, ("q", "q"))[0] ** 0.5
    norm = 0.0 if norm <= 1e-14 * before else norm
    return both.withColumn(f"v{k + 1}", F.col("q") / F.lit(norm or 1.0)).drop("q"), total, norm


def gmres(operator: Operator, b: DataFrame, tol: float = 1e-8, most: int = 200, restart: int = 30, precondition: Operator = identity) -> tuple[DataFrame, list[float]]:
    """Solution (id, w) and relative preconditioned residuals; restarted, preconditioned from the left."""
    both = chained(precondition, operator)
    state = _after(b.select("id", F.col("w").cast("double").alias("b"), F.lit(0.0).alias("x")), precondition, "b", "r")
    size, history = _dots(state, ("r", "r"))[0] ** 0.5, []
    if size == 0:
        return state.select("id", F.col("x").alias("w")), [0.0]
    while len(history) < most:
        beta = _dots(state, ("r", "r"))[0] ** 0.5
        if beta <= tol * size:
            break
        basis, h, done = state.select("id", (F.col("r") / F.lit(beta)).alias("v0")), np.zeros((restart + 1, restart)), False
        for k in range(min(restart, most - len(history))):
            basis, h[: k + 1, k], h[k + 1, k] = _extend(basis, both, k)
            small, goal = h[: k + 2, : k + 1], np.eye(k + 2)[0] * beta
            y = np.linalg.lstsq(small, goal, rcond=None)[0]
            history.append(float(np.linalg.norm(goal - small @ y) / size))
            done = history[-1] <= tol
            if done or h[k + 1, k] == 0:
                break
        step = basis.select("id", _sum(y, [f"v{j}" for j in range(len(y))]).alias("dx"))
        state = written(state.join(step, "id").select("id", "b", (F.col("x") + F.col("dx")).alias("x")))
        if done or len(history) >= most:
            break
        product = _after(state, operator, "x", "ax").withColumn("left", F.col("b") - F.col("ax"))
        stuck = h[k + 1, k] == 0
        state = _after(product.select("id", "b", "x", "left"), precondition, "left", "r").drop("left")
        if stuck and _dots(state, ("r", "r"))[0] ** 0.5 >= beta:
            break
    return state.select("id", F.col("x").alias("w")), history


def tfqmr(operator: Operator, b: DataFrame, tol: float = 1e-8, most: int = 200, precondition: Operator = identity, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """Transpose-free QMR with a shadow residual hashed from ids; history has the residual's bound after each product."""
    both = chained(precondition, operator)
    shadow = F.xxhash64(F.lit(seed), "id") / F.lit(float(2**63))
    state = _after(b.select("id", F.col("w").cast("double").alias("b"), shadow.alias("s")), precondition, "b", "w")
    size = _dots(state, ("w", "w"))[0] ** 0.5
    zero = F.lit(0.0)
    if size == 0:
        return state.select("id", zero.alias("w")), [0.0]
    state = _after(state.select("id", "s", zero.alias("x"), "w", F.col("w").alias("y"), zero.alias("d")), both, "y", "u").withColumn("v", F.col("u"))
    tau, theta, eta, history = size, 0.0, 0.0, []
    rho, sigma = _dots(state, ("s", "w"), ("s", "v"))
    while len(history) < most and rho and sigma:
        alpha = rho / sigma
        for half in range(2):
            if half:
                state = _after(state.withColumn("y", F.col("y") - F.lit(alpha) * F.col("v")).drop("u"), both, "y", "u")
            state = state.withColumn("w", F.col("w") - F.lit(alpha) * F.col("u")).withColumn("d", F.col("y") + F.lit(theta**2 * eta / alpha) * F.col("d"))
            theta = _dots(state, ("w", "w"))[0] ** 0.5 / tau
            c2 = 1 / (1 + theta**2)
            tau, eta = tau * theta * c2**0.5, c2 * alpha
            state = state.withColumn("x", F.col("x") + F.lit(eta) * F.col("d"))
            history.append(tau * (len(history) + 2) ** 0.5 / size)
            if history[-1] <= tol:
                return written(state.select("id", F.col("x").alias("w"))), history
        last, rho = rho, _dots(state, ("s", "w"))[0]
        beta = rho / last
        state = state.withColumn("y", F.col("w") + F.lit(beta) * F.col("y")).withColumn("v", F.lit(beta) * (F.col("u") + F.lit(beta) * F.col("v"))).drop("u")
        state = _after(state, both, "y", "u").withColumn("v", F.col("u") + F.col("v"))
        sigma = _dots(state, ("s", "v"))[0]
    return written(state.select("id", F.col("x").alias("w"))), history


def refine(operator: Operator, b: DataFrame, tol: float = 1e-8, most: int = 200, precondition: Operator = identity) -> tuple[DataFrame, list[float]]:
    """Iterative refinement by an approximate inverse; stops when the residual grows or no longer halves in three rounds, keeping the best."""
    state = written(b.select("id", F.col("w").cast("double").alias("b"), F.lit(0.0).alias("x")).withColumn("r", F.col("b")))
    size, history, best = _dots(state, ("b", "b"))[0] ** 0.5, [], state
    if size == 0:
        return state.select("id", F.col("x").alias("w")), [0.0]
    while len(history) < most:
        state = _after(state, precondition, "r", "dx").select("id", "b", (F.col("x") + F.col("dx")).alias("x"))
        state = _after(state, operator, "x", "ax").select("id", "b", "x", (F.col("b") - F.col("ax")).alias("r"))
        history.append(_dots(state, ("r", "r"))[0] ** 0.5 / size)
        if history[-1] <= min(history):
            best = state
        if history[-1] <= tol or history[-1] > 10 * min(history) or (len(history) > 3 and history[-1] > history[-4] / 2):
            break
    return best.select("id", F.col("x").alias("w")), history


METHODS = {"gmres": gmres, "tfqmr": tfqmr, "refine": refine}


def solve(operator: Operator, b: DataFrame, method: str = "gmres", **given) -> tuple[DataFrame, list[float]]:
    return METHODS[method](operator, b, **given)


def eigenpairs(operator: Operator, ids: DataFrame, n: int = 4, steps: int = 60, tol: float = 1e-8, symmetric: bool = True, seed: int = 42) -> tuple[np.ndarray, DataFrame | None, np.ndarray]:
    """The n eigenvalues of largest size, for symmetric operators their vectors (id, v0 ..), and each pair's residual over its value.

    Arnoldi steps end once all n residuals are at most ``tol``; with the steps used up, the residuals tell what has not converged.
    """
    start = written(ids.select("id", (F.xxhash64(F.lit(seed), "id") / F.lit(float(2**63))).alias("w")))
    size = _dots(start, ("w", "w"))[0] ** 0.5
    basis, h = start.select("id", (F.col("w") / F.lit(size or 1.0)).alias("v0")), np.zeros((steps + 1, steps))
    for k in range(steps):
        basis, h[: k + 1, k], h[k + 1, k] = _extend(basis, operator, k)
        small = h[: k + 1, : k + 1]
        values, vectors = np.linalg.eigh((small + small.T) / 2) if symmetric else np.linalg.eig(small)
        top = np.argsort(-np.abs(values))[:n]
        errors = h[k + 1, k] * np.abs(vectors[-1, top]) / np.maximum(np.abs(values[top]), 1e-300)
        if h[k + 1, k] == 0 or (len(top) == n and errors.max() <= tol):
            break
    if not symmetric:
        return values[top], None, errors
    names = [f"v{j}" for j in range(k + 1)]
    return values[top], written(basis.select("id", *(_sum(vectors[:, t], names).alias(f"v{i}") for i, t in enumerate(top)))), errors
