"""Low-rank interaction blocks: logits = xW + b + sum over blocks of (P[a] * Q[b]) R, by alternating ridge solves.

All steps depend on the data through counts only: n_ab, the products of features with cells, and class counts per cell.
They are collected once; sweeps cost the same whatever the number of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from .readout import Readout, best_temperature, temperature_rows
from .suffstats import Tables


class BlockStats:
    """Counts behind a model with linear features and cell columns (cell = a * alphabet + b)."""

    def __init__(self, tables: Tables, features: list[str], cells: list[str], y: str):
        self.n = tables.n
        self.xx, self.nx = tables.block(features, features), tables.counts(features)
        self.classes = tables.block([y], [y]).shape[0]
        self.xt = tables.block(features, [y]) - self.nx[:, None] / self.classes
        self.t = tables.counts([y]) - self.n / self.classes
        self.nc = [tables.counts([c]) for c in cells]
        self.xc = [tables.block(features, [c]) for c in cells]
        self.ct = [tables.block([c], [y]) - n[:, None] / self.classes for c, n in zip(cells, self.nc)]
        self.cc = [[tables.block([a], [b]) for b in cells] for a in cells]


def ridge(gram: np.ndarray, rhs: np.ndarray, lam: float) -> np.ndarray:
    return np.linalg.solve(gram + lam * np.eye(len(gram)), rhs)


def factor_step(n_ab: np.ndarray, s_ab: np.ndarray, other: np.ndarray, r: np.ndarray, old: np.ndarray, lam: float) -> np.ndarray:
    """One factor given the other (rows of n_ab by this symbol): a ridge solve per symbol, skipped where rows are too few."""
    rr, new = r @ r.T, old.copy()
    dim, classes = r.shape
    for a in range(len(old)):
        if n_ab[a].sum() * classes < dim + 2:
            continue
        gram = (other * n_ab[a][:, None]).T @ other * rr
        rhs = (other * (s_ab[a] @ r.T)).sum(0)
        new[a] = ridge(gram, rhs, lam)
    return new


def fit_blocks(stats: BlockStats, alphabet: int, dim: int = 8, sweeps: int = 6, lam: float = 1e-3, seed: int = 0) -> dict:
    """W, b and (P, Q, R) per block; block coordinate descent, each step in closed form."""
    rng = np.random.default_rng(seed)
    blocks = [[rng.normal(0, 0.1, (alphabet, dim)), rng.normal(0, 0.1, (alphabet, dim)), None] for _ in stats.nc]
    d = len(stats.nx)
    w = b = None
    for _ in range(sweeps):
        pis = [np.einsum("ar,br->abr", p, q).reshape(-1, dim) for p, q, _ in blocks]
        m = len(pis)
        size = d + m * dim + 1
        gram, rhs = np.zeros((size, size)), np.zeros((size, stats.classes))
        gram[:d, :d], gram[:d, -1], gram[-1, :d], gram[-1, -1] = stats.xx, stats.nx, stats.nx, stats.n
        rhs[:d], rhs[-1] = stats.xt, stats.t
        for i, pi in enumerate(pis):
            at = slice(d + i * dim, d + (i + 1) * dim)
            gram[:d, at] = stats.xc[i] @ pi
            gram[at, :d] = gram[:d, at].T
            gram[at, -1] = gram[-1, at] = stats.nc[i] @ pi
            rhs[at] = pi.T @ stats.ct[i]
            for j, pj in enumerate(pis):
                gram[at, d + j * dim : d + (j + 1) * dim] = pi.T @ stats.cc[i][j] @ pj
        coef = ridge(gram, rhs, lam)
        w, b = coef[:d], coef[-1]
        for i in range(m):
            blocks[i][2] = coef[d + i * dim : d + (i + 1) * dim]
        for i, block in enumerate(blocks):
            p, q, r = block
            rest = stats.ct[i] - stats.xc[i].T @ w - stats.nc[i][:, None] * b
            for j, (pj, qj, rj) in enumerate(blocks):
                if j != i:
                    rest = rest - stats.cc[i][j] @ (np.einsum("ar,br->abr", pj, qj).reshape(-1, dim) @ rj)
            s = rest.reshape(alphabet, alphabet, -1)
            n = stats.nc[i].reshape(alphabet, alphabet)
            block[0] = factor_step(n, s, q, r, p, lam)
            block[1] = factor_step(n.T, s.transpose(1, 0, 2), block[0], r, q, lam)
    return {"W": w, "b": b, "blocks": [tuple(x) for x in blocks]}


def fit_gradient(stats: BlockStats, alphabet: int, dim: int = 8, steps: int = 400, rate: float = 0.05, seed: int = 0) -> dict:
    """The same one-block model by Adam on the same squared error, its gradients taken from the counts."""
    rng = np.random.default_rng(seed)
    k, c, d = alphabet, stats.classes, len(stats.nx)
    params = {"P": rng.normal(0, 0.1, (k, dim)), "Q": rng.normal(0, 0.1, (k, dim)), "R": rng.normal(0, 0.1, (dim, c)), "W": np.zeros((d, c)), "b": np.zeros(c)}
    first, second = ({n: np.zeros_like(v) for n, v in params.items()} for _ in range(2))
    scale = 2.0 / (stats.n * c)
    for step in range(1, steps + 1):
        p, q, r, w, b = (params[n] for n in "PQRWb")
        pi = np.einsum("ar,br->abr", p, q).reshape(-1, dim)
        cell = stats.xc[0].T @ w + stats.nc[0][:, None] * (b + pi @ r) - stats.ct[0]
        by_cell = (cell @ r.T).reshape(k, k, dim)
        grads = {
            "R": pi.T @ cell, "P": np.einsum("abr,br->ar", by_cell, q), "Q": np.einsum("abr,ar->br", by_cell, p),
            "W": stats.xx @ w + stats.nx[:, None] * b + stats.xc[0] @ (pi @ r) - stats.xt, "b": stats.nx @ w + stats.n * b + stats.nc[0] @ (pi @ r) - stats.t,
        }
        for name, g in grads.items():
            g = g * scale
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.999 * second[name] + 0.001 * g * g
            params[name] = params[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return {"W": params["W"], "b": params["b"], "blocks": [(params["P"], params["Q"], params["R"])]}


def as_readout(model: dict, features: list[str], cells: list[str], sizes: list[int], alphabet: int) -> Readout:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    tables = [np.einsum("ar,br->abr", p, q).reshape(alphabet * alphabet, -1) @ r for p, q, r in model["blocks"]]

    def logits(columns: list[np.ndarray]) -> np.ndarray:
        out = np.tile(model["b"], (len(columns[0]), 1))
        for k in range(len(features)):
            out += model["W"][offsets[k] + columns[k]]
        for k, table in enumerate(tables):
            out += table[columns[len(features) + k]]
        return out

    size = model["W"].size + model["b"].size + sum(x.size for b in model["blocks"] for x in b)
    return Readout([*features, *cells], logits, len(model["b"]), parameters=size)


def fit_lowrank(df: DataFrame, features: list[str], sizes: list[int], cells: list[str], alphabet: int, y: str, classes: int, ordinal: Column, n: int, dim: int = 8, sweeps: int = 6, method: str = "als", seed: int = 0, share: float = 0.7) -> tuple[Readout, dict]:
    """(read-out, factors), fitted on the first share of rows and tempered on the held-back rest."""
    cut = int(n * share)
    tables = Tables(df.where(ordinal < cut), [*features, *cells, y], [*sizes, *[alphabet * alphabet] * len(cells), classes], budget=6000 + classes)
    stats = BlockStats(tables, features, cells, y)
    model = fit_blocks(stats, alphabet, dim, sweeps, seed=seed) if method == "als" else fit_gradient(stats, alphabet, dim, seed=seed)
    out = as_readout(model, features, cells, sizes, alphabet)
    held, truth = temperature_rows(df, out.features, y, ordinal, cut, n)
    if len(truth):
        out.temperature = best_temperature(out.logits(held), truth)
    return out, model


def emit_table(spark, model: dict, block: int = 0, centred: bool = False) -> DataFrame:
    """(a, b, g): the class that a block's factors favour for every pair of symbols.

    centred takes out what depends on one symbol alone, which the linear part may hold as well."""
    p, q, r = model["blocks"][block]
    g = np.einsum("ar,br,rc->abc", p, q, r)
    if centred:
        g = g - g.mean(0, keepdims=True) - g.mean(1, keepdims=True) + g.mean((0, 1), keepdims=True)
    g = g.argmax(2)
    return spark.createDataFrame([(int(a), int(b), int(g[a, b])) for a in range(g.shape[0]) for b in range(g.shape[1])], "a int, b int, g int")
