"""Tensor trains of arrays and of matrices over several modes: compression, products and sums; modes of two with padding."""

from __future__ import annotations

import numpy as np

from kernelforge.operators.blocks_algebra import numerical_rank, tensor_full, tensor_train

Train = list[np.ndarray]


def unfold(a: np.ndarray, mode: int) -> np.ndarray:
    """The matrix of a tensor with one mode as its rows."""
    return np.moveaxis(a, mode, 0).reshape(a.shape[mode], -1)


def fold(m: np.ndarray, mode: int, shape: tuple[int, ...]) -> np.ndarray:
    return np.moveaxis(m.reshape(shape[mode], *np.delete(shape, mode)), 0, mode)


def matrix_train(a: np.ndarray, rows: tuple[int, ...], cols: tuple[int, ...], tol: float) -> Train:
    """Cores (r, row, col, r) of a matrix whose rows and columns run over modes, paired mode by mode."""
    d = len(rows)
    paired = a.reshape(*rows, *cols).transpose([x for k in range(d) for x in (k, d + k)])
    cores = tensor_train(paired.reshape([m * n for m, n in zip(rows, cols, strict=True)]), tol)
    return [c.reshape(c.shape[0], m, n, c.shape[-1]) for c, m, n in zip(cores, rows, cols, strict=True)]


def matrix_full(cores: Train) -> np.ndarray:
    d = len(cores)
    a = tensor_full([c.reshape(c.shape[0], -1, c.shape[-1]) for c in cores]).reshape([x for c in cores for x in c.shape[1:3]])
    a = a.transpose([*range(0, 2 * d, 2), *range(1, 2 * d, 2)])
    return a.reshape(int(np.prod(a.shape[:d])), -1)


def apply_full(cores: Train, x: np.ndarray) -> np.ndarray:
    """A matrix train times a full vector, one mode after the other."""
    now = x.reshape(1, *(c.shape[2] for c in cores))  # (rank, remaining columns .., rows done)
    for c in cores:
        now = np.tensordot(now, c, axes=([0, 1], [0, 2]))  # .., row, next rank
        now = np.moveaxis(now, -1, 0)
    return now.reshape(-1)


def apply_train(cores: Train, x: Train) -> Train:
    """A matrix train times a vector's train: cores of multiplied ranks."""
    out = []
    for c, v in zip(cores, x, strict=True):
        y = np.einsum("amnb,cnd->acmbd", c, v)
        out.append(y.reshape(c.shape[0] * v.shape[0], c.shape[1], c.shape[-1] * v.shape[-1]))
    return out


def shorten(cores: Train, tol: float) -> Train:
    """The same train with ranks cut at the tolerance: orthogonal from the left, cut from the right."""
    out = [c.copy() for c in cores]
    for k in range(len(out) - 1):
        a, n, b = out[k].shape
        q, r = np.linalg.qr(out[k].reshape(a * n, b))
        out[k], out[k + 1] = q.reshape(a, n, -1), np.tensordot(r, out[k + 1], 1)
    for k in range(len(out) - 1, 0, -1):
        a, n, b = out[k].shape
        u, s, v = np.linalg.svd(out[k].reshape(a, n * b), full_matrices=False)
        r = numerical_rank(s, tol / np.sqrt(max(1, len(out) - 1)))
        out[k], out[k - 1] = v[:r].reshape(r, n, b), np.tensordot(out[k - 1], u[:, :r] * s[:r], 1)
    return out


def power_of_two(n: int) -> int:
    """The least power of two that is n or more."""
    return 1 << max(0, n - 1).bit_length()


def quantized(a: np.ndarray, tol: float) -> tuple[Train, tuple[int, ...]]:
    """A train over modes of two of an array padded with zeros to powers of two, and the shape to crop to."""
    full = np.zeros([power_of_two(n) for n in a.shape], a.dtype)
    full[tuple(slice(n) for n in a.shape)] = a
    return tensor_train(full.reshape((2,) * max(1, int(np.log2(full.size)))), tol) if full.size > 1 else [full.reshape(1, 1, 1)], a.shape


def quantized_full(cores: Train, shape: tuple[int, ...]) -> np.ndarray:
    full = tensor_full(cores).reshape([power_of_two(n) for n in shape])
    return full[tuple(slice(n) for n in shape)]


def quantized_matrix(a: np.ndarray, tol: float) -> tuple[Train, tuple[int, int]]:
    """A matrix train over pairs of modes of two, padded to a square power of two."""
    n = power_of_two(max(a.shape))
    full = np.zeros((n, n), a.dtype)
    full[: a.shape[0], : a.shape[1]] = a
    modes = (2,) * max(1, int(np.log2(n)))
    return matrix_train(full, modes, modes, tol) if n > 1 else [full.reshape(1, 1, 1, 1)], a.shape


def quantized_apply(cores: Train, shape: tuple[int, int], x: np.ndarray) -> np.ndarray:
    n = int(np.prod([c.shape[2] for c in cores]))
    return apply_full(cores, np.concatenate((x, np.zeros(n - len(x), x.dtype))))[: shape[0]]
