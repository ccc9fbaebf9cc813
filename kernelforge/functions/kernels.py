"""Kernel functions, each as a Column expression and as numpy on blocks.

x and y are arrays of doubles. Complex kernels are numpy blocks (complex) and a pair of Columns (re, im).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_CUT = -2 * math.log(1e-30)
#: Coordinates up to which distances are summed coordinate by coordinate.
DIRECT = 8


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _over(d):
    """1 over the distance, 1 at 0."""
    return 1 / np.sqrt(np.where(d == 0, 1.0, d))


#: name -> (Column form, numpy form) of (d2, dot, h).
KERNELS = {
    "rbf": (lambda d, p, h: F.when(d > _CUT * h * h, 0.0).otherwise(F.exp(-d / (2 * h * h))), lambda d, p, h: np.where(d > _CUT * h * h, 0.0, np.exp(-d / (2 * h * h)))),
    "power4": (lambda d, p, h: F.pow(d, F.lit(4.0)), lambda d, p, h: d**4),
    "multiquadric": (lambda d, p, h: F.sqrt(d + h), lambda d, p, h: np.sqrt(d + h)),
    "inverse_multiquadric": (lambda d, p, h: 1 / F.sqrt(d + h), lambda d, p, h: 1 / np.sqrt(d + h)),
    "polynomial": (lambda d, p, h: (p + h) * (p + h), lambda d, p, h: (p + h) ** 2),
    "laplacian": (lambda d, p, h: F.exp(-F.sqrt(d) / h), lambda d, p, h: np.exp(-np.sqrt(d) / h)),
    "inverse_distance": (lambda d, p, h: F.when(d == 0, 1.0).otherwise(1 / F.sqrt(d)), lambda d, p, h: np.where(d == 0, 1.0, _over(d))),
    "helmholtz_re": (lambda d, p, h: F.when(d == 0, 1.0).otherwise(F.cos(h * F.sqrt(d)) / F.sqrt(d)), lambda d, p, h: np.where(d == 0, 1.0, np.cos(h * np.sqrt(d)) * _over(d))),
    "helmholtz_im": (lambda d, p, h: F.when(d == 0, 0.0).otherwise(-F.sin(h * F.sqrt(d)) / F.sqrt(d)), lambda d, p, h: np.where(d == 0, 0.0, -np.sin(h * np.sqrt(d)) * _over(d))),
    "fourier_re": (lambda d, p, h: F.cos(-2 * math.pi * p), lambda d, p, h: np.cos(2 * math.pi * p)),
    "fourier_im": (lambda d, p, h: F.sin(-2 * math.pi * p), lambda d, p, h: -np.sin(2 * math.pi * p)),
    # The exponential kernel and a product of rank r = h[1], sum of (k + 1)**2 / r**2 / 100 over k < r.
    "laplacian_low_rank": (lambda d, p, h: F.exp(-F.sqrt(d) / h[0]) + F.lit(sum((k + 1) ** 2 / h[1] ** 2 / 100 for k in range(h[1]))), lambda d, p, h: np.exp(-np.sqrt(d) / h[0]) + sum((k + 1) ** 2 / h[1] ** 2 / 100 for k in range(h[1]))),
    # The wave equation's Green function with slowness 2 in h[1] dimensions at frequency h[0]; 100 at distance 0.
    "wave": (
        lambda d, p, h: F.when(d == 0, 100.0).otherwise(F.cos(2 * h[0] * F.sqrt(d)) / math.pi / F.sqrt(4 * h[0] * F.sqrt(d)) * F.pow(4 * F.sqrt(d) / h[0], F.lit(1 - h[1] / 2))),
        lambda d, p, h: np.where(d == 0, 100.0, np.cos(2 * h[0] * np.sqrt(d)) / math.pi / np.sqrt(4 * h[0] / _over(d)) * (4 / _over(d) / h[0]) ** (1 - h[1] / 2)),
    ),
}
#: Complex kernels by the names of their parts.
COMPLEX = {"helmholtz": ("helmholtz_re", "helmholtz_im"), "fourier": ("fourier_re", "fourier_im")}


def _ellipse(x, k, n, f):
    wave = lambda g: (2 + g(_TAU * x[0]) * g(_TAU * x[1])) / 16
    return x[0] * k[0] + x[1] * k[1] + f.sqrt((wave(f.sin) * k[0]) ** 2 + (wave(f.cos) * k[1]) ** 2)


def _plane(x, k, n, f):
    tilt, turn = x[0] * (math.pi / 8), x[1] * _TAU
    return k[2] * n * (x[2] / f.cos(tilt) - f.tan(tilt) * (f.cos(turn) * k[0] + f.sin(turn) * k[1]))


def _line(x, k, n, f):
    tilt = x[0] * (math.pi / 4)
    return k[1] * n * (x[1] / f.cos(tilt) - f.tan(tilt) * k[0])


def _sphere(x, k, n, f):
    size = f.sqrt(k[0] * k[0] + k[1] * k[1] + k[2] * k[2])
    return x[0] * k[0] + x[1] * k[1] + x[2] * k[2] + (3 + f.sin(_TAU * x[0]) * f.sin(_TAU * x[1]) * f.sin(_TAU * x[2])) / 100 * size


_TAU = 2 * math.pi
#: Fourier integral operators and generalised Radon transforms, exp(2 pi i phase): name -> phase of the coordinates of
#: x and k and of the number n of frequencies an axis, in functions of f (numpy's or Spark's).
PHASES = {
    "fio": lambda x, k, n, f: x[0] * k[0] + (2 + f.sin(_TAU * x[0])) / 8 * f.abs(k[0]),
    "fio_inverse_fourier": lambda x, k, n, f: -x[0] * k[0],
    "fio_curved": lambda x, k, n, f: (2 + f.sin(_TAU * x[0])) / 8 * f.abs(k[0]),
    "radon_ellipse": _ellipse,
    "radon_plane": _plane,
    "radon_line": _line,
    "radon_hyperbola": lambda x, k, n, f: k[1] * (n / 10) * f.sqrt(x[0] * x[0] + x[1] * x[1] * k[0] * k[0]),
    "radon_sphere": _sphere,
}


def entry(name: str, x: Column, y: Column, h) -> Column:
    return KERNELS[name][0](squared_distance(x, y), dot(x, y), h)


def block(name: str, x: np.ndarray, y: np.ndarray, h) -> np.ndarray:
    """Kernel matrix of two sets of points; distances of differences, so equal points are at exactly 0."""
    if name in COMPLEX:
        re, im = COMPLEX[name]
        return block(re, x, y, h) + 1j * block(im, x, y, h)
    if name in PHASES:
        # Whole turns are taken off first: exact, and small angles are quick.
        phase = PHASES[name]([c[:, None] for c in x.T], [c[None] for c in y.T], h, np)
        turn, out = _TAU * (phase - np.rint(phase)), np.empty(phase.shape, complex)
        out.real, out.imag = np.cos(turn), np.sin(turn)
        return out
    dots = x @ y.T
    if x.shape[1] <= DIRECT:
        # Coordinate by coordinate: no temporary of all differences.
        d = np.zeros((len(x), len(y)))
        for a, b in zip(x.T, y.T, strict=True):
            d += (a[:, None] - b[None]) ** 2
        return KERNELS[name][1](d, dots, h)
    # From the products, but by differences where these cancel out.
    size = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    d = size - 2 * dots
    i, j = np.nonzero(~(d >= 1e-2 * size))
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        d[a, b] = ((x[a] - y[b]) ** 2).sum(1)
    return KERNELS[name][1](d, dots, h)


def is_complex(name: str) -> bool:
    return name in COMPLEX or name in PHASES


def gram_distance(zmn: Column, zmm: Column, znn: Column) -> Column:
    """Angular distance of two rows of a positive definite matrix."""
    return 1 - zmn * zmn / (zmm * znn)


def phase_entry(name: str, x: Column, k: Column, n: float, dim: int) -> tuple[Column, Column]:
    """(re, im) of exp(2 pi i phase)."""
    phase = _TAU * PHASES[name]([F.element_at(x, i + 1) for i in range(dim)], [F.element_at(k, i + 1) for i in range(dim)], n, F)
    return F.cos(phase), F.sin(phase)


def bit_reversed(i: int, bits: int) -> int:
    """The number (from 0) of which the last ``bits`` bits are turned round."""
    return int(format(i, f"0{bits}b")[::-1], 2) if bits else i


def _bessel_terms(order: int, most: int = 60) -> list[float]:
    """Coefficients of the power series of J_order in -(x / 2)**2."""
    out = [1.0 / math.factorial(order)]
    for k in range(1, most):
        out.append(out[-1] / (k * (k + order)))
    return out


def bessel0(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """J0 and Y0 of positive numbers: power series up to 14, beyond that the asymptotic series."""
    x = np.asarray(x, float)
    small = np.minimum(x, 14.0)
    q, j, y, term, harmonic = -((small / 2) ** 2), np.ones_like(x), np.zeros_like(x), np.ones_like(x), 0.0
    for k in range(1, 60):
        term = term * q / (k * k)
        harmonic += 1 / k
        j, y = j + term, y - harmonic * term
    with np.errstate(divide="ignore"):
        near = j, 2 / math.pi * ((np.log(small / 2) + np.euler_gamma) * j + y)
    big, p, r, a = np.maximum(x, 14.0), 1.0, 0.0, 1.0
    for k in range(1, 21):
        a = a * -((2 * k - 1) ** 2) / (8 * k * big)
        p, r = (p + a * (-1) ** (k // 2), r) if k % 2 == 0 else (p, r + a * (-1) ** (k // 2))
    angle, size = big - math.pi / 4, np.sqrt(2 / (math.pi * big))
    wide = size * (p * np.cos(angle) - r * np.sin(angle)), size * (p * np.sin(angle) + r * np.cos(angle))
    return tuple(np.where(x <= 14, u, v) for u, v in zip(near, wide, strict=True))


def hankel02(x: np.ndarray) -> np.ndarray:
    """Hankel function of the second kind, order 0."""
    j, y = bessel0(x)
    return j - 1j * y


def _hankel(part: str):
    """The part of H0(2)(h r), 0 at r = 0, as a Column by way of an Arrow UDF and as numpy."""
    of = lambda r: getattr(hankel02(np.where(r == 0, 1.0, r)), part) * (r != 0)

    def column(d: Column, p: Column, h: float) -> Column:
        import pandas as pd

        return F.pandas_udf(lambda s: pd.Series(of(s.to_numpy())), "double")(F.sqrt(d) * F.lit(float(h)))

    return column, lambda d, p, h: of(h * np.sqrt(d))


KERNELS |= {"hankel_re": _hankel("real"), "hankel_im": _hankel("imag")}
COMPLEX["hankel"] = ("hankel_re", "hankel_im")
