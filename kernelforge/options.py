"""Tunables with their defaults, from a command line, and as a table."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Options:
    leaf: int = 200  # most points of a leaf
    order: str = "tm"  # natural, ckd, tm or tm_gram
    strong: bool = False  # near and far by geometry (H), else siblings are far (HSS, HODLR)
    near_para: float = 2.1  # of strong plans and of the choice of proxies: far if center distance > near_para * (r1 + r2) / 2
    knn_near_para: float = 20.0
    knn: int = 0  # nearest points of each leaf point that join the proxies
    tol: float = 1e-4  # of construction, relative to a block's largest column
    max_rank: int = 10_000
    tol_solve: float = 1e-6
    max_iter: int = 1000
    restart: int = 30
    jitter: float = 1e-13  # pivots under this share of a block's norm are raised to it
    samples: int = 600  # points of the whole set that stand for what is far
    seed: int = 42


def parse(arguments: list[str], start: Options = Options()) -> Options:
    """Options from ``--name value`` pairs; an unknown name or a missing value is an error."""
    kinds, given = {f.name: type(getattr(start, f.name)) for f in fields(start)}, asdict(start)
    for name, value in zip(arguments[::2], [*arguments[1::2], *[None] * (len(arguments) % 2)], strict=True):
        key = name.removeprefix("--").replace("-", "_")
        if not name.startswith("--") or key not in kinds or value is None:
            raise ValueError(f"not an option with a value: {name}")
        given[key] = value.lower() in ("1", "true", "yes") if kinds[key] is bool else kinds[key](value)
    return Options(**given)


def as_table(spark: SparkSession, options: Options) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in asdict(options).items()], "name string, value string")
