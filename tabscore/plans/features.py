"""Feature jobs: raw contest rows to model-ready tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.functions.columns import bit_columns, split_code
from tabscore.operators.scaling import Scaler, SplitScaler
from tabscore.sources.tables import FEATURES

# SQL conditions on contest rows
ALL_TRAINING = "not tournament"
TRAIN_ONLY = "not tournament and validation = 0"
VALID_ONLY = "not tournament and validation = 1"
EVERYTHING = "true"
TOURNAMENT = "tournament"

FOUR_POPULATIONS = {"m1": ALL_TRAINING, "m2": TRAIN_ONLY, "m3": VALID_ONLY, "m4": EVERYTHING}
THREE_SPLITS = {"train": TRAIN_ONLY, "valid": VALID_ONLY, "tournament": TOURNAMENT}


@dataclass(frozen=True)
class BitEncoderModel:
    col: str
    width: int
    prefix: str
    larger: str

    def names(self) -> list[str]:
        return [f"{self.prefix}{i}" for i in range(1, self.width + 1)]

    def transform(self, df: DataFrame) -> DataFrame:
        _, code = split_code(self.col)
        if self.larger == "error":
            return bit_columns(df, code, self.width, self.prefix)
        known = df.withColumn("__code", code)
        fitting = F.when(F.col("__code").between(0, 2**self.width - 1), F.col("__code"))
        return bit_columns(known, fitting, self.width, self.prefix).drop("__code")


@dataclass(frozen=True)
class BitEncoder:
    """Encode the number of a ``token_number`` code as 0/1 columns.

    The width is fitted, so tables scored later get the same columns. A code
    that needs more bits raises, or gives NULL bits with ``larger='null'``.
    """

    col: str
    prefix: str = "c_"
    larger: str = "error"

    def fit(self, df: DataFrame) -> BitEncoderModel:
        _, code = split_code(self.col)
        # parse every code once, not every row
        largest = df.select(self.col).distinct().agg(F.max(code)).first()[0]
        return BitEncoderModel(self.col, max(1, int(largest or 0).bit_length()), self.prefix, self.larger)


def _scaled(rows: DataFrame, scaler, keys: list[str], condition: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Keys, bits and scaled features of the rows under ``condition``."""
    source = rows if fit_on is None else fit_on
    bits = BitEncoder("c1").fit(source.filter(ALL_TRAINING))
    model = scaler.fit(source)
    return model.transform(bits.transform(rows.filter(condition)), keep=[*keys, *bits.names()])


def scaled_features(rows: DataFrame, populations: dict[str, str] | None = None) -> DataFrame:
    """Training features scaled by several populations (``_m1.._m4``)."""
    scaler = Scaler(tuple(FEATURES), populations or FOUR_POPULATIONS)
    return _scaled(rows, scaler, ["id", "validation", "target"], ALL_TRAINING)


def scaled_tournament(rows: DataFrame, populations: dict[str, str] | None = None) -> DataFrame:
    """Tournament features scaled by the statistics of the training rows."""
    scaler = Scaler(tuple(FEATURES), populations or FOUR_POPULATIONS)
    return _scaled(rows, scaler, ["id"], TOURNAMENT).withColumnRenamed("id", "t_id")


def feature_table(rows: DataFrame, part: str) -> DataFrame:
    """Own-split scaling, scaled squares, scaled anchor products and bits.

    ``part='train'``: ``id, validation, target`` and 46 features;
    ``part='test'``: ``id`` and the same features.
    """
    if part == "train":
        keys, condition = ["id", "validation", "target"], ALL_TRAINING
        splits = {s: THREE_SPLITS[s] for s in ("train", "valid")}
    elif part == "test":
        keys, condition, splits = ["id"], TOURNAMENT, {"tournament": TOURNAMENT}
    else:
        raise ValueError(f"unknown part {part!r}")
    return _scaled(rows, SplitScaler(tuple(FEATURES), splits), keys, condition)


# variant -> populations of the scaled columns
FEATURE_SETS = {
    "all": FOUR_POPULATIONS,
    "train_only": {"m2": TRAIN_ONLY},
    "all_training": {"m1": ALL_TRAINING},
}


def feature_set(rows: DataFrame, name: str) -> DataFrame:
    """A named variant of the scaled training table."""
    return scaled_features(rows, FEATURE_SETS[name])
