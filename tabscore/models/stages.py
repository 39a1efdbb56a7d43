"""Pipeline stages that Spark ML does not have."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MeanProbability(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Average the class-1 probability of several members into one vector."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        members = self.getInputCols()
        p1 = reduce(add, [F.get(vector_to_array(F.col(c)), F.lit(1)) for c in members]) / F.lit(float(len(members)))
        averaged = df.withColumn("__p1", p1)
        vector = array_to_vector(F.array(1 - F.col("__p1"), F.col("__p1")))
        return averaged.withColumn(self.getOutputCol(), vector).drop("__p1", *members)


class ClassVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A column of class-1 probabilities as a vector of both classes."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        p1 = F.col(self.getInputCol())
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(1 - p1, p1)))


class MatrixProjection(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``W x + b`` of a vector column, or its scaled cosine.

    One Arrow batch is one matrix product.
    """

    weights = Param(Params._dummy(), "weights", "rows of W", TypeConverters.toListListFloat)
    offsets = Param(Params._dummy(), "offsets", "b", TypeConverters.toListFloat)
    cosine = Param(Params._dummy(), "cosine", "use sqrt(2/rows) * cos", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, weights=None, offsets=None, cosine=False):
        super().__init__()
        self._setDefault(cosine=False)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        w = np.asarray(self.getOrDefault(self.weights), dtype=float)
        b = np.asarray(self.getOrDefault(self.offsets), dtype=float)
        cosine = self.getOrDefault(self.cosine)

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            out = np.stack(x.to_numpy()) @ w.T + b
            if cosine:
                out = np.sqrt(2.0 / len(w)) * np.cos(out)
            return pd.Series(list(out))

        projected = project(vector_to_array(F.col(self.getInputCol())))
        return df.withColumn(self.getOutputCol(), array_to_vector(projected))


class GatedMargin(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Gate-weighted mean of expert margins as a probability and a class.

    Inputs: the gate probabilities and the expert margins, one entry per expert.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        gate, margins = [vector_to_array(F.col(c)) for c in self.getInputCols()]
        mixed = F.aggregate(F.zip_with(gate, margins, lambda g, m: g * m), F.lit(0.0), lambda a, x: a + x)
        out = df.withColumn("__m", mixed).drop(*self.getInputCols())
        p1 = 1 / (1 + F.exp(-F.col("__m")))
        vector = array_to_vector(F.array(1 - p1, p1))
        label = F.when(F.col("__m") > 0, 1.0).otherwise(0.0)
        return out.withColumns({self.getOutputCol(): vector, "prediction": label}).drop("__m")
