"""Unicode normalisation, for which Spark has no built-in: an Arrow-batched function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf


def normaliser(form: str = "NFKC"):
    """A function of a text column that gives its normal form; null stays null."""

    @pandas_udf("string")
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normalise
