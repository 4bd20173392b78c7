"""Unicode NFC, which Spark lacks: one Arrow-batched function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")
