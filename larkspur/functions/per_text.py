"""Python functions of one text as column functions: each distinct text of an Arrow batch is read once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def per_text(one: Callable[[str], object], returns: DataType) -> Callable[[Column], Column]:
    """``one`` of a text, null counting as empty; maps are lists of pairs, structs are dictionaries."""
    kind = to_arrow_type(returns)

    def run(texts: pa.Array) -> pa.Array:
        coded = texts.fill_null("").dictionary_encode()
        return pa.array([one(t) for t in coded.dictionary.to_pylist()], kind).take(coded.indices)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)
