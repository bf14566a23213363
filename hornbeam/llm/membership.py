"""A set of ids as a bit table of fixed size: never misses a member, lets some others pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = 65536
_MARKS = "part int, marks binary"


def marks(slots: DataFrame, bits: int = 23) -> np.ndarray:
    """A packed table of 2**bits bits, those of the slots in the single column set: 1 MB, whatever the number of rows."""
    name = slots.columns[0]

    def mark(batches):
        seen = np.zeros(1 << bits, bool)
        for pdf in batches:
            seen[pdf[name].to_numpy()] = True
        packed = np.packbits(seen)
        for part in range(-(-len(packed) // _PART)):
            if (own := packed[part * _PART : (part + 1) * _PART]).any():
                yield pd.DataFrame({"part": [part], "marks": [own.tobytes()]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "marks": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["marks"]]).tobytes()]})

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in slots.mapInPandas(mark, _MARKS).groupBy("part").applyInPandas(join, _MARKS).collect():
        own = np.frombuffer(bytes(r["marks"]), np.uint8)
        out[r["part"] * _PART : r["part"] * _PART + len(own)] = own
    return out


def maybe_among(ids: DataFrame, bits: int = 23) -> Callable[[Column], Column]:
    """A condition on an id column, false only for ids that are not in the single column of ``ids``.

    The table has 2**bits bits (1 MB) whatever the number of ids, so it may be broadcast; a join then
    settles the ids that pass.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    known = ids.sparkSession.sparkContext.broadcast(marks(ids.select(slot(F.col(ids.columns[0])).alias("slot")), bits))

    @F.pandas_udf("boolean")
    def may(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((known.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return lambda c: may(slot(c))
