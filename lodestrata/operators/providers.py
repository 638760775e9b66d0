"""Models behind small interfaces: a function over a list of texts becomes a Column, batch by batch.

A failing batch is halved until the bad text stands alone, which then gives null; errors that pass are tried again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Model = Callable[[list[str]], list]


class Passing(Exception):
    """An error that may pass: the same call is worth another try."""


def isolated(model: Model, texts: list[str], tries: int = 3, wait: float = 0.1) -> list:
    """What the model gives for each text; None for those it can't take."""
    for n in range(tries):
        try:
            return list(model(texts))
        except Passing:
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)
        except Exception:  # noqa: BLE001
            break
    if len(texts) == 1:
        return [None]
    half = len(texts) // 2
    return isolated(model, texts[:half], tries, wait) + isolated(model, texts[half:], tries, wait)


def applied(model: Model, text: Column, kind: str, batch: int = 512, tries: int = 3) -> Column:
    """The model's value of each text as a Column of the given type; nulls and blanks are given as a single space."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = [t if t and t.strip() else " " for t in texts]
            out: list = []
            for at in range(0, len(given), batch):
                out += isolated(model, given[at : at + batch], tries)
            yield pd.Series(out, dtype=object)

    return run(text)


def unit(vector: Column) -> Column:
    """The vector over its length; a vector of length 0 stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(x))
