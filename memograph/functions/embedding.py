"""Text embeddings: a deterministic built-in one, and a wrapper for a model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from memograph.functions.text import search_tokens


def hashed_embedding(value: Column, dim: int = 64) -> Column:
    """Unit vector of signed token counts, one hash slot per token; zero for no tokens."""

    @F.arrow_udf("array<float>")
    def unit(slots: pa.Array) -> pa.Array:
        sizes, flat = np.diff(slots.offsets.to_numpy()), slots.flatten().to_numpy(zero_copy_only=False).astype("int64")
        cells = np.repeat(np.arange(len(slots)), sizes) * dim + np.abs(flat) - 1
        table = np.bincount(cells, np.sign(flat), len(slots) * dim).astype("float64").reshape(len(slots), dim)
        norms = np.sqrt((table * table).sum(axis=1, keepdims=True))
        made = np.divide(table, norms, out=np.zeros_like(table), where=norms > 0).astype("float32")
        return pa.ListArray.from_arrays(np.arange(len(slots) + 1, dtype="int32") * dim, made.ravel())

    # Slots are numbered from 1 so that the sign of a slot number carries the sign of the count.
    slots = F.transform(
        search_tokens(value),
        lambda t: (F.pmod(F.xxhash64(t), F.lit(dim)) + 1).cast("int")
        * F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1).otherwise(-1),
    )
    return unit(slots)


def model_embedding(encode: Callable[[list[str]], np.ndarray], batch: int = 16) -> Callable[[Column], Column]:
    """Column function around an encoder of text batches; vectors are brought to unit length."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        parts = [np.asarray(encode(list(texts[i : i + batch])), dtype="float32") for i in range(0, len(texts), batch)]
        table = np.concatenate(parts) if parts else np.empty((0, 1), dtype="float32")
        norms = np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(table / norms), index=texts.index)

    return run
