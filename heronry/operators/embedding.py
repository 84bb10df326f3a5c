"""Embedders: functions (df, text column, vector column) -> df with the vectors of the texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot, tokenize

Embedder = Callable[[DataFrame, str, str], DataFrame]
DIMENSION = 64


def bucket(token: Column, n: int = DIMENSION) -> Column:
    """A token's bucket: a polynomial of its code points modulo n, which divides 2 ** 32."""
    return F.aggregate(F.split(token, ""), F.lit(0), lambda h, c: (h * 31 + F.ascii(c)) % n)


def hashed(text: Column | str, n: int = DIMENSION) -> Column:
    """Counts of the tokens' buckets at norm 1; zeros where there is no token."""
    found = F.transform(tokenize(text), lambda t: bucket(t, n))
    zeros = F.array_repeat(F.lit(0.0), n)
    add = lambda v, b: F.concat(F.slice(v, 1, b), F.array(F.element_at(v, b + 1) + 1.0), F.slice(v, b + 2, n - 1))
    return normalized(F.aggregate(found, zeros, add))


def normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def _buckets(tokens: list[str], n: int) -> np.ndarray:
    """bucket() of each token."""
    codes = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % n
    size = np.array([len(t) for t in tokens], np.int64)
    powers = np.ones(int(size.max(initial=0)) + 1, np.int64)
    for k in range(1, len(powers)):
        powers[k] = powers[k - 1] * 31 % n
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes)) - 1
    sums = np.concatenate([[0], np.cumsum(codes * powers[left] % n)])
    ends = np.cumsum(size)
    return (sums[ends] - sums[ends - size]) % n


def hash_embedder(n: int = DIMENSION) -> Embedder:
    """The built-in embedder: deterministic, no model. Distinct tokens of an Arrow batch are hashed once, all at a time."""

    @F.arrow_udf("array<double>")
    def vectors(tokens: pa.Array) -> pa.Array:
        flat = tokens.flatten().dictionary_encode()
        size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(tokens)), size)
        at = row * n + _buckets(flat.dictionary.to_pylist(), n)[flat.indices.to_numpy(zero_copy_only=False)] if len(row) else row
        v = np.bincount(at, minlength=len(tokens) * n).reshape(-1, n).astype(np.float64)
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return pa.ListArray.from_arrays(np.arange(0, v.size + 1, n, dtype=np.int32), pa.array((v / np.where(norm == 0, 1, norm)).ravel()))

    return lambda df, text, vector: df.withColumn(vector, vectors(tokenize(text)))


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = "", batch: int = 32) -> Embedder:
    """An embedder around a model: load() is called once in a Python worker and gives a function of lists of texts."""

    def run(df: DataFrame, text: str, vector: str) -> DataFrame:
        @F.pandas_udf("array<double>")
        def vectors(parts: pd.Series) -> pd.Series:
            model = loaded(load)
            own = [prefix + (t or "") for t in parts]
            return pd.Series([[float(x) for x in v] for a in range(0, len(own), batch) for v in model(own[a : a + batch])])

        return df.withColumn(vector, vectors(F.col(text)))

    return run


class FitOnce:
    """An embedder that fits itself on the first texts it is given, and stays as it is: fit(df, text) makes the embedder."""

    def __init__(self, fit: Callable[[DataFrame, str], Embedder]):
        self.fit, self.fitted = fit, None

    def __call__(self, df: DataFrame, text: str, vector: str) -> DataFrame:
        if self.fitted is None:
            self.fitted = self.fit(df, text)
        return self.fitted(df, text, vector)


def local_embedder(name: str, prefix: str = "", batch: int = 32) -> Embedder:
    """Embeds with a local sentence model, loaded once in a Python worker. Needs the package sentence_transformers there."""

    def load() -> Callable[[list[str]], list[list[float]]]:
        model = imported("sentence_transformers").SentenceTransformer(name)
        return lambda texts: model.encode(texts, normalize_embeddings=True).tolist()

    return model_embedder(load, prefix, batch)


def imported(package: str):
    import importlib

    try:
        return importlib.import_module(package)
    except ImportError as e:
        raise ImportError(f"{package} is needed to run local models; install it on the executors, or give an embedder of your own") from e


_models: dict[int, tuple] = {}


def loaded(load):
    """Models of this worker, at most four, the last used last."""
    key = id(load)
    held = _models.pop(key, None) or (load, load())
    _models[key] = held
    while len(_models) > 4:
        _models.pop(next(iter(_models)))
    return held[1]


def checked(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """df, which fails when run if a vector is missing or of another dimension."""
    wrong = F.coalesce(F.size(vector) != dimension, F.lit(True)) | F.col(vector).isNull()
    return df.withColumn(vector, F.when(wrong, F.raise_error(F.lit(f"embedding is missing or not of dimension {dimension}")).cast("array<double>")).otherwise(F.col(vector)))
