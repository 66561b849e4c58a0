"""Vector expressions and the default, model-free hash encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.spans import in_slices

HASH_DIMENSION = 8


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    size = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / size)


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def hash_counts_of(text: str, dimension: int = HASH_DIMENSION) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.bincount((points + np.arange(len(points))) % dimension, minlength=dimension).astype(np.float32)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def hash_counts(texts: pa.Array) -> pa.Array:
    """Character counts per bucket (code point + position) mod 8: exact small integers."""
    def counted(part: pa.Array) -> pa.Array:
        rows = np.array([hash_counts_of(t or "") for t in part.to_pylist()], dtype=np.float32).reshape(-1, HASH_DIMENSION)
        offsets = pa.array(np.arange(len(rows) + 1) * HASH_DIMENSION, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))

    return in_slices(texts, counted)


def encoder_udf(load: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "passage: "):
    """Wrap a model: ``load`` runs once per Python worker and returns texts -> matrix."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            matrix = np.asarray(model([prefix + (t or "") for t in texts]), dtype=np.float64)
            size = np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list((matrix / size).astype(np.float32)), index=texts.index)

    return encode


def token_windows(count: int, room: int, shared: int) -> list[tuple[int, int]]:
    """Windows of at most ``room`` tokens over ``count``, each ``shared`` tokens back into the one before; one window for none."""
    step = room - shared
    if step < 1:
        raise ValueError("windows must share fewer tokens than they hold")
    starts = range(0, max(1, count - shared), step)
    return [(s, min(count, s + room)) for s in starts]


def window_encoder(load: Callable[[], tuple[Callable[[str], list[int]], Callable[[np.ndarray, np.ndarray], np.ndarray]]], *,
                   room: int = 512, shared: int = 32, prefix: str = "passage: ", at_once: int = 16, pad: int = 0):
    """Wrap a token model so that no token of a long text is lost.

    ``load`` runs once per Python worker and returns ``tokens`` (text to ids) and ``model``, which maps ids
    and a mask (windows x length) to hidden states (windows x length x dimension). The windows of all texts
    of a batch go to the model ``at_once`` at a time, padded to the longest; each gives the masked mean of
    its hidden states, L2-normalised. The vector of a text is the normalised mean of its windows, summed up
    in its row, so that no window is shuffled. NULL counts as an empty text.
    """
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, model = load()

        def unit(x: np.ndarray) -> np.ndarray:
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

        for texts in batches:
            sums: np.ndarray | None = None
            number = np.zeros(len(texts), np.int64)
            waiting: list[tuple[int, list[int]]] = []

            def pooled() -> None:
                nonlocal sums
                size = max(1, max(len(ids) for _, ids in waiting))
                ids, mask = np.full((len(waiting), size), pad, np.int64), np.zeros((len(waiting), size), np.int64)
                for k, (_, own) in enumerate(waiting):
                    ids[k, :len(own)], mask[k, :len(own)] = own, 1
                hidden = np.asarray(model(ids, mask), np.float64)
                vectors = unit((hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9))
                owners = np.array([k for k, _ in waiting])
                if sums is None:
                    sums = np.zeros((len(texts), vectors.shape[1]))
                np.add.at(sums, owners, vectors)
                np.add.at(number, owners, 1)
                waiting.clear()

            for k, text in enumerate(texts.to_pylist()):
                own = tokens(prefix + (text or ""))
                for begin, end in token_windows(len(own), room, shared):
                    waiting.append((k, own[begin:end]))
                    if len(waiting) == at_once:
                        pooled()
            if waiting:
                pooled()
            found = unit(sums / number[:, None]).astype(np.float32) if sums is not None else np.zeros((0, 0), np.float32)
            offsets = pa.array(np.arange(len(texts) + 1) * found.shape[1], pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

    return encode
