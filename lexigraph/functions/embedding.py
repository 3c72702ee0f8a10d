"""Embedders behind one seam, the registry of models, and the vector codec."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import stable_json
from ..errors import NotFound
from . import counting


@dataclass(frozen=True)
class Model:
    name: str
    dim: int
    kind: str  # hashing or neural
    query_prefix: str = ""
    doc_prefix: str = ""
    batch: int = 32  # texts that a neural encoder gets at once


#: The hashing model is the one that runs here; neural ones are plugged in with
#: register() by whoever has their weights.
MODELS: dict[str, Model] = {m.name: m for m in (Model("hashing-384", 384, "hashing"), Model("hashing-64", 64, "hashing"))}
_ENCODERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def register(model: Model, encode: Callable[[list[str]], np.ndarray]) -> None:
    """Adds a neural model: encode gives a row of dim numbers for each text, or the
    vectors of its tokens (texts x tokens x dim) and their mask, of which the
    mean is taken."""
    MODELS[model.name] = model
    _ENCODERS[model.name] = encode


def list_models() -> list[Model]:
    return list(MODELS.values())


def find_model(name: str) -> Model:
    if name not in MODELS:
        raise NotFound(f'no model "{name}"', {"model": name}, f"known: {', '.join(MODELS)}")
    return MODELS[name]


def space_id(model: Model, chunking: dict, version: str = "1") -> str:
    """Names an embedding space by all that its vectors depend on."""
    return sha256(stable_json({"model": asdict(model), "chunking": chunking, "version": version}).encode()).hexdigest()[:16]


#: FNV-1a's constants here, and below the half weight of a word's second bucket.
@lru_cache(maxsize=200_000)
def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for c in text:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    return h


def hashed_vector(text: str, dim: int) -> np.ndarray:
    """A bucket for each word, and half a one in a second bucket; unit length."""
    return hashed_vectors([text], dim)[0]


#: Texts whose vectors are made at once.
TEXTS = 512


def hashed_vectors(texts: list[str], dim: int) -> list[np.ndarray]:
    """The same of several texts, which are cut together; a word is hashed once."""
    out: list[np.ndarray] = []
    for i in range(0, len(texts), TEXTS):
        some = pa.array([t.lower() for t in texts[i : i + TEXTS]], pa.string())
        words, of, _ = counting._index_words(some)
        coded = words.dictionary_encode()
        code, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        v = np.zeros(len(some) * dim)
        for mark, weight in (("", 1.0), ("~", 0.5)):
            bucket = np.array([fnv1a(mark + w) % dim for w in known], np.int64)
            v += np.bincount(of * dim + bucket[code], minlength=len(v)) * weight
        v = v.reshape(len(some), dim)
        norm = np.sqrt((v**2).sum(axis=1, keepdims=True))
        out += list((v / np.where(norm > 0, norm, 1)).astype(np.float32))
    return out


def pooled(given) -> np.ndarray:
    """Rows as they are, or the means of the tokens that a mask marks."""
    if not isinstance(given, tuple):
        return np.asarray(given, np.float32)
    hidden, mask = np.asarray(given[0], np.float64), np.asarray(given[1], np.float64)[..., None]
    return ((hidden * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)).astype(np.float32)


def encode(texts: list[str], model: Model, query: bool = False, encoder: Callable | None = None) -> list[np.ndarray]:
    if model.kind == "hashing":
        return hashed_vectors(texts, model.dim)
    prefix = model.query_prefix if query else model.doc_prefix
    parts = [pooled((encoder or _ENCODERS[model.name])([prefix + t for t in texts[i : i + model.batch]])) for i in range(0, len(texts), model.batch)]
    rows = np.concatenate(parts) if parts else np.empty((0, model.dim), np.float32)
    if rows.shape != (len(texts), model.dim):
        raise ValueError(f"{model.name} gave vectors of shape {rows.shape}")
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return list((rows / np.where(norms > 0, norms, 1)).astype(np.float32))


def embed(text: Column, model: Model, query: bool = False) -> Column:
    encoder = _ENCODERS.get(model.name)  # goes with the function: tasks have a registry of their own

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encode([t or "" for t in texts], model, query, encoder))

    return run(text)


def encode_vector(v: Column) -> Column:
    """Little-endian 32-bit floats, packed."""

    @F.pandas_udf("binary")
    def pack(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x, "<f4").tobytes() for x in rows])

    return pack(v)


def decode_vector(blob: Column, dim: int) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        for x in b:
            if x is not None and len(x) != 4 * dim:
                raise ValueError(f"a vector of {len(x)} bytes, not {4 * dim}")
        return pd.Series([None if x is None else np.frombuffer(x, "<f4") for x in b])

    return unpack(blob)
