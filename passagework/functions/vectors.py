"""Vectors as array columns: cosine, truncation, and embedders behind one interface."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 if a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def truncate_normalize(v: Column, n: int) -> Column:
    """The first n dimensions at unit length; a zero vector stays. """
    head = F.transform(F.slice(v, 1, n), lambda x: x.cast("double"))
    return bound(F.sqrt(dot(head, head)), lambda size: F.when(size > 0, F.transform(head, lambda x: x / size)).otherwise(head))


#: Directions that a worker remembers.
REMEMBERED = 50_000
_words = re.compile(r"[^\W_]+").findall


def _direction(word: str, dim: int) -> np.ndarray:
    """8 signed steps. Up to 256 dimensions by the bytes of the word's MD5, two a step: dimension `first mod dim`, plus 1 if the second is below 128, else minus 1.

    More dimensions take SHA-256 and four bytes a step: the first two give the dimension, the third the sign.
    """
    if dim <= 256:
        own = np.frombuffer(hashlib.md5(word.encode()).digest(), np.uint8).astype(np.int64)
        place, sign = own[::2], own[1::2]
    else:
        own = np.frombuffer(hashlib.sha256(word.encode()).digest(), np.uint8).astype(np.int64)
        place, sign = own[::4] * 256 + own[1::4], own[2::4]
    return np.bincount(place % dim, np.where(sign < 128, 1.0, -1.0), dim)


def hash_embed(text: str, dim: int = 256, known: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Sum over words (letters and digits, lower case) of (1 + ln tf) times a fixed direction of the word; unit length.

    known: directions met before, kept up to a bound.
    """
    known = {} if known is None else known
    words = Counter(_words(text.lower()))
    if not words:
        return np.zeros(dim, np.float32)
    if len(known) > REMEMBERED:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = _direction(w, dim)
    out = (1 + np.log(np.fromiter(words.values(), np.float64, len(words)))) @ np.stack([known[w] for w in words])
    size = np.linalg.norm(out)
    return (out / size if size else out).astype(np.float32)


def embedder(encode: Callable[[list[str]], np.ndarray], batch: int = 16, halvings: int = 2):
    """A pandas UDF over texts. A failing batch is retried text by text; a text that is too long is halved, `halvings` times at most, then null."""

    def one(text: str):
        for _ in range(halvings + 1):
            try:
                return encode([text])[0].tolist()
            except ValueError:
                text = text[: len(text) // 2]
        return None

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list = []
            for at in range(0, len(texts), batch):
                part = texts.iloc[at : at + batch].fillna("").tolist()
                try:
                    out += [v.tolist() for v in encode(part)]
                except ValueError:
                    out += map(one, part)
            yield pd.Series(out)

    return embed


def hash_encoder(dim: int = 256) -> Callable[[list[str]], np.ndarray]:
    known: dict[str, np.ndarray] = {}
    return lambda texts: np.stack([hash_embed(t, dim, known) for t in texts])


class StaticEncoder:
    """Sum of a table's rows over greedy word pieces of the lower-cased text, unit length."""

    def __init__(self, table: np.ndarray, pieces: dict[str, int], unknown: str = "[UNK]") -> None:
        self.table, self.pieces, self.unknown = table, pieces, pieces.get(unknown)

    @staticmethod
    def words(text: str) -> list[str]:
        spaced = "".join(f" {c} " if not c.isalnum() and not c.isspace() else c for c in text.lower())
        return spaced.split()

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for w in self.words(text):
            at, own = 0, []
            while at < len(w):
                end = next((e for e in range(len(w), at, -1) if ("##" if at else "") + w[at:e] in self.pieces), None)
                if end is None:
                    own = [self.unknown] if self.unknown is not None else []
                    break
                own.append(self.pieces[("##" if at else "") + w[at:end]])
                at = end
            out += own
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.table.shape[1]), np.float32)
        for i, t in enumerate(texts):
            ids = self.ids(t)
            if ids:
                v = self.table[ids].sum(axis=0)
                size = np.linalg.norm(v)
                out[i] = v / size if size else v
        return out


def read_table(raw: bytes, name: str | None = None) -> np.ndarray:
    """The two-dimensional float table of a safetensors file (32 or 16 bit)."""
    import json

    (size,) = struct.unpack("<Q", raw[:8])
    head = json.loads(raw[8 : 8 + size])
    for key, x in head.items():
        if key != "__metadata__" and len(x["shape"]) == 2 and x["dtype"] in ("F32", "F16") and name in (None, key):
            a, z = x["data_offsets"]
            return np.frombuffer(raw[8 + size + a : 8 + size + z], "<f4" if x["dtype"] == "F32" else "<f2").reshape(x["shape"]).astype(np.float32)
    raise ValueError("no two-dimensional float table")


def read_pieces(raw: bytes) -> dict[str, int]:
    """Word pieces of a tokenizer file in JSON."""
    import json

    return json.loads(raw)["model"]["vocab"]


def encode_vector(v: np.ndarray) -> bytes:
    return np.asarray(v, "<f4").tobytes()


def decode_vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f4")
