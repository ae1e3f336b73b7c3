"""Fragments embedded by the encoder of their sector, in batches, each model loaded once in a worker."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrank.operators.parsing import cached
from tallyrank.operators.rank import encoder_column

#: Texts to a call of a model, and tokens of a text that a model reads. Fixed values of the encoders.
BATCH, TOKENS = 32, 512
#: Words whose places an encoder remembers.
WORDS = 1 << 17


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """The offline encoder: a vector of signed counts of the first ``TOKENS`` words. Words are hashed together with the encoder's name,
    so two encoders differ: the first 15 hexadecimal digits of the MD5 give the place and, by the next bit, the sign."""

    def __init__(self, name: str, dim: int = 64):
        self.name, self.dim, self._known = name, dim, {}

    def _place(self, word: str) -> int:
        """Where a word counts: below ``dim`` as minus one, above it as one."""
        if (at := self._known.get(word)) is None:
            h = int(md5(f"{self.name}:{word}".encode()).hexdigest()[:15], 16)
            if len(self._known) >= WORDS:
                self._known.clear()
            at = self._known[word] = h % (2 * self.dim)
        return at

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            words = (text or "").lower().split()[:TOKENS]
            n = np.bincount(np.fromiter(map(self._place, words), np.int64, len(words)), minlength=2 * self.dim)
            out[i] = n[self.dim :] - n[: self.dim]
        return out


def embed_by(load: Callable[[str], Encoder] = HashedWords) -> Callable[[Column, Column], Column]:
    """A column function of (text, encoder's name). Rows reach Python ``BATCH`` at a time; a batch is split by encoder, and ``load`` is
    called once for each encoder in each worker."""

    def make():
        def predict(texts: np.ndarray, names: np.ndarray) -> np.ndarray:
            texts, names = texts.reshape(-1), names.reshape(-1)
            out: np.ndarray | None = None
            for name in sorted(set(names)):
                at = np.flatnonzero(names == name)
                made = cached(load, name).encode([texts[i] for i in at])
                out = np.zeros((len(texts), made.shape[1]), np.float32) if out is None else out
                out[at] = made
            return out

        return predict

    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=BATCH)


def embed_fragments(parts: DataFrame, load: Callable[[str], Encoder] = HashedWords, text: str = "fragment", sector: str = "sector") -> DataFrame:
    """Adds encoder and embedding: each fragment by the model that its sector is routed to; null texts are empty. Rows are dealt out by
    encoder and at random, so that a task's batches ask one model for the most part and a common sector has many tasks."""
    named = parts.withColumn("encoder", encoder_column(F.coalesce(F.col(sector), F.lit(""))))
    return named.withColumn("embedding", embed_by(load)(F.coalesce(F.col(text), F.lit("")), F.col("encoder")))
