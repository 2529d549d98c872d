"""Encoders: rows to token vectors. Trained networks plug in here; HashEncoder is a
deterministic stand-in that needs no weights."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import kmers as K

MAX_TOKENS = 256
MAX_WEIGHTS = 65_536
CLS, EOS = "<cls>", "<eos>"


class Encoder(ABC):
    """What a trained network has to offer: subclasses set ``dim``."""

    dim: int

    @abstractmethod
    def encode(self, seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token vectors of all texts end to end, and the number of each."""


class HashEncoder(Encoder):
    """A unit vector per residue from a hash of the k-mer around it, special tokens
    included at both ends, cut to ``max_tokens``."""

    def __init__(self, dim: int = 32, k: int = 3, max_tokens: int = MAX_TOKENS):
        self.dim, self.k, self.max_tokens = dim, k, max_tokens

    def encode(self, seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, offsets = K.residues(seqs)
        keys, counts = [], []
        for i in range(len(offsets) - 1):
            own = codes[offsets[i] : offsets[i + 1]].astype(np.int64)
            padded = np.r_[[20] * (self.k // 2), own, [20] * (self.k // 2)]
            around = sum(padded[j : j + len(own)] * 21**j for j in range(self.k)) if len(own) else own
            tokens = np.r_[-1, around, -2][: self.max_tokens]
            keys.append(tokens)
            counts.append(len(tokens))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        raw = np.stack([K.mix(keys, salt) for salt in range(self.dim)], axis=1) if len(keys) else np.zeros((0, self.dim), np.uint64)
        vec = raw.astype(np.float64) / 2.0**63 - 1
        return (vec / np.linalg.norm(vec, axis=1, keepdims=True)).astype(np.float32), np.array(counts, np.int64)


def read_weights(spark: SparkSession, path: str) -> np.ndarray:
    """A matrix from a table ``(row int, weights array<double>)``, at most MAX_WEIGHTS rows."""
    rows = spark.read.parquet(path).orderBy("row").limit(MAX_WEIGHTS + 1).collect()
    if len(rows) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} rows of weights")
    return np.array([r["weights"] for r in rows], np.float64)


class ProjectedEncoder(Encoder):
    """Token vectors of another encoder times a matrix (out x in), at unit length: the
    projection that follows a backbone in late interaction."""

    def __init__(self, base: Encoder, weights: np.ndarray):
        if weights.ndim != 2 or weights.shape[1] != base.dim:
            raise ValueError("weights have a row per output and a column per dimension of the encoder")
        self.base, self.weights, self.dim = base, weights, len(weights)

    def encode(self, seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        vec, n = self.base.encode(seqs)
        out = vec.astype(np.float64) @ self.weights.T
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32), n


def encode_tokens(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """``(id, toks)`` of ``texts(id, seq)``. The encoder travels with the task and is
    used batch by batch; one that loads weights does so on first use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                vec, n = encoder.encode(batch.column("seq"))
                inner = pa.ListArray.from_arrays(np.arange(0, vec.size + 1, encoder.dim, dtype=np.int32), vec.ravel())
                toks = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), inner)
                yield pa.RecordBatch.from_arrays([batch.column("id"), toks], names=["id", "toks"])

    return texts.select("id", "seq").where("seq is not null").mapInArrow(run, "id long, toks array<array<float>>")


def encode_pooled(texts: DataFrame, encoder: Encoder, inner: bool = False, weights: np.ndarray | None = None) -> DataFrame:
    """``(id, vec)``: the mean of all token vectors, times ``weights`` (out x in) if given;
    with ``inner`` that of the tokens between the special ones, at unit length. Zeros if
    there is none."""
    width = encoder.dim if weights is None else len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                vec, n = encoder.encode(batch.column("seq"))
                low, high = np.cumsum(n) - n, np.cumsum(n)
                if inner:
                    low, high = low + 1, np.maximum(high - 1, low + 1)
                run_sum = np.vstack([np.zeros((1, encoder.dim)), np.cumsum(vec, axis=0, dtype=np.float64)])
                pooled = (run_sum[high] - run_sum[low]) / np.maximum(high - low, 1)[:, None]
                if weights is not None:
                    pooled = pooled @ weights.T
                if inner:
                    pooled /= np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)
                lists = pa.ListArray.from_arrays(np.arange(0, pooled.size + 1, width, dtype=np.int32), pooled.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "vec"])

    return texts.select("id", "seq").where("seq is not null").mapInArrow(run, "id long, vec array<double>")


def tokenize(seq: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Residues between the special tokens, cut to ``max_tokens``; no padding."""
    letters = F.filter(F.split(seq, ""), lambda x: x != "")
    return F.slice(F.concat(F.array(F.lit(CLS)), letters, F.array(F.lit(EOS))), 1, max_tokens)
