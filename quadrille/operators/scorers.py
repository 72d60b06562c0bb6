"""Scorers of quartets. Without trained weights the closed form of sites.scores is used."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = ["q0", "q1", "q2", "q3"]


def histograms(patterns: DataFrame) -> DataFrame:
    """(q0..q3, pat, n) -> (q0..q3, hist): the 256 frequencies of each quartet."""
    pairs = F.map_from_entries(F.collect_list(F.struct("pat", "n")))
    rows = patterns.groupBy(*Q).agg(pairs.alias("m"), F.sum("n").alias("total"))
    return rows.select(*Q, F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("total"), F.lit(0.0))).alias("hist"))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def layer_norm(x: np.ndarray, gain: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + eps) * gain + shift


def mlp(weights: dict[str, np.ndarray], x: np.ndarray, prefix: str = "mlp") -> np.ndarray:
    """Linear layers prefix.0, prefix.1, ... with rectifiers between them."""
    n = sum(k.startswith(f"{prefix}.") and k.endswith(".w") for k in weights)
    for i in range(n):
        x = x @ weights[f"{prefix}.{i}.w"] + weights[f"{prefix}.{i}.b"]
        if i < n - 1:
            x = np.maximum(x, 0)
    return x


def shared_tiles(q: np.ndarray, least: int = 3, tile: int = 256) -> dict[int, list[tuple[int, np.ndarray]]]:
    """For each tile of rows the tiles of columns with pairs that share so many taxa, and which pairs these are.

    Quartets in order of their taxa share most within a tile's neighbourhood, so most tiles are empty and none of their scores is made. A pair is
    compared by its taxa as bits: a block has 64 taxa at most. Every quartet goes with itself.
    """
    taxa, at = np.unique(q, return_inverse=True)
    if len(taxa) > 64:
        raise ValueError("a block has more than 64 taxa")
    bits = np.bitwise_or.reduce(np.uint64(1) << at.reshape(q.shape).astype(np.uint64), axis=1)
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i in range(0, len(q), tile):
        out[i] = []
        for j in range(0, len(q), tile):
            pairs = np.bitwise_count(bits[i : i + tile, None] & bits[None, j : j + tile]) >= least
            if i == j:
                pairs |= np.eye(len(pairs), dtype=bool)
            if pairs.any():
                out[i].append((j, pairs))
    return out


def attention(x: np.ndarray, tiles: dict[int, list[tuple[int, np.ndarray]]], weights: dict[str, np.ndarray], prefix: str, heads: int) -> np.ndarray:
    """Multi-head attention over the pairs of the tiles.

    A tile of rows goes over its tiles of columns once, with a running maximum, sum and mean, so no matrix of all pairs is held.
    """
    q, k, v = (x @ weights[f"{prefix}.{n}.w"] + weights[f"{prefix}.{n}.b"] for n in "qkv")
    d = q.shape[-1] // heads
    split = lambda y: y.reshape(len(y), heads, d).transpose(1, 0, 2)
    q, k, v = split(q) / np.sqrt(d), split(k), split(v)
    out = np.empty_like(q)
    for i, columns in tiles.items():
        rows = q[:, i : i + len(columns[0][1])]
        top, total, mean = np.full(rows.shape[:2], -np.inf), np.zeros(rows.shape[:2]), np.zeros(rows.shape)
        for j, pairs in columns:
            here = slice(j, j + pairs.shape[1])
            scores = np.where(pairs, rows @ k[:, here].transpose(0, 2, 1), -np.inf)
            high = np.maximum(top, scores.max(-1))
            safe = np.where(np.isfinite(high), high, 0.0)
            fade, part = np.exp(top - safe), np.exp(scores - safe[..., None])
            total = total * fade + part.sum(-1)
            mean = mean * fade[..., None] + part @ v[:, here]
            top = high
        out[:, i : i + rows.shape[1]] = mean / total[..., None]
    return out.transpose(1, 0, 2).reshape(len(x), heads * d) @ weights[f"{prefix}.o.w"] + weights[f"{prefix}.o.b"]


def transformer(weights: dict[str, np.ndarray], hist: np.ndarray, q: np.ndarray, members: np.ndarray, heads: int = 16) -> np.ndarray:
    """Class logits of a block's quartets: histograms through an MLP, joined with marks of the block's taxa, then layers of masked attention."""
    marks = (q[:, :, None] == members[None, None, :]).any(1).astype(float)
    x = np.concatenate([mlp(weights, hist, "embed"), marks], 1) @ weights["join.w"] + weights["join.b"]
    tiles = shared_tiles(q)
    layer = 0
    while f"layer{layer}.q.w" in weights:
        p = f"layer{layer}"
        x = layer_norm(x + attention(x, tiles, weights, p, heads), weights[f"{p}.n1.g"], weights[f"{p}.n1.b"])
        x = layer_norm(x + mlp(weights, x, f"{p}.ff"), weights[f"{p}.n2.g"], weights[f"{p}.n2.b"])
        layer += 1
    return x @ weights["out.w"] + weights["out.b"]


def load_weights(spark, path: str) -> dict[str, np.ndarray]:
    """Arrays of an .npz file, read by Spark from any store. Pickled objects are refused."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with np.load(io.BytesIO(bytes(raw)), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def mlp_scores(hists: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(q0..q3, hist) -> (q0..q3, w0..w2): 100 times the class probabilities of the MLP."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = 100 * softmax(mlp(weights, np.stack(b["hist"].to_numpy()) if len(b) else np.zeros((0, 256))))
            yield b[Q].assign(w0=w[:, 0], w1=w[:, 1], w2=w[:, 2])

    return hists.mapInPandas(score, "q0 long, q1 long, q2 long, q3 long, w0 double, w1 double, w2 double")


def transformer_scores(hists: DataFrame, weights: dict[str, np.ndarray], heads: int = 16) -> DataFrame:
    """(block_id, q0..q3, hist) -> (block_id, q0..q3, w0..w2): a block of 24 taxa has 10626 quartets, which bounds a group."""

    def score(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        q = b[Q].to_numpy()
        w = 100 * softmax(transformer(weights, np.stack(b["hist"].to_numpy()), q, np.unique(q), heads))
        return b[["block_id", *Q]].assign(w0=w[:, 0], w1=w[:, 1], w2=w[:, 2])

    return hists.groupBy("block_id").applyInPandas(score, "block_id long, q0 long, q1 long, q2 long, q3 long, w0 double, w1 double, w2 double")
