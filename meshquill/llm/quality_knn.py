"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A bounded sample of labelled documents is turned into term vectors (words in
hashed bins, classes of neighbouring bytes, word shapes, levels of repetition),
weighted by tf-idf and projected on the leading singular directions. The labelled vectors, of fixed
number and length, are broadcast; every document's exact cosine products with
all of them are computed in blocks, and the nearest ones vote with their
similarity as weight.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import held_out_col, ship
from .training import bounded_ids, one_label, with_texts

#: Bound of the labelled sample, rank of the projection, neighbours that vote.
MAX_LABELLED, RANK, NEIGHBOURS = 4000, 48, 25
THRESHOLD = 0.3
#: A neighbour's weight is its similarity to this power.
SHARPNESS = 1
_N = 16
_CLASS = np.full(256, 15, np.uint8)
for _chars, _c in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\v\f\r", 4), (b"\n", 5), (b".", 7), (b",", 8), (b"!?", 9), (b"|", 10), (b"#*$%&", 11), (b"<>{}[]()=\\/;", 12), (b"-'\"_:", 13), (b"@+~^`", 14)):
    _CLASS[list(_chars)] = _c
_CLASS[128:] = 6
_LEVELS = 12
_VOCABULARY = 1 << 11
_SHAPES = 2 * _N * _N + 5 * _LEVELS
SIZE = _SHAPES + _VOCABULARY


def _level(share: np.ndarray) -> np.ndarray:
    """0 for nothing, then finer steps near zero."""
    return np.where(share <= 0, 0, np.clip(_LEVELS - 1 + np.floor(np.log2(np.maximum(share, 1e-9))), 1, _LEVELS - 1)).astype(np.int64)


def _grouped(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Per row, how many of its keys occurred before in the row."""
    if not len(keys):
        return np.zeros(n)
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[again], minlength=n)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts (rows x SIZE) of whole texts."""
    n = len(offsets) - 1
    out = np.zeros((n, SIZE), np.float32)
    cls = _CLASS[data]
    for i in range(n):
        c = cls[offsets[i] : offsets[i + 1]].astype(np.int32)
        if len(c) > 1:
            out[i, : _N * _N] = np.bincount(c[:-1] * _N + c[1:], minlength=_N * _N)
    starts, ends = bv.word_spans(data, offsets)
    hashes, bounds = bv.word_hashes(data, offsets, (starts, ends))
    row = np.repeat(np.arange(n), np.diff(bounds))
    if len(starts):
        term = row * _VOCABULARY + (hashes >> np.uint64(53)).astype(np.int64)
        out[:, _SHAPES:] = np.bincount(term, minlength=n * _VOCABULARY).reshape(n, -1)
        shape = row * _N * _N + cls[starts].astype(np.int64) * _N + cls[ends - 1]
        out[:, _N * _N : 2 * _N * _N] = np.bincount(shape, minlength=n * _N * _N).reshape(n, -1)
    words = np.maximum(np.diff(bounds), 1)
    same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    adjacent = np.bincount(row[1:][same], minlength=n) / words
    seen = _grouped(hashes, row, n) / words
    grams = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7) if len(hashes) > 2 else hashes[:0]
    inside = row[2:] == row[:-2] if len(hashes) > 2 else np.zeros(0, bool)
    tri = _grouped(grams[inside], row[2:][inside] if len(hashes) > 2 else row[:0], n) / words
    lines = np.array([bytes(data[offsets[i] : offsets[i + 1]]).count(b"\n") for i in range(n)]) / words
    size = np.clip(np.log2(words).astype(np.int64), 0, _LEVELS - 1)
    at = 2 * _N * _N
    for k, level in enumerate((_level(adjacent), _level(seen), _level(tri), _level(lines), size)):
        out[np.arange(n), at + k * _LEVELS + level] = words
    return out


def batch_counts(col) -> np.ndarray:
    data, offsets = bv.buffers(col)
    parts = [term_counts(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]) for a, z in bv.row_slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, SIZE), np.float32)


def leading(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration."""
    start = np.random.default_rng(1).standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    q = np.linalg.qr(start)[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, vectors = np.linalg.eigh((q.T @ (x.T @ (x @ q))).astype(np.float64))
    return np.ascontiguousarray(q @ vectors[:, ::-1][:, :rank].astype(np.float32))


class Model:
    """Latent-semantic vectors of the labelled sample."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS):
        n = len(counts)
        self.idf = (np.log((1 + n) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        x = self._weigh(counts)
        self.axes = leading(x, rank)
        self.points, self.labels, self.k = self._unit(x @ self.axes), labels.astype(np.float64), min(neighbours, n)

    def _weigh(self, counts):
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        return self._unit((np.sqrt(share) * self.idf).astype(np.float32))

    @staticmethod
    def _unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of the neighbours' similarity that votes for label 1."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        out = np.empty(len(counts))
        for lo in range(0, len(counts), 256):
            sim = self._unit(self._weigh(counts[lo : lo + 256]) @ self.axes) @ self.points.T
            least = np.partition(sim, -self.k, axis=1)[:, -self.k][:, None]
            row, near = np.nonzero(sim >= least)  # all ties vote
            weight = np.maximum(sim[row, near].astype(np.float64), 0) ** SHARPNESS
            total = np.bincount(row, weight, len(sim))
            votes = np.bincount(row, weight * self.labels[near], len(sim))
            out[lo : lo + 256] = np.where(total > 0, votes / np.maximum(total, 1e-300), self.labels.mean())
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """A model of at most max_labelled labelled documents, none held out."""
    ship(docs.sparkSession)
    ids = bounded_ids(one_label(labels, id_col, F.col(label_col)), max_labelled)

    def scan(batches):
        for b in batches:
            if b.num_rows:
                counts = batch_counts(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([zlib.compress(c.tobytes(), 1) for c in counts], pa.binary())], names=["doc_id", "y", "counts"])

    rows = with_texts(docs, ids, id_col, text_col).select("doc_id", "text", "y").mapInArrow(scan, "doc_id long, y int, counts binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    counts = np.frombuffer(b"".join(zlib.decompress(r["counts"]) for r in rows), np.float32).reshape(-1, SIZE)
    return Model(counts, np.array([r["y"] for r in rows], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Learns from at most ``max_labelled`` labelled documents (least id hash)
    whose crc32(id) mod 5 is not 0. Only the text is an input of a score.

    Null and empty texts are scored like any other, from a vector without
    terms (the sample's mean label). Without any label the score is 0.5. A null
    id is not held out and never learnt from. Repeated labels count by
    majority, 1 on a tie; repeated documents each give a row. Other columns are
    ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, id_col, text_col, max_labelled))

    def scan(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.score(batch_counts(part.column(1))))], names=["doc_id", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = own.mapInArrow(scan, "doc_id long, score double")
    return scored.select("doc_id", held_out_col(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
