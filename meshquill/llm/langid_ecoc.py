"""Language ID by error-correcting output codes.

Every language has a codeword; one linear classifier over hashed byte n-grams
predicts each bit. Decoding adds up, for every language, the exponential loss
of the bits against its codeword, weighted by how well a bit's classifier does
on that language; the least loss wins, and a small lead is flagged ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import held_out_col, ship
from .training import bounded_ids

#: Bound of the labelled sample; hashed n-gram dimensions; ridge penalty.
MAX_LABELLED, DIMS, RIDGE = 4000, 2048, 0.05
AMBIGUOUS = 0.6
#: Languages up to which all distinct splits of the languages are used as bits.
_EXHAUSTIVE = 6
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Unit vectors (rows x dims) of hashed 2- and 3-grams of whole texts,
    letters lower-cased (A-Z), everything that is no letter as a space."""
    n = len(offsets) - 1
    out = np.zeros((n, dims), np.float32)
    shift = np.uint32(32 - int(np.log2(dims)))
    folded = _FOLD[data]
    for i in range(n):
        text, total = folded[offsets[i] : offsets[i + 1]], np.zeros(dims, np.int64)
        for lo in range(0, len(text), bv.BLOCK):
            b = text[max(0, lo - 2) : lo + bv.BLOCK].astype(np.uint32)
            two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
            total += np.bincount(two >> shift, minlength=dims)
            if len(b) > 2:
                three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
                total += np.bincount(three >> shift, minlength=dims)
        out[i] = np.sqrt(total)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def batch_grams(col, dims: int = DIMS) -> np.ndarray:
    data, offsets = bv.buffers(col)
    parts = [grams(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], dims) for a, z in bv.row_slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, dims), np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: every distinct split of up to _EXHAUSTIVE
    languages, else random columns chosen for the largest least distance."""
    if n < 2:
        return np.ones((n, 1))
    if n <= _EXHAUSTIVE:
        columns = [[1, *(1 if (k >> i) & 1 else -1 for i in range(n - 1))] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, least
    return best


class Model:
    def __init__(self, x: np.ndarray, langs: list[str], ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        which = np.array([self.langs.index(v) for v in langs], int)
        self.code = codewords(len(self.langs))
        if not len(self.langs):
            return
        per = 1 / np.bincount(which)[which]  # languages weigh alike
        w = (per / per.mean())[:, None]
        self.mean = (x * w).mean(0).astype(np.float32)
        centred = (x - self.mean).astype(np.float64)
        y = self.code[which]
        gram = centred.T @ (centred * w) + ridge * len(x) / 100 * np.eye(x.shape[1])
        self.bias = (y * w).mean(0)
        self.weights = np.linalg.solve(gram, centred.T @ ((y - self.bias) * w)).astype(np.float32)
        right = np.sign(self._bits(x)) == y
        trust = np.array([right[which == k].mean(0) for k in range(len(self.langs))])
        self.trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-9)

    def _bits(self, x):
        return (x - self.mean) @ self.weights + self.bias

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language's place, score, margin) of each row: the softmax of the
        negative losses, and its lead over the runner-up."""
        margin = np.clip(self._bits(x) * 2, -4, 4)
        loss = (self.trust[None] * np.exp(-margin[:, None, :] * self.code[None])).sum(2)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, axis=1)
        lead = top[:, -1] - top[:, -2] if p.shape[1] > 1 else np.ones(len(p))
        return best, top[:, -1], lead


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """A model of at most max_labelled documents with a language, none held out."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    ship(docs.sparkSession)
    ids = bounded_ids(own.filter("lang is not null and text is not null").select("doc_id"), max_labelled).distinct()
    sample = own.filter("lang is not null and text is not null").join(F.broadcast(ids), "doc_id")

    def scan(batches):
        for b in batches:
            if b.num_rows:
                x = batch_grams(b.column(1)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "lang", "x"])

    rows = sample.select("doc_id", "text", "lang").mapInArrow(scan, "doc_id long, lang string, x binary").dropDuplicates(["doc_id", "lang"]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float16).reshape(-1, DIMS).astype(np.float32)
    return Model(x, [r["lang"] for r in rows])


def identify_language(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every whole text.

    Learns from at most ``max_labelled`` documents (least id hash) with a
    language, whose crc32(id) mod 5 is not 0. Only the text is an input of a
    prediction.

    Null texts and texts without a letter (Unicode category L) are ``und`` with score 0 and
    ambiguous; so is everything when no language could be learnt. A null id is
    not held out and never learnt from. Repeated rows each give a row. Other
    columns are ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, lang_col, id_col, text_col, max_labelled))

    def scan(batches):
        m = model.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                known = np.array([t is not None and bool(_LETTER.search(t)) for t in part.column(1).to_pylist()], bool)
                if m.langs and known.any():
                    best, score, lead = m.decode(batch_grams(part.column(1)))
                    names = [m.langs[k] if ok else "und" for k, ok in zip(best, known)]
                    score, unsure = np.where(known, score, 0.0), (lead < AMBIGUOUS) | ~known
                else:
                    names, score, unsure = ["und"] * len(known), np.zeros(len(known)), np.ones(len(known), bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1).astype(float)), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = own.mapInArrow(scan, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return named.select("doc_id", held_out_col(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
