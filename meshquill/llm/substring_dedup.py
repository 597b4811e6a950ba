"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

1. Documents are dealt to chunks by a hash of their id and text (one exchange
   of the texts, used twice). A chunk hashes every window of its documents and
   sends, for each distinct hash, its first document, packed by hash bucket:
   however often a passage occurs, a chunk sends it once. Buckets without an
   entry cost nothing, so work and messages follow the number of windows.
2. A bucket compares the chunks' lists and answers each with one bit per entry:
   the passage also starts in an earlier document of another chunk.
3. A chunk joins the answers with its own texts, hashes them again and merges
   the repeated windows into maximal removal intervals.

Windows are equal if their 64-bit hashes and 16 bits of an independent second
hash are: among n distinct windows n**2 / 2**81 pairs are expected to collide
(0.01 for the 1.5e11 windows of 1 TB, 93 for the 1.5e13 of 100 TB).
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import n_tasks, ship, text_bytes

CHUNK_BYTES, BUCKET_BYTES = 5 << 20, 10 << 20
_STEPS = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


def window_hashes(words: np.ndarray, bounds: np.ndarray, window: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window inside one document, its first word)."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    step = np.uint64(_STEPS[family])
    for k in range(window):
        h *= step
        h += words[k : k + n]
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return bv.mix(h[at]), at


def _grouped(h: np.ndarray, g: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order by hash pair and rank, or place; whether a row of that order
    starts a group of equal pairs). Second hashes are compared only where first
    ones are equal, and sorted only if they ever differ there."""
    keys = (h,) if rank is None else (rank, h)
    order = np.lexsort(keys)
    for full in (False, True):
        if full:
            order = np.lexsort((*keys[:-1], g, h))
        same, equal = h[order[1:]] == h[order[:-1]], g[order[1:]] == g[order[:-1]]
        if not (same & ~equal).any():
            break
    return order, np.concatenate((np.ones(min(len(h), 1), bool), ~(same & equal)))


class _Chunk:
    """The documents of one chunk in order, and their distinct windows by bucket."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        ids = table["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
        ties = table["tie"].to_numpy()
        order = np.lexsort((ties, ids))
        self.table, self.ids, self.ties = table.take(pa.array(order)), ids[order], ties[order]
        data, offsets = bv.buffers(self.table["text"])
        spans = bv.word_spans(data, offsets)
        words, self.bounds = bv.word_hashes(data, offsets, spans)
        self.data, self.offsets = data, offsets
        h, self.at = window_hashes(words, self.bounds, window)
        words, _ = bv.word_hashes(data, offsets, spans, 1)
        g = (window_hashes(words, self.bounds, window, 1)[0] >> np.uint64(48)).astype(np.uint16)
        del words
        order, new = _grouped(h, g, None)
        self.first, self.which = order[new], np.empty(len(h), np.int64)
        self.which[order] = np.cumsum(new) - 1
        h, g = h[self.first], g[self.first]
        doc = np.searchsorted(self.bounds, self.at[self.first], "right") - 1
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        #: Entries by bucket, then document; runs of one bucket.
        self.entry = np.lexsort((self.first, bucket))
        bucket = bucket[self.entry]
        self.cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))), len(bucket))
        self.buckets = bucket[self.cuts[:-1]].astype(np.int64)
        self.h, self.g, self.doc = h[self.entry], g[self.entry], doc[self.entry]

    def messages(self):
        """(bucket, hash pairs, ids and ties of their documents, entries of each)."""
        for k, b in enumerate(self.buckets.tolist()):
            lo, hi = self.cuts[k], self.cuts[k + 1]
            docs, n = np.unique(self.doc[lo:hi], return_counts=True)
            ids, ties = np.diff(self.ids[docs], prepend=0), (self.ties[docs] >> 32).astype(np.int32)
            yield b, self.h[lo:hi].tobytes() + self.g[lo:hi].tobytes(), ids.tobytes() + ties.tobytes(), n.astype(np.uint32).tobytes()


def _later(hashes: list[bytes], docs: list[bytes], sizes: list[bytes]) -> list[np.ndarray]:
    """Of each list's entries, those that an earlier document, or an equal one
    of an earlier list, has."""
    def halves(rows, a, b):
        """8 bytes of a column of type a, and a column of type b, of n rows each."""
        n = [len(x) // (8 + b().itemsize) for x in rows]
        return [np.frombuffer(x, a, k) for x, k in zip(rows, n)], np.concatenate([np.frombuffer(x, b, k, 8 * k) for x, k in zip(rows, n)])

    pairs, g = halves(hashes, np.uint64, np.uint16)
    steps, ties = halves(docs, np.int64, np.int32)
    h, ids = np.concatenate(pairs), np.concatenate([np.cumsum(x) for x in steps])
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ties, ids))] = np.arange(len(ids))
    rank = np.repeat(rank, np.frombuffer(b"".join(sizes), np.uint32))
    order, new = _grouped(h, g, rank)
    out = np.empty(len(h), bool)
    out[order] = ~new
    return np.split(out, np.cumsum([len(p) for p in pairs])[:-1])


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also
    starts earlier (smaller id, or same document and earlier start).

    Returns ``doc_id, n_words, n_removed, kept_text, removed``: kept words
    joined by one space, and the removed word ranges, end exclusive.

    Null or empty texts have no words and are kept as empty. A null id stands
    before all others. Rows that share an id stand in the order of a hash of
    their texts and are dealt by it; each gives a row. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = text_bytes(own, "text")
    chunks = max(n_tasks(spark), -(-n_bytes // chunk_bytes))
    buckets = max(n_tasks(spark), -(-n_bytes // BUCKET_BYTES))
    own = own.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(chunks)).cast("int").alias("chunk"))

    def send(table: pa.Table) -> pa.Table:
        rows = list(_Chunk(table, window, buckets).messages())
        column = lambda k: pa.array([r[k] for r in rows], pa.binary())
        return pa.table({
            "chunk": pa.array(np.full(len(rows), table["chunk"][0].as_py(), np.int32)),
            "bucket": pa.array([r[0] for r in rows], pa.int64()),
            "hashes": column(1), "docs": column(2), "sizes": column(3),
        })

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        found = _later(*(table[c].to_pylist() for c in ("hashes", "docs", "sizes")))
        keep = [i for i, f in enumerate(found) if f.any()]
        return pa.table({
            "chunk": table["chunk"].take(pa.array(keep, pa.int64())),
            "bucket": table["bucket"].take(pa.array(keep, pa.int64())),
            "later": pa.array([np.packbits(found[i]).tobytes() for i in keep], pa.binary()),
        })

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(table, window, buckets)
        later = np.zeros(len(c.first), bool)
        for b, bits in zip(answers["bucket"].to_pylist(), answers["later"].to_pylist()):
            k = int(np.searchsorted(c.buckets, b))
            e = c.entry[c.cuts[k] : c.cuts[k + 1]]
            later[e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(e)).astype(bool)
        repeat = later[c.which]
        mine = np.ones(len(c.at), bool)
        mine[c.first] = False
        repeat |= mine
        n = int(c.bounds[-1])
        cover = np.zeros(n + 1, np.int32)
        at = c.at[repeat]
        cover[at] += 1
        cover[at + window] -= 1
        gone = np.cumsum(cover[:n]) > 0
        raw, kept, spans = c.data.tobytes(), [], []
        totals = np.concatenate(([0], np.cumsum(gone)))
        removed = totals[c.bounds[1:]] - totals[c.bounds[:-1]]
        for i in range(len(c.ids)):
            words = raw[c.offsets[i] : c.offsets[i + 1]].split()
            cut = []
            if removed[i]:
                own_gone = gone[c.bounds[i] : c.bounds[i + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], own_gone, [0])).astype(np.int8)))
                cut = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                words = compress(words, ~own_gone)
            kept.append(b" ".join(words))
            spans.append(cut)
        return pa.table({
            "doc_id": c.table["doc_id"],
            "n_words": pa.array(np.diff(c.bounds).astype(np.int64)),
            "n_removed": pa.array(removed.astype(np.int64)),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    sent = own.groupBy("chunk").applyInArrow(send, "chunk int, bucket long, hashes binary, docs binary, sizes binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket long, later binary")
    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(remove, RESULT)
