"""Token ids in directly addressable codes.

An id is split into 8-bit chunks. Level k holds the k-th chunk of every id
that has one; a bitmap per level says which ids go on, and a rank directory
(ones before each 512 bits) finds the place on the next level. So any token
can be read without decoding its block.

A file set is a Parquet directory of blocks in ascending document order; a
block holds whole documents, their ids and ends, and one code payload.
"""

from __future__ import annotations

import array
import gc
import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesvec import as_array, buffers, row_slices
from .common import n_tasks, sent_rows, ship, text_bytes

BLOCK_TOKENS = 1 << 18
BLOCK_SCHEMA = "shard int, block int, first_token long, n_tokens long, doc_ids binary, id_known binary, ends binary, payload binary"
SHARD_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 20, 4096, 3 << 20
#: Rows that Spark sends to the encoder at once; by_bytes() puts them together.
SENT_ROWS = 256
_CACHE_WORDS = 100_000
#: How a byte-level vocabulary shows a space.
_SPACE = "\u0120"
# Fixed value: the pre-token pattern of byte-level vocabularies, for text without
# runs of white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: Pieces with this go to the library as they are: characters beyond the Latin
#: blocks, controls, runs of white space.
_ODD = r"[^\t\n\r\x20-\x7e\x{a1}-\x{24f}]|\s\s"
#: A space after white space (of any sort): the text is no sequence of pieces.
_BEFORE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
_RANK = 512
#: Runs that gather() copies at once.
GATHER_RUNS = 1 << 14


def dac_encode(ids: np.ndarray) -> bytes:
    """Levels of chunk bytes, each with continuation bitmap and rank directory."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 255
        chunk = (rest & 255).astype(np.uint8).tobytes()
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (_RANK // 8), np.uint8)))
        ones = np.bitwise_count(bits.reshape(-1, _RANK // 8)).sum(1, dtype=np.uint32)
        rank = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()
        levels.append(struct.pack("<III", len(rest), len(bits), len(rank)) + chunk + bits.tobytes() + rank)
        rest = rest[more] >> 8
        if not len(rest):
            return struct.pack("<I", len(levels)) + b"".join(levels)


def _levels(payload: bytes):
    at = 4
    for _ in range(struct.unpack_from("<I", payload)[0]):
        n, n_bits, n_rank = struct.unpack_from("<III", payload, at)
        at += 12
        yield (np.frombuffer(payload, np.uint8, n, at), np.frombuffer(payload, np.uint8, n_bits, at + n), np.frombuffer(payload, "<u4", n_rank // 4, at + n + n_bits))
        at += n + n_bits + n_rank


def dac_decode(payload: bytes) -> np.ndarray:
    """All ids of a payload."""
    out, at = None, None
    for k, (chunk, bits, _) in enumerate(_levels(payload)):
        if out is None:
            out, at = np.zeros(len(chunk), np.uint32), np.arange(len(chunk))
        out[at] |= chunk.astype(np.uint32) << np.uint32(8 * k)
        at = at[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)]
    return out


def dac_access(payload: bytes, i: int) -> int:
    """The id at place i, by one rank query a level; nothing else is decoded."""
    value = 0
    for k, (chunk, bits, rank) in enumerate(_levels(payload)):
        value |= int(chunk[i]) << (8 * k)
        if not bits[i >> 3] >> (i & 7) & 1:
            return value
        b, lo = i // _RANK, (i // _RANK) * (_RANK // 8)
        tail = int(np.bitwise_count(bits[lo : i >> 3]).sum()) + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        i = int(rank[b]) + tail
    raise ValueError("broken payload")


def gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each run, one after the other; the
    places of a few runs at a time are in memory."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    for lo in range(0, len(ends), GATHER_RUNS):
        n = lengths[lo : lo + GATHER_RUNS]
        to = ends[lo : lo + GATHER_RUNS]
        first = int(to[0] - n[0])
        out[first : to[-1]] = values[np.repeat(starts[lo : lo + GATHER_RUNS] - (to - n), n) + np.arange(first, to[-1])]
    return out


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct pre-token once.

    A byte-level pre-tokenizer never joins a non-space with a following space,
    so a text is cut there; equal pieces of a batch are found by Arrow's
    dictionary encoding, and so are the pre-tokens of the distinct pieces. Only
    pre-tokens that the cache doesn't have go to the library's model. Pieces
    with anything but the Latin blocks and single white space, and texts with
    special tokens, are left to the library's whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self._model = self.tok.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self._alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        form = json.loads(self.tok.to_str())
        split = form["pre_tokenizer"] or {}
        self.simple = form["normalizer"] is None and form["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"]
        self._clear()
        gc.freeze()  # what is loaded now stays; later collections are short

    def _clear(self) -> None:
        self._place: dict[str, int] = {}
        self._starts, self._ids = array.array("q", [0]), array.array("I")
        self._add("", ())

    def _add(self, key: str, ids) -> int:
        self._ids.extend(ids)
        self._starts.append(len(self._ids))
        self._place[key] = at = len(self._starts) - 2
        return at

    def _whole(self, texts: list[str]) -> list[list[int]]:
        out = []
        for lo in range(0, len(texts), 256):
            out += [e.ids for e in self.tok.encode_batch_fast(texts[lo : lo + 256], add_special_tokens=False)]
        return out

    def _places(self, tokens: list[str]) -> np.ndarray:
        """Places in the cache of pre-tokens, after adding the new ones."""
        get, tokenize, add, alphabet = self._place.get, self._model.tokenize, self._add, self._alphabet
        out = list(map(get, tokens))
        if None in out:
            for i in [i for i, at in enumerate(out) if at is None]:
                t = tokens[i]
                form = _SPACE + t[1:] if t[0] == " " and t[1:].isalnum() and t.isascii() else t.encode().decode("latin-1").translate(alphabet)
                out[i] = add(t, [x.id for x in tokenize(form)])
        return np.array(out, np.int64)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of distinct pieces."""
        plain = pc.invert(pc.match_substring_regex(pieces, _ODD))
        odd = pc.filter(pieces, pc.invert(plain)).to_pylist()
        cut = pc.split_pattern(pc.replace_substring_regex(pc.filter(pieces, plain), _PATTERN, "\\0\0"), "\0")
        tokens = cut.flatten().dictionary_encode()
        place = self._places(tokens.dictionary.to_pylist())
        token = place[tokens.indices.to_numpy()]
        rest = [self._place.get("\0" + p) for p in odd]
        missing = [p for p, at in zip(odd, rest) if at is None]
        for p, ids in zip(missing, self._whole(missing)):
            self._add("\0" + p, ids)
        rest = np.array([self._place["\0" + p] for p in odd], np.int64)
        starts, values = np.frombuffer(self._starts, np.int64), np.frombuffer(self._ids, np.uint32)  # views: the cache stays as it is until they go
        # pieces in their order: runs of places, of which an odd piece has one
        mask = plain.to_numpy(zero_copy_only=False)
        n_runs = np.ones(len(pieces), np.int64)
        n_runs[mask] = np.diff(cut.offsets.to_numpy())
        owner = np.repeat(mask, n_runs)
        run = np.empty(len(owner), np.int64)
        run[owner], run[~owner] = token, rest
        begin = starts[run]
        lengths = starts[run + 1] - begin
        sums = np.concatenate(([0], np.cumsum(lengths)))
        bounds = np.concatenate(([0], np.cumsum(n_runs)))
        return gather(begin, lengths, values), np.diff(sums[bounds])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        texts = as_array(texts)
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        if len(self._place) > _CACHE_WORDS:
            self._clear()
        n = len(texts)
        whole = np.full(n, not self.simple)
        for mark in (*self.special, "\0"):
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        hard = pc.match_substring_regex(texts, _BEFORE_SPACE).to_numpy(zero_copy_only=False)
        counts, parts = np.zeros(n, np.int64), []
        easy = np.flatnonzero(~whole & ~hard)
        if len(easy):
            marked = pc.binary_join_element_wise("", texts.take(pa.array(easy)), "\0")  # the first piece has no space
            cut = pc.split_pattern(marked, " ")
            pieces = cut.flatten().dictionary_encode()
            keys = pieces.dictionary
            first = pc.starts_with(keys, "\0")
            keys = pc.if_else(first, pc.utf8_slice_codeunits(keys, 1), pc.binary_join_element_wise(" ", keys, ""))
            ids, sizes = self._pieces(keys)
            codes, bounds = pieces.indices.to_numpy(), cut.offsets.to_numpy()
            bounds = bounds - bounds[0]
            starts = np.cumsum(sizes) - sizes
            sums = np.concatenate(([0], np.cumsum(sizes[codes])))
            counts[easy] = np.diff(sums[bounds])
            parts.append((easy, gather(starts[codes], sizes[codes], ids)))
        left = np.flatnonzero(whole | hard)
        if len(left):
            found = self._whole(texts.take(pa.array(left)).to_pylist())
            counts[left] = [len(x) for x in found]
            parts.append((left, np.array([i for x in found for i in x], np.uint32)))
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if n else 0, np.uint32)
        for rows, ids in parts:
            if len(rows) == n:
                return ids, counts
            mine = np.zeros(n, bool)
            mine[rows] = True
            out[np.repeat(mine, counts)] = ids
        return out, counts


def by_bytes(batches, size: int = BATCH_BYTES, rows: int = BATCH_ROWS):
    """The rows of batches (id, text) in their order, in batches of about size
    bytes of text, under twice of it unless one text is longer, and of few rows."""
    held, n_bytes, n_rows = [], 0, 0
    for b in batches:
        offsets = buffers(b.column(1))[1]
        for first, end in row_slices(offsets, size):
            for lo in range(first, end, rows):
                hi = min(end, lo + rows)
                held.append(b.slice(lo, hi - lo))
                n_bytes, n_rows = n_bytes + int(offsets[hi] - offsets[lo]), n_rows + hi - lo
                if n_bytes >= size or n_rows >= rows:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, n_bytes, n_rows = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every whole text, append end_id, and write the blocks to path in
    ascending document order.

    Null or empty texts have only the end id. A null id stands first; rows
    that share an id stand in the order of a hash of their texts, and are dealt
    by it, so that no id is bound to one task. Other columns are ignored,
    whatever their names. A document is never split: a block is as
    large as its longest text needs.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]
    shards = max(n_tasks(spark), -(-text_bytes(own, "text") // SHARD_BYTES))
    ordered = own.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("id_known", pa.binary()), ("ends", pa.binary()), ("payload", pa.binary())])

    def encode(batches):
        enc, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        docs_in, known, parts, ends, held, start, block = [], [], [], [], 0, 0, 0

        def row():
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "first_token": [start], "n_tokens": [held], "doc_ids": [np.array(docs_in, "<i8").tobytes()], "id_known": [bytes(known)], "ends": [np.array(ends, "<i8").tobytes()], "payload": [dac_encode(ids)]}, schema)

        for part in by_bytes(batches):
            ids, counts = enc.encode(part.column(1))
            pa.default_memory_pool().release_unused()
            ids = np.insert(ids, np.cumsum(counts), end_id)
            to = np.cumsum(counts + 1)
            for doc, a, z in zip(part.column(0).to_pylist(), (to - counts - 1).tolist(), to.tolist()):
                if held and held + z - a > block_tokens:
                    yield row()
                    start, block = start + held, block + 1
                    docs_in, known, parts, ends, held = [], [], [], [], 0
                held += z - a
                docs_in.append(doc or 0)
                known.append(doc is not None)
                parts.append(ids[a:z])
                ends.append(held)
        if docs_in:
            yield row()

    with sent_rows(spark, SENT_ROWS):
        ordered.mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path)


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard: one number a file, whatever the corpus holds."""
    sizes = spark.read.schema(BLOCK_SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    out, total = {}, 0
    for shard, n in sorted((r["shard"], r["n"]) for r in sizes):
        out[shard], total = total, total + n
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, decoded from the
    files; ids are little-endian unsigned 32-bit."""
    ship(spark)
    starts = shard_starts(spark, path)

    def decode(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                ids = dac_decode(row["payload"]).astype("<u4")
                ends = np.frombuffer(row["ends"], "<i8")
                begins = np.concatenate(([0], ends[:-1]))
                known = np.frombuffer(row["id_known"], np.uint8) == 0
                base = starts[row["shard"]] + row["first_token"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=known), pa.array(begins + base), pa.array(ends - begins), pa.array([ids[a:z].tobytes() for a, z in zip(begins, ends)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def token_at(spark: SparkSession, path: str, place: int) -> int | None:
    """The id at a place of the whole corpus: finds the block by its bounds and
    reads one token of it. None beyond the end."""
    starts = shard_starts(spark, path)
    shard = max((s for s, a in starts.items() if a <= place), key=lambda s: starts[s], default=None)
    if place < 0 or shard is None:
        return None
    at = place - starts[shard]
    hit = spark.read.schema(BLOCK_SCHEMA).parquet(path).filter((F.col("shard") == shard) & (F.col("first_token") <= at) & (F.col("first_token") + F.col("n_tokens") > at)).select("first_token", "payload").first()
    return None if hit is None else dac_access(bytes(hit["payload"]), at - hit["first_token"])
