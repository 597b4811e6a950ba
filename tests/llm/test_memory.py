import tracemalloc

import numpy as np
import pyarrow as pa

from meshquill.llm import token_dac
from meshquill.llm.bytesvec import buffers, row_slices


def test_encoder_takes_small_batches():
    """What is encoded at once, and so a worker's memory, is about 4 MB of text."""
    texts = pa.array(["word " * 400] * 10_000)
    parts = list(row_slices(buffers(texts)[1], token_dac.BATCH_BYTES))
    assert sum(hi - lo for lo, hi in parts) == 10_000 and max(hi - lo for lo, hi in parts) * 2000 <= 4 << 20


def test_encoder_keeps_few_words():
    """A worker forgets words beyond 300,000, and its ids stay the library's."""
    import public_tokenizers

    enc = token_dac.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(20):
        text = " ".join(chr(97 + k) + "".join(chr(97 + int(c, 16)) for c in f"{i:x}") for i in range(20_000))
        ids, counts = enc.encode(pa.array([text]))
        assert ids.tolist() == enc.tok.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
        assert len(enc._place) <= 330_000


def test_encoder_takes_batches_by_bytes():
    """Batches are put together, or cut, to about 3 MB of text, in their order."""

    def rows(first, texts):
        return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])

    size = token_dac.BATCH_BYTES
    sent = [rows(256 * k, ["x" * 2000] * 256) for k in range(20)] + [rows(5120, ["x" * 2000] * 10_000), rows(15_120, []), rows(15_120, ["y" * 2 * size, None])]
    out = list(token_dac.by_bytes(sent))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(15_122))
    n_bytes = [int(buffers(b.column(1))[1][-1]) for b in out]
    assert min(n_bytes[:-1]) >= size and max(n_bytes[:-2]) < 2 * size
    assert max(b.num_rows for b in token_dac.by_bytes([rows(0, [None] * 20_000)])) == token_dac.BATCH_ROWS and not list(token_dac.by_bytes([]))


def test_encoder_is_sent_few_rows(spark):
    """Spark sends the encoder 256 rows at once, not 10,000, and the session's
    setting is as before afterwards."""
    from meshquill.llm.common import sent_rows

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    with sent_rows(spark, token_dac.SENT_ROWS):
        found = spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long").collect()
    assert [r["n"] for r in found] == [256, 256, 256, 232] and spark.conf.get(key) == before


def test_gather_holds_few_places():
    """Beside its result, gather() holds the places of a few runs; no runs, empty
    runs and runs in any order are the same as one by one."""
    rng = np.random.default_rng(1)
    values, lengths = rng.integers(0, 1 << 16, 5000).astype(np.uint32), rng.integers(0, 6, 400_000)
    starts = rng.integers(0, 4990, len(lengths))
    plain = np.concatenate([values[a : a + n] for a, n in zip(starts, lengths)])
    tracemalloc.start()
    found = token_dac.gather(starts, lengths, values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.dtype == values.dtype and np.array_equal(found, plain)
    assert peak < found.nbytes + lengths.nbytes + (4 << 20)
    none = np.zeros(0, np.int64)
    assert len(token_dac.gather(none, none, values)) == 0 and len(token_dac.gather(np.array([3, 4]), np.array([0, 0]), values)) == 0
