"""Language-model scores by stupid backoff, computed as joins.

The model counts all word n-grams up to ``ORDER`` of the whole corpus (ASCII lower case, split at
white space, never across documents). An n-gram counts as seen from ``MIN_COUNT`` occurrences on;
a word's score is the logarithm of count(n-gram) / count(context) for the longest seen n-gram that
ends in it, times ``BACKOFF`` for every step back, and of its share of all words at the end. A
document's score is the sum over its words.

Documents are packed in blocks. Every block sends its distinct n-grams with their counts, sorted
and packed, to the hash range (bucket) they belong to. The buckets together are the count table,
partitioned by hash: each adds up the counts of its n-grams and joins the totals back to the
blocks' n-grams; a block gathers its answers and sums the scores of its documents. A frequent
n-gram is one entry per block, so it does not weigh more than others.

Defined cases: a null, empty or blank text has 0 words and score 0. Repeated rows count and are
scored each for itself. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid.llm.common import raw_bytes
from visitgrid.llm.jaccard import WordHashes, mix, pack, unpack
from visitgrid.plans.ordered import materialize

ORDER, MIN_COUNT, BACKOFF = 3, 2, 0.4
#: N-grams are hashed to so many bits.
BITS = 54
#: A block closes at so many bytes of text or documents.
BLOCK_BYTES, BLOCK_DOCS = 6 << 20, 60_000

BLOCKS = "block long, ids array<long>, sizes array<int>, words binary, bucket int, answer binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks: ids, words per document, and all words compressed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def row(block, ids, texts):
        import zstandard
        words = [t.split() for t in texts]
        data = zstandard.ZstdCompressor(level=9).compress(b" ".join(w for t in words for w in t))
        cols = [[block], [ids], [[len(w) for w in words]], [data], [None], [None]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=[c.split()[0] for c in BLOCKS.split(", ")])

    def run(batches):
        block, ids, texts, volume = TaskContext.get().partitionId() << 20, [], [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = raw_bytes(text).lower()
                ids.append(doc)
                texts.append(raw)
                volume += len(raw)
                if volume >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield row(block, ids, texts)
                    block, ids, texts, volume = block + 1, [], [], 0
        if ids:
            yield row(block, ids, texts)

    return docs.mapInArrow(run, BLOCKS)


def grams(data: bytes, sizes: np.ndarray, order: int, known: WordHashes) -> list[np.ndarray]:
    """Per order n, the hash of the n-gram that ends at every word; 0 where it would leave the document."""
    import zstandard
    words = zstandard.ZstdDecompressor().decompress(data).split()
    h = np.array([known[w] for w in words], dtype=np.uint64)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(h)) - starts
    out, value = [], np.zeros(len(h), np.uint64)
    for n in range(1, order + 1):
        # the n-gram's hash runs from its last word back to its first
        back = np.zeros(len(h), np.uint64)
        back[n - 1:] = h[:len(h) - n + 1]
        value = mix(value * np.uint64(3) + back + np.uint64(n))
        one = (value >> np.uint64(64 - BITS)) | np.uint64(1)  # never 0
        out.append(np.where(place >= n - 1, one, np.uint64(0)))
    return out


def _asked(table_bits: int, order: int):
    """Function that turns blocks into one row per bucket with the block's n-grams and counts."""

    def run(batches):
        known = WordHashes()
        for b in batches:
            for block, sizes, data in zip(*(b.column(c).to_pylist() for c in ("block", "sizes", "words"))):
                every = np.concatenate(grams(data, np.array(sizes, dtype=np.int64), order, known))
                own, n = np.unique(every[every > 0], return_counts=True)
                edges = np.searchsorted(own, np.arange(1, 1 << table_bits, dtype=np.uint64) << np.uint64(BITS - table_bits))
                rows = [(k, block, pack(own[lo:hi], True), pack(n[lo:hi].astype(np.uint32)))
                        for k, (lo, hi) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(own)])) if hi > lo]
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     names=["bucket", "block", "grams", "n"])

    return run


def _answered(table: pa.Table) -> pa.Table:
    """One bucket: the total count of every n-gram, joined back to each block's n-grams."""
    own = [unpack(x, "u8", True) for x in table.column("grams").to_pylist()]
    n = np.concatenate([unpack(x, "u4") for x in table.column("n").to_pylist()])
    every, place = np.unique(np.concatenate(own), return_inverse=True)
    total = np.bincount(place, n, len(every)).astype(np.uint64)[place]
    ends = np.cumsum([len(x) for x in own])
    answers = [pack(x) for x in np.split(total, ends[:-1])]
    return pa.table([table.column("block"), table.column("bucket"), pa.array(answers, pa.binary())],
                    names=["block", "bucket", "answer"])


def _scored(order: int, total_words: int):
    """Function that scores the documents of one block from its words and the counts it asked for."""

    known = WordHashes()

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        body = next(r for r in rows if r["words"] is not None)
        sizes = np.array(body["sizes"], dtype=np.int64)
        parts = sorted((r["bucket"], r["answer"]) for r in rows if r["answer"] is not None)
        counted = np.concatenate([unpack(a, "u8") for _, a in parts] or [np.empty(0, np.uint64)]).astype(np.float64)
        every = np.concatenate(grams(body["words"], sizes, order, known))
        inside = np.flatnonzero(every)
        own, place = np.unique(every[inside], return_inverse=True)
        if len(own) != len(counted):
            raise ValueError("a block's n-grams and their counts differ")
        c = np.zeros(len(every))
        c[inside] = counted[place]
        c = np.split(c, order)
        # the context of the n-gram ending at a word is the (n-1)-gram ending at the word before
        result = np.log(np.maximum(c[0], 1) / max(total_words, 1)) + (order - 1) * math.log(BACKOFF)
        for n in range(2, order + 1):
            context = np.r_[1.0, c[n - 2][:-1]] if len(c[n - 2]) else c[n - 2]
            seen = c[n - 1] >= MIN_COUNT
            step = np.log(np.maximum(c[n - 1], 1) / np.maximum(context, 1)) + (order - n) * math.log(BACKOFF)
            result = np.where(seen, step, result)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        score = np.bincount(doc, result, len(sizes))
        return pa.table([pa.array(body["ids"], pa.int64()), pa.array(sizes), pa.array(score),
                         pa.array(np.where(sizes > 0, score / np.maximum(sizes, 1), 0.0))],
                        names=["doc_id", "n_words", "log_score", "mean_log_score"])

    return run


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of every document."""
    spark = docs.sparkSession
    bits = max(4, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))))
    stored = materialize(blocks(docs))
    total = stored.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    answers = (stored.select("block", "sizes", "words")
               .mapInArrow(_asked(bits, order), "bucket int, block long, grams binary, n binary")
               .groupBy("bucket").applyInArrow(_answered, "block long, bucket int, answer binary"))
    answers = answers.select("block", F.lit(None).cast("array<long>").alias("ids"),
                             F.lit(None).cast("array<int>").alias("sizes"), F.lit(None).cast("binary").alias("words"),
                             "bucket", "answer")
    return stored.union(answers).groupBy("block").applyInArrow(
        _scored(order, total), "doc_id long, n_words long, log_score double, mean_log_score double")
