"""Phrase collocations, counted by FM-indexes over word ids.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces into words.
Every task cuts its rows into shards of about ``SHARD_TOKENS`` words, and indexes each: its words
become ids, pieces are kept apart by id 0, and the symbols before (and behind) every place of the
sorted text are the transform of the text (and of the reversed text). Intervals in both are kept
together: symbols in front of an interval are its left extensions, found in the forward transform
and counted; symbols behind it are the right extensions, found in the reverse one. Starting from
single words, phrases grow to ``MAX_WORDS`` words, right and left in turn, all intervals of a
length at once.

A shard's counts leave as one block per hash bucket of the phrases; blocks of a bucket meet in one
task and are summed, and phrases that occur often enough become rows. The number of buckets follows
the measured bytes of the texts, so a bucket keeps its size; a phrase occurs once per shard at
most, so no word or phrase is hot. What is left (cuts, extensions, ranks) are joins over frequent
phrases. A longer phrase is a left or right extension of the phrases one word shorter; as counts
fall with length, these decide whether a phrase is dropped.

Defined cases: a null text is empty, a null lang is ``und``. Repeated rows count each for itself.
Texts of any length are indexed whole. Without frequent phrases, and for empty tables, the result
is empty. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid.plans.ordered import materialize, top_rows

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
SHARD_TOKENS = 800_000
#: Bytes of text whose phrases share a bucket: about 1.5 million rows before they are summed.
BUCKET_BYTES = 4_500_000
#: What ends a piece; A-Z in lower case; a tab separates words like a blank.
BREAKS = b".,;:!?\x0A\x0B\x0C\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes.maketrans(BREAKS + b"\t" + UPPER.encode(), b"\n" * len(BREAKS) + b" " + LOWER.encode())
_SCHEMA = pa.schema([("key", pa.binary()), ("n", pa.int64())])


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text, with a line end at every break between pieces and at the end."""
    return [w for w in (raw.translate(_TABLE) + b"\n").replace(b"\n", b" \n ").split(b" ") if w]


def _ordered(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the next ``depth`` symbols from each on; behind the end are zeros."""
    rank = symbols.astype(np.int64)
    for d in range(1, depth):
        behind = np.zeros(len(symbols), np.int64)
        behind[:max(len(symbols) - d, 0)] = symbols[d:]
        rank = np.unique(rank * (int(symbols.max()) + 1) + behind, return_inverse=True)[1]
    return np.argsort(rank, kind="stable")


class PhraseIndex:
    """Forward and reverse transform of a text of ids, 0 being the break; it starts and ends with 0."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n, self.alphabet = len(text), int(text.max()) + 1
        self.transforms = {}
        for side, t in (("left", text), ("right", text[::-1])):
            at = _ordered(t, depth)
            self.transforms[side] = t[at - 1]  # place 0 holds a break, and so does the place before it
        starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.alphabet))])
        self.starts = starts
        self._occurrences = {}

    def words(self):
        """All single words: (ids of shape (words, 1), {side: interval starts}, counts)."""
        ids = np.arange(1, self.alphabet, dtype=np.int32)
        counts = np.diff(self.starts)[1:]
        ids, counts = ids[counts > 0], counts[counts > 0]
        return ids[:, None], {side: self.starts[ids] for side in self.transforms}, counts

    def _rank(self, side: str, symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands in a side's transform before a row."""
        if side not in self._occurrences:
            t = self.transforms[side].astype(np.int64)
            self._occurrences[side] = np.sort(t * self.n + np.arange(self.n))
        return np.searchsorted(self._occurrences[side], symbols.astype(np.int64) * self.n + before) - self.starts[symbols]

    def extended(self, phrases, side: str, last: bool = False):
        """All phrases one word longer on a side. Their interval on that side follows from ranks, the
        one on the other side from the smaller symbols of the parent's interval."""
        ids, lows, counts = phrases
        parent = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        rows = np.arange(len(parent)) - first[parent] + lows[side][parent]
        keys = np.sort(parent * self.alphabet + self.transforms[side][rows])
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        own, symbol = np.divmod(keys[cut], self.alphabet)
        n = np.diff(np.concatenate([cut, [len(keys)]]))
        del keys, rows
        smaller = cut - first[own]
        kept = symbol > 0  # a phrase ends where its piece ends
        own, symbol, n, smaller = own[kept], symbol[kept].astype(np.int32), n[kept], smaller[kept]
        grown = [symbol[:, None], ids[own]] if side == "left" else [ids[own], symbol[:, None]]
        if last:
            return np.hstack(grown), {}, n
        other = "right" if side == "left" else "left"
        near = self.starts[symbol] + self._rank(side, symbol, lows[side][own])
        return np.hstack(grown), {side: near, other: lows[other][own] + smaller}, n

    def phrases(self, longest: int):
        """(ids, counts) of all phrases of 1, 2, ... ``longest`` words."""
        now = self.words()
        yield now[0], now[2]
        for k, side in zip(range(2, longest + 1), itertools.cycle(("right", "left"))):
            now = self.extended(now, side, last=k == longest)
            yield now[0], now[2]


class Shard:
    """Words of rows as ids; every language has its own."""

    def __init__(self):
        self.fresh = itertools.count(1)
        self.ids: dict[bytes, defaultdict] = {}
        self.parts, self.tokens = [np.zeros(1, np.int32)], 0

    def add(self, lang: bytes, raw: bytes) -> None:
        if lang not in self.ids:
            self.ids[lang] = defaultdict(self.fresh.__next__, {b"\n": 0})
        found = words_of(raw)
        self.parts.append(np.fromiter(map(self.ids[lang].__getitem__, found), np.int32, len(found)))
        self.tokens += len(found)

    def blocks(self, bits: int, longest: int):
        """(bucket, bytes): the counts of all phrases, and of all words of a language under the empty
        phrase. A key is lang, line end, phrase."""
        text = np.concatenate(self.parts)
        known = sorted((lang, word, i) for lang, ids in self.ids.items() for word, i in ids.items() if i)
        if not known:
            return
        place = np.zeros(len(known) + 1, np.int32)
        place[[i for _, _, i in known]] = np.arange(1, len(known) + 1)
        index = PhraseIndex(place[text], longest - 1)
        plain = pa.array([b"", *(word for _, word, _ in known)], pa.binary())
        marked = pa.array([b"", *(lang + b"\n" + word for lang, word, _ in known)], pa.binary())
        hashes = np.array([0, *(xxhash.xxh64_intdigest(lang + b"\n" + word) for lang, word, _ in known)], np.uint64)
        totals = defaultdict(int)
        for ids, counts in index.phrases(longest):
            if ids.shape[1] == 1:
                for i, n in zip(ids[:, 0].tolist(), counts.tolist()):
                    totals[known[i - 1][0]] += n
            keys = marked.take(pa.array(ids[:, 0]))
            mixed = hashes[ids[:, 0]]
            for column in ids.T[1:]:
                keys = pc.binary_join_element_wise(keys, plain.take(pa.array(column)), b" ")
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[column]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            bucket = (mixed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(mixed), np.int64)
            order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
            rows = pa.record_batch([keys, pa.array(counts)], schema=_SCHEMA).take(pa.array(order))
            ends = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
            for b in np.flatnonzero(np.diff(ends)):
                yield int(b), packed(rows.slice(ends[b], ends[b + 1] - ends[b]))
        for lang, n in totals.items():
            bucket = xxhash.xxh64_intdigest(lang) >> (64 - bits) if bits else 0
            yield bucket, packed(pa.record_batch([pa.array([lang + b"\n"], pa.binary()), pa.array([n])], schema=_SCHEMA))


def packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    return sink.getvalue().to_pybytes()


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                  shard_tokens: int = SHARD_TOKENS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of up to ``max_words`` words that occur ``min_count``
    times or more in their lang; the empty phrase, of 0 words, counts all words."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(int(size // bucket_bytes), 0).bit_length()

    def blocks(shard):
        held, room = [], 0
        for b, payload in shard.blocks(bits, max_words):
            held.append((b, payload))
            room += len(payload)
            if room > 1 << 24:
                yield pa.record_batch([pa.array(x) for x in zip(*held)], names=["bucket", "payload"])
                held, room = [], 0
        if held:
            yield pa.record_batch([pa.array(x) for x in zip(*held)], names=["bucket", "payload"])

    def index(batches):
        shard = Shard()
        for batch in batches:
            langs = batch.column("lang").cast(pa.binary())
            texts = batch.column("text").cast(pa.binary())
            for lang, text in zip(langs, texts):
                shard.add(lang.as_py(), text.as_py())
                if shard.tokens >= shard_tokens:
                    yield from blocks(shard)
                    shard = Shard()
        yield from blocks(shard)

    def total(table):
        read = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in table.column("payload")]
        sums = pa.concat_tables(read).group_by("key").aggregate([("n", "sum")])
        key, n = sums.column("key"), sums.column("n_sum")
        often = pc.or_(pc.greater_equal(n, min_count), pc.ends_with(key, b"\n"))
        parts = [k.rsplit(b"\n", 1) for k in key.filter(often).to_pylist()]
        return pa.table({"lang": pa.array([a.decode() for a, _ in parts], pa.string()),
                         "phrase": pa.array([p.decode() for _, p in parts], pa.string()),
                         "words": pa.array([p.count(b" ") + 1 if p else 0 for _, p in parts], pa.int32()),
                         "n": n.filter(often).combine_chunks()})

    return (docs.mapInArrow(index, "bucket long, payload binary")
            .groupBy("bucket").applyInArrow(total, "lang string, phrase string, words int, n long"))


def collocations(docs: DataFrame, top: int = TOP, **limits) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of every lang."""
    return ranked(materialize(phrase_counts(docs, **limits)), top)


def ranked(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases by the counts (lang, phrase, words, n) of all frequent ones."""
    split = F.split("phrase", " ")

    def words(first, last):
        return F.array_join(F.slice(split, F.lit(first) if isinstance(first, int) else first, last), " ")

    size = F.size(split)
    several = counts.where("words >= 2")
    # phrases one word longer, by the phrases they extend to the right and to the left
    longer = (counts.where("words >= 3")
              .select("lang", "n", F.explode(F.array(words(1, size - 1), words(2, size - 1))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("n").alias("longer")))
    kept = (several.join(longer, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("n"))))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), split.alias("ws"),
                       F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws")), " ").alias("rest"))
    part = counts.where("words >= 1")
    left = part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    # 38 digits hold 1000000 * a * a up to a = 10 ** 16
    score = F.expr("(cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0))) "
                   "div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best = top_rows(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, rank="rank")
    n = counts.where("words = 0").select("lang", "n")
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
