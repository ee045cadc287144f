"""N-gram Jaccard join by T-occurrence search (DivideSkip), down to connected groups.

Two documents link when the Jaccard similarity of their sets of ``size``-word shingles is at least
``percent`` / 100.

1. Exact copies collapse to one representative before anything is shingled. Texts that are shuffled
   whole are compressed first.
2. Inverted lists: every block of documents sends its shingles, sorted and packed, to the bucket
   of their hash range. A bucket knows the length of every list and drops lists of one document,
   which are most. Shingles that are frequent inside a block ("long" ones) send no postings to
   the bucket but pass by it, so one very common passage cannot fill a task.
3. A document of n shingles needs T = ceil(n * percent / 100) shared ones with any partner. With
   fewer than T lists of two or more it links with nothing and goes. Otherwise its n - T + 1
   shortest lists must hold every partner (the lists set aside number T - 1): documents that meet
   in such a list fall in one cell.
4. A cell larger than one tile gets a hub: of its commonest set sizes, the document that shares the
   largest part of its shingles. Every document of the cell is compared with the hub. Those that
   link are one group already and need not meet each other, so one large group of near copies
   costs in proportion to its size.
5. Cells are cut in blocks of similar set size and bounded volume, and every pair of blocks whose
   sizes allow a link is one tile, but for pairs of blocks that are both linked to the hub. In a
   tile DivideSkip runs for each document of one block against the inverted lists of the other:
   short lists are merged with counts, the candidates are probed in the long lists by binary
   search, and those that reach the exact overlap are links. A tile returns a spanning forest of
   its links, never its pairs.
6. Links join into components.

Nothing is capped: a large cell makes more tiles.

Defined cases: a null, empty or blank text has no shingles and is alone in its component, also
beside its copies. With fewer words than ``SIZE`` the whole sequence is the one shingle. Rows that
repeat an id are judged by their texts. Rows without an id take part, but their component is null
where no document with an id belongs to it. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from visitgrid.llm.common import DOCUMENT_COLUMNS, raw_bytes
from visitgrid.llm.components import components
from visitgrid.plans.ordered import materialize

SIZE, PERCENT = 4, 85
#: Shingles are hashed to so many bits.
BITS = 56
#: A block closes at so many shingles or documents.
BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 60_000
#: Postings of one shingle in one block above which it counts as long.
LONG = 32
LONG_LENGTH = 2 ** 31 - 1
#: A tile's blocks close at about so many shingles or documents.
TILE_SHINGLES, TILE_DOCS = 16_000, 96
#: Texts go on from Python in parts of about so many bytes.
PART_BYTES = 16_000_000
#: Rows without an id rank behind all others.
NO_ID = 2 ** 62


class WordHashes(dict):
    """Word -> 64-bit hash; emptied when it gets large."""

    def __missing__(self, word):
        import xxhash
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text, size: int = SIZE, known: WordHashes | None = None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = raw_bytes(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = WordHashes() if known is None else known
    h = np.array([known[w] for w in words], dtype=np.uint64)
    width = min(size, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out + h[k:k + n])
    return np.unique(out >> np.uint64(64 - BITS))


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as zstd bytes, byte planes apart; of rising ones, the differences."""
    import zstandard
    if rising and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind, rising: bool = False) -> np.ndarray:
    import zstandard
    kind = np.dtype(kind)
    data = zstandard.ZstdDecompressor().decompress(data)
    planes = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)
    values = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def _swapped(df: DataFrame, kind: str, change) -> DataFrame:
    """``df`` with its column text through ``change`` (bytes to bytes; null stays) as type ``kind``. A
    batch goes on in parts, so that no part grows far beyond ``PART_BYTES``."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` {kind if f.name == 'text' else f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        once = change()
        for b in batches:
            at, done, volume = 0, [], 0
            texts = b.column("text").cast(pa.binary())
            for k, text in enumerate(texts):
                done.append(None if text.as_py() is None else once(text.as_py()))
                volume += len(done[-1] or b"")
                if volume > PART_BYTES or k + 1 == len(texts):
                    new = pa.array(done, pa.binary())
                    new = new.cast(pa.string()) if kind == "string" else new
                    yield pa.RecordBatch.from_arrays([new if c == "text" else b.column(c).slice(at, k + 1 - at) for c in names], names=names)
                    at, done, volume = k + 1, [], 0

    return df.mapInArrow(run, schema)


def zipped(df: DataFrame) -> DataFrame:
    """``df`` with its texts as zstd bytes: a shuffle of whole texts writes less of them than of plain ones."""
    import zstandard
    return _swapped(df, "binary", lambda: zstandard.ZstdCompressor(level=1).compress)


def unzipped(df: DataFrame) -> DataFrame:
    """The inverse of ``zipped``."""
    import zstandard
    return _swapped(df, "string", lambda: zstandard.ZstdDecompressor().decompress)


POSTED = "bucket int, block long, passed boolean, toks binary, runs binary, refs binary, reps binary, sizes binary"


def _post(docs: list, block: int, bits: int) -> pa.RecordBatch:
    """A block's rows: one per bucket, and one with its documents and long shingles."""
    sizes = np.array([len(t) for _, t in docs], dtype=np.uint32)
    toks = np.concatenate([t for _, t in docs])
    refs = np.repeat(np.arange(len(docs), dtype=np.uint16), sizes)
    order = np.argsort(toks, kind="stable")
    toks, refs = toks[order], refs[order]
    starts = np.flatnonzero(np.r_[True, toks[1:] != toks[:-1]])
    runs = np.diff(np.r_[starts, len(toks)]).astype(np.uint32)
    own, long = toks[starts], runs > LONG
    rows = []
    edges = np.searchsorted(own, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(BITS - bits))
    at = np.r_[starts, len(toks)]
    for b, (lo, hi) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(own)])):
        if hi > lo:
            short = np.repeat(~long[lo:hi], runs[lo:hi])
            rows.append((b, block, False, pack(own[lo:hi], True),
                         pack(np.where(long[lo:hi], 0, runs[lo:hi]).astype(np.uint8)),
                         pack(refs[at[lo]:at[hi]][short]), None, None))
    held = np.repeat(long, runs)
    reps = np.array([r for r, _ in docs], dtype=np.int64)
    # passes by a bucket chosen by the block
    rows.append((hash(block) % (1 << bits), block, True, pack(own[long], True), pack(runs[long]),
                 pack(refs[held]), pack(reps), pack(sizes)))
    kinds = (pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 5)
    names = [c.split()[0] for c in POSTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def posted(reps: DataFrame, bits: int, size: int = SIZE) -> DataFrame:
    """Packed shingles of every block of representatives (rep, text, plain or zipped), by bucket."""

    def run(batches):
        import zstandard
        unzip = zstandard.ZstdDecompressor().decompress
        known, docs, volume = WordHashes(), [], 0
        block = TaskContext.get().partitionId() << 20
        for b in batches:
            for rep, text in zip(b.column("rep").to_pylist(), b.column("text").to_pylist()):
                if isinstance(text, bytes):
                    text = unzip(text).decode("utf-8", "surrogatepass")
                toks = shingles(text, size, known)
                if not len(toks):
                    continue
                docs.append((rep, toks))
                volume += len(toks)
                if volume >= BLOCK_SHINGLES or len(docs) >= BLOCK_DOCS:
                    yield _post(docs, block, bits)
                    docs, volume, block = [], 0, block + 1
        if docs:
            yield _post(docs, block, bits)

    return reps.mapInArrow(run, POSTED)


def _listed(table: pa.Table) -> pa.Table:
    """The postings of one bucket: (doc, tok, length) of every list of two or more documents, and
    of passed blocks (doc, null, n, rep) and their long shingles. A doc is block and place."""
    doc, tok, length, rep = [], [], [], []
    blocks = table.column("block").to_pylist()
    passed = table.column("passed").to_pylist()
    cols = {c: table.column(c).to_pylist() for c in ("toks", "runs", "refs", "reps", "sizes")}
    lists = []
    for k, block in enumerate(blocks):
        base = np.int64(block) << 16
        toks, refs = unpack(cols["toks"][k], "u8", True), unpack(cols["refs"][k], "u2")
        if passed[k]:
            reps, runs = unpack(cols["reps"][k], "i8"), unpack(cols["runs"][k], "u4")
            doc += [base + np.arange(len(reps)), base + refs.astype(np.int64)]
            tok += [np.full(len(reps), -1), np.repeat(toks, runs).astype(np.int64)]
            length += [unpack(cols["sizes"][k], "u4").astype(np.int64), np.full(len(refs), LONG_LENGTH)]
            rep += [reps, np.full(len(refs), -1)]
        else:
            lists.append((base, toks, unpack(cols["runs"][k], "u1"), refs))
    if lists:
        every = np.concatenate([x[1] for x in lists])
        runs = np.concatenate([x[2] for x in lists]).astype(np.int64)
        own, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, runs, len(own)).astype(np.int64)
        total[np.bincount(place, runs == 0, len(own)) > 0] = LONG_LENGTH
        every_length, at = total[place], 0
        for base, toks, run, refs in lists:
            lengths = every_length[at:at + len(toks)]
            at += len(toks)
            keep = np.repeat(lengths > 1, run)
            doc.append(base + refs[keep].astype(np.int64))
            tok.append(np.repeat(toks, run)[keep].astype(np.int64))
            length.append(np.repeat(lengths, run)[keep])
            rep.append(np.full(int(keep.sum()), -1))
    return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in (doc, tok, length, rep)],
                    names=["doc", "tok", "length", "rep"])


def partner_overlap(n, percent: int = PERCENT):
    """T: the least overlap of a set of n with any partner."""
    return F.floor((n * percent + 99) / 100)


def survivors(reps: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sizes, kept): the set size of every representative, and the ranked postings of those that
    share enough shingles to have a partner: rep, n, tok and whether its list is in the prefix."""
    spark = reps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    bits = max(4, math.ceil(math.log2(4 * parts)))
    rows = materialize(posted(reps, bits, size).groupBy("bucket")
                       .applyInArrow(_listed, "doc long, tok long, length long, rep long"))
    sizes = rows.where("tok = -1").select(F.col("doc").alias("of"), "rep", F.col("length").alias("n"))
    lists = rows.where("tok >= 0").select("doc", "tok", "length")
    mine = Window.partitionBy("doc")
    ranked = (lists.join(sizes, lists["doc"] == sizes["of"])
              .select("rep", "n", "tok", F.count(F.lit(1)).over(mine).alias("shared"),
                      F.row_number().over(mine.orderBy("length", "tok")).alias("rank")))
    need = partner_overlap(F.col("n"), percent)
    # lists of one document come first in the order by length; they are the n - shared absent ones
    kept = ranked.where(F.col("shared") >= need).select(
        "rep", "n", "tok", (F.col("rank") <= F.col("shared") - need + 1).alias("prefix"))
    return sizes.select("rep", "n"), materialize(kept)


def cells(kept: DataFrame) -> DataFrame:
    """(node, label) of documents that meet in a prefix list."""
    prefix = kept.where("prefix").select("rep", "tok")
    lists = materialize(prefix.groupBy(F.col("tok").alias("list")).agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("m"))
                        .where("m > 1").select("list", "a"))
    edges = prefix.join(lists, prefix["tok"] == lists["list"]).where("rep != a").select("a", F.col("rep").alias("b"))
    return components(edges.distinct())


def banded(kept: DataFrame, cell_of: DataFrame, percent: int = PERCENT) -> DataFrame:
    """cell, rep, n, toks, band, hub and near of every document: its size class (0 in cells of one
    tile), the hub of its cell (null in cells of one tile), and 1 if it links with the hub or is it."""
    # set sizes of linked documents differ by less than one band
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100 - 0.001)).cast("int")
    docs = materialize(kept.groupBy("rep", "n").agg(F.sort_array(F.collect_list("tok")).alias("toks"))
                       .join(cell_of, F.col("rep") == F.col("node"))
                       .select(F.col("label").alias("cell"), "rep", "n", "toks"))
    by_band = docs.groupBy("cell", band.alias("band")).agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.size("toks")).alias("s"),
        F.max_by("rep", F.size("toks") / F.col("n")).alias("first"))
    volume = F.greatest(F.sum("m") / TILE_DOCS, F.sum("s") / TILE_SHINGLES)
    whole = materialize(by_band.groupBy(F.col("cell").alias("c"))
                        .agg((volume > 1).alias("large"), F.max_by("first", "m").alias("first")))
    hubs = materialize(docs.join(whole.where("large"), F.col("rep") == F.col("first"))
                       .select(F.col("cell").alias("h"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"),
                               F.col("toks").alias("hub_toks")))
    both = F.size(F.array_intersect("toks", "hub_toks"))
    # a document's least overlap with the hub, solved for the overlap: (100 + percent) * both >= percent * (n + n)
    near = ((100 + percent) * both >= percent * (F.col("n") + F.col("hub_n"))) | (F.col("rep") == F.col("hub"))
    return materialize(docs.join(whole, F.col("cell") == F.col("c")).join(hubs, F.col("cell") == F.col("h"), "left")
                       .select("cell", "rep", "n", "toks", F.when(F.col("large"), band).otherwise(0).alias("band"), "hub",
                               F.coalesce(near, F.lit(False)).cast("int").alias("near")))


def tiled(docs: DataFrame) -> DataFrame:
    """Every document of ``banded`` in the tiles of its cell: the two blocks (band, near, number), its
    side (0, 1, or 2 for both), rep, n, toks."""
    volume = F.greatest(F.count(F.lit(1)) / TILE_DOCS, F.sum(F.size("toks")) / TILE_SHINGLES)
    blocks = materialize(docs.groupBy(F.col("cell").alias("c"), F.col("band").alias("d"), F.col("near").alias("g"))
                         .agg(F.ceil(volume).cast("int").alias("k")))
    # the blocks that a block meets: at most six kinds, of its band and the next ones
    other = blocks.select(F.col("c").alias("c2"), F.col("d").alias("d2"), F.col("g").alias("g2"), F.col("k").alias("k2"))
    meets = (blocks.withColumn("to", F.explode(F.array(F.col("d") - 1, F.col("d"), F.col("d") + 1)))
             .join(other, (F.col("c") == F.col("c2")) & (F.col("to") == F.col("d2"))).where("g + g2 < 2")
             .groupBy("c", "d", "g", "k").agg(F.collect_list(F.struct("d2", "g2", "k2")).alias("meets")))
    placed = (docs.join(materialize(meets), (F.col("cell") == F.col("c")) & (F.col("band") == F.col("d"))
                        & (F.col("near") == F.col("g")))
              .withColumn("own", F.struct("band", "near", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int").alias("no"))))
    met = F.expr("flatten(transform(meets, m -> transform(sequence(0, m.k2 - 1), "
                 "j -> struct(m.d2 as band, m.g2 as near, j as no))))")
    side = F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1)
    return (placed.withColumn("met", F.explode(met))
            .select("cell", F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"), side.alias("side"),
                    "rep", "n", "toks"))


def divide_skip(index: list[np.ndarray], query: np.ndarray, need: int, lists=None) -> tuple[np.ndarray, np.ndarray]:
    """T-occurrence search: (places, overlaps) of the index sets that share ``need`` or more with
    the query. ``lists``: the inverted lists of ``index``, if already built."""
    own, starts, lengths, posts, m = lists or inverted(index)
    at = np.searchsorted(own, query)
    at = at[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == query)] if len(own) else at[:0]
    if len(at) < need:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = at[np.argsort(lengths[at], kind="stable")]
    # the longest lists are only probed: as many as pay for it, fewer than the overlap needed
    aside = min(need - 1, int(need / (0.01 * math.log(max(2, lengths[at[-1]])) + 1)))
    short, long = at[:len(at) - aside], at[len(at) - aside:]
    total = lengths[short]
    ends = np.cumsum(total)
    merged = posts[np.repeat(starts[short] - ends + total, total) + np.arange(ends[-1])]
    counts = np.bincount(merged, minlength=m)  # the merge of the short lists, with occurrences
    found = np.flatnonzero(counts >= need - aside)
    overlap = counts[found]
    for k in long if len(found) else ():
        part = posts[starts[k]:starts[k] + lengths[k]]
        spot = np.searchsorted(part, found)
        overlap += part[np.minimum(spot, len(part) - 1)] == found
    enough = overlap >= need
    return found[enough], overlap[enough]


def inverted(index: list[np.ndarray]):
    """Inverted lists: their shingles, starts, lengths, the sorted postings, and the number of sets."""
    toks = np.concatenate([*index, np.empty(0, np.int64)])
    refs = np.repeat(np.arange(len(index)), [len(x) for x in index])
    order = np.argsort(toks, kind="stable")
    toks, posts = toks[order], refs[order]
    starts = np.flatnonzero(np.r_[True, toks[1:] != toks[:-1]]) if len(toks) else np.empty(0, np.int64)
    return toks[starts], starts, np.diff(np.r_[starts, len(toks)]), posts, len(index)


def _links(percent: int):
    """Function that gives a spanning forest of the links of one tile."""

    def run(table: pa.Table) -> pa.Table:
        rep, n, side = (np.array(table.column(c)) for c in ("rep", "n", "side"))
        toks = [np.asarray(x.values) for x in table.column("toks")]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        lists = inverted([toks[i] for i in left])
        up = np.arange(len(rep))

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        a, b = [], []
        for q in right:
            need = -(-int(n[q]) * percent // 100)
            found, overlap = divide_skip([], toks[q], need, lists)
            other = left[found]
            linked = 100 * overlap >= percent * (n[q] + n[other] - overlap)
            for x in other[linked]:
                r, s = top(q), top(x)
                if r != s:
                    up[max(r, s)] = min(r, s)
                    a.append(rep[q])
                    b.append(rep[x])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(reps: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sizes, links): set sizes of the representatives, and links enough to connect every group."""
    sizes, kept = survivors(reps, size, percent)
    docs = banded(kept, cells(kept), percent)
    found = tiled(docs).groupBy("cell", "lo", "hi").applyInArrow(_links(percent), "a long, b long")
    with_hub = docs.where("near = 1 and rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    return sizes, materialize(found.union(with_hub))


def near_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, digest, n_shingles, component_id of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    held = zipped(rows.where(F.col("text").isNotNull()))
    own = F.coalesce(F.min("doc_id"), F.lit(NO_ID) + F.expr("abs(xxhash64(digest) div 4)")).alias("rep")
    texts = (held.groupBy("digest").agg(own, F.first("text").alias("text"))
             .select("rep", "text").sortWithinPartitions("rep"))  # blocks come out alike in every attempt
    sizes, linked = links(texts, size, percent)
    groups = components(linked)
    info = sizes.join(groups, sizes["rep"] == groups["node"], "left").select(
        sizes["rep"].alias("of"), "n", F.coalesce("label", "rep").alias("label"))
    digests = rows.groupBy("digest").agg(own)
    known = materialize(digests.join(info, digests["rep"] == info["of"])
                        .select(F.col("digest").alias("same"), "n", "label"))
    return rows.select("doc_id", "digest").join(known, F.col("digest") == F.col("same"), "left").select(
        "doc_id", "digest", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).when(F.col("label") < NO_ID, F.col("label"))
        .alias("component_id"))


def jaccard_join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return near_groups(docs, size, percent).drop("digest")


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, that with the smallest id, with the columns of documents."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    stay = materialize(near_groups(docs, size, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
                       .groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("same"))
                       .agg((F.count(F.lit(1)) * F.sign(F.max("n_shingles"))).alias("rows")))
    marked = zipped(docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)))

    def those(part):
        return marked.join(part, marked["doc_id"].eqNullSafe(part["id"]) & (marked["digest"] == part["same"]))

    # only rows that repeat an id and its text are compared with each other
    repeated = those(stay.where("rows > 1")).dropDuplicates(["id", "digest"])
    return unzipped(those(stay.where("rows <= 1")).select(*DOCUMENT_COLUMNS).union(repeated.select(*DOCUMENT_COLUMNS)))
