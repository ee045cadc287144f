"""Secret scans: fixed patterns, and character Markov models for what they miss.

The base kinds are regular expressions. Beyond them, long runs of key characters, left when the
base matches are blanked out, are scored by first-order Markov models of their characters: one of
random strings for each of the usual key alphabets, and one of ordinary identifiers. A run whose
best mean log-likelihood ratio per character pair exceeds the margin is a span of kind ``markov``.
The models are counts of character pairs over labelled samples, added up by Spark: the values of
base spans and strings drawn from the key alphabets are random; words of documents, also in
capitals, are ordinary. The margin is the ratio that all but ``FALSE_SHARE`` of the ordinary samples
kept aside stay below. Only pair tables, whose size is the square of the alphabet, and the margin
reach the driver. Every step is a DataFrame operation, and its time is linear in a text (running
offsets take log2 of the number of matches passes): no step walks a text once per match.

Offsets are code points, the end exclusive. Matches of one kind never overlap. A markov span can
touch a base span only where base spans overlap each other.

Defined cases: a null or empty text has no spans. Without ordinary samples the models find
nothing. Texts and runs of any length are scanned whole. Repeated rows get equal results. Empty
tables give empty results. Other columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitgrid.llm.common import blocks_of, hash_sample, let, piece, running

#: The base patterns. Match length (or group 2 of assign) is checked afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 or more: a failing run holds no longer match
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 or more, for the same reason
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN = 16
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
#: Words that may serve as ordinary identifiers.
WORD = r"[A-Za-z0-9+/_=-]{6,}"
#: The random models: one per key alphabet, told by a pattern that its strings match. A labelled
#: secret counts for the first that fits.
MODELS = (("hex", r"\A[0-9a-f]+\z"), ("upper_hex", r"\A[0-9A-F]+\z"), ("upper", r"\A[0-9A-Z]+\z"),
          ("lower", r"\A[0-9a-z]+\z"), ("mixed", r"\A[A-Za-z0-9+/_=-]+\z"))
ORDINARY = "ordinary"
#: Random strings drawn for each alphabet, of 32 characters and more.
DRAWN = 400
SMOOTHING = 0.2
#: Share of the ordinary samples kept aside that may exceed the margin; the least margin.
FALSE_SHARE, MARGIN = 0.001, 0.25


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def matched(text: Column, pattern: str, body) -> Column:
    """``body(pieces, found)`` of the pieces between the matches and the matches, each computed once
    per text; null where nothing matches."""
    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(F.rlike(text, F.lit(pattern)), let(parts, lambda x: body(x["pieces"], x["found"])))


def spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches as an array of (start, kind, end)."""
    def placed(pieces, found):
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, f: (F.length(p) + F.length(f)).cast("long"))
        return F.zip_with(running(steps), found, lambda end, f: F.struct(
            (end - F.length(f)).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))

    empty = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")
    return F.coalesce(matched(text, pattern, placed), empty)


def assigned(text: Column) -> Column:
    """Whether the value of each match of ASSIGN is long enough."""
    return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= MIN_ASSIGN)


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: the spans of the base kinds, by start and kind."""
    text = F.col("text")
    both = F.zip_with(spans(text, ASSIGN, 0), assigned(text), lambda s, ok: F.struct(s.alias("s"), ok.alias("ok")))
    assign = F.transform(F.filter(both, lambda x: x["ok"]), lambda x: x["s"])
    some = F.when(F.rlike(text, F.lit(ASSIGN)), assign).otherwise(spans(F.lit(""), ASSIGN, 0))
    return docs.withColumn("base", F.array_sort(F.concat(some, spans(text, ACCESS, 1), spans(text, HEX, 2))))


def blanked(text: Column) -> Column:
    """The text with base matches turned into as many blanks, kind after kind."""
    def joined_up(pieces, found):
        return F.array_join(F.zip_with(pieces, found, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")

    def gap(f):
        return F.repeat(F.lit(" "), F.length(f))

    def assign(t):
        return matched(t, ASSIGN, lambda pieces, found: joined_up(pieces, F.zip_with(
            found, assigned(t), lambda f, ok: F.when(ok, gap(f)).otherwise(f))))

    def plain(pattern):
        return lambda t: matched(t, pattern, lambda pieces, found: joined_up(pieces, F.transform(found, gap)))

    def after(step):
        return lambda t: F.coalesce(step(t), t)

    for step in (assign, plain(ACCESS), plain(HEX)):
        text = let(text, after(step))
    return text


def runs(text: Column) -> Column:
    """(start, kind, end, value) of all runs of key characters outside of base matches."""
    def with_values(t):
        values = F.regexp_extract_all(t, F.lit(RUN), F.lit(0))
        return F.zip_with(spans(t, RUN, KINDS.index("markov")), values, lambda s, v: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), v.alias("value")))

    empty = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint, value: string>>)")
    return F.when(F.rlike(text, F.lit(RUN)), let(blanked(text), with_values)).otherwise(empty)


def pair_counts(samples: DataFrame) -> DataFrame:
    """(model, pair, n): character pairs of samples(model, value); combines before the shuffle."""
    pairs = let(F.split("value", ""), lambda c: F.zip_with(
        F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))),
        lambda a, b: F.concat(a, b)))
    return (samples.where(F.length("value") > 1).select("model", F.explode(pairs).alias("pair"))
            .groupBy("model", "pair").agg(F.count(F.lit(1)).alias("n")))


def words_of(docs: DataFrame) -> DataFrame:
    """(before, value, after, letters, vowel, digits): every long word away from base spans with the words
    around it, whether it has no digit, a vowel, and nothing but digits."""
    def around(ws):
        others = F.greatest(F.size(ws) - 1, F.lit(0))
        return F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.slice(ws, F.lit(1), others)), ws, F.slice(ws, F.lit(2), others))

    found = let(F.regexp_extract_all(blanked(F.col("text")), F.lit(WORD), F.lit(0)), around)
    rows = docs.where(F.rlike(F.col("text"), F.lit(WORD))).select(F.inline(found)).toDF("before", "value", "after")
    return rows.where(F.col("value").isNotNull()).select("*", *[e.alias(n) for n, e in zip(("letters", "vowel", "digits"), _traits("value"))])


def _traits(word: str) -> tuple[Column, Column, Column]:
    return ~F.col(word).rlike("[0-9]"), F.col(word).rlike("[AEIOUaeiou]"), F.col(word).rlike(r"\A[0-9]+\z")


def _ordinary() -> Column:
    """Whether a word of ``words_of``, in capitals or not, is an ordinary identifier: letters and digits
    mixed are neither kind for certain."""
    return F.col("digits") | (F.col("letters") & F.col("vowel"))


def _with(other: str, joined: Column) -> tuple[Column, Column]:
    """The word and its neighbour as one identifier, and whether that is an ordinary one."""
    letters, vowel, _ = _traits(other)
    return joined, F.coalesce(F.col("letters") & letters & (F.col("vowel") | vowel), F.lit(False))


def _before() -> tuple[Column, Column]:
    return _with("before", F.concat("before", F.lit("_"), "value"))


def _after() -> tuple[Column, Column]:
    return _with("after", F.concat("value", F.lit("_"), "after"))


def _aside(value: Column) -> Column:
    """The ordinary samples that the models do not learn from."""
    return F.crc32(value) % 4 == 0


def ordinary_pairs(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """``pair_counts`` of the ordinary samples that are not kept aside. A word's own pairs are counted once
    for all identifiers that it is in: the words are counted, and the pairs of distinct words are taken."""
    def kept(value, ordinary):
        return (ordinary & ~_aside(value)).cast("long")

    words = words_of(docs if sample is None else hash_sample(docs, sample))
    counted = words.select("value", kept(F.col("value"), _ordinary()).alias("own"), kept(F.upper("value"), _ordinary()).alias("upper"),
                           kept(*_before()).alias("second"), kept(*_after()).alias("first"))
    counted = counted.where("own + upper + second + first > 0").groupBy("value").agg(
        *[F.sum(c).alias(c) for c in ("own", "upper", "second", "first")])

    def pairs(value, n):
        return let(F.split(value, ""), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(
            F.concat(F.get(c, i - 1), F.get(c, i)).alias("pair"), n.alias("n"))))

    plain = F.col("own") + F.col("second") + F.col("first")
    ends = F.array(F.struct(F.concat(F.lit("_"), F.left("value", F.lit(1))).alias("pair"), F.col("second").alias("n")),
                   F.struct(F.concat(F.right("value", F.lit(1)), F.lit("_")).alias("pair"), F.col("first").alias("n")))
    rows = counted.select(F.inline(F.concat(pairs(F.col("value"), plain), pairs(F.upper("value"), F.col("upper")), ends)))
    return rows.where("n > 0").groupBy("pair").agg(F.sum("n").alias("n")).select(F.lit(ORDINARY).alias("model"), "pair", "n")


def log_ratios(samples: DataFrame, counted: DataFrame | None = None) -> list[list[float]]:
    """Per random model, the log-likelihood ratio of every pair of alphabet characters, row by row:
    random over ordinary. A model without samples is left out, and all without ordinary ones.
    ``counted``: pairs of other samples, as of ``pair_counts``."""
    size = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts: dict[str, list] = {}
    inside = F.col("pair").rlike(r"\A[A-Za-z0-9+/_=-]{2}\z")
    found = pair_counts(samples) if counted is None else pair_counts(samples).unionByName(counted)
    for r in found.where(inside).collect():  # at most size ** 2 rows per model
        rows = counts.setdefault(r["model"], [[0] * size for _ in place])
        rows[place[r["pair"][0]]][place[r["pair"][1]]] += r["n"]
    plain = counts.pop(ORDINARY, None)
    if plain is None:
        return []
    out = []
    for name, _ in MODELS:
        if name in counts:
            table = []
            for a in range(size):
                random, usual = counts[name][a], plain[a]
                rt, pt = sum(random) + SMOOTHING * size, sum(usual) + SMOOTHING * size
                table += [math.log((random[b] + SMOOTHING) / rt) - math.log((usual[b] + SMOOTHING) / pt) for b in range(size)]
            out.append(table)
    return out


def model_of(value: Column) -> Column:
    """The random model that a secret counts for."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(MODELS):
        out = F.when(value.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def drawn(spark, n: int = DRAWN) -> DataFrame:
    """(value): ``n`` random strings for each key alphabet, from hashes of their numbers."""
    number = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("a"), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256).alias("b"))
    base64 = F.regexp_replace(F.base64(F.unhex(F.concat("a", "b"))), r"\s", "")
    letters = F.regexp_replace(base64, "[+/=]", "")
    return number.select(F.explode(F.array(F.col("a"), F.upper("b"), F.upper(letters), F.lower(letters), letters, base64)).alias("value"))


def samples_of(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """Labelled samples (model, value). Values of the base spans of all documents and drawn strings
    are random; long words of all documents (of at most ``sample`` of them, if given), away from base
    spans, are ordinary."""
    def found(pattern):
        return F.regexp_extract_all("text", F.lit(pattern), F.lit(0))

    # of an assignment, what follows the last character outside of the alphabet
    tail = F.element_at(F.split("v", r"[^A-Za-z0-9+/_=-]"), -1)
    values = (docs.where(F.rlike(F.col("text"), F.lit(f"{ASSIGN}|(?-i:{ACCESS})|(?-i:{HEX})")))
              .select(F.explode(F.concat(found(ASSIGN), found(ACCESS), found(HEX))).alias("v")).select(tail.alias("value")))
    secret = values.where(F.length("value") >= MIN_ASSIGN).union(drawn(docs.sparkSession))
    each = [(F.col("value"), _ordinary()), (F.upper("value"), _ordinary()), _after()]
    plain = words_of(docs if sample is None else hash_sample(docs, sample)).select(F.explode(F.array(
        *[F.when(ordinary, value) for value, ordinary in each])).alias("value")).where(F.col("value").isNotNull())
    return (secret.select(model_of(F.col("value")).alias("model"), "value").where("model IS NOT NULL")
            .union(plain.select(F.lit(ORDINARY).alias("model"), "value")))


def score(value: Column, ratios: list[list[float]]) -> Column:
    """The best mean log-likelihood ratio per character pair of a run, over the random models."""
    size = len(ALPHABET)
    # one string each: an array of thousands of literals would cost the planner seconds
    tables = [F.split(F.lit(",".join(map(repr, t))), ",").cast("array<double>") for t in ratios]

    def add(acc, c):
        at = F.instr(F.lit(ALPHABET), c)
        return let(F.struct(at.alias("at"), ((acc["at"] - 1) * size + at - 1).alias("pair")), lambda x: F.struct(
            x["at"].alias("at"), *[(acc[f"s{i}"] + F.when(acc["at"] > 0, F.get(t, x["pair"])).otherwise(F.lit(0.0))).alias(f"s{i}")
                                   for i, t in enumerate(tables)]))

    zero = F.struct(F.lit(0).alias("at"), *[F.lit(0.0).alias(f"s{i}") for i in range(len(tables))])
    best = F.aggregate(F.split(value, ""), zero, add, lambda acc: F.greatest(*[acc[f"s{i}"] for i in range(len(tables))], F.lit(-math.inf)))
    return best / (F.length(value) - 1)


def learned(docs: DataFrame, sample: int | None = None) -> tuple[list[list[float]], float]:
    """The models, and the margin from ordinary samples kept aside, of all documents."""
    samples = samples_of(docs, sample)
    ratios = log_ratios(samples.where(F.col("model") != ORDINARY), ordinary_pairs(docs, sample))
    if not ratios:
        return [], MARGIN
    kept = samples.where((F.col("model") == ORDINARY) & _aside(F.col("value")) & (F.length("value") >= MIN_RUN)).select("value").distinct()
    (limit,) = kept.agg(F.percentile_approx(score(F.col("value"), ratios), F.lit(1 - FALSE_SHARE), F.lit(10000))).first()
    return ratios, max(limit or MARGIN, MARGIN)


def scan(docs: DataFrame, models: tuple[list[list[float]], float]) -> DataFrame:
    """Adds ``base`` and ``found``, all spans by start and kind, to (doc_id, text, ...)."""
    ratios, margin = models
    rows = base_spans(docs)
    if not ratios:
        return rows.withColumn("found", F.col("base"))
    secret = F.filter(runs(F.col("text")), lambda r: score(r["value"], ratios) > margin)
    more = F.transform(secret, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    return rows.withColumn("found", F.array_sort(F.concat("base", more)))


def joined(column: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def prepared(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select("doc_id", *[c for c in columns if c not in ("doc_id", "text")], _text().alias("text"))


def secret_scan(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """doc_id, counts per base kind, base_sha256, spans, n_markov of every document."""
    docs = prepared(docs)
    found = scan(docs, learned(docs, sample))

    def count(k):
        return F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"),
                        count(3).alias("n_markov"))


def marked(text: Column, found: Column, mark: str) -> Column:
    """The text with the union of its spans, which come by start, replaced by ``mark``."""
    def cut(x):
        reached = running(F.transform(x["found"], lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return let(F.struct(x["blocks"].alias("blocks"), x["found"].alias("found"), reached.alias("reached")), filled)

    def filled(x):
        before = F.concat(F.array(F.lit(0).cast("long")), F.slice(x["reached"], F.lit(1), F.size(x["found"]) - 1))
        parts = F.zip_with(before, x["found"], lambda end, s: F.when(
            s["start"] >= end, F.concat(piece(x["blocks"], end, s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(x["blocks"], F.element_at(x["reached"], -1), F.length(text).cast("long")))

    return let(F.struct(blocks_of(text).alias("blocks"), found.alias("found")), cut)


def redacted(docs: DataFrame, columns, mark: str = "<secret>", sample: int | None = None) -> DataFrame:
    """The documents with every span replaced by ``mark``; n_chars follows. Overlapping spans are
    replaced as one."""
    ready = prepared(docs, *columns)
    found = scan(ready, learned(ready.select("doc_id", "text"), sample))
    some = F.size("found") > 0
    out = found.withColumn("text", F.when(some, marked(F.col("text"), F.col("found"), mark)).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)
