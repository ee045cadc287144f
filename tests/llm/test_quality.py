from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from nasty import NASTY, PROSE, docs, empty

from visitgrid.llm import quality as Q
from visitgrid.plans.ordered import materialize


def repeated(words, window=8):
    seen = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    inside = set()
    for i in range(len(words) - window + 1):
        if seen[tuple(words[i:i + window])] > 1:
            inside |= set(range(i, i + window))
    return len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert Q.repeated_words(words) == repeated(words)


def test_measures():
    text = "a b c d e f g h i j a b c d e f g h ü#\nq\nq\n\n \n \n"
    n_words, chars, symbols, dup_lines, rep, lines, echo = Q.measures(text)
    assert (n_words, chars, symbols, dup_lines, rep, lines) == (21, 22, 1, 1, 16, 3)
    assert echo == 1
    assert Q.measures(None) == Q.measures("") == Q.measures(" \x0b\x1c"[:2]) == (0,) * 7
    assert Q.measures("a\x1cb")[0] == 1  # only the six ASCII blanks split words


def test_cases(spark):
    got = {(r["doc_id"], r["n_words"]): r for r in Q.quality_rules(docs(spark)).collect()}
    assert len(Q.quality_rules(docs(spark)).collect()) == len(NASTY)
    assert not got[(3, 0)]["kept"] and got[(3, 0)]["base_failed"]
    assert got[(7, 30000)]["n_repeat_words"] == 30000 and not got[(7, 30000)]["kept"]
    assert got[(1, len(PROSE.split()))]["kept"]
    assert Q.quality_rules(empty(spark)).count() == 0
    assert Q.keep_good(docs(spark)).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in Q.keep_good(docs(spark)).collect()} == {1, 2, None}


def test_buckets(spark):
    v = spark.range(0, 5000).union(spark.createDataFrame([(10 ** 12,), (2 ** 40 - 1,)], "id long"))
    for r in v.select("id", Q.bucket_of(v["id"]).alias("b")).withColumn("lo", Q.bucket_low(Q.F.col("b"))).collect():
        assert r["lo"] <= r["id"] <= r["lo"] * 65 / 64 + 1
    b = [r["b"] for r in spark.range(0, 5000).select(Q.bucket_of(Q.F.col("id")).alias("b")).orderBy("id").collect()]
    assert b == sorted(b)


def test_sketches_merge(spark):
    """Sketches of parts, added up, are the sketch of the whole; fences follow the group's quartiles."""
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam".split()
    texts = [(i, " ".join(f"{w}{i}{'#' * (i % 7)}" for w in words), "en", "s") for i in range(140)]
    rows = materialize(Q.measured(docs(spark, texts), ["doc_id", "lang", "source"]))
    one = Q.sketches(rows).collect()
    two = (Q.sketches(rows.where("doc_id < 50")).union(Q.sketches(rows.where("doc_id >= 50")))
           .groupBy("lang", "source", "measure", "bucket").agg(Q.F.sum("n").alias("n"))).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    fence = Q.fences(Q.sketches(rows)).first()["fence"]
    values = sorted(1000 * sum(c in "#" for c in t) // 20 for _, t, _, _ in texts)
    q1, q3 = values[34], values[104]
    want = q3 + 3 * (q3 - q1) + 100
    assert abs(fence["symbol_rate_max"] - want) <= 0.07 * want
    # a small group takes the sketch of its language
    few = docs(spark, texts + [(1000, texts[0][1], "en", "other")])
    rows = materialize(Q.measured(few, ["doc_id", "lang", "source"]))
    assert len({str(r["fence"]) for r in Q.fences(Q.sketches(rows), 100).where("s = 'other' or s = 's'").collect()}) == 1


def test_fences_of_rates_that_are_mostly_zero(spark):
    """Where a whole group has no repeats, a text with 28 % repeated words or half its lines goes;
    where every text has as many, it stays."""
    def text(i, n, head=0, lines=False):
        body = [f"w{i}x{k}" for k in range(n)]
        if lines:
            return "\n".join([*body, *body])
        return " ".join([*body[:head], *body])

    plain = [(i, text(i, 86), "en", "a") for i in range(150)]
    bad = [(1000, text(1000, 86, 14), "en", "a"), (1001, text(1001, 7, 0, True) + "\n" + text(1002, 30), "en", "a")]
    usual = [(2000 + i, text(2000 + i, 86, 14), "de", "b") for i in range(150)]
    got = {r["doc_id"]: r for r in Q.quality_rules(docs(spark, plain + bad + usual)).collect()}
    assert not got[1000]["base_failed"] and not got[1000]["kept"] and got[1000]["n_repeat_words"] == 28
    assert not got[1001]["base_failed"] and not got[1001]["kept"]
    assert all(got[i]["kept"] for i, *_ in plain + usual)
