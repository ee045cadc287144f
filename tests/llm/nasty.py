"""Small tables with the cases every operator must take: nulls, blanks, long texts, ties, repeats,
and extra columns whose names clash with the operators' own."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n long, label string, bucket int, "
          "kept boolean, score double, held_out string, digest string, spans string, rep long, toks string")


def rows(texts):
    return [(i, t, lang, src, None if t is None else len(t), 1, "x", 2, None, None, "h", "d", "s", 3, "t")
            for i, t, lang, src in texts]


PROSE = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree and "
         "count every falling leaf of the long autumn evening")
NASTY = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"),  # a copy and a repeated row
    (3, None, None, None), (4, "", "en", None), (5, " \n\t ", None, "a"), (None, PROSE + " without id", "en", "a"),
    (6, "ein kurzer Satz über Käse", "de", "b"), (7, "word " * 30_000, "en", "a"), (8, "x" * 200_000, None, "b"),
    (9, "🙂 ünïcödé 漢字 \x85  text", "fr", "c"), (10, "two words", "en", "a"), (11, "12345 !!! ###", None, "a"),
]


def docs(spark, texts=NASTY):
    return spark.createDataFrame(rows(texts), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
