"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, extra columns."""

LONG = "lorem ipsum dolor " * 4000


def odd_rows():
    a = "The quick brown fox jumps over the lazy dog near the quiet river bank today"
    return [
        (1, a, "en", "src0", 10),
        (2, a.replace(" ", "\t \n"), None, None, None),
        (2, a.replace(" ", "\t \n"), None, None, None),
        (3, None, "en", "src0", 0),
        (4, "", None, "src1", 0),
        (5, " \t\n ", "fr", "src1", 4),
        (None, a, "en", None, 3),
        (6, LONG, "en", "src0", len(LONG)),
        (7, a + " indeed", "en", "src0", 1),
        (8, "one two", "en", "src0", 1),
        (9, "É à 漢字 <|endoftext|> x\x1cy a  b \n c", "fr", "src0", 1),
        (10, "x" * 20000, "de", "src0", 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


CLASHES = ("id", "fp", "n", "sha", "score", "kept", "run", "_drop", "_id", "_sha", "_keep", "row_key", "key", "t", "p", "left", "word", "bits", "first", "c", "low", "n_words", "spans", "items", "lang_pred", "languages", "shares")


def odd_docs(spark, extra=True):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    if extra:  # names that clash with what operators make, and a map, which has no order
        from pyspark.sql import functions as F

        for k, name in enumerate(CLASHES):
            df = df.withColumn(name, F.lit(k) if k % 2 else F.lit(None).cast("string"))
        df = df.withColumn("props", F.create_map(F.lit("a"), F.col("n_chars")))
    return df


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
