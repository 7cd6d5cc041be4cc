from pyspark.sql import functions as F

from folioforge.functions import documents as D, text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_text_helpers(spark):
    assert one(spark, T.clean_text(F.col("t")), t="a​b 😀→\x07c\n\td") == "ab c\n\td"
    assert one(spark, T.precompare(F.col("t")), t='A *b*, c: "d" #-`e`.') == "abcde"
    assert one(spark, T.straight_quotes(F.col("t")), t="‘a’ “b”") == "'a' \"b\""
    assert one(spark, T.url_compatible(F.col("t")), t="a b/c~d*é") == "a_b%2Fc~d%2A%C3%A9"
    assert one(spark, T.escape_newlines(F.col("t")), t="a\nb\\\nc") == "a\\nb\\\nc"
    assert one(spark, T.keywords(F.col("t")), t="What is the capital of France?") == "capital France?"
    assert one(spark, T.keywords(F.col("t")), t="what is the") == "what is the"
    assert one(spark, T.trim_words(F.col("t"), 2), t="a b c") == "a b"
    assert one(spark, T.trim_middle(F.col("t"), 2, "|"), t="a b c") == "a|c"
    assert one(spark, T.sanitize_cell(F.col("t")), t="=1+1") == "'=1+1"
    assert [one(spark, f(F.col("t")), t=None) for f in (T.clean_text, T.precompare, T.sanitize_cell, T.valid_text)] == [None] * 4
    assert one(spark, T.n_words(F.col("t")).cast("string"), t=None) == "0"


def test_stop_words_are_the_fixed_number():
    assert len(T.STOPWORDS) == len(set(T.STOPWORDS)) == 198


def test_long_ids_are_hashed(spark):
    k = one(spark, D.chunk_key(F.col("d"), F.lit(512), F.lit(3)), d="a/b c")
    assert k == "abc__512__3"
    assert len(one(spark, D.chunk_key(F.col("d"), F.lit(512), F.lit(3)), d="x" * 600)) == 64 + len("__512__3")


def test_round_trip_of_enrichment(spark):
    e = D.enriched(F.col("c"), F.col("p"), F.col("s"), F.col("m"), F.col("x"))
    back = D.cleaned_up(D.enriched(F.col("c"), F.col("p"), F.col("s")), F.col("t"), F.col("s"))
    v = {"c": "Words of it.", "p": "Title\n\r\n", "s": "\n\r\nMetadata:\n\ta - b", "t": "Title", "m": "sum ", "x": " ctx"}
    assert one(spark, back, **v) == "Words of it."
    assert one(spark, e, **v) == "Title\n\r\nsum Words of it. ctx\n\r\nMetadata:\n\ta - b"


def test_owner_names(spark):
    df = spark.sql("""SELECT array(
        named_struct('display_name', 'D', 'first_name', 'aNN', 'middle_initial', 'q', 'last_name', 'lee', 'email', 'e'),
        named_struct('display_name', 'D', 'first_name', null, 'middle_initial', null, 'last_name', null, 'email', 'e'),
        named_struct('display_name', null, 'first_name', null, 'middle_initial', null, 'last_name', null, 'email', null)) AS o""")
    assert df.select(D.owner_names(F.col("o")).alias("n")).first().n == ["Ann Q. Lee", "D", "Unknown"]
