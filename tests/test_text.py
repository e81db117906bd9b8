"""Golden serialisations (FIXTURES.md) and text helpers."""

from pyspark.sql import functions as F

from lakejoin.functions import text as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(x) if x is not None else F.lit(None).cast("string") for x in xs])


def test_multi_key_golden(spark):
    parts = F.array(T.column_part(F.lit("Country"), arr("USA", "UK", "France"), 10),
                    T.column_part(F.lit("City"), arr("NYC", "London", "Paris"), 10))
    assert one(spark, T.join_parts(parts)) == "Country : USA, UK, France [SEP] City : NYC, London, Paris"


def test_multi_key_distinct_then_limit_then_drop_blank(spark):
    # a blank uses a slot before it is dropped; duplicates collapse in order
    v = arr("a", "a", "", "b", "c")
    assert one(spark, T.joined_values(v, 2)) == "a"
    assert one(spark, T.joined_values(v, 3)) == "a, b"
    assert one(spark, T.join_parts(F.array(T.column_part(F.lit("x"), arr("", None), 10)))) == "empty"


def test_descriptions_golden(spark):
    d = T.serialize_descriptions(arr("Country", "City"), arr("The name of the country", "The name of the city"))
    assert one(spark, d) == "Country : The name of the country [SEP] City : The name of the city"
    assert one(spark, T.serialize_descriptions(arr("a", "b"), arr("  ", None))) == "No description available"
    assert one(spark, T.serialize_descriptions(arr("a"), arr(" x \n"))) == "a : x"


def test_row_golden(spark):
    assert one(spark, T.serialize_row(arr("Country", "City"), arr("USA", "NYC"))) == "Country : USA [SEP] City : NYC"
    assert one(spark, T.serialize_row(arr("a", "b"), arr("", None))) == "empty"


def test_cell_text(spark):
    assert one(spark, T.cell_text(F.lit("c"), F.lit("  v "))) == "c : v"
    assert one(spark, T.cell_text(F.lit("c"), F.lit(" "))) == "c :"
    assert one(spark, T.cell_text(F.lit("c"), F.lit(None).cast("string"))) == "c :"


def test_fmt_1f_matches_python(spark):
    for x in [12.25, 0.05, 1234.35, 6.75, 2.0, 0.0, 7.45]:
        assert one(spark, T.fmt_1f(F.lit(x))) == f"{x:.1f}", x


def test_words_and_int_list(spark):
    assert one(spark, T.words(F.lit("Hello, World_42!"))) == ["hello", "world", "42"]
    assert one(spark, T.parse_int_list(F.lit("30, 10,,5,10"))) == [5, 10, 30]
