import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

CLASHING = (
    "kept score n_tokens place variant key anchor anchors n band bands set_id copies copy_no shuffle_key rank w l p host path word_chars begin end "
    "length start task crc tail rate _s _copies _rate _key held_out lang_pred first_doc class_id n_links size content url n_words base_failed chars"
).split()

LINE = "the quick brown fox of the north walked with the old bear over a long and narrow bridge in the rain"
LONG = " ".join(f"word{i % 977} the and{i % 31}" for i in range(9000))


def odd_rows():
    """Null values, empty and very long texts, ties and repeated rows."""
    texts = [
        None, "", " \n\t ", "12345 !!", LINE, LINE, LINE + " again", LINE.replace("fox", "dog"), LONG, LONG + " tail", "aaaa" * 200, "é" * 150, "日本語の文章です。" * 30,
        (LINE + "\n") * 6, "<|endoftext|> a <|startoftext|> b", "# $ % & | < > *", "a b c", "x", LINE.upper(), "ſ İ ½ ² \x85 \x1c z", "word " * 60,
    ]
    langs = [None, "en", "de", "fr"]
    rows = [(i, t, langs[i % 4], [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[8], (None, LINE, "en", "a", 5), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    base = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["!"] * len(CLASHING)) for r in odd_rows()], f"{base}, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def is_native(df):
    return not any(word in plan_of(df) for word in ("Python", "Pandas", "Arrow", "ExternalRDD"))


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])
