import pytest
from pyspark.sql import Row

TOXIC = "you are scum and trash"
CLEAN = "a quiet walk along the river with friends in the early morning light"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""
    from clubspark.llm.common import prepare

    prepare(spark)
    rows = [(i, f"{CLEAN} number {i} of the series", "en", f"src{i % 2}", i) for i in range(20)]
    rows += [(30, None, None, None, None), (31, "", "en", "src0", 0), (None, "no id here", "en", "src1", 1)]
    rows += [(40, "same text twice", "en", "src0", 2), (41, "same text twice", "en", None, 2), (41, "same text twice", "en", None, 2)]
    rows += [(50, "word " * 60_000, "en", "src0", 3), (51, " \t\n\x0b\x0c\r ", "xx", "src1", 4), (52, "ſK İ\x00<|endoftext|>é" * 9, "xx", "src1", 5)]
    rows += [(60, TOXIC, "en", "src0", 6), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).repartition(3)
    for name in "fp sha row kept score rid component_id copy_number root n sender".split():
        df = df.selectExpr("*", f"n_chars AS {name}")
    return df


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, 0) for i in range(20)] + [(60, 0, 1), (60, 1, 0), (None, 1, 1), (999, None, None), (31, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def texts_of(df):
    return [Row(doc_id=r["doc_id"], text=r["text"] or "") for r in df.select("doc_id", "text").collect()]
