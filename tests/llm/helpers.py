"""Small inputs with the cases that every operator has to stand: nulls, empty and very long texts, repeats, ties, clashing names."""

from pyspark.sql import SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark: SparkSession, rows: list[tuple]):
    """Documents of (doc_id, text[, lang[, source]]), with columns whose names operators might use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", None) for r in rows]
    out = spark.createDataFrame(full, DOCS)
    return out.selectExpr("*", "doc_id as fp", "text as term", "1 as n", "'x' as segment", "2 as score", "'y' as root", "3 as _tokens", "null as html")


ODD = [(1, "plain words here for all of us"), (2, None), (3, ""), (4, " \t\n"), (5, "?!. --"), (6, "long " * 50_000), (7, "plain words here for all of us"), (7, "plain words here for all of us"), (None, "no id at all"), (8, "日本語 のテキスト")]
