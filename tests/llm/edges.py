"""Documents with every awkward case, and frames with clashing column names."""

from __future__ import annotations

from pyspark.sql import functions as F

# Names that the operators use inside.
CLASHING = (
    "_id _source _rate _copy _added _text size target taken rate draw score label key node low high words marks window rule verdict host"
    " path first second bands edges place gram kept spans entry embedding_ list query rank severity grade"
).split()

WORDS = [f"word{i}" for i in range(400)]


def documents(spark, rows, clashing=True):
    """A documents table of (doc_id, text, source) rows."""
    frame = spark.createDataFrame(
        [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    return frame.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else frame


def awkward(spark):
    long = " ".join(WORDS * 40)
    return documents(
        spark,
        [
            (1, " ".join(WORDS[:60]), "a"),
            (2, " ".join(WORDS[:60]), "a"),
            (3, None, "a"),
            (4, "", "b"),
            (5, " \t\n\x0b ", "b"),
            (6, long, None),
            (7, "one", "c"),
            (7, "one", "c"),
            (None, " ".join(WORDS[100:160]), "c"),
            (9, "é\u00a0ß 日本語 \U0001f600 " * 30, None),
            (10, "same " * 500, "a"),
        ],
    )


def nothing(spark):
    return documents(spark, []).where("false")


def same_schema(left, right):
    return [(f.name, f.dataType) for f in left.schema] == [(f.name, f.dataType) for f in right.schema]
