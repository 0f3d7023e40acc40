"""Small tables with everything that may go wrong in them."""

LONG = " ".join(f"word{i % 700} of{i % 13}," for i in range(6000))
NEAR = " ".join(f"near{i}" for i in range(60))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, length bigint, node bigint, score string, size string, n_lines string"


def rows():
    texts = [
        (1, "to be or not to be that is the question"),
        (2, ""),
        (3, None),
        (4, "To be or not to be that is the question"),
        (5, "to be or not to be that is the question"),
        (5, "to be or not to be that is the question"),  # repeated row
        (6, LONG),
        (7, LONG + " end"),
        (8, NEAR),
        (9, NEAR + " more"),
        (9, "another text under the same id"),
        (10, "one"),
        (11, "one two"),
        (12, "ONE\ttwo"),
        (13, " \n\n \t"),
        (14, "same line\nsame line\nnaïve “quoted” line — it's\nsame line\n"),
        (15, "\n".join(["same line"] * 70)),
        (None, "no id here at all"),
        (None, NEAR),
        (None, None),
        (16, "日本語   text \x1c x" + "é" * 50 + "###" * 20),
    ]
    sources = ["a", "b", None, ""]
    return [(d, t, None, sources[i % 4], i, 7, 3, "s", "t", "u") for i, (d, t) in enumerate(texts)]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
