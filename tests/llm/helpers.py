"""Small tables with the awkward rows that every operator has to take."""

from pyspark.sql import DataFrame, SparkSession

#: Names that operators use, or have used, inside.
CLASHING = ["fp", "h", "n", "row", "id", "mark", "key", "node", "sketch", "root", "host", "lines", "__mark", "__found", "__marks", "__host", "__n_lines", "__n_dropped", "__key", "__n", "__text", "c1"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
PASSAGE = "".join(f"passage number {i} of a long shared section, " for i in range(12))


def awkward_rows() -> list[tuple]:
    words = " ".join(f"word{i % 37}" for i in range(120))
    texts = [
        words, words, None, "", " \n\t ", "a", "é" * 500, "x" * 3000, "ab" * 400,
        "left part " + PASSAGE + " right part", "other beginning " + PASSAGE + " and another end",
        PASSAGE[:210], "Und Und Und " * 60, "the same line\nthe same line\nunlike", "!!! ### ***", "12 345 6789",
        "漢字かな交じり文" * 40, "naïve café " * 30, "<|endoftext|> inside <|startoftext|>", "tail \u0085 and   blank",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", None, "s1"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "no id here " + PASSAGE[50:400], "en", "s0", 10), (3, "", "en", "s0", 0), (0, words, "en", "s0", 5), (0, words, "en", "s0", 5), (50, words + " more", None, None, None)]
    return [(*r, *["clash"] * len(CLASHING)) for r in rows]


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
