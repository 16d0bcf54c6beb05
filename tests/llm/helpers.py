"""Small document tables with the awkward cases that every operator defines."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that a table may have besides, named like results or inner columns of the operators.
CLASHES = "score key node print document variant row copies ids kept spans start size share labels held rank n".split()
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "!!! ???"), (904, "word"), (905, "Émile İstanbul straße 北京 😀"),
       (906, "tie tie tie"), (907, "tie tie tie"), (908, "a" * 30_000), (909, "long word list " * 4_000), (None, "no id here")]


def documents(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit(7.5) for c in CLASHES}) if extra else df


def odd_documents(spark, extra=True):
    """The awkward rows, two of them twice."""
    return documents(spark, ODD + [ODD[4], ODD[10]], extra)


def empty_documents(spark):
    return documents(spark, [(1, "x")]).where("doc_id < 0")
