"""Documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns they were given, whatever
these are besides ``doc_id`` and ``text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm import decontam, langid, packing, pii, simhash
from fleetframe.llm.common import discard, materialize, numbered, scratch_scope, table

MIN_LANGUAGE_SCORE = 0.4


def _row(docs: DataFrame) -> Column:
    """All columns but the text as one struct, so that no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_row(docs), F.col("text"))


def _columns(rows: DataFrame, docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again; where the text has ``changed`` its
    ``n_chars`` follows."""
    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        value = F.col("row").getField(c)
        if c == "n_chars" and changed is not None:
            value = F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(value)
        return value.alias(c)
    return rows.select(*map(column, docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of a known language.

    The CRF is learned from the documents that are not held out (as in
    ``op1_langid``).  Those without a letter (``und``) go, and so do those of
    which no language's words have a mean posterior of 0.4: mixtures of three
    or more languages.
    """
    crf = langid.fit(docs.filter(~langid.held_out("doc_id")), "text", "lang", "doc_id")
    found = langid.identify(_rows(docs), "row", "text", crf, with_text=True)
    return _columns(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash class: the one with the smallest
    ``doc_id``; ties go to the smaller digest of the text, then of the other
    columns, and of rows alike in all of these one stays.

    Classes and kept rows are found on fingerprints, digests and the rows'
    places in their files; texts meet the kept places in one join, which no
    value of the data can skew.  Null texts count as empty; an empty table
    gives no rows.
    """
    docs, place = numbered(docs)
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    name = F.struct(F.col("doc_id"), digest(F.coalesce("text", F.lit(""))).alias("text"), digest(rest).alias("rest"),
                    place.alias("place"))
    with scratch_scope() as keep:
        classes = simhash.simhash_groups(docs.select(name.alias("name"), F.col("text")), "name", "text", shingle=4,
                                         distance=4)
        kept = keep(materialize(classes.filter(F.col("name").eqNullSafe(F.col("component_id"))).select(
            F.col("name.place.row_index").alias("kept_at"), F.col("name.place.file_path").alias("kept_in")),
            "pipeline-kept"))
    rows = docs.select(_row(docs), F.col("text"), place.alias("place"))
    # the kept places grow with the documents: never broadcast, at any size
    alone = rows.join(kept.hint("merge"), (F.col("place.row_index") == F.col("kept_at"))
                      & (F.col("place.file_path") == F.col("kept_in")), "left_semi")
    return _columns(alone, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which benchmark windows cover 5 % or more, and
    cut the covered ranges of 13 words or more out of the others; ``n_chars``
    follows the text.  Null and empty texts have no words and stay; rows are
    judged one by one."""
    found = decontam.contamination(decontam.match_items(
        _rows(docs), "row", "text", table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text", cut=13))
    left = found.filter(~F.col("contaminated"))
    return _columns(left, docs, F.size("hits") > 0)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; ``n_chars`` follows the text.  Null
    texts stay null (and so does their ``n_chars``); every row stays."""
    clean = pii.redact(docs, "text")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096: one row per piece, with its ids.  A
    null or empty text is its end token alone."""
    return packing.pack(docs, "doc_id", "text", packing.public_tokenizer(), with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("personal_data", personal_data), ("pack", pack)]

#: The first stage learns a model, so SQL cannot give the rows of ``run``;
#: tests/llm/test_pipeline.py holds every stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope() as keep:  # a stage's own tables go with it
            after = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = after
    return docs
