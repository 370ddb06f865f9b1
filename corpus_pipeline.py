"""A training corpus from `documents`: language, boilerplate lines, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
documents. Null text, empty tables and repeated rows: as the operators state; a stage never fails on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import byte_bpe, langid, line_dedup, mixing, order_minhash
from quarrylight.llm.common import broadcast_if_small, small_batches, table, written
from quarrylight.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if it has no letters or if its language's posterior is lower than this.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language; `lang` becomes the predicted language of the rest. The model learns from the
    labels that docs has; without any label nothing can be told and only texts without letters go."""
    small_batches(spark)
    model = langid.train(docs)
    found = langid.predict(docs.select(*COLUMNS), model)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE) if model.langs else F.col("text").rlike(r"\p{L}")
    lang = F.col("lang_pred") if model.langs else F.col("lang")
    return found.where(known).select(*[lang.alias("lang") if c == "lang" else F.col(c) for c in COLUMNS])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars is that of the new text."""
    found = line_dedup.remove_boilerplate(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near copies stays."""
    small_batches(spark)
    found = order_minhash.near_duplicates(docs)
    gone = written(found.where("doc_id <> class_id").select("doc_id").distinct(), "gone")
    return docs.select(*COLUMNS).join(broadcast_if_small(gone), "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that bring sources, languages and topics to their target weights."""
    return mixing.mix(docs.select(*COLUMNS)).where("selected").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of what they decode to."""
    small_batches(spark)
    return byte_bpe.encode_decode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"))


STAGES: list = [("language", language), ("line dedup", lines), ("near copies", near_copies), ("mixture", mixture), ("token ids", token_ids)]
#: Language scores, near copies and byte pairs have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
