"""A corpus pipeline: language ID, exact dedup, similarity dedup, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. It is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimlode.llm import common, decontaminate, exactdedup, jaccard, langid, wordbpe


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are in no language; fitted to the labelled rows of docs.

    These are null texts, those without letters, and those of SURE_CHARS or more none of whose n-grams are in any
    language's filter. Where no language is learned, all texts with letters stay. Repeated rows are judged each for
    itself; columns may have any names; an empty table stays empty.
    """
    learn = common.crc_bucket(F.col("doc_id"), 4) != 2
    filters = langid.fit(docs.where(learn))
    if not filters.languages:
        return langid.lettered(docs)
    pred, score = common.fresh(docs, "lang_pred"), common.fresh(docs, "score")
    found = langid.predict(docs, filters, pred_col=pred, score_col=score)
    placed = (F.col(score) > 0) | (F.length("text") < SURE_CHARS)
    return found.where((F.col(pred) != langid.UNKNOWN) & placed).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: the longest text, then the smallest id.

    Null and blank texts are one group. Null ids come last; of repeated rows one stays; an empty table stays empty.
    """
    return exactdedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id: linked by five-word shingles with a similarity of 0.8 or more.

    Null and blank texts have no copies and stay; null ids come last; an empty table stays empty.
    """
    return jaccard.dedup(docs, words=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of whose words a twentieth or more are benchmark passages, and without such passages in others.

    Null and empty texts, and all texts where the benchmark is empty, stay as they are; repeated rows are treated alike.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids (little-endian unsigned 32-bit), their number, and the SHA-256 of the text decoded from them.

    Null and empty texts have no ids, and decode to the empty text. A row for each row; an empty table has none.
    """
    return wordbpe.round_trip(docs, wordbpe.vocabulary("word_bpe_49k.json"))


#: Characters from which on a text without any learned n-gram is in no learned language.
SURE_CHARS = 64
STAGES = [("language", language), ("exact", exact), ("near", near), ("clean", clean), ("encode", encode)]
#: SQL can't express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole documents table; each stage before is written and read again. Null and repeated rows and an empty table are as the stages say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
