"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes it to the shared
folder and reads it again as the next one's docs. The first four return the columns of
documents:

toxicity           drops documents that score 0.3 or more, by a model of the labels' rows
ngram_join         keeps the first row (by id) of every group whose five-word shingles reach a
                   Jaccard similarity of 0.8; rows have keys of their own, so a row goes only
                   if it is a near copy of one that stays, whatever ids they have
decontamination    drops documents that hold a benchmark passage
pii                puts surrogates in the place of personal data
packing            cuts and packs the token ids into sequences of 4096

Null and blank texts pass all filters, each row of them. Ids may be null or repeat; other
columns are kept under any name. Empty tables pass through as such. The surrogates' key is
the session's spark.tessera.surrogateKey; without it, a random one of this session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, ngram_join, packing, pii, toxicity
from tessera.llm.common import fresh, stored, table

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, score = toxicity.train(docs, table(spark, sf_dir, "labels")), fresh(docs, "score")
    return toxicity.scored(docs, model, score_col=score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = fresh(docs, "row")
    # Written once, so that every later read sees the same keys.
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    groups = ngram_join.near_components(keyed, size=5, percent=80, id_col=row).select(F.col("doc_id").alias(row), F.col("component_id").alias("__group"))
    ids = keyed.select(row, F.col("doc_id").alias("__id"))
    members = groups.join(ids, row)
    first = members.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull(), "__id", row)).getField(row).alias("__first"))
    later = members.join(first, "__group").where(F.col(row) != F.col("__first")).select(row)
    return keyed.join(later, row, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = fresh(docs, "found")
    out = pii.checked(docs, pii.session_key(spark), count_col=found)
    if "n_chars" in docs.columns:
        length = F.when(F.col(found) > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", replace_pii),
    ("packing", pack),
]
#: The stages cannot be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
