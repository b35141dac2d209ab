"""From raw documents to packed training sequences: stages over the operators of samphire.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again for the next one.

Odd rows have these results in every stage: an empty table gives an empty one;
columns beyond those of documents go along, whatever their names; null ids,
languages and sources are values like others. What null and empty texts and
repeated rows become is said at each stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samphire.checkpoints import remove_folder
from samphire.llm import mixing, near_copies, packing, secret_scan, toxicity
from samphire.llm.common import checkpoint_dir, fold
from samphire.shipping import ship

#: Rows of an Arrow batch: they are whole documents, of which a task holds several copies at once.
BATCH_ROWS = 1000
#: Documents that score this or more are rejected.
TOXIC = 0.5
TOKENIZER = "word_bpe_49k.json"


def _ready(spark: SparkSession) -> None:
    """The workers have the package; the application's session has short batches and drops a query's shuffle files with it.

    What a later query reads is a checkpoint or a stage's table, so no shuffle outlives its own query.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below TOXIC; it learns from the labels of four folds in five.

    Null and empty texts have the score of the model's bias, far below TOXIC; repeated rows go or stay together.
    """
    _ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model, carry=docs.columns, score_col="__toxicity")
    return scored.where(F.col("__toxicity") < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, that of the smallest id.

    Null, empty and blank texts are one group. A null id stays only where its group has no other. Of rows that repeat an
    id and its text one stays.
    """
    _ready(spark)
    found = near_copies.near_copies(docs, words=5, similarity=0.8)
    kept = found.where("first").groupBy(F.col("doc_id").alias("__kept"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("__rows"))
    same = (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")) & docs["doc_id"].eqNullSafe(F.col("__kept"))
    rows, columns = docs.join(kept, same), [F.col(f"`{c}`") for c in docs.columns]
    # rows that repeat an id and its text are copies too: one of them stays
    return rows.where("__rows = 1").select(*columns).unionByName(rows.where("__rows > 1").select(*columns).dropDuplicates(["doc_id", "text"]))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every secret masked; n_chars follows. Rows without secrets, null texts too, are unchanged."""
    _ready(spark)
    return secret_scan.redact(docs, secret_scan.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, wholly or (one document a source) in part.

    Documents without words add nothing to a source and have no row; a null source is a source.
    """
    _ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text", "source"))
    taken = mixing.mix(keyed, labels, carry=["__row"])
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    # rows equal in id, text and source can't be told apart: each gets the most that one of them got
    copies = taken.where("taken > 0").groupBy(F.col("doc_id").alias("__id"), F.col("__row").alias("__taken_row")).agg(F.max(times).alias("__times"))
    joined = keyed.join(copies, (F.col("__row") == F.col("__taken_row")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, lexical neighbours together. Null and empty texts are one end id."""
    _ready(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: No stage's learned scores or fingerprints can be expressed in SQL: tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them goes to the shared folder, where the last stage's rows stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
