"""A corpus run: five operators, one after the other, over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns what it keeps, with the columns of ``docs``; the last returns the
packed pieces. ``run`` writes every stage's rows to the shared folder and reads
them back as the next one's documents.

Every stage reads the columns doc_id and text (packing: source too) and carries
all others, whatever their names. Null and empty texts are documents without
words: they are not toxic, hold no benchmark item and no personal data; as
equal texts, all but one of them go as copies, and what stays packs to its end
mark. A null doc_id comes after all others where ids decide. Texts of any
length are read whole. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerwire.llm import decontaminate, minhash, packing, pii, toxicity
from tickerwire.llm.common import cut, text_key
from tickerwire.llm.queries import categories


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain finds toxic go; those that it knows nothing of
    (no labels: a probability of the threshold) stay. Equal rows are judged
    alike."""
    models = toxicity.train(docs, _table(spark, sf_dir, "labels"), categories())
    return toxicity.score(docs, models).where(F.col("p")[1] <= toxicity.THRESHOLD).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the smallest
    doc_id (a null one last) of the class, of equal ids the one whose text hash
    is least, and of rows equal in id and text any one."""
    found = minhash.classes(docs).select("key", "class_key")
    rows = docs.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("key"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))
    # ids and text keys alone pick the document; a row given twice stays once
    stay = cut(rows.select("key", "id").join(found, "key").groupBy("class_key").agg(F.min(order).alias("first"))
               .select(F.col("first.key").alias("k"), F.col("first.id").alias("i")), "stay")
    chosen = rows.join(stay, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
    return chosen.dropDuplicates(["key", "id"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, equal rows alike; without items
    none goes."""
    keys = cut(decontaminate.find(docs, _table(spark, sf_dir, "benchmark")).select(F.col("text_key").alias("key")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("key"))
    return rows.join(keys, "key", "left_anti").select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are sanitised, equal ones alike, null ones stay null; n_chars, where
    there is one, follows."""
    clean = pii.sanitise(docs)
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return clean.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents; equal rows are packed each, a null source is a
    queue of its own."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_contaminated),
          ("personal_data", mask_personal_data), ("packing", pack)]
#: SQL expresses neither the trained chain nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
