"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Nulls in any column, empty and very long texts,
repeated rows and empty tables are handled as the operators state; columns that documents do not have are dropped at the
start of ``run`` and kept as they are by a stage that is called alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablevault.llm import jaccard, mixing, packing, quality_hosts, secret_ledger
from tablevault.llm.common import settle
from tablevault.llm.registry import vocabulary
from tablevault.workspace import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject, or whose host they reject, go."""
    judged = quality_hosts.quality_rules(docs.select(F.struct(*docs.columns).alias("doc"), "text", "source"), carry=["doc"])
    return judged.where("kept").select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the least doc_id stays."""
    return jaccard.drop_linked(docs, 5, 80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; ``n_chars`` follows where the text changed. All documents stay."""
    ledger = f"{shared_folder(spark)}/llm-ledger-{uuid.uuid4().hex}"
    scanned = secret_ledger.scan_secrets(docs.select(F.struct(*docs.columns).alias("doc"), "text"), ledger)
    clean = secret_ledger.redact(F.col("text"), F.col("findings"))
    doc = F.col("doc").withField("text", clean)
    if "n_chars" in docs.columns:
        length = F.length(clean).cast(docs.schema["n_chars"].dataType)
        doc = doc.withField("n_chars", F.when(F.size("findings") > 0, length).otherwise(F.col("doc.n_chars")))
    return scanned.select(doc.alias("doc")).select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document that the mix takes twice is there twice, one that it leaves out is gone."""
    planned = mixing.mix(docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", "source"), carry=["doc"])
    return mixing.shuffled(planned).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids, packed into sequences."""
    return packing.pack(packing.cut_documents(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), 1024, 2), 1024)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Shingle components, hashed draws and token ids have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
    return docs
