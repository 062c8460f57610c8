"""The corpus pipeline: each stage is one of the training-data operators.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and reread as the next one's docs.  All but the last return
the columns of documents, whichever there are.

Defined results: a null text is scored as an empty one by the first stage and
has no language, so that it goes in the second; a null doc_id is kept like any
other; of repeated rows one stays; empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontam, jaccard, langid, packing, quality
from larkspur.llm.common import ensure_checkpoint_dir, fold, small_batches, table
from larkspur.llm.queries import CUTOFF, tokenizer_path


def _renamed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with neutral column names, so that none clashes; the names of id and text."""
    small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go."""
    rows, key, text = _renamed(docs)
    others = tuple(c for c in rows.columns if c not in (key, text))
    scored = quality.classify(rows, table(spark, sf_dir, "labels"), fold(key, 5) != 0, key, text, others, carry_text=True, label_key="doc_id")
    return scored.where(F.col("quality_score") >= CUTOFF).select(*rows.columns).toDF(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: null or letterless texts and those far from every centroid."""
    model = langid.fit(docs, fold("doc_id", 5) != 0)
    rows, _, text = _renamed(docs)
    return langid.identify(rows, model, text).where(~F.col("lang_rejected")).select(*rows.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; of repeated rows of it, one."""
    return jaccard.keep_representatives(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    packed = packing.pack_documents(docs, tokenizer_path(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontaminate_stage),
    ("packing", packing_stage),
]

#: the learned classifier, tokens and the packing search are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    base = (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()).rstrip("/")
    place = f"{base}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{place}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            # what a finished stage has read is not needed any more
            gone = sc._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(sc._jsc.hadoopConfiguration()).delete(gone, True)
        before = path
    return docs
