"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns the documents its decisions leave, all but the last with the columns of
``documents``. ``run`` applies them in order, each result written as Parquet into
the shared folder and reread, so that a lost executor costs one stage at most; a
stage's files go once the next one's are written.
The drops, masks and copies of the stages aren't expressible in SQL (learned
lexicon, MinHash, encoder); tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, minhash, mixing, pii, toxicity
from sparkloom.llm.common import prepare, remove_shared, shared_path, table


def _stage(function):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return function(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _stage(toxicity.stage)),
    ("minhash near-dedup", _stage(minhash.stage)),
    ("pii", _stage(pii.stage)),
    ("mixing", _stage(mixing.stage)),
    ("bpe", _stage(bpe.stage)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = shared_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before is not None:
            remove_shared(spark, before)
        before = at
    return docs
