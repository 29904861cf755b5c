"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents.

Rows with null or empty texts have no letter and go with the language stage, unless no row could teach a language;
repeated rows are copies, of which near_dedup keeps one; an empty table gives no rows.
"""

from pyspark.sql import DataFrame, SparkSession

from siftlens.llm import decontaminate, langid, neardup, packing, secrets
from siftlens.llm.common import stored, table
from siftlens.session import ship


def _shipping(stage):
    """The stage, with the package's code at hand on the executors."""
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("language_id", _shipping(langid.stage)),
    ("near_dedup", _shipping(neardup.stage)),
    ("decontaminate", _shipping(decontaminate.stage)),
    ("secrets", _shipping(secrets.stage)),
    ("packing", _shipping(packing.stage)),
]

#: Trained probabilities, shingle hashes and the packing plan have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows lie in the shared folder before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
