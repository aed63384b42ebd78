"""Corpus preparation: toxicity, exact dedup, near-duplicates, decontamination, packing.

Each stage reads the Parquet table that the one before wrote; all but the last return the
columns of documents.  Rows without an id pass through every stage by their text.
"""

from __future__ import annotations

from engram.llm import common as C
from engram.llm import decontaminate, exact, minhash, packing, toxicity
from engram.llm.queries import vocabulary


def drop_toxic(spark, docs, sf_dir):
    """Documents that the segment scores reject go; labels come from the learning part only."""
    return toxicity.drop_toxic(docs, C.table(spark, sf_dir, "labels"), C.crc_remainder(5) != 0)


def drop_copies(spark, docs, sf_dir):
    return exact.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    return minhash.drop_near_copies(docs, words=5, percent=80)


def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.drop_contaminated(docs, C.table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL expresses the score of the first stage; the stages are tested one by one.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
