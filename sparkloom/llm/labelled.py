"""A bounded sample of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, ids: DataFrame, n: int, listed: bool = True) -> DataFrame:
    """Rows (doc_id, text) of the n documents whose hashed doc_id is least among those that `ids` lists; whole texts, null ones empty. Not listed: `ids` are rows of `docs`.

    Ids are chosen among the documents there are, so that labels of other documents take
    no one's place. The rows of one id are all taken; null ids are left out.
    """
    have = docs.select("doc_id").join(ids.select("doc_id"), "doc_id", "left_semi") if listed else ids.select("doc_id").where("doc_id is not null")
    few = have.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return docs.join(F.broadcast(few), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def fold(column: str, parts: int):
    return F.crc32(F.col(column).cast("string")) % parts
