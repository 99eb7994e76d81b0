"""The vector table that ranking reads: built in shards that an interrupted run takes up again, and checked before use."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.profile import RankProfile, load_profile
from ..operators import retrieval, text

SHARD_ROWS = 5000
SHARDS_A_JOB = 64


class ArtifactError(RuntimeError):
    pass


def load_model(folder: str, load: Callable[[str], object], needs: Iterable[str] = ("config.json",), allow_download: bool = False):
    """An encoder or reranker from a local folder. Without permission to download, libraries are told to stay offline and an incomplete folder is an error."""
    if not allow_download:
        os.environ["HF_HUB_OFFLINE"] = os.environ["TRANSFORMERS_OFFLINE"] = "1"
        missing = [n for n in needs if not (Path(folder) / n).exists()]
        if missing:
            raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}; models are not fetched while ranking")
    return load(folder)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        return json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:  # noqa: BLE001  no manifest yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _done(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def build_vectors(records: DataFrame, encoder: Callable, path: str, shard_rows: int = SHARD_ROWS, shards_a_job: int = SHARDS_A_JOB) -> DataFrame:
    """(candidate_id, embedding) of all records, written below `path`.

    Records are dealt to shards by a hash of their id, some thousands to each. Each job
    writes a group of shards, whose success file marks it as done; a later run with the
    same records and shards writes only the groups that are missing.
    """
    spark = records.sparkSession
    rows = records.select("candidate_id", text.rich_text().alias("text"))
    n, mark = rows.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("candidate_id", "text") % 1_000_003), F.lit(0))).first()
    shards = max(1, -(-n // shard_rows))
    want = {"rows": n, "mark": mark, "shards": shards, "shards_a_job": shards_a_job}
    have = _manifest(spark, path)
    if have is not None and have != want:
        raise ArtifactError(f"{path} holds shards of other records or of another size: {have}, not {want}")
    if have is None:
        spark.createDataFrame([(json.dumps(want),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    shard = F.pmod(F.xxhash64("candidate_id"), F.lit(shards))
    for first in range(0, shards, shards_a_job):
        part = f"{path}/vectors/from={first}"
        if not _done(spark, part):
            mine = rows.where((shard >= first) & (shard < first + shards_a_job)).repartition(min(shards_a_job, shards), shard)
            retrieval.encoded(mine, encoder, "candidate_id", "text").write.mode("overwrite").parquet(part)
    return load_vectors(spark, path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vector table, if all its groups are there."""
    have = _manifest(spark, path)
    if have is None:
        raise ArtifactError(f"{path} has no manifest; build the vectors first")
    for first in range(0, have["shards"], have["shards_a_job"]):
        if not _done(spark, f"{path}/vectors/from={first}"):
            raise ArtifactError(f"{path} lacks the shards from {first} on; build the vectors again")
    return spark.read.option("recursiveFileLookup", "true").schema("candidate_id string, embedding array<float>").parquet(f"{path}/vectors")


def check(records: DataFrame, vectors: DataFrame, dim: int | None = None) -> None:
    """Raises unless each record has one vector, each vector a record, and all are of one length (`dim`, if given)."""
    ids = records.select("candidate_id", F.lit(1).alias("r"), F.lit(0).alias("v"), F.lit(None).cast("int").alias("n"))
    both = ids.unionByName(vectors.select("candidate_id", F.lit(0).alias("r"), F.lit(1).alias("v"), F.size("embedding").alias("n")))
    each = both.groupBy("candidate_id").agg(F.sum("r").alias("r"), F.sum("v").alias("v"), F.min("n").alias("low"), F.max("n").alias("high"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    none, stray, twice, low, high = each.agg(count(F.col("v") == 0), count(F.col("r") == 0), count((F.col("v") > 1) | (F.col("r") > 1)), F.min("low"), F.max("high")).first()
    faults = [f"{n} {what}" for n, what in ((none, "records without a vector"), (stray, "vectors without a record"), (twice, "ids that occur twice")) if n]
    if low != high or (dim is not None and low is not None and low != dim):
        faults.append(f"vectors of {low} to {high} components" + (f" instead of {dim}" if dim is not None else ""))
    if faults:
        raise ArtifactError("records and vectors don't belong together: " + "; ".join(faults))


def load_artifacts(spark: SparkSession, records: DataFrame, vectors_path: str, profile_path: str, dim: int | None = None) -> tuple[RankProfile, DataFrame]:
    """The profile and the checked vector table."""
    if not Path(profile_path).is_file():
        raise ArtifactError(f"no profile at {profile_path}")
    vectors = load_vectors(spark, vectors_path)
    check(records, vectors, dim)
    return load_profile(profile_path), vectors


def sanity(x: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """(kind, candidate_id, cosine, ok) of the first record of a strong title and the first keyword stuffer; ok if the former is nearer to the query. No rows where either is missing. `x` has features."""
    from ..operators.consistency import is_stuffer

    kind = F.when(is_stuffer(), "stuffer").when(F.col("title_class") == "strong", "strong")
    first = x.select("candidate_id", kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.min("candidate_id").alias("candidate_id"))
    q = F.array(*[F.lit(float(v)) for v in query])
    norm = lambda v: F.sqrt(retrieval.dot(v, v))
    cosine = F.try_divide(retrieval.dot(F.col("embedding"), q), norm(F.col("embedding")) * norm(q))
    both = vectors.join(F.broadcast(first), "candidate_id").select("kind", "candidate_id", cosine.alias("cosine"))
    told = both.agg(F.count("*").alias("n"), (F.max(F.when(F.col("kind") == "strong", F.col("cosine"))) > F.max(F.when(F.col("kind") == "stuffer", F.col("cosine")))).alias("ok"))
    return both.crossJoin(F.broadcast(told)).where("n = 2").select("kind", "candidate_id", "cosine", "ok")


def encode_queries(p: RankProfile, encoder: Callable, prefix: str = "") -> list[tuple[str, list[float]]]:
    """(aspect, unit vector) of each aspect's text, in order of name; `prefix` is what the encoder wants before a query."""
    import numpy as np

    ordered = p.ordered_aspects()
    m = np.asarray(encoder([prefix + a.query_text for _, a in ordered]), dtype=float).reshape(len(ordered), -1)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return [(name, row.tolist()) for (name, _), row in zip(ordered, m, strict=True)]


def rerank_seconds(reranker: Callable, pairs: list[tuple[str, str]], sizes: tuple[int, ...] = (200, 400)) -> list[tuple[int, float]]:
    """(pairs, milliseconds a pair) of a reranker for each size; the pairs given are repeated as needed."""
    import time

    out = []
    for n in sizes:
        some = [pairs[i % len(pairs)] for i in range(n)]
        began = time.perf_counter()
        for a in range(0, n, retrieval.PAIRS_A_BATCH):
            reranker(some[a : a + retrieval.PAIRS_A_BATCH])
        out.append((n, (time.perf_counter() - began) * 1000 / n))
    return out

