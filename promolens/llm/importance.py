"""Operator 2: quality classifier by importance resampling.

Two generative models over ``buckets`` hashed word unigrams and bigrams, one of
the target (trusted labelled documents) and one of all raw documents.  A
document's weight is the ratio of its likelihoods; its logarithm is the sum of
the n-grams' log ratios.  Adding Gumbel noise to the log weights and keeping
the k largest draws k documents without replacement in proportion to their
weights.  The noise is a hash of (seed, doc_id), so the sample repeats.

The raw model counts every n-gram of every document (one vector a task, added
up in slices).  The target model is fitted on at most ``max_target`` labelled
documents, a documented bound.  The k-th largest key is found by counting in
ever finer bins; nothing is sorted or collected, and k is ``keep`` times the
number of documents at every size.

Defined results: a null, empty or wordless text has weight 1 (log ratio 0);
rows with equal keys (repeated rows) are kept or left together, so a tie at the
edge keeps a few more than k; null ids are treated as one more id; extra
columns pass through (``n_grams``, ``log_ratio``, ``gumbel_key`` and ``kept``
are replaced).  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.common import P2, U, Words, arrow_map, documents, kth_largest, mix, shared_table, summed_vectors, table, text_blocks

BUCKETS, ALPHA, PRIOR, KEEP, SEED, MAX_TARGET = 16_384, 0.01, 1_000.0, 0.8, 17, 200_000
RESULTS = ("n_grams", "log_ratio", "gumbel_key", "kept")


def target_ids(labels: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """Ids of at most ``max_target`` documents labelled good and not toxic (by id hash)."""
    good = (labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
            .where("q = 1 AND coalesce(t, 0) = 0"))
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).select("doc_id")


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every unigram and bigram of a block."""
    words = Words(data, offsets, lower=True)
    h, size = words.hash, np.diff(words.first)
    row = np.repeat(np.arange(len(size)), size)
    inside = row[1:] == row[:-1]
    pair = mix(h[:-1] * P2 + h[1:])[inside]
    place = np.concatenate([h, pair]) % U(buckets)
    return np.concatenate([row, row[1:][inside]]), place.astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA, prior: float = PRIOR,
        max_target: int = MAX_TARGET, text_col: str = "text", id_col: str = "doc_id") -> np.ndarray:
    """log(P_target / P_raw) of each bucket."""
    good = target_ids(labels, max_target).select(F.col("doc_id").alias("_id"), F.lit(True).alias("good"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(good), "_id", "left")   # bounded by max_target

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, buckets))
        for batch in batches:
            good = np.array(batch.column(1).fill_null(False).to_pylist(), bool)
            for a, b, data, offsets in text_blocks(batch.column(0)):
                row, place = _grams(data, offsets, buckets)
                total[0] += np.bincount(place, minlength=buckets)
                total[1] += np.bincount(place[good[a:b][row]], minlength=buckets)
        return total.ravel()

    raw, target = summed_vectors(rows.select("text", "good"), 2 * buckets, count).reshape(2, buckets)
    raw = (raw + alpha) / (raw + alpha).sum()
    # the target's prior is the raw model, so a small target says little instead of the wrong thing
    return np.log((target + prior * raw) / (target.sum() + prior)) - np.log(raw)


def weights(docs: DataFrame, model: np.ndarray, seed: int = SEED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with n_grams, log_ratio and gumbel_key."""
    df = docs.drop(*RESULTS)
    # uniform in (0, 1) from 52 bits of the id's hash, then the Gumbel quantile
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 12).cast("double") + 0.5) / F.lit(2.0**52)
    df = df.withColumn("gumbel_key", -F.log(-F.log(unit)))
    fields = [f.name for f in df.schema.fields]
    schema = T.StructType([*df.schema.fields, T.StructField("n_grams", T.LongType()), T.StructField("log_ratio", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b, data, offsets in text_blocks(batch.column(text_col)):
                row, place = _grams(data, offsets, len(model))
                n[a:b] = np.bincount(row, minlength=b - a)
                score[a:b] = np.bincount(row, weights=model[place], minlength=b - a)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(n), pa.array(score)], names=[*fields, "n_grams", "log_ratio"])

    return arrow_map(df, run, schema).withColumn("gumbel_key", F.col("gumbel_key") + F.col("log_ratio"))


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = SEED, text_col: str = "text",
             id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_grams, log_ratio, gumbel_key and kept of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = shared_table(weights(rows, fit(rows, labels), seed).drop("text"), "weights")
    edge = kth_largest(scored, "gumbel_key", math.ceil(keep * scored.count()))
    return scored.select("doc_id", "n_grams", "log_ratio", "gumbel_key",
                         (F.col("gumbel_key") >= F.lit(edge)).alias("kept") if edge is not None else F.lit(False).alias("kept"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight, key and whether it is drawn."""
    return resample(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels"))
