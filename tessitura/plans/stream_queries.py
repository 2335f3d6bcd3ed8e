"""Queries of streams: requests that fail, and sounds as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.plans.queries import CHUNK, CONTEXT, query, read, text_of
from tessitura.sources import pcm, writers
from tessitura.streaming.requests import request_chunks, streaming_session

FAILS = 13


@query(
    f"WITH e AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderkey % {FAILS} = 0) AS bad FROM orders GROUP BY o_custkey), "
    "c AS (SELECT o_custkey, list(o_orderkey % 65536 ORDER BY o_orderkey) AS codes FROM orders JOIN e USING (o_custkey) WHERE bad IS NULL OR o_orderkey < bad GROUP BY o_custkey), "
    f"n AS (SELECT o_custkey, codes, len(codes) AS n, unnest(range(0, greatest(len(codes) - {CONTEXT}, 0) // {CHUNK})) AS k FROM c) "
    f"SELECT o_custkey, CAST(k AS INT) AS k, CAST(k * {CHUNK} AS INT) AS \"start\", CAST((k + 1) * {CHUNK} AS INT) AS \"end\", array_to_string(codes[greatest(k * {CHUNK} - {CONTEXT}, 0) + 1 : least((k + 1) * {CHUNK} + {CONTEXT}, n)], ' ') AS codes, NULL AS error FROM n "
    "UNION ALL SELECT o_custkey, NULL, NULL, NULL, NULL, 'order ' || bad FROM e WHERE bad IS NOT NULL"
)
def failed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream in which some fail: whole chunks of each customer before the first failure, and the failure."""
    schema = read(spark, sf_dir, "orders").schema
    own = streaming_session(spark)
    orders = own.readStream.schema(schema).parquet(f"{sf_dir}/orders.parquet*")
    bad = F.col("o_orderkey") % FAILS == 0
    fragment = F.concat(F.lit("<|s_"), text_of(F.col("o_orderkey") % 65536), F.lit("|>"))
    rows = orders.select(text_of(F.col("o_custkey")).alias("request"), F.col("o_orderkey").alias("seq"), F.when(~bad, fragment).alias("fragment"), F.when(bad, F.concat(F.lit("order "), text_of(F.col("o_orderkey")))).alias("error"))
    path = f"{writers.shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    chunks = request_chunks(rows, CHUNK, CONTEXT)
    writers.stream_to(chunks, f"{path}/out", f"{path}/log").awaitTermination()
    found = spark.read.schema(chunks.schema).parquet(f"{path}/out")
    return found.select(F.col("request").cast(schema["o_custkey"].dataType).alias("o_custkey"), "k", "start", "end", F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"), "error")


@query("SELECT CAST(vec_id // 8 AS VARCHAR) AS request, 24000 AS sample_rate, 1 AS channels, 16 AS bit_depth, CAST(sum(len(embedding)) * 2 AS BIGINT) AS bytes FROM embeddings GROUP BY vec_id // 8")
def sound_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors each as one file of samples, and what stands beside the files."""
    path = f"{writers.shared_folder(spark)}/sounds-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "embeddings").select(F.expr("CAST(vec_id div 8 AS STRING)").alias("request"), (F.col("vec_id") % 8).cast("int").alias("k"), F.col("embedding").cast("array<float>").alias("samples"))
    pcm.with_pcm(spark)
    rows.write.format("pcm").mode("append").option("path", path).save()
    return pcm.sound_files(spark, path)
