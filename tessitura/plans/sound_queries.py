"""Queries of sounds: sample rates and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import arrays, signals
from tessitura.operators import sound
from tessitura.plans.queries import query, read

CUT, SIDE = "(0.95 * 2 / 3)", 51


@query(
    "WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, CAST(trunc(greatest(-1.0, least(1.0, CAST(unnest(embedding) AS DOUBLE))) * 32767) AS DOUBLE) / 32768 AS v FROM embeddings), "
    f"taps AS (SELECT n, n * 3 // 2 + j AS i, j - (n * 3 % 2) / 2.0 AS away FROM range(0, 43) a(n), range({1 - SIDE}, {SIDE + 1}) b(j)), "
    f"h AS (SELECT n, i, CASE WHEN away = 0 THEN 1.0 ELSE sin(pi() * {CUT} * away) / (pi() * {CUT} * away) END * (0.5 + 0.5 * cos(pi() * greatest(-1.0, least(1.0, away / {SIDE})))) AS h FROM taps), "
    "total AS (SELECT n, sum(h) AS total FROM h GROUP BY n) "
    "SELECT vec_id, n, round(sum(v * h) / any_value(total), 6) + 0.0 AS value FROM x JOIN h USING (i) JOIN total USING (n) GROUP BY vec_id, n"
)
def resampled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as WAV files of 24 kHz, at 16 kHz."""
    files = read(spark, sf_dir, "embeddings").select("vec_id", arrays.wav(arrays.pcm16("embedding")).alias("content"))
    parts = sound.resample_files(files, "vec_id", "content")
    return parts.select("vec_id", F.posexplode("samples").alias("at", "v")).select("vec_id", F.col("at").cast("long").alias("n"), (F.round("v", 6) + 0.0).alias("value"))


@query(
    "WITH f AS (SELECT vec_id // 4 AS clip, vec_id % 4 AS k, embedding FROM embeddings), "
    "b AS (SELECT clip, k, unnest(range(0, 33)) AS b, embedding FROM f), "
    "c AS (SELECT clip, k, b, CAST(embedding[b + 1] AS DOUBLE) AS re, CASE WHEN b BETWEEN 1 AND 31 THEN CAST(embedding[b + 33] AS DOUBLE) ELSE 0.0 END AS im, CASE WHEN b IN (0, 32) THEN 1.0 ELSE 2.0 END AS twice FROM b), "
    "s AS (SELECT clip, k, i, sum(twice * (re * cos(2 * pi() * b * i / 64) - im * sin(2 * pi() * b * i / 64))) / 64 AS x FROM c, range(0, 64) t(i) GROUP BY clip, k, i), "
    "r AS (SELECT clip, k * 32 + i - 16 AS \"at\", x, 0.5 * (1 - cos(2 * pi() * i / 64)) AS w FROM s) "
    "SELECT clip, CAST(\"at\" AS BIGINT) AS \"at\", round(sum(x * w) / sum(w * w), 6) + 0.0 AS value FROM r JOIN (SELECT clip AS c, (max(k) + 1) * 32 AS n FROM f GROUP BY clip) ON clip = c AND \"at\" >= 0 AND \"at\" < n GROUP BY clip, r.\"at\" HAVING sum(w * w) > 1e-11"
)
def sounds_of_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as half spectra, turned into frames of samples that are added up under a window."""
    d = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: x.cast("double"))
    im = F.concat(F.array(F.lit(0.0)), d(34, 31), F.array(F.lit(0.0)))
    frames = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("clip"), (F.col("vec_id") % 4).alias("k"), d(1, 33).alias("re"), im.alias("im"))
    out = signals.overlap_add(sound.inverse_spectra(frames, "clip", "k", "re", "im", 64), "clip", "k", "samples", 32, 64)
    return out.select("clip", F.col("at").cast("long").alias("at"), (F.round("value", 6) + 0.0).alias("value"))
