"""The sink for sounds: one file a request, whatever is tried again."""

from __future__ import annotations

import os

import numpy as np
import pytest

from tessitura.sources.pcm import PcmStreamWriter, PcmWriter, sound_files, with_pcm
from tessitura.sources.readers import sounds

SCHEMA = "request string, k int, samples array<float>"


def pieces():
    rng = np.random.default_rng(1)
    return [(r, k, [float(x) for x in rng.uniform(-1.2, 1.2, 50)]) for r, n in (("a", 5), ("b/ü", 1), ("c", 3)) for k in range(n)]


def joined(rows, request):
    return b"".join((np.clip(np.array(s, np.float32).astype(float), -1, 1) * 32767).astype("<i2").tobytes() for r, _, s in sorted(rows, key=lambda x: x[1]) if r == request)


def there(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("_"))


def test_one_file_a_request(spark, tmp_path):
    rows = pieces()
    df = with_pcm(spark).createDataFrame([*rows, (None, 0, [0.5]), ("a", 9, None)], SCHEMA).repartition(6)
    df.write.format("pcm").mode("append").option("path", str(tmp_path)).save()
    assert there(tmp_path) == ["a.json", "a.pcm", "b%2F%C3%BC.json", "b%2F%C3%BC.pcm", "c.json", "c.pcm"] and not os.listdir(tmp_path / "_staged")
    for request, name in (("a", "a"), ("b/ü", "b%2F%C3%BC"), ("c", "c")):
        assert (tmp_path / f"{name}.pcm").read_bytes() == joined(rows, request)
    told = {r["request"]: r for r in sound_files(spark, str(tmp_path)).collect()}
    assert set(told) == {"a", "b/ü", "c"} and told["a"]["bytes"] == 500 and told["a"]["sample_rate"] == 24000 and told["a"]["bit_depth"] == 16
    df.write.format("pcm").mode("append").option("path", str(tmp_path / "wav")).option("response_format", "wav").option("rate", "100").save()
    lengths = {r["path"].rsplit("/")[-1]: r["seconds"] for r in sounds(spark, str(tmp_path / "wav/*.wav")).collect()}
    assert lengths["a.wav"] == 2.5 and lengths["c.wav"] == 1.5


def test_tasks_that_ran_twice_and_aborted_jobs(tmp_path):
    rows = [{"request": r, "k": k, "samples": s} for r, k, s in pieces()]
    writer = PcmWriter({"path": str(tmp_path)})
    writer.write(iter(rows[:4]))  # an attempt that was lost: nobody has its message
    writer.commit([writer.write(iter(rows[:4])), writer.write(iter(rows[4:])), None])
    assert there(tmp_path) == ["a.json", "a.pcm", "b%2F%C3%BC.json", "b%2F%C3%BC.pcm", "c.json", "c.pcm"] and (tmp_path / "a.pcm").read_bytes() == joined(pieces(), "a")
    gone = PcmWriter({"path": str(tmp_path / "x")})
    gone.abort([gone.write(iter(rows))])
    assert there(tmp_path / "x") == [] and not os.listdir(tmp_path / "x/_staged")
    with pytest.raises(ValueError):
        PcmWriter({"path": "x", "response_format": "mp3"})


def test_batches_add_and_a_retried_one_replaces_itself(tmp_path):
    rows = [{"request": "a", "k": k, "samples": s} for r, k, s in pieces() if r == "a"]
    for number, some in ((0, rows[:2]), (1, rows[2:3]), (1, rows[2:3]), (2, rows[3:])):
        writer = PcmStreamWriter({"path": str(tmp_path)})
        writer.commit([writer.write(iter(some))], number)
    assert (tmp_path / "a.pcm").read_bytes() == joined(pieces(), "a") and there(tmp_path) == ["a.json", "a.pcm"]


def test_stream(spark, tmp_path):
    rows = pieces()
    with_pcm(spark)
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] % 3 == k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).where("k < 3")
        stream.writeStream.format("pcm").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    kept = [r for r in rows if r[1] < 3]
    assert (tmp_path / "out/a.pcm").read_bytes() == joined(kept, "a") and (tmp_path / "out/c.pcm").read_bytes() == joined(kept, "c")
