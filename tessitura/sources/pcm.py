"""A sink for sounds: one file for each request, by ``df.write.format("pcm")`` or ``writeStream.format("pcm")``.

Rows have request, k (the order of its pieces) and samples. Every task writes the pieces that it has to files of its own under ``_staged``; only what a
task has reported is put together, in the order of ``k``, when all tasks are done, so a task that ran twice leaves one copy. A file is put
in place by a rename and has a second one beside it with rate, channels and depth.

Batches of a stream add to the files of their requests: each keeps its part under ``_parts``, named by the number of the batch, so a batch that is tried again
replaces its own part, and the file is put together anew from the parts of its request.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

RATE, CHANNELS, BITS = 24_000, 1, 16
#: Bytes of a file that are copied at once.
COPIED = 1 << 20


@dataclass
class Staged(WriterCommitMessage):
    """The pieces that a task has written: request, k and file."""

    pieces: list[tuple[str, int, str]] = field(default_factory=list)


def pcm16_bytes(samples: list[float]) -> bytes:
    return (np.clip(np.nan_to_num(np.asarray(samples, np.float64)), -1, 1) * 32767).astype("<i2").tobytes()


def wav_head(size: int, rate: int) -> bytes:
    """The 44 bytes before the samples of a mono 16-bit WAV."""
    n = lambda value, width: value.to_bytes(width, "little")
    return b"RIFF" + n(size + 36, 4) + b"WAVEfmt " + n(16, 4) + n(1, 2) + n(CHANNELS, 2) + n(rate, 4) + n(rate * CHANNELS * BITS // 8, 4) + n(CHANNELS * BITS // 8, 2) + n(BITS, 2) + b"data" + n(size, 4)


class PcmFiles:
    """What both writers do: stage pieces in tasks, put files together on commit, remove what was staged otherwise."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rate, self.form = options["path"].rstrip("/"), int(options.get("rate", RATE)), options.get("response_format", "pcm")
        if self.form not in ("pcm", "wav"):
            raise ValueError(f"response_format is pcm or wav, not {self.form}")
        self.run = uuid.uuid4().hex

    def place(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if ":/" in self.path else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, top = self.place()
        own, done = f"{top}/_staged/{self.run}/{uuid.uuid4().hex}", Staged()
        files.create_dir(own, recursive=True)
        for row in iterator:
            if row["request"] is None or row["samples"] is None:
                continue
            at = f"{own}/{len(done.pieces)}"
            with files.open_output_stream(at) as out:
                out.write(pcm16_bytes(row["samples"]))
            done.pieces.append((str(row["request"]), int(row["k"] or 0), at))
        return done

    @staticmethod
    def by_request(messages: list[Staged | None]) -> dict[str, list[str]]:
        """The staged files of every request in the order of their pieces."""
        found: dict[str, list[tuple[int, str]]] = {}
        for message in messages:
            for request, k, at in message.pieces if message else ():
                found.setdefault(request, []).append((k, at))
        return {request: [at for _, at in sorted(pieces)] for request, pieces in found.items()}

    def joined(self, files: pafs.FileSystem, parts: list[str], to: str, headed: bool) -> int:
        """Copy files one behind the other to ``to`` by way of a file beside it; the number of bytes of sound."""
        size = sum(x.size for x in files.get_file_info(parts)) if parts else 0
        beside = f"{to}.{uuid.uuid4().hex}"
        with files.open_output_stream(beside) as out:
            if headed:
                out.write(wav_head(size, self.rate))
            for part in parts:
                with files.open_input_stream(part) as piece:
                    while block := piece.read(COPIED):
                        out.write(block)
        files.move(beside, to)
        return size

    def published(self, files: pafs.FileSystem, top: str, request: str, parts: list[str]) -> None:
        name = quote(request, safe="")
        size = self.joined(files, parts, f"{top}/{name}.{self.form}", self.form == "wav")
        with files.open_output_stream(f"{top}/{name}.json") as out:
            out.write(json.dumps({"request": request, "sample_rate": self.rate, "channels": CHANNELS, "bit_depth": BITS, "bytes": size}).encode())

    def unstaged(self) -> None:
        files, top = self.place()
        if files.get_file_info(f"{top}/_staged/{self.run}").type == pafs.FileType.Directory:
            files.delete_dir(f"{top}/_staged/{self.run}")


class PcmWriter(PcmFiles, DataSourceWriter):
    """A batch: all files are new."""

    def commit(self, messages: list[Staged | None]) -> None:
        files, top = self.place()
        for request, parts in self.by_request(messages).items():
            self.published(files, top, request, parts)
        self.unstaged()

    def abort(self, messages: list[Staged | None]) -> None:
        self.unstaged()


class PcmStreamWriter(PcmFiles, DataSourceStreamWriter):
    """A stream: files grow by a part for each batch."""

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        files, top = self.place()
        for request, pieces in self.by_request(messages).items():
            folder = f"{top}/_parts/{quote(request, safe='')}"
            files.create_dir(folder, recursive=True)
            self.joined(files, pieces, f"{folder}/{batchId:012d}", False)
            parts = [x.path for x in files.get_file_info(pafs.FileSelector(folder)) if x.base_name.isdigit()]
            self.published(files, top, request, sorted(parts))
        self.unstaged()

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.unstaged()


class PcmSource(DataSource):
    """Options: path (seen by the driver and all executors), rate, response_format (pcm or wav)."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PcmWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return PcmStreamWriter(dict(self.options))


def with_pcm(spark: SparkSession) -> SparkSession:
    """``spark`` with the format ``pcm``."""
    spark.dataSource.register(PcmSource)
    return spark


def sound_files(spark: SparkSession, path: str) -> DataFrame:
    """The files that the sink has put in place: request, sample_rate, channels, bit_depth and bytes."""
    return spark.read.schema("request string, sample_rate int, channels int, bit_depth int, bytes long").json(f"{path}/*.json")
