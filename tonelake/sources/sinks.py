"""Where samples go: tables, streams of tables, and WAV files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.session import ready


def write_table(pcm: DataFrame, path: str, mode: str = "overwrite") -> None:
    """PCM rows as Parquet, partitioned by nothing: streams are many and small."""
    pcm.write.mode(mode).parquet(path)


def wav_header(frames: int, rate: int, channels: int = 2, bits: int = 16) -> bytes:
    size = frames * channels * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + b"data" + struct.pack("<I", size)


def record_wav(pcm: DataFrame, folder: str, rate: int) -> DataFrame:
    """Writes 16-bit stereo WAV files, one for each stream; returns (stream_id, path, frames).

    Frames are counted first, so the header is right from the start and no file is rewritten. Streams are hashed over
    tasks and sorted there; a task holds a batch of one stream at a time. A stream missing frames is written closed up.
    """
    from pyarrow.fs import FileSystem

    ready(pcm.sparkSession)
    counted = pcm.join(pcm.groupBy("stream_id").agg(F.count("*").alias("frames")), "stream_id")
    rows = counted.select("stream_id", "frame_no", "left", "right", "frames").repartition("stream_id").sortWithinPartitions("stream_id", "frame_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import numpy as np

        open_, out, path, n = None, None, "", 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([open_]), pa.array([path]), pa.array([n], pa.int64())], names=["stream_id", "path", "frames"])

        for batch in batches:
            ids = np.array(batch.column("stream_id").to_pylist(), object)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            samples = np.clip(np.stack([batch.column(c).to_numpy() for c in ("left", "right")], axis=1) >> 16, -32768, 32767).astype("<i2")
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if out is None or ids[a] != open_:
                    if out is not None:
                        yield done()
                    open_, path, n = ids[a], f"{folder}/{uuid.uuid4().hex}.wav", 0
                    fs, local = FileSystem.from_uri(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None)
                    out.write(wav_header(batch.column("frames")[a].as_py(), rate))
                out.write(samples[a:b].tobytes())
                n += b - a
        if out is not None:
            yield done()

    return rows.mapInArrow(run, "stream_id string, path string, frames long")
