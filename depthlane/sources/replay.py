"""A replay data source for recorded frames, batch and streaming: folders of .npz files, one frame each.

Each file holds frame_id, filtered and raw (uint16) and gray (uint8). Register with spark.dataSource.register(ReplaySource),
then spark.read.format("depth_replay").load(folder) or spark.readStream with the same format.
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "frame_id long, width int, height int, filtered binary, raw binary, gray binary"


def _read(path: str):
    import numpy as np

    with np.load(path) as f:
        filtered = f["filtered"].astype("<u2")
        return (int(f["frame_id"]), filtered.shape[1], filtered.shape[0], filtered.tobytes(), f["raw"].astype("<u2").tobytes(), f["gray"].astype("uint8").tobytes())


def _files(folder: str) -> list[str]:
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".npz"))


class _Batch(DataSourceReader):
    def __init__(self, folder: str, per_task: int):
        self.folder, self.per_task = folder, per_task

    def partitions(self):
        files = _files(self.folder)
        return [InputPartition(files[a : a + self.per_task]) for a in range(0, len(files), self.per_task)] or [InputPartition([])]

    def read(self, partition):
        for path in partition.value:
            yield _read(path)


class _Stream(SimpleDataSourceStreamReader):
    """Offsets count files in name order, so a recording that grows by later names is replayed exactly once."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def initialOffset(self):
        return {"file": 0}

    def read(self, start):
        files = _files(self.folder)[start["file"] : start["file"] + self.most]
        return iter([_read(f) for f in files]), {"file": start["file"] + len(files)}

    def readBetweenOffsets(self, start, end):
        return iter([_read(f) for f in _files(self.folder)[start["file"] : end["file"]]])


class ReplaySource(DataSource):
    @classmethod
    def name(cls):
        return "depth_replay"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options["path"], int(self.options.get("framesPerTask", 32)))

    def simpleStreamReader(self, schema):
        return _Stream(self.options["path"], int(self.options.get("framesPerBatch", 64)))
