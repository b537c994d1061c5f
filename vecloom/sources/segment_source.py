"""Spark data source 'vector_segment': reads and writes binary segments, one file per partition.

Options: path (a folder that driver and executors share), dimension, storage (float32 or float16).
"""

from __future__ import annotations

import uuid
from pathlib import Path

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from vecloom.sources import binary_format


class Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(str(f)) for f in sorted(Path(self.options["path"]).glob("*.qemb"))] or [InputPartition("")]

    def read(self, partition):
        if partition.value:
            for item, v in binary_format.read(Path(partition.value).read_bytes(), int(self.options["dimension"]), self.options.get("storage", "float32")):
                yield item, v.tolist()


class Writer(DataSourceWriter):
    def __init__(self, options):
        self.options = options

    def write(self, rows):
        place = Path(self.options["path"])
        place.mkdir(parents=True, exist_ok=True)
        name = f"{uuid.uuid4().hex}.tmp"
        data = binary_format.write(((r["id"], np.asarray(r["embedding"], np.float32)) for r in rows), b"{}", self.options.get("storage", "float32"))
        (place / name).write_bytes(data)
        return Written(name)

    def commit(self, messages):
        for m in messages:
            if m is not None:
                p = Path(self.options["path"]) / m.name
                p.rename(p.with_suffix(".qemb"))

    def abort(self, messages):
        for m in messages:
            if m is not None:
                (Path(self.options["path"]) / m.name).unlink(missing_ok=True)


class SegmentSource(DataSource):
    @classmethod
    def name(cls):
        return "vector_segment"

    def schema(self):
        return "id string, embedding array<float>"

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)
