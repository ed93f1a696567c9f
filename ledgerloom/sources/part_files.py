"""Data source that writes numbered parts under their final names, from the tasks that hold them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "ledgerloom_parts"


@dataclass
class _Written(WriterCommitMessage):
    parts: int


class PartFiles(DataSource):
    """Takes ``part, line``: rows of a part stand in one task, in order, and so do a task's parts.

    Options: ``target`` with ``{part}`` for the number, ``header``.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["target"], self.options["header"])


class _Writer(DataSourceArrowWriter):
    """A part is written beside its place and moved there when it is whole.

    A repeated task writes the same bytes again and replaces its files, so a lost executor
    leaves neither half a part nor two, and the driver has no step per part.
    """

    def __init__(self, target: str, header: str):
        self.target, self.header = target, header

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, pattern = fs.FileSystem.from_uri(self.target.replace("{part}", "PART-NUMBER"))
        folder = pattern.rsplit("/", 1)[0]
        files.create_dir(folder, recursive=True)
        part, out, written = None, None, 0
        beside = f"{folder}/.{uuid.uuid4().hex}"

        def finish():
            out.close()
            files.move(beside, pattern.replace("PART-NUMBER", str(part)))

        try:
            for batch in iterator:
                for number, line in zip(batch.column("part").to_pylist(), batch.column("line").to_pylist()):
                    if number != part:
                        if out is not None:
                            finish()
                        part, out, written = number, files.open_output_stream(beside, buffer_size=1 << 20), written + 1
                        out.write((self.header + "\n").encode())
                    out.write((line + "\n").encode())
            if out is not None:
                finish()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
                files.delete_file(beside)
            raise
        return _Written(written)
