"""Small files next to others, such as indexes: written aside by tasks and moved when the job commits."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Moves(WriterCommitMessage):
    files: list[tuple[str, str]]


class SidecarWriter(DataSourceArrowWriter):
    """Rows (target, data); those of a target follow each other in one task and are its pieces in order."""

    def write(self, iterator):
        moves, out, current = [], None, None
        for batch in iterator:
            for target, data in zip(batch.column("target").to_pylist(), batch.column("data").to_pylist()):
                filesystem, name = pafs.FileSystem.from_uri(target.replace("file:///", "/"))
                if target != current:
                    if out is not None:
                        out.close()
                    aside = f"{name}.{uuid.uuid4().hex}"
                    moves.append((aside, name))
                    out, current = filesystem.open_output_stream(aside), target
                out.write(data)
        if out is not None:
            out.close()
        return Moves(moves)

    def _each(self, messages, act):
        for message in messages:
            for aside, name in message.files if message is not None else ():
                filesystem, path = pafs.FileSystem.from_uri(aside)
                act(filesystem, path, name)

    def commit(self, messages):
        self._each(messages, lambda filesystem, aside, name: filesystem.move(aside, name))

    def abort(self, messages):
        self._each(messages, lambda filesystem, aside, name: filesystem.delete_file(aside))


class SidecarSource(DataSource):
    @classmethod
    def name(cls):
        return "sidecars"

    def schema(self):
        return "target string, data binary"

    def writer(self, schema, overwrite):
        return SidecarWriter()


def write_sidecars(rows: DataFrame) -> None:
    """Writes (target, data) rows; a target's rows must lie in one partition, together and in order."""
    rows.sparkSession.dataSource.register(SidecarSource)
    rows.write.format("sidecars").mode("append").save()
