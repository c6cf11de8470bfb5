"""A Python data source for segment files: spark.read.format("capture_segments").load(folder); each file is a partition."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracemill.core.fold import call_id
from tracemill.core.segments import SCOPE, identity, read_segment
from tracemill.core.values import dump


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_segments"

    def schema(self) -> str:
        return "call_id string, segment_id string, digest string, first_sequence long, through_sequence long, observations string, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return SegmentReader(self.options["path"])


class SegmentReader(DataSourceReader):
    """Files are listed and opened through pyarrow's file systems, so a URI may name any store they know."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._store()
        return [FilePartition(f.path) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with self._store()[0].open_input_stream(partition.path) as f:
            for line in f.read().decode("utf-8", "replace").splitlines():
                if line.strip():
                    e, found, error = read_segment(line)
                    scope = [e.get(k) for k in SCOPE]
                    named = all(isinstance(x, str) for x in scope)
                    yield (call_id(*scope) if named else None, identity(e, e.get("firstSequence"), e.get("throughSequence")) if named else None, e.get("contentSha256"), e.get("firstSequence") if not error else None, e.get("throughSequence") if not error else None, dump(found) if found else None, error)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSource)
