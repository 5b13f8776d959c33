"""Stored responses as a data source: what a service answered once is read again, as a table or as a stream.

``spark.dataSource.register(StoredResponses)``, then ``spark.read.format("stored_responses").load(folder)``, or
``readStream``. A folder holds files of responses, one JSON object a line with url, source, status and payload. Every file is
a partition; a stream takes files in order of name and counts them as its offset, so new files must sort behind those
that are there, and a stream that is started again goes on where it stopped. Folders are of any store that Arrow opens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, line int, source string, url string, status int, payload string, note string"


def _files(folder: str) -> list[str]:
    """The folder's files in order of name; hidden ones and those of writers in progress aren't listed."""
    from pyarrow import fs

    store, base = _opened(folder)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=False))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and not f.base_name.endswith(".crc"))


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


class File(InputPartition):
    def __init__(self, folder: str, path: str):
        self.folder, self.path = folder, path


def _rows(part: File) -> Iterator[tuple]:
    """One row a line; a line that isn't a response is a row of status 0 with the reason."""
    import io

    store, _ = _opened(part.folder)
    with store.open_input_stream(part.path) as raw:
        for n, line in enumerate(io.TextIOWrapper(raw, "utf-8", errors="replace"), 1):
            if not line.strip():
                continue
            try:
                r = json.loads(line)
                status = int(r.get("status", 200))
                yield part.path, n, r.get("source") or "", r.get("url") or "", status, (r.get("payload") or "") if status == 200 else "", "" if status == 200 else f"HTTP {status}"
            except (ValueError, AttributeError, TypeError) as e:
                yield part.path, n, "", "", 0, "", f"{type(e).__name__}: {e}"


class StoredResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [File(self.folder, p) for p in _files(self.folder)]

    def read(self, partition: File) -> Iterator[tuple]:
        return _rows(partition) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [File(self.folder, p) for p in _files(self.folder)[start["files"] : end["files"]]]

    def read(self, partition: File) -> Iterator[tuple]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        """Files are kept: a table reads them again."""
