"""K1 as a data source: request batch files named by the tasks that write them, and a manifest
that says which files count.

A task opens ``{run}_batch_{i}_{stamp}.jsonl`` under a hidden name, writes the batch and gives it
its name when it is whole; a retried or speculative task writes the same bytes to the same name.
The commit writes one manifest, ``_manifest/<n>``, with a line per file of the table; the newest
manifest is the table, so a job that dies between two files, or before its commit, leaves the
old set as it was.  Nothing is renamed file by file on the driver.  Characters that a file name
cannot hold are percent-encoded in the run's part of the name.

Paths are resolved as Spark resolves them and written through pyarrow (local folders that all
machines share, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import storage_uri

MANIFEST = "_manifest"


def encoded(run: str) -> str:
    """A run's name as part of a file name.  Characters that a path, a glob or a URL reads
    otherwise are percent-encoded, and a leading ``.`` or ``_``, which would hide the file."""
    def shown(i, c):
        return "".join(f"%{b:02X}" for b in c.encode()) if c in '%/\\:*?"<>|[]{},' or ord(c) < 32 or (i == 0 and c in "._") else c
    return "".join(shown(i, c) for i, c in enumerate(run))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path.rstrip("/"))


def _versions(fs: pafs.FileSystem, folder: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(f"{folder}/{MANIFEST}", allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.isdigit())


def committed(path: str) -> list[dict] | None:
    """The files of the newest manifest: file, run, batch, tasks.  None without a manifest."""
    fs, folder = _open(path)
    versions = _versions(fs, folder)
    if not versions:
        return None
    with fs.open_input_stream(versions[-1]) as f:
        return [json.loads(line) for line in f.read().decode().splitlines()]


class _Written(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class BatchWriter(DataSourceArrowWriter):
    """Rows (run, batch_index, value), sorted by the first two; a batch lies in one task."""

    def __init__(self, options, overwrite: bool):
        self.path, self.stamp, self.existing = options["path"], options["stamp"], options.get("existing", "error")
        self.job = uuid.uuid4().hex
        old = committed(self.path) or []
        self.taken = {f["file"] for f in old}  # names that this job must not write over

    def _name(self, run: str, batch: int) -> str:
        name = f"{encoded(run)}_batch_{batch}_{self.stamp}"
        return f"{name}.jsonl" if f"{name}.jsonl" not in self.taken else f"{name}-{self.job[:8]}.jsonl"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        files, now, out, hidden = [], None, None, None

        def close():
            out.close()
            name = self._name(now[0], now[1])
            fs.move(hidden, f"{folder}/{name}")
            files.append({"file": name, "run": now[0], "batch": now[1], "tasks": tasks})

        tasks = 0
        try:
            for rows in iterator:
                run, batch, value = (rows.column(i) for i in range(3))
                same = [(r, b) for r, b in zip(run.to_pylist(), batch.to_pylist())]
                cuts = [0] + [i for i in range(1, len(same)) if same[i] != same[i - 1]] + [len(same)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if same[a] != now:
                        if out is not None:
                            close()
                        now, tasks, hidden = same[a], 0, f"{folder}/_part-{self.job}-{uuid.uuid4().hex}"
                        out = fs.open_output_stream(hidden)
                    out.write(("\n".join(value.slice(a, b - a).to_pylist()) + "\n").encode())
                    tasks += b - a
            if out is not None:
                close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            self._remove(fs, [hidden] if hidden else [])
            raise
        return _Written(files)

    @staticmethod
    def _remove(fs: pafs.FileSystem, paths: list[str]) -> None:
        for p in paths:
            if fs.get_file_info(p).type != pafs.FileType.NotFound:
                fs.delete_file(p)

    def commit(self, messages) -> None:
        """One new manifest: the old files (less those of the same runs, for ``existing=overwrite``)
        and the new ones."""
        fs, folder = _open(self.path)
        new = [f for m in messages if m is not None for f in m.files]
        old, runs = committed(self.path) or [], {f["run"] for f in new}
        same = [f for f in old if f["run"] in runs]
        if same and self.existing == "error":
            self._remove(fs, [f"{folder}/{f['file']}" for f in new])
            raise FileExistsError(f"{self.path} holds batches of these runs already")
        kept = [f for f in old if not (self.existing == "overwrite" and f["run"] in runs)]
        versions = _versions(fs, folder)
        fs.create_dir(f"{folder}/{MANIFEST}", recursive=True)
        n = int(versions[-1].rsplit("/", 1)[-1]) + 1 if versions else 0
        hidden = f"{folder}/{MANIFEST}/.{self.job}"
        with fs.open_output_stream(hidden) as f:
            f.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in sorted(kept + new, key=lambda x: (x["run"], x["batch"], x["file"]))).encode())
        fs.move(hidden, f"{folder}/{MANIFEST}/{n:010d}")
        if self.existing == "overwrite":  # after the new set counts; what is left behind by a crash here does not
            self._remove(fs, [f"{folder}/{f['file']}" for f in same])

    def abort(self, messages) -> None:
        fs, folder = _open(self.path)
        self._remove(fs, [f"{folder}/{f['file']}" for m in messages if m is not None for f in m.files])
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            self._remove(fs, [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.startswith(f"_part-{self.job}-")])


class BatchSource(DataSource):
    @classmethod
    def name(cls):
        return "request_batches"

    def schema(self):
        return "run string, batch_index long, value string"

    def writer(self, schema, overwrite: bool):
        return BatchWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(BatchSource)


def write_batches(batches: DataFrame, path: str, stamp: str, existing: str) -> None:
    """``batches`` (run, batch_index, value), each batch in one task and in order."""
    register(batches.sparkSession)
    try:
        batches.write.format("request_batches").mode("append").option("stamp", stamp).option("existing", existing).save(storage_uri(batches.sparkSession, path))
    except Exception as e:  # noqa: BLE001 - what the commit raises comes wrapped
        if "holds batches of these runs already" in str(e):
            raise FileExistsError(f"{path} holds batches of these runs already") from e
        raise
