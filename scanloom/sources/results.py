"""A sink for results of a stream with commits: the newest batch alone, or all of them."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from .messages import _folder


class ResultSink(DataSource):
    """`scan_results`, for writeStream: tasks write Parquet files that no reader sees; the commit of a micro-batch makes them
    its result, in one step, by naming them in `commit-<batch>.json`.

    Options: path; keep "latest" (a canvas or positions: the newest batch with rows takes the place of those before, whose
    files go one commit later, so that readers can end) or "all" (batches of predictions: none is dropped).  A batch that
    runs again takes its own place; one that fails leaves the last commit as it was."""

    @classmethod
    def name(cls) -> str:
        return "scan_results"

    def streamWriter(self, schema, overwrite: bool):
        return _Results(dict(self.options), schema)


@dataclass
class _Part(WriterCommitMessage):
    file: str
    rows: int


class _Results(DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema):
        self.path, self.keep, self.schema = options["path"].rstrip("/"), options.get("keep", "all"), schema
        if self.keep not in ("latest", "all"):
            raise ValueError("keep is latest or all")
        files, base = _folder(self.path)
        files.create_dir(base)

    def write(self, iterator):
        import pyarrow.parquet as pq

        files, base = _folder(self.path)
        name, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            out = out or pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=files)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return _Part(name if out is not None else "", rows)

    def commit(self, messages, batchId: int) -> None:
        files, base = _folder(self.path)
        parts = [m.file for m in messages if m is not None and m.rows]
        if self.keep == "latest" and not parts:
            self._drop([m.file for m in messages if m is not None])
            return
        before = _commits(self.path)
        tmp, at = f"{base}/_{uuid.uuid4().hex}", f"{base}/commit-{batchId:012d}.json"
        with files.open_output_stream(tmp) as f:
            f.write(json.dumps(parts).encode())
        again = before.get(batchId, [])
        files.move(tmp, at)
        self._drop([*again, *(m.file for m in messages if m is not None and not m.rows)])
        if self.keep == "latest":
            for number in sorted(n for n in before if n != batchId)[:-1]:  # all but the last before this one
                files.delete_file(f"{base}/commit-{number:012d}.json")
                self._drop(before[number])

    def abort(self, messages, batchId: int) -> None:
        self._drop([m.file for m in messages if m is not None])

    def _drop(self, names: list[str]) -> None:
        from pyarrow import fs

        files, base = _folder(self.path)
        for name in filter(None, names):
            if files.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
                files.delete_file(f"{base}/{name}")


def _commits(path: str) -> dict[int, list[str]]:
    """Batch number -> files of the commits."""
    from pyarrow import fs

    files, base = _folder(path)
    out = {}
    for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.base_name.startswith("commit-"):
            with files.open_input_stream(f.path) as s:
                out[int(f.base_name[7:-5])] = json.loads(s.read())
    return out


def read_results(spark: SparkSession, path: str, schema, keep: str = "all") -> DataFrame:
    """What is committed: all batches, or the newest one."""
    found = _commits(path)
    if keep == "latest":
        found = dict([max(found.items())]) if found else {}
    names = [f"{path.rstrip('/')}/{name}" for parts in found.values() for name in parts]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
