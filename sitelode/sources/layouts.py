"""Tables in a destination's layout: data files that count only once a manifest names them.

``sitelode_layout`` is a data source: its tasks write Parquet files, and the commit of the whole job writes one
manifest and moves it into place, so that a job is seen whole or not at all. Readers go by manifests
alone: what a killed task or job has left is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import html
from ..plans.scratch import shared_folder
from ..registry import query, texts

#: Rows of a data file.
FILE_ROWS = 1_000_000


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class LayoutWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.root, self.table, self.run = options["path"].rstrip("/"), options["table"], options["run"]
        self.rows = int(options.get("filerows", FILE_ROWS))
        self.columns = schema.jsonValue()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _opened(self.root)
        files: list[dict] = []
        out = name = None
        try:
            for batch in iterator:
                while batch.num_rows:
                    if out is None:
                        # a name of its own for every attempt: two attempts of a task never share a file
                        name = f"{self.table}/run={self.run}/part-{uuid.uuid4().hex}.parquet"
                        fs.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
                        out, rows = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=fs, compression="zstd"), 0
                    part = batch.slice(0, self.rows - rows)
                    out.write_batch(part)
                    rows, batch = rows + part.num_rows, batch.slice(part.num_rows)
                    if rows >= self.rows:
                        out.close()
                        files.append({"name": name, "rows": rows, "bytes": fs.get_file_info(f"{root}/{name}").size})
                        out = None
            if out is not None:
                out.close()
                files.append({"name": name, "rows": rows, "bytes": fs.get_file_info(f"{root}/{name}").size})
                out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.root)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        manifest = {"table": self.table, "run": self.run, "rows": sum(f["rows"] for f in files), "schema": self.columns, "files": files}
        folder = f"{root}/{self.table}/_manifests"
        fs.create_dir(folder, recursive=True)
        draft = f"{folder}/.{self.run}-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(manifest, sort_keys=True).encode())
        fs.move(draft, f"{folder}/{self.run}.json")  # from here on the run is there

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.root)
        for m in messages:
            for f in m.files if m is not None else ():
                if fs.get_file_info(f"{root}/{f['name']}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{root}/{f['name']}")


class LayoutSource(DataSource):
    """Options: path, table, run (writing it again replaces the run as a whole), fileRows."""

    @classmethod
    def name(cls) -> str:
        return "sitelode_layout"

    def writer(self, schema: StructType, overwrite: bool) -> LayoutWriter:
        return LayoutWriter({k.lower(): v for k, v in self.options.items()}, schema)


def write_table(df: DataFrame, path: str, table: str, run: str, file_rows: int = FILE_ROWS) -> None:
    """Write ``df`` as one run of a table. A run that is written again is replaced in one step; until then readers see the old one."""
    df.sparkSession.dataSource.register(LayoutSource)
    df.write.format("sitelode_layout").options(path=path, table=table, run=run, fileRows=file_rows).mode("append").save()


def manifests(path: str, table: str) -> dict[str, dict]:
    """The manifests of a table's runs: as many as runs, each names the run's files."""
    fs, root = _opened(path.rstrip("/"))
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/{table}/_manifests", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                out[info.base_name.removesuffix(".json")] = json.loads(f.read())
    return out


def read_table(spark: SparkSession, path: str, table: str, runs: list[str] | None = None) -> DataFrame:
    """The rows of the given runs (all, if none are named) with the column run. A run that is not there is an error."""
    known = manifests(path, table)
    wanted = sorted(known) if runs is None else runs
    if not wanted or set(wanted) - set(known):
        raise ValueError(f"no such run of {table}: {sorted(set(wanted) - set(known)) or 'none at all'}")
    out = None
    for run in wanted:
        schema = StructType.fromJson(known[run]["schema"])
        files = [f"{path.rstrip('/')}/{f['name']}" for f in known[run]["files"]]
        rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
        rows = rows.withColumn("run", F.lit(run))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("layout_pages", f"WITH {html.SQL} SELECT page_id, url, title, word_count, 'r' || page_id % 2 AS run FROM pf")
def layout_pages(spark, sf_dir):
    """Facts of pages as two runs in a layout, read back through their manifests."""
    path = f"{shared_folder(spark)}/layout-{uuid.uuid4().hex}"
    facts = html.page_facts(texts(spark, sf_dir, "pages")).select("page_id", "url", "title", "word_count")
    for k in (0, 1):
        write_table(facts.where(F.col("page_id") % 2 == k), path, "pages", f"r{k}")
    return read_table(spark, path, "pages")
