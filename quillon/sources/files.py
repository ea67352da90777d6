"""Scans and sinks of files: tables by suffix, folders, tolerant reads, workbooks, JSON documents."""

from __future__ import annotations

import io
import json
import os
import uuid
import warnings
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fnmatch import fnmatchcase
from functools import reduce
from itertools import islice
from typing import BinaryIO

import pyarrow
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.utils import AnalysisException

from quillon.schema import PANEL, RAW_HEADERS, enforce_schema, normalize_quotes, rename_synonyms, require


#: Rows of a workbook that are held at a time.
BATCH = 10_000
#: What a file that is no readable workbook raises.
UNREADABLE = (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError)


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None, any_suffix: bool = False) -> DataFrame:
    """A Parquet or CSV table by suffix; other suffixes raise ValueError unless `any_suffix` reads them as CSV."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "csv" or (any_suffix and suffix not in ("pkl", "pickle")):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    raise ValueError(f"unsupported format: {path}")


def scan_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel file under the panel's contract; the index return is filled in from weighted returns."""
    panel = enforce_schema(scan(spark, path), PANEL)
    from quillon.operators.windows import weighted_mean_by

    return panel.withColumn("index_return", F.coalesce("index_return", weighted_mean_by(F.col("ret"), F.col("index_weight"), ["date"], 1e-12, need_weight=True)))


def scan_scores(spark: SparkSession, path: str, required: tuple[str, ...] = ("date", "id", "h", "y", "l", "u")) -> DataFrame:
    """A score log with its synonyms renamed and its required columns checked."""
    df = rename_synonyms(scan(spark, path))
    require(df, required)
    return df


def scan_or_none(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A CSV table, or None with a warning if it is absent or unreadable."""
    try:
        df = scan(spark, path, schema, any_suffix=True)
        df.limit(1).count()
    except (AnalysisException, ValueError, OSError) as e:
        warnings.warn(f"{path} was not read: {e}", stacklevel=2)
        return None
    return df


def universe_pattern(universe: str) -> str:
    """The file name pattern of a universe's workbooks."""
    return f"*{universe.upper()}*.xlsx"


def _parse_workbooks(batches: Iterator) -> Iterator:
    """For mapInPandas over (path, content): a row per quote with its cells by header, in batches, and one with the error, if any."""
    import pandas as pd

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                rows = workbook_rows(io.BytesIO(content))
                head = header_names(next(rows, []))
                for name in ("date", "debenture_id"):
                    if not set(RAW_HEADERS[name][0]) & set(head):
                        raise ValueError(f"no column for {name}")
                for _ in workbook_rows(io.BytesIO(content)):
                    pass  # a workbook that breaks off gives no row
                while part := list(islice(rows, BATCH)):
                    yield pd.DataFrame({"path": path, "error": None, "cells": [{h: v for h, v in zip(head, row, strict=False) if v is not None} for row in part]})
            except UNREADABLE as e:
                yield pd.DataFrame({"path": path, "error": str(e) or type(e).__name__, "cells": [{}]})


def scan_folder(spark: SparkSession, folder: str, universe: str) -> DataFrame | None:
    """All workbooks of a universe, normalised and united; unreadable ones are skipped with a warning.

    The folder may lie in any store that Spark reads; each workbook is parsed by the task that reads it.
    A folder that is absent or holds none gives None.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", universe_pattern(universe)).load(folder).select("path", "content")
        if files.select("path").isEmpty():
            return None
    except AnalysisException:
        return None
    parsed = files.mapInPandas(_parse_workbooks, "path string, error string, cells map<string,string>")
    for r in parsed.where("error is not null").select("path", "error").collect():  # a row per file
        warnings.warn(f"{r['path'].rsplit('/', 1)[-1]} was skipped: {r['error']}", stacklevel=2)
    raw = parsed.where("error is null").select(*[F.col("cells")[h].alias(h) for headers, _ in RAW_HEADERS.values() for h in headers])
    return normalize_quotes(raw, universe)


def union_all(frames: list[DataFrame]) -> DataFrame | None:
    """All rows of all frames, absent columns as null; None for no frames."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


# Workbooks: a zip of XML parts. The parts' namespace and the first sheet's name.
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_SHEET, _STRINGS = "xl/worksheets/sheet1.xml", "xl/sharedStrings.xml"


def _column_number(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def workbook_rows(path: str | BinaryIO) -> Iterator[list[str | None]]:
    """The first sheet's rows as text, cells in place, read as a stream."""
    with zipfile.ZipFile(path) as book:
        shared: list[str] = []
        if _STRINGS in book.namelist():
            for item in ET.fromstring(book.read(_STRINGS)).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        with book.open(_SHEET) as sheet:
            for _, row in ET.iterparse(sheet):
                if row.tag != f"{_NS}row":
                    continue
                cells: dict[int, str | None] = {}
                for i, c in enumerate(row.iter(f"{_NS}c")):
                    value = c.find(f"{_NS}v")
                    text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{_NS}t")) or None
                    if c.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    cells[_column_number(c.get("r") or "") if c.get("r") else i] = text
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                row.clear()


def header_names(row: list[str | None]) -> list[str]:
    """Column names of a first row: an empty one by its place, a repeated one with its number."""
    out: list[str] = []
    for i, h in enumerate(row):
        name, n = h or f"column_{i}", 1
        while (name if n == 1 else f"{name}.{n - 1}") in out:
            n += 1
        out.append(name if n == 1 else f"{name}.{n - 1}")
    return out


@dataclass
class _OneFile(InputPartition):
    path: str


class _WorkbookReader(DataSourceReader):
    def __init__(self, store: pyarrow.fs.FileSystem, paths: list[str], names: list[str], mode: str):
        self.store, self.paths, self.names, self.mode = store, paths, names, mode

    def partitions(self) -> list[InputPartition]:
        return [_OneFile(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pyarrow.RecordBatch]:
        if not isinstance(partition, _OneFile):
            return  # no file, no partition

        def batch(columns: dict, n: int) -> pyarrow.RecordBatch:
            columns = {"_file": [partition.path] * n, **columns}
            return pyarrow.record_batch({c: pyarrow.array(columns.get(c, [None] * n), pyarrow.string()) for c in self.names}) if self.names else pyarrow.RecordBatch.from_struct_array(pyarrow.array([{}] * n, pyarrow.struct([])))

        with self.store.open_input_file(partition.path) as stream:
            try:
                if self.mode != "FAILFAST":
                    for _ in workbook_rows(stream):
                        pass  # so that a workbook that breaks off gives no row
                    stream.seek(0)
                rows = workbook_rows(stream)
                head = header_names(next(rows, []))
                places = {c: head.index(c) for c in self.names if c in head}
                while part := list(islice(rows, BATCH)):
                    yield batch({c: [r[i] if i < len(r) else None for r in part] for c, i in places.items()}, len(part))
            except UNREADABLE as e:
                if self.mode == "FAILFAST":
                    raise
                if self.mode == "PERMISSIVE":
                    yield batch({"_error": [str(e) or type(e).__name__]}, 1)


class WorkbookSource(DataSource):
    """`spark.read.format('workbook').load(path)`: the first sheets of a file, or of all in a folder, as text.

    A partition per file, read in batches of rows; the path may lie in any store that pyarrow opens by address. Columns
    are matched by header, absent ones are null. Without a schema they are all headers of all files, which are read
    first; a schema saves that and reads only its columns. Options: `pathGlobFilter` (file names, `*.xlsx`), and `mode` for
    unreadable files: FAILFAST raises (the default), DROPMALFORMED skips them, PERMISSIVE gives one row with the reason in
    `_error`, if the schema has that column. `_file` in a schema is the file's path.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _files(self) -> tuple[pyarrow.fs.FileSystem, list[str]]:
        path = self.options["path"]
        path = path.replace("file:", "", 1) if path.startswith("file:/") and not path.startswith("file://") else path
        store, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
        kind = store.get_file_info(root).type
        if kind == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if kind == pyarrow.fs.FileType.File:
            return store, [root]
        found = store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        return store, sorted(f.path for f in found if f.is_file and fnmatchcase(f.base_name, self.options.get("pathGlobFilter", "*.xlsx")))

    def _mode(self) -> str:
        mode = self.options.get("mode", "FAILFAST").upper()
        if mode not in ("FAILFAST", "DROPMALFORMED", "PERMISSIVE"):
            raise ValueError(f"unknown mode: {mode}")
        return mode

    def schema(self) -> T.StructType:
        store, paths = self._files()
        names: dict[str, None] = {}
        for path in paths:
            try:
                with store.open_input_file(path) as stream:
                    names |= dict.fromkeys(header_names(next(workbook_rows(stream), [])))
            except UNREADABLE:
                if self._mode() == "FAILFAST":
                    raise
        return T.StructType([T.StructField(h, T.StringType()) for h in names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if any(not isinstance(f.dataType, T.StringType) for f in schema.fields):
            raise ValueError("columns of workbooks are text")
        return _WorkbookReader(*self._files(), schema.fieldNames(), self._mode())


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, or those of all workbooks of a folder."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet or CSV by suffix."""
    if path.endswith(".parquet"):
        df.write.mode(mode).option("compression", "snappy").parquet(path)
    else:
        df.write.mode(mode).option("header", True).csv(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON document, in `value`."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def _in_store(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Spark's writers reach them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Put a file or folder in the place of another, in one step where the store has such a step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    (old, store), (new, _) = _in_store(spark, source), _in_store(spark, target)
    if store.exists(new) and store.getFileStatus(new).isDirectory():
        store.delete(new, True)  # no store replaces a folder that is not empty
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(old).toUri(), conf).rename(store.makeQualified(old), store.makeQualified(new), overwrite)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store, if it is there."""
    target, store = _in_store(spark, path)
    store.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder of any store is there."""
    target, store = _in_store(spark, path)
    return store.exists(target)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file in the store that the path names, beside tables that tasks write there.

    It is written under another name first, so a reader finds the old text or the new one, never a part.
    """
    folder, _, name = path.rpartition("/")
    part = f"{folder}/_{name}-{uuid.uuid4().hex}" if folder else f"_{name}-{uuid.uuid4().hex}"
    target, store = _in_store(spark, part)
    out = store.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename(spark, part, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any store; None if it is absent, empty text if it is empty."""
    if not exists(spark, path):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def file_sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """Bytes of every file below a folder of any store."""
    target, store = _in_store(spark, folder)
    found, files, root = {}, store.listFiles(target, True), store.makeQualified(target).toString().rstrip("/")
    while files.hasNext():
        one = files.next()
        found[one.getPath().toString().removeprefix(root).lstrip("/")] = one.getLen()
    return dict(sorted(found.items()))


def write_json(document: Mapping, path: str, spark: SparkSession | None = None) -> None:
    """A document, on the driver's disk or, given a session, in the store that the path names."""
    text = json.dumps(document, indent=2, default=str, ensure_ascii=False)
    if spark is not None:
        return write_text(spark, text, path)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return None


def read_json(path: str, default: Mapping | None = None, spark: SparkSession | None = None) -> dict:
    """A document that `write_json` wrote; one that is absent, empty, cut short or no mapping gives the default."""
    try:
        if spark is not None:
            found = json.loads(read_text(spark, path) or "")
        else:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
    except (OSError, ValueError):
        return dict(default or {})
    return found if isinstance(found, dict) else dict(default or {})


def resolve_panel_path(results: str, default: str = "panel.parquet", spark: SparkSession | None = None) -> str:
    """The panel's path from the settings saved beside results (JSON as a run writes them, or YAML), nested or flat, else the default.

    With a session `results` may lie in any store; without one, on this machine.
    """
    from quillon.config import load_yaml, lookup, parse_yaml

    results = results.rstrip("/")
    saved = read_json(f"{results}/config_resolved.json", spark=spark)
    if not saved and spark is not None:
        saved = parse_yaml(read_text(spark, f"{results}/config_resolved.yaml") or "")
    elif not saved:
        try:
            saved = load_yaml(f"{results}/config_resolved.yaml")
        except OSError:
            return default
    return lookup(saved, ("panel_path", "data.panel_path"), default)


def load_settings(results: str, spark: SparkSession | None = None):  # noqa: ANN201
    """The Config that a run saved beside its results; the default one if there is none."""
    from quillon.config import Config

    return Config.from_mapping(read_json(f"{results.rstrip('/')}/config_resolved.json", spark=spark))
