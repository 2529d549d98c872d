"""Alignment blocks in Stockholm format, gzip or plain, Latin-1."""

from __future__ import annotations

import io
import os
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinfold.functions.sequences import clean_sequence, length_ok
from kinfold.operators.hits import last_mapping
from kinfold.operators.ordering import first_rows


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Of a path with a scheme (file, hdfs, an object store) or of a local one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        where, path = _file_system(self.path)
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        found = where.get_file_info(path)
        if found.type == fs.FileType.File:
            return [_File(self.path)]
        folder, pattern = (path, "*") if found.type == fs.FileType.Directory else path.rsplit("/", 1)
        inside = sorted(i.path for i in where.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File)
        named = [p for p in inside if fnmatch(p.rsplit("/", 1)[-1], pattern) and not p.rsplit("/", 1)[-1].startswith((".", "_"))]
        return [_File(scheme + p) for p in named]

    def read(self, partition: _File):
        where, path = _file_system(partition.path)
        acc = name = None
        pending: list[tuple[int, str | None, str | None]] = []
        with where.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as raw:
            lines = io.TextIOWrapper(raw, encoding="latin-1")
            for no, line in enumerate(lines, 1):
                line = line.rstrip()
                if line.startswith("# STOCKHOLM") or line == "//":
                    if line == "//":
                        for at, sid, gapped in [*pending, (no, None, None)]:
                            yield partition.path, at, acc, name, sid, gapped
                    acc, name, pending = None, None, []
                elif line.startswith("#=GF AC"):
                    named = line[len("#=GF AC") :].split()
                    acc = named[0].partition(".")[0] if named else acc  # an empty line names nothing
                elif line.startswith("#=GF ID"):
                    name = line[len("#=GF ID") :].strip()
                elif line and line[0] != "#":
                    fields = line.split(None, 1)
                    if len(fields) == 2:
                        pending.append((no, *fields))


class StockholmSource(DataSource):
    """``spark.read.format("stockholm")``: a row per sequence line of a closed block,
    and one without ``sid`` for the line that closes it. Interleaved lines stay apart. A compressed file is one task, as it can't be
    split; give many files, and repartition after reading. It is read as a stream. Paths
    may name any file system that Arrow knows by its scheme."""

    @classmethod
    def name(cls) -> str:
        return "stockholm"

    def schema(self) -> str:
        return "file string, line_no long, family string, family_name string, sid string, gapped string"

    def reader(self, schema):
        return _Reader(self.options)


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(StockholmSource)
    return spark.read.format("stockholm").load(path)


def read_clans(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, family, clan, family_name)`` of a tab-separated file, gzip or plain,
    Latin-1; lines with fewer than two fields are skipped. ``line_no`` rises with
    the line within a file."""
    rows = spark.read.option("sep", "\t").option("encoding", "ISO-8859-1").option("quote", "").schema(
        "family string, clan string, c2 string, c3 string, family_name string").csv(path)
    return rows.where("family is not null and clan is not null").select(F.monotonically_increasing_id().alias("line_no"), "family", "clan", "family_name")


def clan_members(sequences: DataFrame, clans: DataFrame, per_family: int = 50) -> DataFrame:
    """``(sid, sequence, superfamily, family, family_name)``: families with a clan, the
    first ``per_family`` lines of each, repaired (only residues kept), then those of
    20 to 512 residues. The cut comes before the length filter."""
    first = first_rows(sequences.where("family is not null and sid is not null"), ["file", "family"], [F.col("line_no")], per_family)
    mapped = first.join(last_mapping(clans, "family", "clan", "line_no"), "family")
    return mapped.select("sid", clean_sequence(F.col("gapped")).alias("sequence"), F.col("clan").alias("superfamily"), "family",
                         F.coalesce("family_name", F.lit("")).alias("family_name")).where(length_ok(F.col("sequence")))


def block_counts(sequences: DataFrame, clans: DataFrame) -> DataFrame:
    """One row: closed blocks, and those whose family has a clan."""
    ends = sequences.where("sid is null").select("family")
    known = last_mapping(clans, "family", "clan", "line_no")
    return ends.join(known, "family", "left").agg(F.count(F.lit(1)).alias("n_blocks"), F.count("clan").alias("n_clan_blocks"))
