"""Value-change dumps as a batch data source.

``spark.read.format("vcd").option("table", "changes").load(path)`` after ``register(spark)``. Tables: ``vars``
(var_ref, signal_ref, full_name, is_parameter) and ``changes`` (signal_ref, time, seq, value). A dump is sequential, so a file is one
partition; a folder of dumps is read in parallel.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "vars": "file string, var_ref bigint, signal_ref bigint, full_name string, is_parameter boolean",
    "changes": "file string, signal_ref bigint, time bigint, seq int, value string",
    "timescale": "file string, factor bigint, unit string",
}


class Dump:
    """One pass over the tokens of a dump."""

    def __init__(self, path: str) -> None:
        self.path = path

    def tokens(self) -> Iterator[str]:
        with open(self.path, encoding="utf-8", errors="replace") as f:
            for line in f:
                yield from line.split()

    def rows(self, table: str) -> Iterator[tuple]:
        words = self.tokens()
        scope: list[str] = []
        codes: dict[str, int] = {}
        var = time = seq = 0
        for word in words:
            if word.startswith("$"):
                body: list[str] = []
                if word not in ("$dumpvars", "$dumpall", "$dumpon", "$dumpoff", "$end"):
                    for w in words:
                        if w == "$end":
                            break
                        body.append(w)
                if word == "$scope":
                    scope.append(body[1])
                elif word == "$upscope":
                    scope.pop()
                elif word == "$var":
                    ref = codes.setdefault(body[2], len(codes))
                    name = re.sub(r"\s*\[[0-9]+(:[0-9]+)?\]$", "", " ".join(body[3:]))
                    if table == "vars":
                        yield self.path, var, ref, ".".join([*scope, name]), body[0] == "parameter"
                    var += 1
                elif word == "$timescale" and table == "timescale":
                    m = re.match(r"([0-9]+)\s*([a-z]+)", " ".join(body))
                    if m:
                        yield self.path, int(m[1]), m[2]
                elif word == "$enddefinitions" and table != "changes":
                    return
            elif word[0] == "#":
                time = int(word[1:])
            elif word[0] in "bBrR":
                ref = codes.get(next(words, ""))
                if table == "changes" and ref is not None:
                    yield self.path, ref, time, seq, word[1:].lower()
                    seq += 1
            elif word[0] in "01xXzZ" and table == "changes" and word[1:] in codes:
                yield self.path, codes[word[1:]], time, seq, word[0].lower()
                seq += 1


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str) -> None:
        self.path, self.table = path, table

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*.vcd"))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return Dump(partition.value).rows(self.table)


class VcdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcd"

    def _table(self) -> str:
        table = self.options.get("table", "changes")
        if table not in SCHEMAS:
            raise ValueError(f"table must be one of {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema: object) -> Reader:
        return Reader(self.options["path"], self._table())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VcdSource)
