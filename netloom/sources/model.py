"""Model documents: one JSON object for a design, read with an explicit schema into tables; Parquet copies keyed by fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "STRUCT<line: BIGINT, col: BIGINT, offset: BIGINT>"
_RANGE = f"STRUCT<file: BIGINT, start: {_POINT}, end: {_POINT}>"
NODE = (
    "STRUCT<id: BIGINT, kind: STRING, name: STRING, path: STRING, parent: BIGINT, children: ARRAY<BIGINT>, symbol_key: STRING, "
    f"def_range: {_RANGE}, inst_range: {_RANGE}, type: STRING, dir: STRING, const: STRING, modport: STRING, "
    "members: ARRAY<STRUCT<name: STRING, dir: STRING>>, reset: STRING, enable: STRING, mem_depth: BIGINT, init_source: STRING, op: STRING, "
    "drivers: ARRAY<BIGINT>, loads: ARRAY<BIGINT>>"
)
DOCUMENT = (
    "schema_version BIGINT, design STRING, files ARRAY<STRUCT<id: BIGINT, path: STRING, language: STRING>>, "
    f"nodes ARRAY<{NODE}>, edges ARRAY<STRUCT<id: BIGINT, port: BIGINT, endpoint: BIGINT, dir: STRING, select: STRING, mem_port: STRING, mux_port: STRING>>, "
    "enums MAP<STRING, STRUCT<width: BIGINT, members: ARRAY<STRUCT<name: STRING, value: BIGINT>>>>, "
    f"source_map ARRAY<STRUCT<generated: {_RANGE}, source: {_RANGE}>>, "
    "name_refs ARRAY<STRUCT<file: BIGINT, line: BIGINT, col: BIGINT, offset: BIGINT, len: BIGINT, class: STRING, rel: STRING>>"
)
TABLES = ("files", "nodes", "edges", "source_map", "name_refs")
VERSION = 1


class ModelError(ValueError):
    pass


@dataclass
class Model:
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    enums: DataFrame
    source_map: DataFrame
    name_refs: DataFrame


def read(spark: SparkSession, path: str, check: bool = True) -> Model:
    """The tables of a model document; a document of another version or with dangling references is refused."""
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    tables = {t: doc.select(F.explode(t).alias("r")).select("r.*") for t in TABLES}
    enums = doc.select(F.explode("enums").alias("type", "e")).select("type", "e.width", F.explode("e.members").alias("m")).select("type", "width", "m.name", "m.value")
    model = Model(enums=enums, **tables)
    if check:
        versions = [r.schema_version for r in doc.select("schema_version").collect()]  # one a document
        if any(v != VERSION for v in versions):
            raise ModelError(f"schema_version must be {VERSION}, not {versions}")
        bad = problems(model).limit(5).collect()
        if bad:
            raise ModelError("; ".join(f"{r.rule} {r.id}" for r in bad))
    return model


def problems(model: Model) -> DataFrame:
    """(rule, id): children, parents, edge ends and mapped files that don't exist."""
    ids, files = model.nodes.select("id"), model.files.select(F.col("id").alias("file"))

    def missing(rows: DataFrame, known: DataFrame, key: str, rule: str) -> DataFrame:
        return rows.join(known, key, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).alias("id"))

    refs = [
        ("child", model.nodes.select(F.explode("children").alias("id"))),
        ("parent", model.nodes.where("parent IS NOT NULL").select(F.col("parent").alias("id"))),
        ("port", model.edges.select(F.col("port").alias("id"))),
        ("endpoint", model.edges.select(F.col("endpoint").alias("id"))),
    ]
    out = missing(model.source_map.select(F.explode(F.array("generated.file", "source.file")).alias("file")), files, "file", "file")
    for rule, rows in refs:
        out = out.unionAll(missing(rows, ids, "id", rule))
    return out


def _fingerprint(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    return hashlib.sha256(json.dumps([VERSION, status.getLen(), status.getModificationTime()]).encode()).hexdigest()[:16]


def read_cached(spark: SparkSession, path: str, cache: str) -> Model:
    """The Parquet copy of a document if its length, time and format still agree, else the document, copied anew."""
    base = f"{cache.rstrip('/')}/{_fingerprint(spark, path)}"
    names = (*TABLES, "enums")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_DONE")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        model = read(spark, path)
        for name in names:
            getattr(model, name).write.mode("overwrite").parquet(f"{base}/{name}")
        fs.create(hadoop, True).close()  # last, so that a broken copy is never taken for whole
    return Model(**{name: spark.read.parquet(f"{base}/{name}") for name in names})
