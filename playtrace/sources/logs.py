"""Event-log files of other tools: CSV and JSON readers, column roles."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_row"  # position in the file, the last resort for ordering
HEAD_BYTES = 1 << 16
MAX_DOCUMENT = 1 << 30  # bytes of one JSON document, which one task must read; larger logs come as JSON lines

# Roles in priority order and the header hints of each, strongest first.
ROLES = ["session", "activity", "timestamp", "actor", "seq", "score", "stars", "level"]
ROLE_HINTS = {
    "session": ["caseid", "case", "sessionid", "session", "traceid", "trace", "attemptid", "attempt", "playid", "visitid", "sessionuuid"],
    "activity": ["activity", "activityname", "action", "eventtype", "event", "type", "task", "step", "state", "concept:name", "conceptname"],
    "timestamp": ["timestamp", "time:timestamp", "timetimestamp", "datetime", "occurredat", "occurred", "eventtime", "recordedat", "loggedat", "logged", "createdat", "completetime", "starttime", "startdate", "iso", "time", "ts", "date", "when"],
    "actor": ["userid", "user", "studentid", "student", "playerid", "player", "resource", "actor", "subject", "participant", "learner", "org:resource"],
    "seq": ["seq", "sequence", "order", "orderindex", "index", "position", "eventnr", "eventno", "step", "nr"],
    "score": ["score", "points", "grade", "result", "value", "reward", "mark"],
    "stars": ["stars", "rating", "star"],
    "level": ["level", "difficulty", "stage", "round", "lvl"],
}


class ImportProblem(ValueError):
    """The log or the import request cannot be used."""


def _norm(header: str) -> str:
    return re.sub(r"[^a-z0-9]", "", str(header).lower())


def guess_mapping(headers: list[str]) -> dict[str, str | None]:
    """Column of each role; every column is used at most once."""
    free = list(headers)
    mapping: dict[str, str | None] = {}
    for role in ROLES:
        hits = (h for hint in ROLE_HINTS[role] for h in free if _norm(hint) in _norm(h))
        mapping[role] = next(hits, None)
        if mapping[role] is not None:
            free.remove(mapping[role])
    return mapping


def is_own_export(headers: list[str]) -> bool:
    names = {_norm(h) for h in headers}
    return {"sessionid", "type"} <= names and bool(names & {"seq", "iso"})


def _head(spark: SparkSession, path: str) -> str:
    """The first bytes of a log, to tell its format and column order."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.globStatus(where)
    status = files[0]
    if status.isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(status.getPath()) if s.isFile())
        names = [n for n in names if not n.rsplit("/", 1)[-1].startswith(("_", "."))]
        where = jvm.org.apache.hadoop.fs.Path(names[0])
    else:
        where = status.getPath()
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(HEAD_BYTES)).decode("utf-8", "replace").lstrip("﻿")
    finally:
        stream.close()


def _bytes(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def log_format(spark: SparkSession, path: str) -> str:
    """JSON by file name or by its first character, otherwise CSV."""
    if path.lower().endswith(".json"):
        return "json"
    return "json" if _head(spark, path).lstrip()[:1] in ("[", "{") else "csv"


def _placed(df: DataFrame, columns: list[str]) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    return df.select(*[F.col(f"`{c}`") for c in columns], place.alias(ROW))


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A CSV log with a header row; every value is text and missing cells are empty.

    ``multiline`` allows line breaks inside quotes, at the price of one task per file.
    """
    reader = spark.read.options(
        header=True, multiLine=multiline, quote='"', escape='"', mode="PERMISSIVE", encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    df = reader.csv(path)
    if not df.columns:
        raise ImportProblem("no columns found; is this a CSV with a header row?")
    names = [c.lstrip("﻿").strip() for c in df.columns]
    placed = _placed(df, df.columns).toDF(*names, ROW)
    return placed.fillna("", names)


def _first_seen(head: str, columns: list[str]) -> list[str]:
    """Columns in the order of their keys in the first objects of the text that can be read, others behind by name."""
    decode, at, seen = json.JSONDecoder(object_pairs_hook=lambda pairs: pairs).raw_decode, 0, {}
    while (at := head.find("{", at)) >= 0:
        try:
            pairs, at = decode(head, at)
        except ValueError:  # a wrapper cut off, or the last object of the text
            at += 1
            continue
        for key in (k for k, v in pairs for k in ([k] if k not in ("events", "rows") else [q for o in v for q, _ in o] if isinstance(v, list) and v and isinstance(v[0], list) else [k])):
            seen.setdefault(key, len(seen))
    return sorted(columns, key=lambda c: (c not in seen, seen.get(c, 0), c))


def _is_line(head: str) -> bool:
    """Whether the first line is a whole JSON object, or too long to tell."""
    line, brk, _ = head.lstrip().partition("\n")
    if not brk and len(head) >= HEAD_BYTES // 4:
        return True
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON log: an array of objects, ``{events: [...]}`` or ``{rows: [...]}``, or JSON lines.

    Nested values stay JSON text; elements that are not objects are dropped.
    """
    head = _head(spark, path)
    document = not _is_line(head)
    if document and _bytes(spark, path) > MAX_DOCUMENT:
        raise ImportProblem("one JSON document of this size is read by a single task; send JSON lines instead")
    df = spark.read.options(multiLine=document, primitivesAsString=True, mode="PERMISSIVE").json(path)
    columns = [c for c in df.columns if c != "_corrupt_record"]
    lists = {f.name: f.dataType.elementType for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}
    name = next((n for n in ("events", "rows") if n in lists), None)
    if name:
        columns = lists[name].names
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("object"))
        df = df.select(place.alias("_file"), F.posexplode(F.col(name)).alias("_i", "_o")).where(F.col("_o").isNotNull())
        df = df.select(*[F.col("_o")[c].alias(c) for c in columns], F.struct("_file", "_i").alias(ROW))
    else:
        if not columns:
            raise ImportProblem("JSON must be an array of row objects")
        df = _placed(df, columns)
        df = df.where(F.coalesce(*[F.col(f"`{c}`").cast("string") if not isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(f"`{c}`") for c in columns]).isNotNull())
    nested = (T.StructType, T.ArrayType, T.MapType)
    text = {c: F.to_json(f"`{c}`") for c in columns if isinstance(df.schema[c].dataType, nested)}
    return df.withColumns(text).select(*[F.col(f"`{c}`") for c in _first_seen(head, columns)], ROW)


def read_log(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return read_json(spark, path) if log_format(spark, path) == "json" else read_csv(spark, path, multiline)


def headers(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c != ROW]
