"""Nested JSON texts as related flat tables, by Dewey labels.

Every node gets the label of its parent plus one step: ``k`` and the member's ordinal below an object,
``e`` and the position below an array. A parent link is thus the label cut short: dropping the trailing
``e`` steps and one ``k`` step leaves the nearest enclosing object, with no join. Nodes group into tables
by schema path, in which every position is ``*``. Scalars, those in arrays too, are members of the nearest
enclosing object; what lies in no object belongs to a node with the label ``''``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "report_id long, script_index int, label string, steps array<string>, schema_path string"
MEMBERS = NODES + ", members array<struct<leaf string, key string, position string, kind string, value string>>"
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null', re.A)
_GAP = re.compile(r"[ \t\n\r]*")


def _refuse(name: str) -> None:
    raise ValueError(name)


def parse(content: str | None):
    """The value of a valid JSON text after comments, byte-order marks and outer white space are gone.

    Raises ValueError where it isn't valid. Of repeated keys the last counts.
    """
    text = _COMMENT.sub("", content or "").strip("﻿ \t\n\r\f\v ").strip()
    try:
        return json.loads(text, parse_constant=_refuse, parse_int=_whole)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """The same without recursion, for texts nested deeper than the standard parser goes."""
    gap = lambda i: _GAP.match(text, i).end()
    root: list = []
    stack: list[tuple[object, str | None]] = []
    at, box, key = gap(0), root, None

    def put(value: object) -> None:
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)

    def string(i: int) -> tuple[str, int]:
        m = _SCALAR.match(text, i)
        if not m or m[0][0] != '"':
            raise ValueError("key expected")
        return json.loads(m[0]), gap(m.end())

    def member(i: int) -> int:
        nonlocal key
        key, i = string(i)
        if text[i : i + 1] != ":":
            raise ValueError("colon expected")
        return gap(i + 1)

    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            new: object = {} if c == "{" else []
            put(new)
            stack.append((box, key))
            box, at = new, gap(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                at = member(at) if c == "{" else at
                continue
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError("value expected")
            put(json.loads(m[0], parse_int=_whole))
            at = gap(m.end())
        while stack:
            c = text[at : at + 1]
            if c == ",":
                at = gap(at + 1)
                at = member(at) if isinstance(box, dict) else at
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("end expected")
            box, key = stack.pop()
            at = gap(at + 1)
        else:
            if at != len(text):
                raise ValueError("text after the value")
            return root[0]


def _kind(value: object) -> str:
    return "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, _Digits | int | float) else "string"


def _whole(digits: str) -> object:
    """A JSON integer; one too long for the standard conversion keeps its digits."""
    return int(digits) if len(digits) < 4000 else _Digits(digits)


class _Digits(str):
    """An integer of thousands of digits, as text."""


def _leaves(value: object, label: str, key: str | None) -> Iterator[dict]:
    """The scalars of a value that no object stands between, as members."""
    todo = [(value, label, "")]
    while todo:
        v, at, position = todo.pop()
        if isinstance(v, list):
            todo += [(x, f"{at}.e{i}", f"{position}.{i}".lstrip(".")) for i, x in reversed(list(enumerate(v)))]
        elif not isinstance(v, dict):
            text = None if v is None else str(v) if isinstance(v, str) else json.dumps(v)
            yield {"leaf": at, "key": key, "position": position, "kind": _kind(v), "value": text}


def objects(root: object, with_members: bool = True) -> Iterator[tuple[str, list[str], str, list[dict]]]:
    """(label, steps, schema path, members) of every object below a value, itself included.

    Scalars outside all objects come last, as the members of a node without label.
    """
    todo: list[tuple[object, str, list[str], str]] = [(root, "$", ["$"], "$")]
    while todo:
        value, label, steps, schema = todo.pop()
        if isinstance(value, dict):
            flat = [m for i, (k, v) in enumerate(value.items()) for m in _leaves(v, f"{label}.k{i}", k)] if with_members else []
            yield label, steps, schema, flat
            below = [(v, f"{label}.k{i}", k, f"{schema}/{k}") for i, (k, v) in enumerate(value.items())]
        elif isinstance(value, list):
            below = [(v, f"{label}.e{i}", str(i), f"{schema}/*") for i, v in enumerate(value)]
        else:
            continue
        todo += [(v, l, [*steps, s], p) for v, l, s, p in reversed(below) if isinstance(v, dict | list)]
    if with_members and (outside := list(_leaves(root, "$", None))):
        yield "", [], "", outside


def _well(text: str) -> str:
    """Text that can leave Python: a lone half of a surrogate pair becomes the replacement character."""
    return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def _label(with_members: bool):
    member = pa.struct([(n, pa.string()) for n in ("leaf", "key", "position", "kind", "value")])
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(member)]
    names = ["report_id", "script_index", "label", "steps", "schema_path", "members"]
    if not with_members:
        kinds, names = kinds[:-1], names[:-1]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for report, script, content in zip(*(b.column(c).to_pylist() for c in ("report_id", "index", "content")), strict=True):
                try:
                    root = parse(content)
                except ValueError:
                    continue
                for label, steps, schema, flat in objects(root, with_members):
                    row = (report, script, label, [_well(s) for s in steps], _well(schema))
                    rows.append((*row, [{k: None if v is None else _well(v) for k, v in m.items()} for m in flat]) if with_members else row)
                if len(rows) > 20_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    return run


def nodes(reports: DataFrame, with_members: bool = False) -> DataFrame:
    """Labelled objects of all structured-data texts: see ``NODES`` and ``MEMBERS``.

    Reads report_id and json_ld.data. Null ids, null structs, null contents and invalid JSON give no row;
    repeated rows count once; a null index stays null.
    """
    texts = reports.filter("report_id is not null").select("report_id", F.explode("json_ld.data").alias("d"))
    texts = texts.select("report_id", "d.index", "d.content").filter("content is not null").dropDuplicates()
    return texts.mapInArrow(_label(with_members), MEMBERS if with_members else NODES)


def parent_label(label: Column) -> Column:
    """Label of the nearest enclosing object by truncation; '' where there is none."""
    return F.when(label.rlike(r"\.k\d+(?:\.e\d+)*$"), F.regexp_replace(label, r"\.k\d+(?:\.e\d+)*$", "")).otherwise("")


def objects_table(reports: DataFrame) -> DataFrame:
    """(report_id, script_index, node_path, parent_path): one row per object, with its parent link."""
    found = nodes(reports).withColumn("up", parent_label(F.col("label")))
    depth = F.size(F.split("up", r"\."))
    return found.select(
        "report_id",
        "script_index",
        F.array_join("steps", "/").alias("node_path"),
        F.when(F.col("up") == "", "").otherwise(F.array_join(F.slice("steps", F.lit(1), depth), "/")).alias("parent_path"),
    )


def members_table(reports: DataFrame) -> DataFrame:
    """(report_id, script_index, label, schema_path, leaf, key, position, kind, value): one row per scalar.

    ``leaf`` is the scalar's own label, ``label`` that of the object it belongs to, ``key`` the member of that object
    it is or lies in, ``position`` its place in the arrays of that member ('' if none, '2.0' for two levels).
    """
    return nodes(reports, True).select("report_id", "script_index", "label", "schema_path", F.inline("members"))


def table_of(reports: DataFrame, schema_path: str) -> DataFrame:
    """The flat table of one schema path: keys, parent link and a map from member (and position) to kind and value."""
    found = nodes(reports, True).filter(F.col("schema_path") == schema_path)
    name = lambda m: F.when(m["position"] == "", m["key"]).otherwise(F.concat_ws("/", m["key"], F.replace(m["position"], F.lit("."), F.lit("/"))))
    # a member's name may look like another's with a position: the last of equal names counts
    pairs = F.transform("members", lambda m: F.struct(name(m).alias("k"), F.struct(m["kind"].alias("kind"), m["value"].alias("value")).alias("v")))
    values = F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])))
    return found.select("report_id", "script_index", "label", parent_label(F.col("label")).alias("parent_label"), values.alias("members"))


def schema_tables(reports: DataFrame) -> DataFrame:
    """(schema_path, rows): the tables that the objects form, with their sizes."""
    return nodes(reports).groupBy("schema_path").agg(F.count("*").alias("rows"))
