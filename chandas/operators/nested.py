"""Deeply nested JSON records as related flat tables.

Two narrow passes. The first finds the merged schema: for every path the kinds of value met there, over all records.
The second walks each record once more by that schema and turns every array level into rows of a child table: each
row has a key of its own, its parent's key, and its place in the array. Arrays directly inside arrays are levels like
any other; the table of a's inner arrays is named a[]. Optional and missing fields give null columns
or no child rows; where the schema knows a path as an array, a bare object stands for an array of one.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chandas.common import cut

BLANKS = " \t\r\n\x0b\x0c ​﻿  　"


def _refuse(name: str):
    raise ValueError(name)


def _decoder():
    """Made once for each task: json.loads would make one for each record."""
    return json.JSONDecoder(parse_constant=_refuse).decode


def parse(payload: str | None, decode=None):
    """The record, or None where it isn't a valid JSON object (NaN and Infinity are none). Surrounding blanks and byte-order marks don't matter."""
    if payload is None:
        return None
    try:
        got = (decode or _decoder())(payload.strip(BLANKS))
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


#: Whole numbers written as strings.
_DIGITS, _FIRST = re.compile("-?[0-9]{1,18}"), frozenset("-0123456789")


def _merged(kinds: set[str]) -> str:
    """The type of a plain field: numbers may be written as strings beside others that aren't; digits alone are text."""
    if len(kinds) == 1:
        return "string" if "digits" in kinds else next(iter(kinds))
    if kinds <= {"long", "digits"}:
        return "long"
    return "double" if kinds <= {"long", "double", "digits"} else "string"


class _Met:
    """What was met at a path: kinds of values, fields below objects, and elements of arrays (or values of a map)."""

    __slots__ = ("path", "kinds", "fields", "below", "is_map")

    def __init__(self, path: str, maps: frozenset):
        self.path, self.kinds, self.fields, self.below, self.is_map = path, set(), {}, None, path in maps


def _meet(at: _Met, v, maps: frozenset) -> None:
    """Adds a value that isn't None. Paths are made once, not for each value."""
    t = type(v)
    if t is str:
        kinds = at.kinds
        if "string" not in kinds or "digits" not in kinds:
            kinds.add("digits" if v[:1] in _FIRST and _DIGITS.fullmatch(v) else "string")
    elif t is dict:
        at.kinds.add("object")
        if at.is_map:
            _below(at, "{}", v.values(), maps)
            return
        fields = at.fields
        for k, x in v.items():
            if x is not None:
                f = fields.get(k)
                if f is None:
                    f = fields[k] = _Met(f"{at.path}.{k}" if at.path else k, maps)
                _meet(f, x, maps)
    elif t is list:
        at.kinds.add("array")
        _below(at, "[]", v, maps)
    else:
        at.kinds.add("boolean" if t is bool else "long" if t is int else "double")


def _below(at: _Met, mark: str, values, maps: frozenset) -> None:
    if at.below is None:
        at.below = {}
    inner = at.below.get(mark)
    if inner is None:
        inner = at.below[mark] = _Met(at.path + mark, maps)
    for x in values:
        if x is not None:
            _meet(inner, x, maps)


def _paths(at: _Met):
    """(path, kind) of everything below: elements of an array have its path and [], values of a map have {}."""
    for m in (*at.fields.values(), *(at.below or {}).values()):
        for k in m.kinds:
            yield m.path, k
        yield from _paths(m)


def infer(records: DataFrame, maps: tuple[str, ...] = ()) -> DataFrame:
    """path, kind over all records (payload string): the merged schema, of the size of the schema.

    maps: paths of objects whose keys are data, not fields.
    """
    known = frozenset(maps)

    def run(batches):
        import pyarrow as pa

        root, decode = _Met("", known), _decoder()
        for b in batches:
            for x in b.column(0).to_pylist():
                got = parse(x, decode)
                if got is not None:
                    _meet(root, got, known)
        rows = sorted(_paths(root))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["path", "kind"])

    return records.select("payload").filter("payload is not null").mapInArrow(run, "path string, kind string").distinct()


#: Merged schemas of more paths than this are refused: keys that are data must be declared as maps.
MAX_PATHS = 20_000


class Schema:
    """A merged schema on the driver: which paths are arrays, objects, maps, and the type of each plain field."""

    def __init__(self, kinds: DataFrame, maps: tuple[str, ...] = ()):
        rows = kinds.limit(MAX_PATHS + 1).collect()
        if len(rows) > MAX_PATHS:
            raise ValueError("too many paths: declare objects with data for keys as maps")
        by: dict[str, set[str]] = {}
        for r in rows:
            by.setdefault(r["path"], set()).add(r["kind"])
        self.maps = frozenset(maps)
        self.arrays = frozenset(p for p, k in by.items() if "array" in k)
        # an array directly inside an array keeps its marks: a[] is the table of the inner arrays' elements
        flat = lambda p: p.replace("[].", ".")
        # a bare object's fields count as those of the array's elements
        bare = sorted((p for p in self.arrays if "object" in by[p] or p.endswith("[]")), key=len)

        def lifted(p: str) -> str:
            for a in bare:
                if p.startswith(a + "."):
                    p = a + "[]" + p[len(a) :]
            return p

        self.lifted = frozenset(map(lifted, self.arrays))
        self.types: dict[str, str] = {}
        self.types_met: dict[str, set[str]] = {}
        for p, kinds_ in by.items():
            plain = kinds_ - {"object", "array"}
            if plain:
                self.types[lifted(p)] = _merged(self.types_met.setdefault(lifted(p), set()) | plain)
                self.types_met[lifted(p)] |= plain
        self.flat = flat

    def tables(self) -> list[str]:
        """Paths that become child tables (arrays of anything, and maps), with marks only for arrays directly inside arrays."""
        return sorted({self.flat(p) for p in self.lifted} | set(self.maps))

    def columns(self, node: str) -> dict[str, str]:
        """Plain fields of a table's rows, nested objects' fields with their path; '' is the root."""
        out = {}
        for p, t in self.types.items():
            head = p.rfind("[]")
            owner, field = (self.flat(p[:head]), p[head + 3 :]) if head >= 0 else ("", p)
            if owner == node and field and "{}" not in field:
                out[field] = t
            elif owner == node and not field:
                out["value"] = t
        return out


class _Walk:
    """One walk of a record by a schema: child rows go to `emit`, plain fields into the row's fields (if wanted).

    What a field is (a map, an array, a table that is wanted or lies above one) is worked out once for each path.
    """

    def __init__(self, schema: Schema, emit, nodes: frozenset | None, keys_only: bool):
        self.schema, self.emit, self.nodes, self.keys_only = schema, emit, nodes, keys_only
        self.known: dict[tuple[str, str], tuple] = {}

    def _at(self, path: str, k: str) -> tuple:
        """(path of a field, its table's name, whether it is a map, whether it is an array, whether a wanted table lies there or below)."""
        at = f"{path}.{k}" if path else k
        flat = self.schema.flat(at)
        useful = self.nodes is None or any(n == flat or n.startswith((flat + ".", flat + "[")) for n in self.nodes)
        self.known[path, k] = got = (at, flat, at in self.schema.maps, at in self.schema.arrays, useful)
        return got

    def record(self, record_id, v: dict) -> None:
        root = None if self.keys_only else {}
        self.fields(record_id, v, "", "", "", root, "")
        if root is not None and (self.nodes is None or "" in self.nodes):
            self.emit(record_id, "", "", None, None, "", root)

    def fields(self, record_id, v: dict, path: str, key: str, ordinals: str, fields: dict | None, prefix: str) -> None:
        known, keys_only = self.known, self.keys_only
        for k, x in v.items():
            if x is None:
                continue
            at, flat, is_map, is_array, useful = known.get((path, k)) or self._at(path, k)
            if is_map:
                if useful and type(x) is dict:
                    for name, n in x.items():
                        self.emit(record_id, flat, None if keys_only else f"{key}/{prefix}{k}.{name}", key, None, name, None if fields is None else {"value": n})
            elif is_array or type(x) is list:
                if useful:
                    self.elements(record_id, x, at, None if keys_only else f"{key}/{prefix}{k}", key, ordinals)
            elif type(x) is dict:
                if useful or not keys_only:
                    self.fields(record_id, x, at, key, ordinals, fields, prefix if keys_only else f"{prefix}{k}.")
            elif fields is not None:
                fields[prefix + k] = x

    def elements(self, record_id, x, at: str, stem: str | None, parent: str | None, ordinals: str) -> None:
        """A row for each element of the array x at a path; an element that is an array is a further level with its own rows."""
        flat, below, keys_only = self.schema.flat(at), at + "[]", self.keys_only
        nested = below in self.schema.arrays
        for i, e in enumerate(x if type(x) is list else [x]):
            if e is None:
                continue
            o = f"{ordinals}.{i}" if ordinals else str(i)
            own, inner = (None, None) if keys_only else (f"{stem}.{i}", {})
            if type(e) is list or (nested and type(e) is dict):
                self.elements(record_id, e, below, own, own, o)
            elif type(e) is dict:
                self.fields(record_id, e, below, own, o, inner, "")
            elif inner is not None:
                inner["value"] = e
            self.emit(record_id, flat, own, parent, i, o, inner)


class _Lenient(Schema):
    """Paths inside a bare object are looked up as those of the array's elements."""

    def __init__(self, base: Schema):
        self.maps, self.flat = base.maps, base.flat
        self.arrays = frozenset(base.arrays) | base.lifted | {p.replace("[]", "") for p in base.arrays} | _marked(base.arrays)


def _marked(arrays: frozenset) -> set[str]:
    """Each array path with marks after every array above it."""
    plain = {p.replace("[]", "") for p in arrays}
    out = set()
    for p in plain:
        parts, at = p.split("."), ""
        for i, part in enumerate(parts):
            at = f"{at}.{part}" if at else part
            if i < len(parts) - 1 and ".".join(parts[: i + 1]) in plain:
                at += "[]"
        out.add(at)
    return out


ROWS = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("node", T.StringType()), T.StructField("row_key", T.StringType()), T.StructField("parent_key", T.StringType()),
    T.StructField("ordinal", T.IntegerType()), T.StructField("ordinals", T.StringType()), T.StructField("fields", T.StringType()),
])
KEYS = T.StructType([f for f in ROWS if f.name in ("record_id", "node", "ordinals")])


def explode_all(records: DataFrame, schema: Schema, nodes: list[str] | None = None, keys_only: bool = False) -> DataFrame:
    """One row for each element of every array level (and map key): ROWS, or KEYS if keys_only.

    records: record_id long, payload string; one row a record. row_key is the parent's key, the field's path from there and the place
    ('' is the record itself, so keys are unique together with record_id). ordinals: places from the root, joined by
    dots; for a map the key. Records that are null or not valid JSON give no row.
    """
    wanted, lenient = None if nodes is None else frozenset(nodes), _Lenient(schema)
    names = [f.name for f in (KEYS if keys_only else ROWS)]

    def run(batches):
        import pyarrow as pa

        types = {"record_id": pa.int64(), "ordinal": pa.int32()}
        cols: dict[str, list] = {}

        def fresh():
            nonlocal cols
            cols = {n: [] for n in names}

        def emit(record_id, node, key, parent, ordinal, ordinals, fields):
            if wanted is not None and node not in wanted:
                return
            cols["record_id"].append(record_id)
            cols["node"].append(node)
            cols["ordinals"].append(ordinals)
            if not keys_only:
                cols["row_key"].append(key)
                cols["parent_key"].append(parent)
                cols["ordinal"].append(ordinal)
                cols["fields"].append(json.dumps(fields, ensure_ascii=False))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(cols[n], types.get(n, pa.string())) for n in names], names=names)

        fresh()
        walk, decode = _Walk(lenient, emit, wanted, keys_only), _decoder()
        for b in batches:
            for record_id, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = parse(x, decode)
                if got is None:
                    continue
                walk.record(record_id, got)
                if len(cols["record_id"]) >= 50_000:
                    yield batch()
                    fresh()
        if cols["record_id"]:
            yield batch()

    return records.select(F.col("record_id").cast("long").alias("record_id"), "payload").filter("payload is not null").mapInArrow(run, KEYS if keys_only else ROWS)


def flatten(records: DataFrame, maps: tuple[str, ...] = (), nodes: list[str] | None = None) -> dict[str, DataFrame]:
    """Related tables by path ('' is the records): keys, parent's key, place, and typed columns of the merged schema.

    nodes: the tables wanted, all if None. Records are walked once for all of them: the rows of several tables are
    checkpointed together, those of a single one are read as they come.
    """
    schema = Schema(infer(records, maps), maps)
    wanted = ["", *schema.tables()] if nodes is None else nodes
    rows_of = explode_all(records, schema, wanted)
    if len(wanted) > 1:
        rows_of = cut(rows_of)
    out = {}
    for node in wanted:
        rows = rows_of.filter(F.col("node") == node)
        fields = schema.columns(node)
        if node in schema.maps:
            fields = {"value": next((t for p, t in schema.types.items() if schema.flat(p) == node + "{}"), "string")}
        # numbers may be written as strings: every field is read as text and cast to its type
        read = T.StructType([T.StructField(f, T.StringType()) for f in fields])
        got = F.from_json("fields", read)
        cast = [F.expr(f"try_cast(_f.`{f}` AS {t})").alias(f.replace(".", "_")) for f, t in fields.items()]
        base = rows.withColumn("_f", got) if fields else rows
        out[node] = base.select("record_id", "row_key", "parent_key", "ordinal", "ordinals", *cast)
    return out
