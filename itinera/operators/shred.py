"""Deeply nested records into flat tables: adjacency-table shredding.

Every JSON text becomes rows of an adjacency table: node (its number within the text, in
document order, the root 0), parent, label, ordinal, depth, kind and scalar.  ``shred``
hands that table out.  ``entity_table`` joins entity nodes with the scalar nodes below them
over the parent links and pivots these into columns.  A text is whole in its Arrow batch, so
the join is an array lookup by parent there and nothing is shuffled or sorted.

Numbers and parent links keep the table linear in the text however deep it nests; texts
nested beyond what the fast decoder takes are read by a loop of our own.

Defined results: null, blank or malformed text has no nodes; a text that holds JSON
quoted once more as a JSON string is decoded once more; empty arrays and objects are
nodes without children; repeated member names keep the last, as JSON parsers do; numbers
of any length keep all digits; an empty table has no nodes; columns of the table play no
part beyond those named.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of input per Arrow batch that is decoded at once, which bounds the worker's memory.
_STEP = 256
KINDS = ["null", "boolean", "number", "string", "array", "object"]
_NULL, _BOOLEAN, _NUMBER, _STRING, _ARRAY, _OBJECT = range(6)

_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:"])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w.])|(true|false|null|NaN|-?Infinity)\b)')
_WORDS = {"true": True, "false": False, "null": None}
_SPACE = re.compile(r"[ \t\n\r]*")


class Digits(str):
    """A number kept as it was written."""


def read_deep(text: str) -> object:
    """The value of a JSON text of any depth, with numbers of any length; ValueError if it is malformed."""
    stack: list[object] = []
    names: list[str | None] = []
    done = object()
    value: object = done
    at, want = 0, "value"
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        at, sign = m.end(), m[1]
        if want == "colon":
            if sign != ":":
                raise ValueError(f"no colon at {at}")
            want = "value"
            continue
        closes = sign is not None and sign in "]}"
        if closes:
            # After a value, or as the first thing inside; the want says which of the two.
            if not stack or want not in ("comma", "first", "name_first") or (sign == "]") != isinstance(stack[-1], list):
                raise ValueError(f"misplaced {sign} at {at}")
            value = stack.pop()
            names.pop()
        elif want == "comma":
            if sign != ",":
                raise ValueError(f"no comma at {at}")
            want = "value" if isinstance(stack[-1], list) else "name"
            continue
        elif want in ("name", "name_first"):
            if sign != '"':
                raise ValueError(f"no member name at {at}")
            names[-1], at = scanstring(text, at, True)
            want = "colon"
            continue
        elif sign == "[":
            stack.append([])
            names.append(None)
            want = "first"
            continue
        elif sign == "{":
            stack.append({})
            names.append(None)
            want = "name_first"
            continue
        elif sign == '"':
            value, at = scanstring(text, at, True)
        elif sign is not None:
            raise ValueError(f"misplaced {sign} at {at}")
        elif m[2] is not None:
            value = Digits(m[2])
        else:
            value = _WORDS[m[3]] if m[3] in _WORDS else Digits(m[3])
        # A value is complete: it goes to what holds it.
        if not stack:
            if _SPACE.match(text, at).end() != len(text):
                raise ValueError(f"more text at {at}")
            return value
        if isinstance(stack[-1], list):
            stack[-1].append(value)
        else:
            stack[-1][names[-1]] = value
        want = "comma"


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        raise
    except (ValueError, RecursionError):
        # Too many digits or levels for the fast decoder.
        return read_deep(text)


def decode(text: str | None, quoted: int = 1) -> tuple[bool, object]:
    """(complete, value); up to ``quoted`` further layers of JSON-in-a-string are removed."""
    if text is None:
        return False, None
    try:
        value = _loads(text)
        while isinstance(value, str) and not isinstance(value, Digits) and quoted > 0:
            value, quoted = _loads(value), quoted - 1
    except ValueError:
        return False, None
    return True, value


def _utf8(text: str) -> str:
    """Lone surrogates can't be stored as UTF-8."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


class Adjacency:
    """The adjacency rows of a batch of texts by column; node numbers run through the batch."""

    def __init__(self, texts: Sequence[str | None], quoted: int = 1) -> None:
        self._labels: dict[str, int] = {}
        self._lists = parent, ordinal, depth, label, kind, scalar = [], [], [], [], [], []
        ends = [0]
        for t in texts:
            ok, value = decode(t, quoted)
            if ok:
                self._walk(value)
            ends.append(len(kind))
        self.starts = np.array(ends[:-1], np.int64)
        self.record = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        self.parent, self.ordinal, self.depth, self.label = (np.array(c, np.int64) for c in (parent, ordinal, depth, label))
        self.kind, self.scalar = np.array(kind, np.int8), scalar

    def _walk(self, value: object) -> None:
        """Adds one value, parents before children; no recursion.  The label of an array's entry is -1."""
        todo = [(-1, 1, 0, -1, value)]
        labels = self._labels
        parent_, ordinal_, depth_, label_, kind_, scalar_ = (c.append for c in self._lists)
        n = len(self._lists[0])
        while todo:
            parent, ordinal, depth, label, v = todo.pop()
            scalar = None
            if isinstance(v, Digits):
                kind, scalar = _NUMBER, str(v)
            elif isinstance(v, str):
                kind, scalar = _STRING, _utf8(v)
            elif isinstance(v, list):
                kind, below = _ARRAY, depth + 1
                for i in range(len(v), 0, -1):
                    todo.append((n, i, below, -1, v[i - 1]))
            elif v is None:
                kind = _NULL
            elif isinstance(v, dict):
                kind, i, below = _OBJECT, len(v), depth + 1
                for k, x in reversed(v.items()):
                    todo.append((n, i, below, labels.setdefault(k, len(labels)), x))
                    i -= 1
            else:
                kind, scalar = (_BOOLEAN if isinstance(v, bool) else _NUMBER), json.dumps(v)
            parent_(parent), ordinal_(ordinal), depth_(depth), label_(label), kind_(kind), scalar_(scalar)
            n += 1

    def step(self, owner: np.ndarray, step: int | str | None) -> np.ndarray:
        """Of every node the owner of its parent if the node is the step below it, else -1.

        ``owner`` has a number for every node (-1: none).  A step is an array's entry by its
        ordinal, any entry (None), or an object's member by its name.
        """
        if isinstance(step, str):
            fits = self.label == self._labels.get(step, -2)
        else:
            fits = (self.label == -1) & (self.parent >= 0) & ((self.ordinal == step) if step is not None else True)
        return np.where(fits, owner[self.parent], -1) if len(owner) else owner

    def names(self) -> list[str | None]:
        known = [_utf8(k) for k in self._labels]
        return [None if i < 0 else known[i] for i in self.label.tolist()]


Path = tuple[int | str | None, ...]


def _unpivoted(df: DataFrame, keys: Sequence[str], json_columns: Sequence[str]) -> DataFrame:
    """keys, source, text; long lists of columns cost one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("text")) for c in json_columns])
    return df.select(*[F.col(k) for k in keys], F.explode(cells).alias("_s")).select(*keys, "_s.source", "_s.text").where(F.col("text").isNotNull())


def _mapped(flat: DataFrame, columns: str, rows) -> DataFrame:
    """keys, source and ``columns``: ``rows`` answers a batch of texts with the record of each row and the columns' arrays."""
    head = flat.drop("text").schema
    names = [*head.names, *[c.split(" ")[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _STEP):
                b = whole.slice(at, _STEP)
                record, arrays = rows(b.column(b.num_columns - 1).to_pylist())
                take = pa.array(record, pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[:-1]], *arrays], names=names)

    return flat.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in head], columns]))


def shred(df: DataFrame, keys: Sequence[str], json_columns: Sequence[str], quoted: int = 1) -> DataFrame:
    """The adjacency table: ``keys``, source (the column), node, parent (null for the root), label, ordinal, depth, kind, scalar."""

    def rows(texts: list[str | None]):
        a = Adjacency(texts, quoted)
        start = a.starts[a.record]
        arrays = [
            pa.array(np.arange(len(a.record)) - start, pa.int32()), pa.array(a.parent - start, pa.int32(), mask=a.parent < 0), pa.array(a.names(), pa.string()), pa.array(a.ordinal, pa.int32()),
            pa.array(a.depth, pa.int32()), pa.array([KINDS[k] for k in a.kind.tolist()], pa.string()), pa.array(a.scalar, pa.string()),
        ]
        return a.record, arrays

    return _mapped(_unpivoted(df, keys, json_columns), "node int, parent int, label string, ordinal int, depth int, kind string, scalar string", rows)


def entity_table(
    df: DataFrame, keys: Sequence[str], json_columns: Sequence[str], entities: Sequence[Path], members: dict[str, Sequence[Path]], only: dict[str, str] | None = None, every_entity: bool = True, quoted: int = 1
) -> DataFrame:
    """One row per entity node: keys, source, parent (its node number), entity (the ordinal below it) and the members.

    ``entities``: the paths from the root to entity nodes.  ``members``: per column the paths
    from the entity to a scalar, in order of preference; of several scalars on one path the
    first in the document wins.  ``only``: the kind that a column's scalar must have.
    Without ``every_entity``, entities without any member have no row.
    """
    wanted = {c: KINDS.index((only or {})[c]) if c in (only or {}) else None for c in members}

    def rows(texts: list[str | None]):
        a = Adjacency(texts, quoted)
        n = len(a.record)
        entity = np.full(n, -1)
        for path in entities:
            at = np.where(a.parent < 0, 0, -1)
            for s in path:
                at = a.step(at, s)
            entity[at >= 0] = 1
        found = np.flatnonzero(entity >= 0)
        owner = np.full(n, -1)
        owner[found] = np.arange(len(found))
        below: dict[Path, np.ndarray] = {(): owner}

        def reached(path: Path) -> np.ndarray:
            if path not in below:
                below[path] = a.step(reached(path[:-1]), path[-1])
            return below[path]

        has = np.array([s is not None for s in a.scalar], bool)
        picked = {}
        for c, paths in members.items():
            node = np.full(len(found), -1)
            for path in paths:
                at = reached(tuple(path))
                hit = np.flatnonzero((at >= 0) & has & ((a.kind == wanted[c]) if wanted[c] is not None else True))[::-1]
                first = np.full(len(found), -1)
                first[at[hit]] = hit
                node = np.where(node < 0, first, node)
            picked[c] = node
        keep = np.arange(len(found))
        if not every_entity and picked:
            keep = np.flatnonzero(np.any([v >= 0 for v in picked.values()], axis=0))
        nodes = found[keep]
        above = a.parent[nodes]
        arrays = [pa.array(above - a.starts[a.record[nodes]], pa.int32()), pa.array(a.ordinal[nodes], pa.int32())]
        arrays += [pa.array([None if i < 0 else a.scalar[i] for i in v[keep].tolist()], pa.string()) for v in picked.values()]
        return a.record[nodes], arrays

    return _mapped(_unpivoted(df, keys, json_columns), ", ".join(["parent int", "entity int", *[f"{c} string" for c in members]]), rows)


#: Where the members of a stop stand: in the nested pair, in the stop as an object, in a part as an object.
_STOP = {
    "station": [(1, 1), ("station",), ("name",), (None, "station"), (None, "name"), (1,)],
    "country": [(1, 2), ("country",), (None, "country")],
    "arr": [(2, 1), ("arr",), (None, "arr")],
    "dep": [(2, 2), ("dep",), (None, "dep")],
}


def stop_rows(routes: DataFrame, key: str, lists: Sequence[str], members: Sequence[str] = ("station", "country", "arr", "dep"), every_entry: bool = True) -> DataFrame:
    """Stops of leg lists: key, source, list_node, stop_no and the members asked for.

    A list is the text's array or the array member ``legs`` of its object.  A stop is
    ``[[station, country], [arr, dep]]``, or its parts are objects, or it is one object,
    or its first part is the station alone.  stop_no counts all entries from 1; with
    ``every_entry`` each has a row, unusable ones with null members, else only those with
    a member.  A station that is no text is null.
    """
    stops = entity_table(routes, [key], lists, [(None,), ("legs", None)], {m: _STOP[m] for m in members}, {"station": "string"} if "station" in members else None, every_entry)
    return stops.withColumnsRenamed({"parent": "list_node", "entity": "stop_no"})


def paired_stops(routes: DataFrame, key: str, lists: Sequence[str]) -> DataFrame:
    """key, source, stop_no of the stops that are a pair of pairs: arrays of two that hold arrays of two."""

    def rows(texts: list[str | None]):
        a = Adjacency(texts)
        n = len(a.record)
        held = np.bincount(a.parent[a.parent >= 0], minlength=n)
        pair = (a.kind == _ARRAY) & (held == 2)
        root = np.where(a.parent < 0, 0, -1)
        entry = (a.step(root, None) >= 0) | (a.step(a.step(root, "legs"), None) >= 0)
        good = np.bincount(a.parent[pair & (a.parent >= 0)], minlength=n) == 2
        found = np.flatnonzero(entry & pair & good)
        return a.record[found], [pa.array(a.ordinal[found], pa.int32())]

    return _mapped(_unpivoted(routes, [key], lists), "stop_no int", rows)
