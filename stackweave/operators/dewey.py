"""Deeply nested JSON to flat tables by Dewey labels.

One pass over each text gives every node the ordinal path of its positions (``0.2.1``); a node's
parent is its path without the last part, and the schema path says which table it belongs to.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROWS = 8_000
NODE_SCHEMA = "row_id long, schema_path string, path string, ordinal int, n_frames int, attributes string"


def _reject(name: str) -> None:
    raise ValueError(name)


def _number(text: str) -> int | float:
    return float(text) if any(c in text for c in ".eE") else int(text)


def _parse_deep(text: str) -> object:
    """JSON of any depth, without recursion; for texts that exhaust the usual parser's stack."""
    import re

    token = re.compile(r'[ \t\n\r]*(?:([{}\[\],:"])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')
    words = {"true": True, "false": False, "null": None}
    stack: list[tuple[object, str | None]] = []
    key: str | None = None
    want, pos, done, result = "value", 0, False, None

    def put(value: object) -> str:
        nonlocal result, done
        if not stack:
            result, done = value, True
            return "end"
        top = stack[-1][0]
        if isinstance(top, list):
            top.append(value)
        else:
            top[key] = value
        return "comma"

    while not done or stack:
        m = token.match(text, pos)
        if not m:
            raise ValueError(pos)
        pos = m.end()
        sign = m[1]
        if want in ("value", "value or ]"):
            if sign in ("{", "["):
                stack.append(({} if sign == "{" else [], key))
                want = "key or }" if sign == "{" else "value or ]"
                continue
            if sign == "]" and want == "value or ]":
                value, key = stack.pop()
            elif sign == '"':
                value, pos = scanstring(text, pos, True)
            elif sign:
                raise ValueError(pos)
            else:
                value = _number(m[2]) if m[2] is not None else words[m[3]]
            want = put(value)
        elif want in ("key", "key or }"):
            if sign == "}" and want == "key or }":
                value, key = stack.pop()
                want = put(value)
            elif sign == '"':
                key, pos = scanstring(text, pos, True)
                m = token.match(text, pos)
                if not m or m[1] != ":":
                    raise ValueError(pos)
                pos, want = m.end(), "value"
            else:
                raise ValueError(pos)
        else:
            top = stack[-1][0]
            if sign == ",":
                want = "key" if isinstance(top, dict) else "value"
            elif sign == ("}" if isinstance(top, dict) else "]"):
                value, key = stack.pop()
                want = put(value)
            else:
                raise ValueError(pos)
    if text[pos:].strip(" \t\n\r"):
        raise ValueError(pos)
    return result


def decode(value: object) -> object:
    """Undoes JSON encoding as often as it was done; None where a text is no valid JSON."""
    while isinstance(value, str):
        try:
            value = json.loads(value, parse_constant=_reject)
        except RecursionError:
            try:
                value = _parse_deep(value)
            except (ValueError, IndexError):
                return None
        except ValueError:
            return None
    return value


def elements(value: object) -> list[object]:
    """The elements of a list that may be encoded, bare or missing."""
    value = decode(value)
    if isinstance(value, list):
        return value
    return [value] if isinstance(value, dict) else []


def _dump(node: dict, leave_out: tuple[str, ...]) -> str:
    return json.dumps({k: v for k, v in node.items() if k not in leave_out}, ensure_ascii=False, default=str)


def _shredder(with_frames: bool, with_attributes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["row_id", "schema_path", "path", "ordinal", "n_frames", "attributes"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                row, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                todo = [("stack", "", elements(text))]
                while todo:
                    schema, prefix, nodes = todo.pop()
                    for k, node in enumerate(nodes):
                        node = decode(node) if isinstance(node, str) else node
                        if not isinstance(node, dict):
                            continue
                        path = f"{prefix}.{k}" if prefix else str(k)
                        frames = elements(node.get("frames"))
                        n = sum(f is not None for f in frames)
                        out.append((row, schema, path, k, n, _dump(node, ("frames", "nested")) if with_attributes else None))
                        if with_frames:
                            for j, f in enumerate(frames):
                                if f is not None:
                                    shown = _dump(f, ()) if isinstance(f, dict) else json.dumps(f, ensure_ascii=False)
                                    out.append((row, f"{schema}.frame", f"{path}.{j}", j, None, shown if with_attributes else None))
                        below = node.get("nested")
                        if below:
                            todo.append((f"{schema}.nested" if schema == "stack" else schema, path, elements(below)))
                        if len(out) >= _ROWS:
                            yield flush()
        if out:
            yield flush()

    return shred


def parent_path(path: Column) -> Column:
    """The path without its last part, null for a top node."""
    cut = F.regexp_replace(path, r"\.?\d+$", "")
    return F.when(cut != "", cut)


def shred(rows: DataFrame, row_id: str, text: str, frames: bool = True, attributes: bool = True) -> DataFrame:
    """All nodes of the stacks in ``text``: ``row_id, schema_path, path, parent_path, ordinal, n_frames, attributes``.

    ``schema_path`` is ``stack``, ``stack.nested`` (at any depth) and those with ``.frame``.
    A frame's path is its stack's with its own position. Null ids and texts, texts that are no valid JSON and elements
    that are no object give no node, though they keep their position; a frame of any type but null counts. Repeated rows repeat their nodes.
    """
    source = rows.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    nodes = source.mapInArrow(_shredder(frames, attributes), NODE_SCHEMA)
    return nodes.select("row_id", "schema_path", "path", parent_path(F.col("path")).alias("parent_path"), "ordinal", "n_frames", "attributes")


def stack_table(nodes: DataFrame) -> DataFrame:
    """Stacks with their own fields; top and nested ones in one table, told apart by ``parent_path``."""
    return (
        nodes.where(F.col("schema_path").isin("stack", "stack.nested"))
        .select("row_id", F.col("path").alias("stack_path"), F.col("parent_path").alias("parent_stack"), "n_frames",
                F.get_json_object("attributes", "$.exception").alias("exception"), F.get_json_object("attributes", "$.message").alias("message"))
        .distinct()
    )


def frame_table(nodes: DataFrame) -> DataFrame:
    """Frames with the path of the stack they belong to."""
    field = lambda name: F.get_json_object("attributes", f"$.{name}").alias(name)
    return (
        nodes.where(F.col("schema_path").endswith(".frame"))
        .select("row_id", F.col("parent_path").alias("stack_path"), F.col("ordinal").alias("position"), field("depth"), field("function"), field("file"), field("fileline"))
        .distinct()
    )
