"""Results as ordered YAML documents, and what their outcome means for a caller."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

#: Outcomes with their exit codes.
EXIT = {"done": 0, "unchanged": 0, "bounded": 0, "refused": 1, "retry": 2, "failed": 3, "cancelled": 4}
Value = None | str | bool | int | float | list | dict


def exit_code(outcome: str) -> int:
    """The exit code of an outcome; one outside the table reads as done."""
    return EXIT.get(outcome, 0)


def _scalar(x: Value) -> str:
    return "null" if x is None else json.dumps(x, ensure_ascii=False) if isinstance(x, str | bool) else repr(x)


def _lines(value: Value, indent: str) -> list[str]:
    if isinstance(value, dict):
        out = []
        for key, x in value.items():
            deep = isinstance(x, dict | list) and x
            out += [f"{indent}{key}:", *_lines(x, indent + "  ")] if deep else [f"{indent}{key}: {('{}' if isinstance(x, dict) else '[]') if isinstance(x, dict | list) else _scalar(x)}"]
        return out
    if isinstance(value, list):
        out = []
        for x in value:
            rows = _lines(x, indent + "  ") if isinstance(x, dict | list) else [f"{indent}  {_scalar(x)}"]
            out += [f"{indent}- {rows[0].lstrip()}", *rows[1:]] if rows else [f"{indent}- {{}}"]
        return out
    return [f"{indent}{_scalar(value)}"]


def emitted(outcome: str, fields: dict[str, Value]) -> str:
    """A result as one YAML document: its fields in the order given, the outcome last."""
    return "\n".join([*_lines(fields, ""), f"outcome: {outcome}", ""])


def rows_of(df: DataFrame, most: int = 10_000) -> tuple[list[dict], str]:
    """A listing's rows in order for a result, and its outcome: bounded where the listing holds more than `most` rows."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    return rows[:most], "bounded" if len(rows) > most else "done"
