"""Log line parsers: json, logfmt, regexp, pattern, and line templates, as columns.

All run inside the JVM but the flattening of nested JSON, for which there is no
built-in; lines that need it (and no others) go through Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.functions import labels as L
from brightloom.functions.bind import bound

_BAD_NAME = re.compile(r"[^a-zA-Z0-9_]")


def sanitise(name: str) -> str:
    name = _BAD_NAME.sub("_", name)
    return "_" + name if name[:1].isdigit() else name


def _text(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        v = float(v)
        return str(int(v)) if v.is_integer() and abs(v) < 1e21 else repr(v)
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _flatten(prefix: str, value: dict, out: dict[str, str]) -> None:
    for k, v in value.items():
        name = sanitise(f"{prefix}_{k}" if prefix else k)
        if isinstance(v, dict) and v:
            _flatten(name, v, out)
        else:
            out[name] = _text(v)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _json_map(lines: pd.Series) -> pd.Series:
    out = []
    for line in lines:
        try:
            value = json.loads(line)
        except (TypeError, ValueError, RecursionError):
            value = None
        if isinstance(value, dict):
            found: dict[str, str] = {}
            _flatten("", value, found)
            out.append(found)
        else:
            out.append(None)
    return pd.Series(out, dtype=object)


#: An object without objects or arrays in it, and numbers whose spelling is not their text.
_FLAT = r"^\s*\{[^{}\[\]]*\}\s*$"
_ODD_NUMBER = r":\s*(?:-?[0-9]+[.eE]|-?[0-9]{16}|-0)"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _first_of_last(keys: Column, values: Column) -> Column:
    """A map of keys and values; of a repeated key the last."""
    back = F.reverse(keys)
    return F.map_from_entries(F.filter(F.arrays_zip(back.alias("key"), F.reverse(values).alias("value")), lambda e, i: F.array_position(back, e["key"]) == i + 1))


def with_json_labels(rows: DataFrame, name: str) -> DataFrame:
    """rows with the flattened labels of the JSON object in column `line`, null for anything else."""
    line = F.col("line")
    rows = bound(rows, {"flat": F.when(line.rlike(_FLAT) & ~line.rlike(_ODD_NUMBER), line)})
    rows = rows.withColumn("deep", _json_map(F.when(F.col("flat").isNull(), line)))
    rows = bound(rows, {"flat": F.from_json("flat", "map<string,string>", _STRICT)})
    keys = F.transform(F.map_keys("flat"), lambda k: F.when(k.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"), k).otherwise(F.regexp_replace(F.regexp_replace(k, r"[^a-zA-Z0-9_]", "_"), r"^([0-9])", "_$1")))
    values = F.transform(F.map_values("flat"), lambda v: F.coalesce(v, F.lit("")))
    return bound(rows, {name: F.coalesce(F.when(F.col("flat").isNotNull(), _first_of_last(keys, values)), F.col("deep"))}).drop("flat", "deep")


def json_field(line: Column, path: str) -> Column:
    """The text at a path such as a.b[0]["c-d"], null if there is none."""
    steps = re.findall(r'\[(\d+)\]|\[\\?"((?:[^"\\]|\\.)*?)\\?"\]|([^.\[\]]+)', path)
    at = "$" + "".join(f"[{i}]" if i else f"['{q or n}']" for i, q, n in steps)
    return F.get_json_object(line, at)


_PAIR = r'([^\s="]+)=("(?:[^"\\]|\\.)*"|[^\s"]*)'


def _unquoted(v: Column) -> Column:
    return F.when(v.startswith('"'), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v)


def logfmt_labels(line: Column) -> Column:
    """key=value pairs of a line; of a repeated key the last."""
    keys = F.transform(F.regexp_extract_all(line, F.lit(_PAIR), F.lit(1)), lambda k: F.regexp_replace(F.regexp_replace(k, r"[^a-zA-Z0-9_]", "_"), r"^([0-9])", "_$1"))
    return _first_of_last(keys, F.transform(F.regexp_extract_all(line, F.lit(_PAIR), F.lit(2)), _unquoted))


def logfmt_value(line: Column, name: str) -> Column:
    """The last value of one key of a logfmt line, null if it is missing."""
    spelt = "".join('[^a-zA-Z0-9\\s="]' if c == "_" else c for c in name)
    found = F.regexp_extract_all(line, F.lit(f'(?:^|[^\\S\\n]|\\n)({spelt})=("(?:[^"\\\\]|\\\\.)*"|[^\\s"]*)'), F.lit(2))
    # bound as a lambda's variable, the value is found once
    return F.get(F.transform(F.array(F.try_element_at(found, F.lit(-1))), _unquoted), F.lit(0))


def capture_numbers(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern with plain groups, and the number of each named one."""
    java = L.java_regex(pattern)
    opens = [m.start() for m in re.finditer(r"(?<!\\)\((?!\?)|(?<!\\)\(\?<[a-zA-Z_]\w*>", java)]
    number = {m.group(1): opens.index(m.start()) + 1 for m in re.finditer(r"\(\?<([a-zA-Z_]\w*)>", java)}
    return re.sub(r"\(\?<([a-zA-Z_]\w*)>", "(", java), number


def capture_labels(line: Column, pattern: str) -> Column:
    """Named captures of a pattern; no match, no labels."""
    java, number = capture_numbers(pattern)
    if not number:
        raise ValueError("the pattern has no named capture")
    found = F.create_map(*[x for n, i in number.items() for x in (F.lit(n), F.regexp_extract(line, java, i))])
    return F.when(line.rlike(java), found)


def pattern_regex(pattern: str) -> str:
    """A pattern with <name> and <_> as a regular expression, anchored at its beginning unless it begins with <_>."""
    out, at = [], 0
    pieces = list(re.finditer(r"<([a-zA-Z_]\w*)>", pattern))
    if not pieces:
        raise ValueError("the pattern has no capture")
    for n, m in enumerate(pieces):
        out.append(re.escape(pattern[at : m.start()]))
        last = m.end() == len(pattern)
        body = ".*" if last else ".*?"
        out.append(body if m[1] == "_" else f"(?<{m[1]}>{body})")
        at = m.end()
    return ("" if pattern.startswith("<_>") else "^") + "".join(out) + re.escape(pattern[at:])


def pattern_match_regex(pattern: str) -> str:
    """The regular expression of a pattern line filter."""
    return ".*".join(re.escape(p) for p in re.split(r"<[a-zA-Z_]\w*>", pattern))


def template(text: str, label: Callable[[str], Column], line: Column) -> Column:
    """A Go text template over the labels: fields, literals and the functions below, with pipes."""
    out, at = [], 0
    for m in re.finditer(r"\{\{-?\s*(.*?)\s*-?\}\}", text):
        if m.start() > at:
            out.append(F.lit(text[at : m.start()]))
        out.append(_pipeline(m[1], label, line))
        at = m.end()
    if at < len(text):
        out.append(F.lit(text[at:]))
    return F.concat(*out) if out else F.lit("")


def _pipeline(expr: str, label: Callable[[str], Column], line: Column) -> Column:
    held: Column | None = None
    for part in re.split(r"\|(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", expr):
        words = re.findall(r'"((?:[^"\\]|\\.)*)"|`([^`]*)`|(\S+)', part)
        args = [F.lit(a.replace('\\"', '"') or b) if not c else _operand(c, label, line) for a, b, c in words]
        name = words[0][2] if words else ""
        if name in _FUNCTIONS:
            held = _FUNCTIONS[name](*args[1:], *([held] if held is not None else []))
        else:
            held = args[0] if args else F.lit("")
    return held.cast("string")


def _operand(word: str, label: Callable[[str], Column], line: Column) -> Column:
    if word == "__line__":
        return line
    if word.startswith("."):
        return label(word[1:])
    if re.fullmatch(r"-?\d+", word):
        return F.lit(int(word))
    return F.lit(word)


_FUNCTIONS = {
    "lower": F.lower,
    "upper": F.upper,
    "title": F.initcap,
    "trim": F.trim,
    "contains": lambda part, s: F.contains(s, part).cast("string"),
    "hasPrefix": lambda part, s: F.startswith(s, part).cast("string"),
    "hasSuffix": lambda part, s: F.endswith(s, part).cast("string"),
    "replace": lambda old, new, s: F.replace(s, old, new),
    "default": lambda other, s: F.when(s == "", other).otherwise(s),
    "trunc": lambda n, s: F.when(n >= 0, F.left(s, n)).otherwise(F.right(s, -n)),
    "substr": lambda a, b, s: F.substring(s, a + 1, F.greatest(b - a, F.lit(0))),
}
