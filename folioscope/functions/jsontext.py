"""JSON text columns. Key order and unbounded depth need Python; it runs in Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION = T.StructType([
    T.StructField("page", T.StringType()),
    T.StructField("lines", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])
SECTIONS = T.StructType([
    T.StructField("document_type", T.StringType()),
    T.StructField("sections", T.ArrayType(SECTION)),
    T.StructField("error", T.StringType()),
])


def _tidy(value: object) -> str:
    """One line of text; nothing for null."""
    words = [] if value is None else str(value).split()
    return " ".join(words)


def _leaves(root: object):
    """Depth-first (path, leaf) pairs in document order, without recursion limits."""
    todo = [("", root)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            children = [(f"{path}.{k}" if path else k, v) for k, v in node.items()]
        elif isinstance(node, list) and node:
            children = [(f"{path}[{n}]", v) for n, v in enumerate(node, 1)]
        else:
            yield path, node
            continue
        todo.extend(reversed(children))


def _tree_lines(root: object) -> list[str]:
    shown = ((path, "[]" if leaf == [] and isinstance(leaf, list) else _tidy(leaf), leaf) for path, leaf in _leaves(root))
    return [
        f"{path}: {text}" if path or isinstance(leaf, list) else text
        for path, text, leaf in shown
        if path or text
    ]


def _line_texts(lines: object) -> list[str]:
    """Texts of a page's lines, which are objects with a ``text`` or bare values; blank ones are left out."""
    if not isinstance(lines, (list, str, dict)):
        raise ValueError(f"lines is {type(lines).__name__}, not a list")
    bare = (line.get("text", "") if isinstance(line, dict) else line for line in lines)
    return list(filter(None, map(_tidy, bare)))


def _pages(entries: list) -> list[dict]:
    """A section per page, numbered by position where the page has no number; a bad page carries its error."""
    sections = []
    for position, entry in enumerate(entries, start=1):
        page = entry if isinstance(entry, dict) else {}
        label = page["page"] if "page" in page else position
        section = {"page": None if label is None else str(label), "lines": [], "error": None}
        try:
            section["lines"] = _line_texts(page.get("lines", []))
        except ValueError as exc:
            section["error"] = str(exc)
        sections.append(section)
    return sections


def _sections(raw: str | None) -> dict:
    try:
        root = json.loads(raw)
        if isinstance(root, dict) and isinstance(root.get("pages"), list):
            return {"document_type": "ocr_pages", "sections": _pages(root["pages"]), "error": None}
        whole = {"page": None, "lines": _tree_lines(root), "error": None}
        return {"document_type": "structured_json", "sections": [whole], "error": None}
    except (TypeError, ValueError, RecursionError) as exc:
        return {"document_type": None, "sections": [], "error": f"{type(exc).__name__}: {exc}"}


@F.pandas_udf(SECTIONS)
def json_sections(raw: pd.Series) -> pd.DataFrame:
    """Page form: one section per page. Any other JSON: one section of path lines."""
    return pd.DataFrame([_sections(r) for r in raw], columns=["document_type", "sections", "error"])


# Keeps inferred filters above the call: pushed below it they would copy the whole input expression.
json_sections = json_sections.asNondeterministic()


@F.pandas_udf(T.ArrayType(T.StringType()))
def flatten_json(raw: pd.Series) -> pd.Series:
    """``path: value`` lines in key order; null for text that is no JSON."""

    def lines(text):
        try:
            return _tree_lines(json.loads(text))
        except (TypeError, ValueError, RecursionError):
            return None

    return raw.map(lines)


@F.pandas_udf(T.ArrayType(T.StringType()))
def collect_texts(raw: pd.Series) -> pd.Series:
    """Every non-blank ``text`` value under extracted_data, then under raw_ocr."""

    def texts(source):
        try:
            root = json.loads(source)
        except (TypeError, ValueError, RecursionError):
            return []
        if not isinstance(root, dict):
            return []
        found, todo = [], [root.get("raw_ocr"), root.get("extracted_data")]
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                own = node.get("text")
                if isinstance(own, str) and own.strip():
                    found.append(own.strip())
                todo.extend(reversed(list(node.values())))
            elif isinstance(node, list):
                todo.extend(reversed(node))
        return found

    return raw.map(texts)


def json_profile(raw: Column, max_keys: int = 25) -> Column:
    """Top-level type, first keys, item count and parse error of a JSON text."""
    # The parser stops at the end of the first value; the bracketed form shows what follows it.
    alone = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1
    valid = F.coalesce(F.try_parse_json(raw).isNotNull() & alone, F.lit(False))
    head = F.substring(F.ltrim(F.regexp_replace(raw, r"\A[\s]+", "")), 1, 1)
    kind = (
        F.when(head == "{", "dict").when(head == "[", "list").when(head == '"', "str")
        .when(head.isin("t", "f"), "bool").when(head == "n", "NoneType")
        .when(raw.rlike("[.eE]"), "float").otherwise("int")
    )
    return F.struct(
        F.when(valid, kind).alias("top_level_type"),
        F.when(valid & (head == "{"), F.slice(F.array_distinct(F.json_object_keys(raw)), 1, max_keys)).alias("top_level_keys"),
        F.when(valid & (head == "["), F.json_array_length(raw)).alias("item_count"),
        F.when(~valid, F.lit("not valid JSON")).alias("json_error"),
    )
