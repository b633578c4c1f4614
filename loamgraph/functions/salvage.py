"""JSON objects out of broken text: one pass over the signs with a stack of open brackets, Arrow batch by batch."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"^```(?:json)?\s*\n?|\n?```\s*$", re.MULTILINE)
_PAIRS = {"}": "{", "]": "["}


def _read(text: str):
    """The object, or list, that a text is as a whole; None if it is neither."""
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, (dict, list)) else {}


def scan(text: str) -> tuple[str, str | None]:
    """(whole, closed): a text without commas that stand before a closing bracket, and the same with what is open at its end closed; None if nothing is open or brackets cross. Strings are left as they are."""
    out: list[str] = []
    stack: list[str] = []
    comma, inside, escaped, crossed = -1, False, False, False
    for c in text:
        if inside:
            out.append(c)
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
            continue
        if c in "}]":
            if comma >= 0:
                del out[comma]
            if stack and stack[-1] == _PAIRS[c]:
                stack.pop()
            else:
                crossed = True
        elif c in "{[":
            stack.append(c)
        elif c == '"':
            inside = True
        if c == ",":
            comma = len(out)
        elif not c.isspace():
            comma = -1
        out.append(c)
    whole = "".join(out)
    if crossed or not (stack or inside):
        return whole, None
    end = whole + ('"' if inside else "")
    end = end.rstrip()
    if end.endswith(","):
        end = end[:-1]
    return whole, end + "".join("}" if c == "{" else "]" for c in reversed(stack))


def salvage(text: str | None) -> tuple[str | None, str]:
    """(object as JSON, how): ``whole``, ``mended`` (fences, commas, quotes), ``found`` (within other text), ``closed`` (cut off), ``empty`` or ``lost``. A list becomes the ``items`` of an object, a bare value an empty one."""
    if text is None or not text.strip():
        return "{}", "empty"
    text = text.strip()
    found = _read(text)
    if found is not None:
        return _written(found), "whole"
    bare = _FENCE.sub("", text).strip()
    clean, closed = scan(bare)
    tries = [(bare, "mended"), (clean, "mended")]
    if '"' not in clean and "'" in clean:
        tries.append((clean.replace("'", '"'), "mended"))
    for a, z in ("{}", "[]"):
        at, to = bare.find(a), bare.rfind(z)
        if 0 <= at < to:
            tries.append((scan(bare[at : to + 1])[0], "found"))
    if closed is not None:
        tries.append((closed, "closed"))
        at = min((p for p in (bare.find("{"), bare.find("[")) if p > 0), default=-1)
        if at > 0 and (rest := scan(bare[at:])[1]) is not None:
            tries.append((rest, "closed"))
    for candidate, how in tries:
        found = _read(candidate)
        if found is not None:
            return _written(found), how
    return None, "lost"


def _written(found: dict | list) -> str:
    return json.dumps(found if isinstance(found, dict) else {"items": found}, ensure_ascii=False, separators=(",", ":"))


def salvaged(text: Column) -> Column:
    """(json, how) of a column of texts, see salvage()."""

    @F.pandas_udf("json string, how string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([salvage(x) for x in texts], columns=["json", "how"])

    return run(text)
