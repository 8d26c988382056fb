"""The first object in a model's answer: strict, fenced, balanced or repaired by closing what is open, or an inner one.

Texts that are an object and nothing else are read by Spark's own parser; only the others go to Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOUND = T.StructType([T.StructField("how", T.StringType()), T.StructField("probability", T.DoubleType())])
FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
#: Braces that hold no braces deeper than one level; nothing is tried twice, so long texts take no more than a look ahead a brace.
INNER = re.compile(r"\{(?:[^{}]++|\{[^{}]*+\})*+\}")
NUMBERS = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def parse(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def balanced(text: str) -> str | None:
    """From the first brace to its partner, or to the end with the missing quote and braces added."""
    start = text.find("{")
    if start < 0:
        return None
    stack, inside, skip = [], False, False
    for at in range(start, len(text)):
        c = text[at]
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                return text[start : at + 1]
    return text[start:] + '"' * inside + "".join(reversed(stack))


def first_object(text: str | None) -> tuple[str | None, float | None]:
    """How the object was found, and its probability if it has one; NaN is none."""
    if not text or not text.strip():
        return None, None
    ways = {
        "strict": lambda: text.strip(),
        "fenced": lambda: (FENCE.search(text) or [None, ""])[1].strip(),
        "balanced": lambda: balanced(text),
        "inner": lambda: (INNER.search(text) or [None])[0],
    }
    for how, way in ways.items():
        piece = way()
        found = parse(piece) if piece else None
        if found is not None:
            p = found.get("probability")
            return how, float(repr(p)) if isinstance(p, int | float) and not isinstance(p, bool) and p == p else None
    return "none", None


@F.pandas_udf(FOUND)
def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([first_object(t if isinstance(t, str) else None) for t in texts], columns=["how", "probability"]).astype({"how": object, "probability": float})


def object_of(text: Column | str) -> Column:
    """Struct (how, probability) of a text; nulls for a null or blank text.

    Spark's parser ignores what follows a value.  A text is an object and nothing else if it can stand both in brackets and as
    a field: what might follow it would have to close the one and would then break the other.
    """
    text = F.col(text) if isinstance(text, str) else text
    field = F.try_parse_json(F.concat(F.lit('{"o":'), text, F.lit("}")))
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    strict = F.coalesce(element.isNotNull() & F.schema_of_variant(F.try_variant_get(field, "$.o", "variant")).startswith("OBJECT"), F.lit(False))
    told = F.try_variant_get(field, "$.o.probability", "variant")
    probability = F.when(F.schema_of_variant(told).rlike(NUMBERS), F.try_variant_get(told, "$", "double"))
    return F.when(strict, F.struct(F.lit("strict").alias("how"), probability.alias("probability"))).otherwise(extract(F.when(~strict, text)))
