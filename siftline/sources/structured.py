"""JSON-LD entities and sitemap locations."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.plans.plan import Plan

# Limits of a sitemap, and the keys that stand for a nested value, in order.
SITEMAP_BYTES, SITEMAP_URLS = 1_048_576, 500
NESTED_KEYS = ("price", "value", "name", "url")

#: Stands for the value of a script that isn't JSON.
MALFORMED = object()


def _decoded(script: str) -> Any:
    """The value of a JSON text; MALFORMED if it isn't one or nested beyond what the parser reads."""
    try:
        return json.loads(script)
    except (ValueError, RecursionError):
        return MALFORMED


def cut_off(script: Column) -> Column:
    """Whether a text begins an object or array and ends without its end: surely no JSON, told JVM-side by its first and last byte."""
    ends = lambda *marks: reduce(or_, [F.endswith(script, F.lit(m)) for m in marks])
    opened = F.startswith(script, F.lit("{")) & ~ends("}") | F.startswith(script, F.lit("[")) & ~ends("]")
    return opened & ~ends(" ", "\t", "\n", "\r")


def scripts_to_read(scripts: Column) -> Column:
    """Scripts for script_values: those that are cut off stand as empty texts, which count as malformed in their place too."""
    return F.transform(scripts, lambda s: F.when(cut_off(s), F.lit("")).otherwise(s))


def _objects(place: str, value: Any) -> Iterator[tuple[str, dict]]:
    """The entities of one script's value: the objects of a list, or those of an object's graph before the object."""
    groups = {place: value} if isinstance(value, list) else {}
    if isinstance(value, dict):
        groups = {f"{place}.@graph": value.get("@graph"), place: [value]}
    for where, members in groups.items():
        for x in members if isinstance(members, list) else ():
            if isinstance(x, dict):
                yield where, x


def entities(scripts: list[str]) -> tuple[list[tuple[str, dict]], int]:
    """((location, entity) ..., number of malformed scripts) of a page's JSON-LD scripts in order."""
    values = [_decoded(x) for x in scripts]
    found = [x for i, value in enumerate(values) for x in _objects(f"json_ld[{i}]", value)]
    return found, sum(value is MALFORMED for value in values)


def find_value(names: list[str], source: dict[str, Any]) -> Any:
    """The value of the first key, in source order and depth first, that is or contains one of the names.

    Objects still to be looked through are a stack of item iterators, so nesting of any depth
    is fine. A null under such a key ends the search of its own object, at the top the search.
    """
    open_ = [iter(source.items())]
    while open_:
        key, value = next(open_[-1], (None, None))
        if key is None:
            open_.pop()
        elif any(n in key.lower().replace("@", "") for n in names):
            stands = [value[k] for k in NESTED_KEYS if k in value] if isinstance(value, dict) else []
            found = stands[0] if stands else value
            if found is not None or len(open_) == 1:
                return found
            open_.pop()
        else:
            inner = value if isinstance(value, list) else [value]
            open_ += [iter(x.items()) for x in reversed(inner) if isinstance(x, dict)]
    return None


def _raw(value: Any) -> str | None:
    """The text of a value; null if it is nested too deeply to be written."""
    try:
        return None if value is None else value if isinstance(value, str) else str(value)
    except RecursionError:
        return None


SCRIPTS_TYPE = T.StructType(
    [
        T.StructField(
            "entities",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("location", T.StringType()),
                        T.StructField("raws", T.ArrayType(T.StringType())),
                        T.StructField("text", T.StringType()),
                        T.StructField("url", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("malformed", T.IntegerType()),
    ]
)


def script_values(plan: Plan):
    """Arrow UDF: a page's JSON-LD scripts to its entities, with the plan fields' raw values in plan order, and the number of malformed scripts."""
    names = [f.names() for f in plan.fields]

    def one(scripts) -> dict:
        found, malformed = entities([] if scripts is None else list(scripts))
        made = [
            {"location": place, "raws": [_raw(find_value(n, e)) for n in names], "text": _raw(e.get("text")), "url": _raw(e.get("url"))}
            for place, e in found
        ]
        return {"entities": made, "malformed": malformed}

    @F.pandas_udf(SCRIPTS_TYPE)
    def values(json_ld: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in json_ld], columns=SCRIPTS_TYPE.names)

    return values


def locations(xml: str | None, max_bytes: int = SITEMAP_BYTES, max_urls: int = SITEMAP_URLS) -> list[str]:
    """Trimmed texts of the elements whose tag ends with loc; none if the text is null, too long or malformed."""
    if xml is None or len(xml.encode("utf-8", "surrogatepass")) > max_bytes:
        return []
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError):
        return []
    return [x.text.strip() for x in root.iter() if x.tag.endswith("loc") and x.text][:max_urls]


@F.pandas_udf(T.ArrayType(T.StringType()))
def sitemap_locations(xml: pd.Series) -> pd.Series:
    return pd.Series([locations(x) for x in xml], dtype=object)
