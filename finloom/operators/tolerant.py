"""JSON in texts that aren't quite JSON, and items of a page that were given twice."""

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTES = {'"': '"', "'": "'", "“": "”"}
WORDS = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None, "NaN": None, "undefined": None}
#: What can stand after the comma behind a member of an object, or an item of an array.
AFTER_MEMBER = re.compile(r"""\s*(?:["'“}\]]|$|//|/\*|[\w-]+\s*:)""")
AFTER_ITEM = re.compile(r"""\s*(?:["'“}\]{\[\w-]|$|//|/\*)""")


def _ends(text: str, at: int, key: bool, inside_object: bool) -> bool:
    """Whether the quote at ``at`` can end a string: what follows has to go on as JSON would."""
    rest = at + 1
    while rest < len(text) and text[rest].isspace():
        rest += 1
    if rest == len(text):
        return True
    c = text[rest]
    if key:
        return c in ":,}"
    if c in "}]" or text.startswith(("//", "/*"), rest):
        return True
    if c == ",":
        return bool((AFTER_MEMBER if inside_object else AFTER_ITEM).match(text, rest + 1))
    return rest > at + 1 and c in QUOTES  # the comma is missing


def _string(text: str, at: int, key: bool, inside_object: bool) -> tuple[str, int]:
    """The string that the quote at ``at`` opens, and where it ends; a string that is cut goes on to the end."""
    close, out, i = QUOTES[text[at]], [], at + 1
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            e = text[i + 1]
            out.append(text[i : i + 2] if e in '"\\/bfnrtu' else e if e in QUOTES else "\\\\" + json.dumps(e)[1:-1])
            i += 2
            continue
        if c == close and _ends(text, i, key, inside_object):
            break
        out.append('\\"' if c == '"' else json.dumps(c)[1:-1] if c < " " else c)
        i += 1
    body = "".join(out)
    try:
        return json.loads(f'"{body}"'), i + 1
    except ValueError:  # a cut escape
        return body.replace('\\"', '"'), i + 1


def _bare(word: str):
    word = word.strip()
    if word in WORDS:
        return WORDS[word]
    try:
        value = json.loads(word)
        return value if isinstance(value, int) or math.isfinite(value) else None
    except (ValueError, TypeError):
        return word


def scanned(text: str):
    """The first object of a text, read in one pass over its characters with a stack of open brackets; None if there is none.

    Missing and extra commas, comments, single and curly quotes, quotes inside strings, raw
    line ends, bare words, brackets that don't match and a cut end are taken as a reader
    would; keys without a value get null, and of equal keys the last counts.
    """
    root: list = []
    stack: list = [root]
    keys: list = [None]

    def put(value) -> None:
        top = stack[-1]
        if not isinstance(top, dict):
            top.append(value)
        elif keys[-1] is None:
            keys[-1] = value if isinstance(value, str) else "" if isinstance(value, (dict, list)) else json.dumps(value)
            if isinstance(value, (dict, list)):
                top[keys[-1]], keys[-1] = value, None
        else:
            top[keys[-1]], keys[-1] = value, None

    def close() -> None:
        if keys[-1] is not None:
            stack[-1][keys[-1]] = None
        stack.pop()
        keys.pop()

    i = max(0, text.find("{"))
    while i < len(text):
        c, top = text[i], stack[-1]
        if c in "{[":
            value: dict | list = {} if c == "{" else []
            put(value)
            stack.append(value)
            keys.append(None)
        elif c in "}]":
            kind = dict if c == "}" else list
            if any(isinstance(x, kind) for x in stack[1:]):
                while not isinstance(stack[-1], kind):
                    close()
                close()
            if len(stack) == 1 and root:
                break
        elif c in QUOTES:
            value, i = _string(text, i, isinstance(top, dict) and keys[-1] is None, isinstance(top, dict))
            put(value)
            continue
        elif text.startswith("//", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 1
        elif c == ",":
            if isinstance(top, dict) and keys[-1] is not None:
                put(None)
        elif not c.isspace() and c != ":":
            end = i
            while end < len(text) and text[end] not in ",:{}[]\n" and not text.startswith(("//", "/*"), end) and not (text[end] in QUOTES and text[end - 1].isspace()):
                end += 1
            put(_bare(text[i:end]))
            i = end
            continue
        i += 1
    while len(stack) > 1:
        close()
    return root[0] if root and isinstance(root[0], dict) else None


def _repair(texts: pd.Series) -> pd.Series:
    found = [None if t is None else scanned(t) for t in texts]
    return pd.Series([None if f is None else json.dumps(f, ensure_ascii=False) for f in found], dtype=object)


def recovered(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``json``, the object in the text with sorted keys, and ``how`` it was found.

    As it is ("plain"), in a code fence ("fence"), from the first to the last brace
    ("braces"), or by the scanner ("scanned"), in this order; only texts that no other way
    can read reach it.  Both are null where there is no object.
    """
    t = F.trim(F.col(text))
    whole = lambda c: F.when(F.startswith(F.ltrim(c), F.lit("{")) & F.try_parse_json(c).isNotNull(), c)
    x = rows.withColumn("_t", t).withColumn("_fence", F.regexp_extract("_t", r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)).withColumn("_braces", F.regexp_extract("_t", r"(?s)(\{.*\})", 1))
    x = x.withColumn("_p", whole(F.col("_t"))).withColumn("_f", whole(F.col("_fence"))).withColumn("_b", whole(F.col("_braces")))
    x = x.withColumn("_s", F.pandas_udf(_repair, "string")(F.when(F.coalesce("_p", "_f", "_b").isNull() & F.contains("_t", F.lit("{")), F.col("_t"))))
    how = F.when(F.col("_p").isNotNull(), "plain").when(F.col("_f").isNotNull(), "fence").when(F.col("_b").isNotNull(), "braces").when(F.col("_s").isNotNull(), "scanned")
    return x.select(*rows.columns, F.to_json(F.try_parse_json(F.coalesce("_p", "_f", "_b", "_s"))).alias("json"), how.alias("how"))


def without_twins(items: DataFrame, pairs: int = 5, boxes: int = 2) -> DataFrame:
    """``items`` (page, pos, category, text, bbox) without those that stood before.

    Of a category and text that a page has ``pairs`` times or more, and of a box that it has
    ``boxes`` times or more, the first stays.  A box of three numbers is dropped from its
    item, an item with a box of another odd size goes, as does one with neither box nor category.
    """
    size = F.size(F.coalesce("bbox", F.array().cast(items.schema["bbox"].dataType)))
    sound = (F.col("bbox").isNull() & F.col("category").isNotNull()) | ((size == 3) & (F.col("category").isNotNull() | F.col("text").isNotNull())) | (size == 4)
    x = items.where(sound).withColumn("bbox", F.when(size == 4, F.col("bbox")))
    place = lambda *by: Window.partitionBy("page", *by)
    paired, boxed = F.col("category").isNotNull() & F.col("text").isNotNull(), F.col("bbox").isNotNull()
    again = lambda by, least: (F.count("*").over(place(*by)) >= least) & (F.row_number().over(place(*by).orderBy("pos")) > 1)
    marked = x.withColumn("_a", paired & again(("category", "text"), pairs)).withColumn("_b", boxed & again(("bbox",), boxes))
    return marked.where("NOT _a AND NOT _b").select(*items.columns)
