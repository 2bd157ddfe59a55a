"""Canonical JSON, content hashes and stable record ids (their bytes are part of the data contract)."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: object) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def short_sha(value: object) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8")).hexdigest()[:16]


def content_hash(record: dict) -> str:
    """Of the text and all metadata but the record's position."""
    return short_sha({"text": record["text"], "metadata": {k: v for k, v in record.get("metadata", {}).items() if k != "chunk_index"}})


def bound_source(metadata: dict) -> dict:
    """The checked original-source binding of a record."""
    source = metadata["stable_id_source"]
    if not isinstance(source, dict) or set(source) != {"name", "size", "sha256"}:
        raise ValueError("a source binding has name, size and sha256")
    name, size, digest = source["name"], source["size"], source["sha256"]
    if not isinstance(name, str) or name in ("", ".", "..") or re.search(r"[/\\]", name):
        raise ValueError("bad source name")
    if type(size) is not int or size <= 0:
        raise ValueError("bad source size")
    if not isinstance(digest, str) or not re.fullmatch("[0-9a-f]{64}", digest):
        raise ValueError("bad source digest")
    return dict(source)


def stable_id(record: dict, version: int = 2) -> str:
    """``chunk_`` and 16 hex digits: by file name, or bound to the original source where the record names it."""
    meta = record.get("metadata", {})
    fields = {"text": record["text"], "page_start": meta.get("page_start"), "page_end": meta.get("page_end")}
    if "stable_id_source" in meta:
        fields |= {"stable_id_schema_version": version, "source": bound_source(meta)}
    else:
        fields |= {"page_range": meta.get("page_range", ""), "source_file": meta.get("source_file", "")}
    items = meta.get("source_items")
    refs = {i["ref"] for i in items if isinstance(i, dict) and isinstance(i.get("ref"), str) and i["ref"]} if isinstance(items, list) else set()
    if refs:
        fields["source_refs"] = sorted(refs)
    if type(n := meta.get("table_fragment_occurrence")) is int and n > 0:
        fields["table_fragment_occurrence"] = n
    if meta.get("retrieval_role") == "table_child":
        fields |= {k: meta.get(k) for k in ("retrieval_role", "table_parent_stable_id", "table_child_index")}
    return "chunk_" + short_sha(fields)


def context_parent(metadata: dict) -> str:
    """``context_`` and 16 hex digits of the source and chapter that a record's neighbours share; "" for records that have none.

    Table children, structural records, footnotes and figures stand alone; records without a chapter share the front matter.
    """
    alone = metadata.get("retrieval_role") == "table_child" or metadata.get("content_type") == "structural" or metadata.get("content_source") in ("footnote", "figure")
    chapter = metadata.get("chapter_num")
    if alone or not (chapter is None or type(chapter) is int):
        return ""
    if metadata.get("stable_id_source") is not None:
        source: object = bound_source(metadata)
    elif isinstance(metadata.get("source_file"), str) and metadata["source_file"].strip():
        source = {"legacy_source_file": metadata["source_file"]}
    else:
        return ""
    return "context_" + short_sha({"source": source, "chapter_group": "front_matter" if chapter is None else chapter})


@F.pandas_udf(T.StringType())
def parent_id(metadata: pd.Series) -> pd.Series:
    """Context parents of metadata given as JSON."""
    return metadata.map(lambda m: context_parent(json.loads(m)), na_action="ignore")


@F.pandas_udf(T.StringType())
def record_id(record: pd.Series) -> pd.Series:
    """Stable ids of records given as JSON lines."""
    return record.map(lambda r: stable_id(json.loads(r)), na_action="ignore")


@F.pandas_udf(T.StringType())
def record_hash(record: pd.Series) -> pd.Series:
    return record.map(lambda r: content_hash(json.loads(r)), na_action="ignore")


#: English number words of division ordinals; fixed values.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50}


def roman(n: int) -> str:
    digit = lambda d, one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten][d]
    return "M" * (n // 1000) + digit(n // 100 % 10, "C", "D", "M") + digit(n // 10 % 10, "X", "L", "C") + digit(n % 10, "I", "V", "X")


def ordinal(raw: str | None, styles: tuple[str, ...] = ("arabic", "roman", "word"), most: int = 50) -> int | None:
    """A division number written in digits, canonical Roman numerals or English words, from 1 to ``most``."""
    token = "-".join((raw or "").casefold().split())
    names = {}
    for n in range(1, most + 1):
        if "arabic" in styles:
            names[str(n)] = n
        if "roman" in styles:
            names[roman(n).lower()] = n
        if "word" in styles and n <= len(NUMBER_WORDS):
            names[NUMBER_WORDS[n - 1]] = n
    if "word" in styles:
        for word, ten in TENS.items():
            for n in range(10):
                if ten + n <= most:
                    names[word + (f"-{NUMBER_WORDS[n - 1]}" if n else "")] = ten + n
    digits = token.lstrip("0") if token.isascii() and token.isdigit() else token
    return names.get(digits)


@F.pandas_udf(T.IntegerType())
def division_ordinal(raw: pd.Series) -> pd.Series:
    return raw.map(ordinal).astype("Int64")
