"""What a search service lets out: metadata, warnings, texts within a budget, cursors and ids."""

from __future__ import annotations

import base64
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.grounding import compact

#: Metadata fields that a response may show; fixed names.
PUBLIC_FIELDS = ["case_names", "chapter_num", "chapter_title", "content_type", "headings", "page_end", "page_range", "page_start", "primary_case", "section_path"]
#: Parts of a warning and the code that a response shows for it, the first that occurs; fixed values.
WARNING_CODES = {"manifested chunks sha-256": "hybrid_manifest_unavailable", "chunks file": "hybrid_chunks_unavailable", "bm25 search failed": "hybrid_lexical_failed", "bm25 search returned no candidates": "hybrid_lexical_empty", "hybrid search failed": "hybrid_failed", "rerank": "reranker_unavailable"}
OTHER_WARNING, MOST_WARNINGS = "retrieval_degraded", 32
#: Bounds of public strings and lists, of metadata and of a response in bytes; fixed values.
PUBLIC_CHARACTERS, PUBLIC_ITEMS, METADATA_BYTES, RESPONSE_BYTES = 512, 16, 16 * 1024, 1_900_000


def public_metadata(metadata: dict[str, Column]) -> Column:
    """The public fields that are given, in the order of their names, strings and lists cut to their bounds."""
    cut = lambda c, kind: F.transform(F.slice(c, 1, PUBLIC_ITEMS), lambda x: F.left(x, F.lit(PUBLIC_CHARACTERS))) if kind == "list" else F.left(c, F.lit(PUBLIC_CHARACTERS)) if kind == "text" else c
    kinds = {"case_names": "list", "headings": "list", "chapter_num": "number", "page_start": "number", "page_end": "number"}
    return F.struct(*[cut(metadata[k], kinds.get(k, "text")).alias(k) for k in PUBLIC_FIELDS if k in metadata])


def warning_codes(warnings: Column) -> Column:
    """The codes of the first warnings, in order and once each."""
    def code(w: Column) -> Column:
        out = F.lit(OTHER_WARNING)
        for part, name in reversed(WARNING_CODES.items()):
            out = F.when(F.contains(F.lower(w), F.lit(part)), name).otherwise(out)
        return out

    return F.array_distinct(F.transform(F.slice(warnings, 1, MOST_WARNINGS), code))


def fitted(texts: list[str], budget: int) -> list[tuple[str, bool]]:
    """Each text whole if its JSON fits into what the ones before it leave of ``budget`` bytes, else its longest prefix that does."""
    size = lambda t: len(json.dumps(t, ensure_ascii=False).encode("utf-8", "surrogatepass")) - 2
    out = []
    for t in texts:
        # a whole text is marked "false", one byte longer than "true"
        if size(t) + 1 <= budget:
            out.append((t, False))
            budget -= size(t) + 1
            continue
        low, high = 0, len(t)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if size(t[:middle]) <= budget else (low, middle - 1)
        out.append((t[:low], True))
        budget -= size(t[:low])
    return out


def fit_responses(hits: DataFrame, budget: int = RESPONSE_BYTES, frame: int = 0) -> DataFrame:
    """query_id, rank, text and truncated of hits (query_id, rank, text): a response's texts in the order of their ranks.

    ``frame`` is what the rest of a response takes.  A task takes one response.
    """
    kind = dict(hits.dtypes)["query_id"]

    def run(pdf):
        pdf = pdf.sort_values("rank")
        rows = fitted(pdf.text.fillna("").tolist(), budget - frame)
        return pdf[["query_id", "rank"]].assign(text=[t for t, _ in rows], truncated=[c for _, c in rows])

    return hits.select("query_id", "rank", "text").groupBy("query_id").applyInPandas(run, f"query_id {kind}, rank int, text string, truncated boolean")


def encode_cursor(created_at: float, job_id: str) -> str:
    """A page's last row as one URL-safe word."""
    raw = json.dumps({"schema_version": 1, "created_at": float(created_at).hex(), "job_id": job_id}, sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode("ascii")).rstrip(b"=").decode("ascii")


def decode_cursor(value: str) -> tuple[float, str]:
    """created_at and job_id of a cursor; anything that does not encode to itself is an error."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,256}", value or ""):
        raise ValueError("not a cursor")
    try:
        held = json.loads(base64.b64decode(value + "=" * (-len(value) % 4), altchars=b"-_", validate=True))
        at, job = float.fromhex(held["created_at"]), held["job_id"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if set(held) != {"schema_version", "created_at", "job_id"} or encode_cursor(at, job) != value:
        raise ValueError("not a cursor")
    return at, job


def page_before(rows: DataFrame, cursor: str | None, size: int, at: str = "created_at", key: str = "job_id") -> DataFrame:
    """The next ``size`` rows after the cursor, newest first, then greatest id, each with the cursor that follows it."""
    if cursor:
        when, job = decode_cursor(cursor)
        rows = rows.where((F.col(at) < when) | ((F.col(at) == when) & (F.col(key).cast("string") < job)))

    @F.pandas_udf(T.StringType())
    def encoded(t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([encode_cursor(a, b) for a, b in zip(t, k)])

    page = rows.orderBy(F.col(at).desc(), F.col(key).cast("string").desc()).limit(size)
    return page.withColumn("cursor", encoded(F.col(at).cast("double"), F.col(key).cast("string")))


def job_id(corpus: Column, key: Column, operation: str = "reindex", version: str = "v1") -> Column:
    """The job that an idempotency key names: the first 32 hex digits of a digest over operation, corpus and key."""
    return F.left(F.sha2(F.concat(F.lit(f"rag-service/{version}/{operation}/"), corpus, F.lit("\x00"), key), 256), F.lit(32))


def domain_digest(kind: str, fields: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON of the fields (as strings, null as null) and their kind, keys in order."""
    parts = []
    for name in sorted([*fields, "kind", "schema_version"]):
        value = F.lit(f'"{kind}"') if name == "kind" else F.lit("1") if name == "schema_version" else F.coalesce(F.concat(F.lit('"'), fields[name], F.lit('"')), F.lit("null"))
        parts.append(F.concat(F.lit(f'"{name}":'), value))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def canonical_sha256(value: dict) -> str:
    import hashlib

    return hashlib.sha256(compact(value).encode("utf-8")).hexdigest()
