"""Divisions of books: profiles of headings, matches in text, titles, levels and section policies."""

from __future__ import annotations

import hashlib
import re
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.identity import canonical, ordinal, roman

CONTEXTS = ("page_header", "running_header", "toc_entry", "canonical_title", "chunk_heading", "cross_reference")


@dataclass(frozen=True)
class Division:
    """A heading pattern with a ``number`` group, and ``kind`` and ``title`` groups where it has them."""

    contexts: tuple[str, ...]
    pattern: str
    kind: str


@dataclass(frozen=True)
class Section:
    """A named part before or behind the divisions, and whether it stays out of the corpus."""

    key: str
    patterns: tuple[str, ...]
    excluded: bool
    seeds_toc: bool = False


@dataclass(frozen=True)
class Profile:
    """How one family of books is divided."""

    name: str
    divisions: tuple[Division, ...]
    sections: tuple[Section, ...]
    levels: tuple[tuple[int, str], ...] = ()
    title: str = "{kind} {number}: {title}"
    styles: tuple[str, ...] = ("arabic", "roman", "word")
    most: int = 50
    revision: int = 1

    def digest(self) -> str:
        return hashlib.sha256(canonical(asdict(self)).encode("utf-8")).hexdigest()

    def receipt(self) -> dict:
        return {"schema_version": 1, "name": self.name, "revision": self.revision, "sha256": self.digest()}


NUMBER = r"(?P<number>\d{1,3}|[IVXLC]+|[A-Za-z]+(?:[- ][A-Za-z]+)?)"
#: A profile for books divided into chapters, with the usual parts around them.
CHAPTERS = Profile(
    "chapters",
    (
        Division(("toc_entry", "canonical_title", "chunk_heading", "page_header"), rf"^\s*(?P<kind>Chapter|Unit)\s+{NUMBER}\b\s*[:.\-–—]?\s*(?P<title>.*)$", "chapter"),
        Division(("running_header",), r"^\s*(?P<number>\d{1,2})\s*[·•]\s+(?P<title>\S.*)$", "chapter"),
        Division(("cross_reference",), rf"\b(?:see\s+)?(?P<kind>Chapter)\s+{NUMBER}\b", "chapter"),
    ),
    (
        Section("contents", (r"(?:table of )?contents", r"(?:summary|brief|short|detailed) contents"), True, True),
        Section("index", (r"index", r"subject index"), True),
        Section("preface", (r"preface", r"foreword"), False),
        Section("acknowledgments", (r"acknowledge?ments?",), True),
    ),
    ((1, r"^part\b"), (2, r"^(?:[A-Z]\.|§)\s"), (4, r"^\d+\.\s")),
)
#: The same for books whose chapters stand in parts with Roman numbers.
PARTS = replace(CHAPTERS, name="roman-parts", divisions=(Division(("toc_entry", "canonical_title", "chunk_heading"), rf"^\s*(?P<kind>Part)\s+{NUMBER}\b\s*[:.\-–—]?\s*(?P<title>.*)$", "part"),), styles=("roman",))
PROFILES = {p.name: p for p in (CHAPTERS, PARTS)}


def profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


def profile_of(receipt: dict) -> Profile:
    """The profile that a receipt names, if it is still the same."""
    own = profile(receipt.get("name", ""))
    if receipt != own.receipt():
        raise ValueError("the receipt is of another revision of its profile")
    return own


def divisions(text: str | None, own: Profile, context: str) -> list[dict]:
    """All divisions found in a text for a context, by rule, then by place; none overlaps one found before."""
    if context not in CONTEXTS:
        raise ValueError(f"unknown context {context!r}")
    out: list[dict] = []
    for rule in own.divisions:
        for m in re.finditer(rule.pattern, text or "", re.I | re.M) if context in rule.contexts else ():
            number = ordinal(m["number"].strip(), own.styles, own.most)
            if number is not None and all(m.end() <= d["start"] or m.start() >= d["end"] for d in out):
                named = m.groupdict()
                out.append({"ordinal": number, "raw": m["number"].strip(), "kind": (named.get("kind") or rule.kind).strip().title(), "title": (named.get("title") or "").strip(" \t:.-–—"), "start": m.start(), "end": m.end()})
    return out


def fallback_title(own: Profile, number: int) -> str:
    if not 1 <= number <= own.most:
        raise ValueError("no such division in this profile")
    return f"{own.divisions[0].kind.title()} {number if 'arabic' in own.styles else roman(number)}"


def canonical_title(found: dict, own: Profile, fallback: str = "") -> str:
    title = (found["title"] or fallback).strip()
    return own.title.format(kind=found["kind"], number=found["raw"], title=title).strip() if title else f"{found['kind']} {found['raw']}"


def level(title: str, own: Profile) -> int:
    """The level of a contents row: 1 for divisions, else that of the first pattern that fits, else 3."""
    return 1 if divisions(title, own, "toc_entry") else next((n for n, p in own.levels if re.search(p, title, re.I)), 3)


def section(heading: str, own: Profile) -> Section | None:
    return next((s for s in own.sections if any(re.fullmatch(p, heading, re.I) for p in s.patterns)), None)


def holds_subnumber(text: str, found: dict) -> bool:
    """Whether a text has a subdivision such as ``3-1`` of the division, in its own or in plain numbers."""
    return any(re.search(rf"(?<![A-Za-z0-9]){re.escape(v)}-\d+\b", text, re.I) for v in {str(found["ordinal"]), found["raw"]} if v)


def excluded_patterns(own: Profile) -> list[str]:
    """Patterns of headings that the profile keeps out of the corpus."""
    return [rf"^(?:{p})$" for s in own.sections if s.excluded for p in s.patterns]


DIVISION = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("raw", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("title", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def found_divisions(text: Column, own: Profile, context: str) -> Column:
    """The divisions of a text as an array."""

    @F.pandas_udf(DIVISION)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: divisions(t, own, context))

    return run(text)


def toc_level(title: Column, own: Profile) -> Column:
    @F.pandas_udf(T.IntegerType())
    def run(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: level(t or "", own))

    return run(title)
