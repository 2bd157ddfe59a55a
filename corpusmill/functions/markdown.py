"""Rules of project Markdown: what is set out in plain text, and what is an error."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.udfs import table_cells

CASE = re.compile(r"<!-- CASE:\s*(\S.*?)\s*-->")
COMMENT = re.compile(r"<!--.*?-->", re.S)
LINK = re.compile(r"(!?)\[([^\]\n]*)\]\(\s*<?([^)\s>]+)>?\s*\)")
NOTE = re.compile(r"\[\^([^\]\r\n]+)\](:?)")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
OUTSIDE = re.compile(r"^(?:https?|mailto|data):|^#|^//", re.I)


def plain_project(text: str, names: set[str]) -> tuple[str, str | None]:
    """The text with LF line ends, case marks written out and links between a project's files as their labels; and an error that stays.

    Errors: other hidden comments, links to files outside the project, and footnotes that do not pair or are out of order.
    """
    t = text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")
    t = CASE.sub(lambda m: f"_Case opinion: {m[1]}._", t)
    t = LINK.sub(lambda m: m[2] if not m[1] and m[3].split("#")[0] in names else m[0], t)
    t = re.sub(r"\n{3,}", "\n\n", t).strip() + "\n"
    if COMMENT.search(t):
        return t, "hidden_comment"
    if any(not OUTSIDE.search(m[3]) for m in LINK.finditer(t)):
        return t, "local_link"
    return t, footnote_issue(t)


def footnote_issue(text: str) -> str | None:
    """What is wrong with numbered footnotes: labels, pairs, repeats or order."""
    marks = [(m[1], bool(m[2]) and (m.start() == 0 or text[m.start() - 1] == "\n")) for m in NOTE.finditer(text)]
    if any(not re.fullmatch("[1-9][0-9]*", label) for label, _ in marks):
        return "footnote_label"
    called, told = [label for label, d in marks if not d], [label for label, d in marks if d]
    if len(set(called)) < len(called) or len(set(told)) < len(told):
        return "footnote_repeated"
    if set(called) != set(told):
        return "footnote_unpaired"
    return None if called == told == [str(i + 1) for i in range(len(called))] else "footnote_order"


def issues(text: str | None) -> list[str]:
    """Error codes of a Markdown text: an open fence, tables whose rows differ in width or lack a rule, and footnotes."""
    found, fence, rows = [], None, []

    def table_done():
        if len(rows) >= 2 and rows[1][1]:
            if any(len(c) != len(rows[0][0]) for c, _ in rows):
                found.append("table_width")
        elif rows:
            found.append("table_without_rule")
        rows.clear()

    for line in (text or "").split("\n"):
        mark = FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = None
            continue
        cells = table_cells(line)
        if cells is None:
            table_done()
        else:
            rows.append((cells, all(re.fullmatch(r":?-{3,}:?", c) for c in cells)))
        fence = mark[1] if mark else None
    table_done()
    if fence:
        found.append("open_fence")
    note = footnote_issue(text or "")
    return sorted({*found, *([note] if note else [])})


@F.pandas_udf(T.ArrayType(T.StringType()))
def markdown_issues(text: pd.Series) -> pd.Series:
    return text.map(issues)
