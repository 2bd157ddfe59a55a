"""Benchmark decontamination by a generalised suffix automaton.

The automaton holds every word sequence of the normalised test items.  Training words are
streamed through it; at each word it knows the longest sequence ending there that occurs in
some item.  A *window* is ``window`` consecutive words of an item, or the whole of a shorter
item.  Words inside an occurrence of a window are hit; runs of hit words are the spans that
exceed the length limit, and the hit share of a document is its coverage.

Words are runs of characters other than U+0000-2F, 3A-60 and 7B-7F once A-Z are lower-cased:
in UTF-8 these are the bytes 0-9, a-z and 80-FF.  An occurrence of a window is made of words
that items hold, so runs of such words shorter than every window need not be streamed.

Items of the same words are one.  They go to the tasks in groups of at most ``group_words`` words, sent as
their words' bytes (a few hundred KB a group) and built into automata there: 100,000 random words take about 85 MB in a
Python worker.  An item longer than a group is cut into pieces that share window - 1 words, so that every window lies whole in
one.  A worker keeps ``HELD`` automata; where there are more groups, it takes a portion of texts, passes it through the
automata one after another, building each anew, and unites the spans.  So a worker's memory is that of ``HELD`` automata and
a portion, whatever the benchmark's size.  A stage takes ``GROUPS_AT_ONCE`` groups (6.4 million words, about 50 MB sent);
further ones follow in further stages.

Defined results: null texts and texts without words have no words and no hits; items without
words match nothing; items with a null id hit words but are not named; an id given twice is
one item; repeated documents each give their own row; empty tables give empty results or no hits.
``decontaminate`` keeps columns of any name; it cuts once, and words that meet where a span was cut
may in principle make a new window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import lean, portions, set_aside

KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Upper case to lower case, other bytes outside words to a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in KEPT else 0x20 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(FOLD).split() if text else []


class SuffixAutomaton:
    """All factors of the items' word sequences, with the windows that end in each state."""

    def __init__(self, items: list[list[bytes]], window: int = 10):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        for words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary[w])
        self.least = min([window, *(len(w) for w in items if w)])
        #: For each state as long as a window, the one that holds its last ``window`` words; those that do know their items.
        self.anchor = [0] * len(self.length)
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in by_length:
            if self.length[v] >= window:
                up = self.link[v]
                self.anchor[v] = self.anchor[up] if self.length[up] >= window else v
        self.held: dict[int, set[int]] = {}
        here: dict[int, tuple[int, int]] = {}
        for k, words in enumerate(items):
            v = 0
            for n, w in enumerate(words, 1):
                v = self.step[v][self.vocabulary[w]]
                if n >= window:
                    self.held.setdefault(self.anchor[v], set()).add(k)
            if 0 < len(words) < window:
                here[v] = (len(words), k)
        #: For each state, the shorter items that end there: at most one of each length.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in by_length if here else ():
            above = self.short.get(self.link[v], [])
            if v in here:
                self.short[v] = [*above, here[v]]
            elif above:
                self.short[v] = above

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, q, c)
        new = len(length)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        twin = len(length)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = twin
        while p != -1 and step[p].get(c) == q:
            step[p][c] = twin
            p = link[p]
        return twin

    def occurrences(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit [start, end) intervals and item numbers of a run of known words."""
        step, link, length, short, window = self.step, self.link, self.length, self.short, self.window
        held, anchor = self.held, self.anchor
        at, matched, spans, items = 0, 0, [], set()
        for i, c in enumerate(ids):
            to = step[at].get(c)
            while to is None and at:
                at = link[at]
                matched = length[at]
                to = step[at].get(c)
            if to is None:
                continue
            at, matched = to, matched + 1
            if matched >= window:
                items |= held[anchor[at]]
                start = i + 1 - matched
                if spans and start <= spans[-1][1]:
                    spans[-1] = (min(start, spans[-1][0]), i + 1)
                else:
                    spans.append((start, i + 1))
            for n, k in short.get(at, ()):
                if n <= matched:
                    items.add(k)
                    spans.append((i + 1 - n, i + 1))
        return spans, items

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit intervals and item numbers of a document, run by run of known words."""
        import numpy as np

        known = list(map(self.vocabulary.get, words))
        if len(known) < self.least:
            return [], set()
        flags = np.fromiter((x is not None for x in known), bool, len(known))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least
        spans, items = [], set()
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            found, named = self.occurrences(known[a:b])
            if found:
                spans += [(a + s, a + e) for s, e in found]
                items |= named
        return spans, items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


GROUP_WORDS, GROUPS_AT_ONCE = 100_000, 64
#: Automata that a worker keeps, and the bytes of texts that pass through more of them at a time.
HELD, PORTION = 3, 16_000_000

Group = list[tuple[list[str], bytes]]


def item_groups(benchmark: DataFrame, window: int, group_words: int) -> Iterator[Group]:
    """(ids, words joined by spaces) of the distinct items in groups of at most ``group_words`` words, read one after another.

    Items are brought together by their words on the cluster; the driver holds what is sent of one stage.
    """
    group_words = max(group_words, 2 * window)

    @F.udf("binary")
    def normal(text):
        return b" ".join(words_of(text)) or None

    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), normal("text").alias("w")).where("w is not null")
    named = words.groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    group: Group = []
    held = 0
    for row in named.select("ids", "w").toLocalIterator():
        own = bytes(row.w).split()
        for at in range(0, max(len(own) - window + 1, 1), group_words - window + 1):
            piece = own[at : at + group_words]
            if group and held + len(piece) > group_words:
                yield group
                group, held = [], 0
            group.append((list(row.ids), b" ".join(piece)))
            held += len(piece)
    if group:
        yield group


class Automata:
    """The automata of groups of items, the last ``HELD`` of them kept."""

    def __init__(self, groups: list[Group], window: int):
        self.groups, self.window, self.kept = groups, window, {}

    def __getitem__(self, g: int) -> SuffixAutomaton:
        if g not in self.kept:
            while len(self.kept) >= HELD:
                self.kept.pop(next(iter(self.kept)))
            self.kept[g] = SuffixAutomaton([w.split() for _, w in self.groups[g]], self.window)
        return self.kept[g]

    def scan(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Hit intervals and item ids of texts of words."""
        spans, names = [[] for _ in texts], [set() for _ in texts]
        # those that are kept from the texts before come first
        for g in sorted(range(len(self.groups)), key=lambda g: g not in self.kept):
            automaton, ids = self[g], self.groups[g]
            for i, words in enumerate(texts):
                found, held = automaton.scan(words)
                if found:
                    spans[i] += found
                    names[i].update(*(ids[k][0] for k in held))
        return list(zip(spans, names))


def match_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = 10, group_words: int = GROUP_WORDS, cut: bool = False) -> DataFrame:
    """``docs`` with n_words, spans (array of start, end in words, disjoint, ascending) and items (distinct ids as strings).

    Columns of these names are replaced; the others are kept as they are, but with ``cut`` the spans are cut out of the text.
    """
    spark = docs.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType()))]
    names = {f.name for f in added}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    kept_names, added_names = kept.columns, [f.name for f in added]
    at = kept_names.index(text)
    types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
    groups = item_groups(benchmark, window, group_words)
    out, own, first = kept, list(islice(groups, GROUPS_AT_ONCE)), True
    while own or first:
        coming = list(islice(groups, GROUPS_AT_ONCE))

        @lean
        def run(batches, sent=spark.sparkContext.broadcast(own), first=first, cutting=cut and not coming):
            automata = Automata(sent.value, window)
            for batch in portions(batches, at, PORTION if len(sent.value) > HELD else PORTION // 8):
                before = [[]] * batch.num_rows if first else batch.column(batch.num_columns - 2).to_pylist()
                named = [[]] * batch.num_rows if first else batch.column(batch.num_columns - 1).to_pylist()
                counts, spans, items, texts = [], [], [], []
                every = [words_of(t.as_py()) for t in batch.column(at)]
                for t, words, (found, ids), old, old_names in zip(batch.column(at), every, automata.scan(every), before, named):
                    counts.append(len(words))
                    hit = united(found + [(x["start"], x["end"]) for x in old])
                    spans.append([{"start": s, "end": e} for s, e in hit])
                    items.append(sorted(ids | set(old_names)))
                    if cutting:
                        texts.append(remove_spans(t.as_py(), hit) if hit else t.as_py())
                columns = list(batch.columns if first else batch.columns[:-3])
                if cutting:
                    columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, t) for v, t in zip((counts, spans, items), types))], names=[*kept_names, *added_names])

        out = out.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))
        own, first = coming, False
    return out


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them; one space is left in place of each."""
    data = text.encode("utf-8")
    places = [m.span() for m in WORD.finditer(data)]
    out, at = [], 0
    for s, e in spans:
        out += [data[at : places[s][0]].rstrip(b" "), b" "]
        at = places[e - 1][1]
    rest = data[at:]
    return (b"".join(out) + rest.lstrip(b" ")).decode("utf-8").strip(" ")


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` (their own columns) with matched spans cut out of text and n_chars following it, in one pass.

    A document of which more than ``max_coverage`` of the words are hit goes altogether.
    """
    plain, own = set_aside(docs, ("text", "n_chars"))
    staying = match_spans(plain, benchmark, window=window, cut=True).where(hit_words() <= F.col("n_words") * max_coverage)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        staying = staying.withColumn("n_chars", F.when(F.size("spans") > 0, length).otherwise(F.col("n_chars")))
    return staying.select(*own)


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    found = match_spans(docs.select("doc_id", "text"), benchmark)
    hit = hit_words()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
