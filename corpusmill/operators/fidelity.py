"""Whether records keep the words of the source items that they cite."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.udfs import attestation, source_words
from corpusmill.operators.corpus import numbered, ordered_digests

#: Version of attestations, and what is done to items whose words are not kept one by one; fixed values.
ATTESTATION_VERSION = 7
OPAQUE = ["table", "figure", "native_repair", "container_alias"]

#: Odd multiplier of the window hashes.
STEP = 0x9E3779B97F4A7C15


class Words:
    """The words of a document's items as numbers, with which places are taken and which are out of scope."""

    def __init__(self, items: list[tuple[str, list[str], bool]]):
        import numpy as np

        self.vocabulary: dict[str, int] = {}
        self.places: dict[str, slice] = {}
        ids, outside = [], []
        for ref, words, out_of_scope in items:
            self.places[ref] = slice(len(ids), len(ids) + len(words))
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            outside += [out_of_scope] * len(words)
        self.ids = np.array(ids, np.int64)
        self.covered = np.zeros(len(ids), bool)
        self.outside = np.array(outside, bool)
        # a number's code is spread over 64 bits, so that windows of unlike words have unlike hashes
        self.codes = np.arange(1, len(self.vocabulary) + 1, dtype=np.uint64) * np.uint64(STEP)
        self.codes ^= self.codes >> np.uint64(29)
        self.codes *= np.uint64(0xBF58476D1CE4E5B9)

    def aligned(self, words: list[str], refs: list[str]):
        """Where the words of a record stand in the items it cites (places in all the document's words), or None.

        Whole and together, if they do so at places that no record has taken (of the windows the one with the most such, the first among
        equals); if they do so only at places taken in part, None; else one after another, passing over words of the source, places
        taken and those out of scope, but never adding or turning any.  Windows are found by running hashes of the cited words, the
        rest by an index of them: the work is in proportion to the words cited.
        """
        import numpy as np

        known = list(map(self.vocabulary.get, words))
        where = np.concatenate([np.zeros(0, np.int64), *[np.arange(self.places[r].start, self.places[r].stop) for r in refs]])
        if not words or None in known or len(known) > len(where):
            return None if words else where[:0]
        own, source, n = np.array(known, np.int64), self.ids[where], len(known)
        powers = np.full(len(source) + 1, STEP, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(self.codes[source] * powers[:-1])])
        asked = np.add.reduce(self.codes[own] * powers[:n])
        starts = np.flatnonzero(sums[n:] - sums[:-n] == asked * powers[: len(source) - n + 1])
        taken = np.concatenate([[0], np.cumsum(self.covered[where])])
        together = False
        for at in starts[np.argsort(taken[starts + n] - taken[starts], kind="stable")].tolist():
            if np.array_equal(source[at : at + n], own):
                together = True
                if taken[at + n] == taken[at]:
                    return where[at : at + n]
                break
        if together:
            return None
        free = np.flatnonzero(~self.covered[where] & ~self.outside[where])
        order = free[np.argsort(source[free], kind="stable")]
        held = source[order]
        lows, highs = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
        out, cursor = [], 0
        for low, high in zip(lows.tolist(), highs.tolist()):
            k = low + int(np.searchsorted(order[low:high], cursor))
            if k >= high:
                return None
            out.append(int(order[k]))
            cursor = out[-1] + 1
        return where[out]


def aligned(words: list[str], source: list[tuple[str, int, str]], covered: set[tuple[str, int]]) -> list[tuple[str, int]] | None:
    """``Words.aligned`` of one record with a source given as (ref, place, word)."""
    held = Words([("", [w for _, _, w in source], False)])
    for i, (ref, place, _) in enumerate(source):
        held.covered[i] = (ref, place) in covered
    found = held.aligned(words, [""])
    return None if found is None else [source[i][:2] for i in found.tolist()]


AUDIT = "doc {0}, kind string, key string, n_words long, covered long, issue string"


def audit(records: DataFrame, items: DataFrame) -> DataFrame:
    """doc, kind (record or item), key, n_words, covered and issue of records (doc, ord, text, refs) against items (doc, place, ref, text).

    Records take their words from the items they cite, in their order, each place once.  A record that cannot is
    ``unattested_words``, one that cites none ``no_source``; an item is ``words_lost`` where records took not all of its words.
    Items may have a ``container``: to cite a container, even one that is no item, is to cite all within it, however deep.  Items
    may be ``out_of_scope`` (a page view that is left out): their words may be taken whole and together only, and none is lost.  A
    task takes one document.
    """
    kind = dict(records.dtypes)["doc"]
    held = items.withColumns({c: F.lit(None).cast(t) for c, t in (("container", "string"), ("out_of_scope", "boolean")) if c not in items.columns})

    def run(key, mine, theirs):
        theirs = theirs.sort_values("place").drop_duplicates("ref", keep="last")
        refs = theirs.ref.tolist()
        order = {ref: i for i, ref in enumerate(refs)}
        own_words = {ref: source_words(t) for ref, t in zip(refs, theirs.text)}
        outside = {ref: bool(x) for ref, x in zip(refs, theirs.out_of_scope.fillna(False).astype(bool))}
        source = Words([(r, own_words[r], outside[r]) for r in refs])
        inside: dict[str, list[str]] = {}
        for ref, box in zip(refs, theirs.container):
            if isinstance(box, str):
                inside.setdefault(box, []).append(ref)

        def reached(cited) -> list[str]:
            found, todo = set(), list(cited)
            while todo:
                r = todo.pop()
                if r not in found:
                    found.add(r)
                    todo += inside.get(r, [])
            return sorted((r for r in found if r in order), key=order.get)

        out = []
        for ord_, text, cited in mine.sort_values("ord")[["ord", "text", "refs"]].itertuples(index=False):
            own = source_words(text)
            cited = reached([] if cited is None else cited)
            found = source.aligned(own, cited) if cited else None
            if found is not None:
                source.covered[found] = True
            issue = "no_source" if not cited and own else "unattested_words" if found is None and own else None
            out.append((key[0], "record", str(ord_), len(own), 0 if found is None else len(found), issue))
        for ref in refs:
            n, size = int(source.covered[source.places[ref]].sum()), len(own_words[ref])
            out.append((key[0], "item", ref, size, n, "words_lost" if n < size and not outside[ref] else None))
        return pd.DataFrame(out, columns=["doc", "kind", "key", "n_words", "covered", "issue"])

    own = held.select("doc", "place", "ref", "text", "container", "out_of_scope")
    return records.groupBy("doc").cogroup(own.groupBy("doc")).applyInPandas(run, AUDIT.format(kind))


def attested(text: Column, items: Column) -> Column:
    """The attestation of a record as canonical JSON: digests of its text and words, and, if an item was put in opaquely, what it cites.

    ``items``: array of (ref, transform), null for none.
    """
    own = attestation(F.coalesce(text, F.lit("")))
    some = F.coalesce(F.exists(items, lambda i: F.coalesce(i["transform"].isin(OPAQUE), F.lit(False))), F.lit(False))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    refs = F.to_json(F.filter(F.transform(items, lambda i: i["ref"]), lambda r: r.isNotNull()))
    fields = {
        "opaque_output_sha256": F.when(some, quoted(own["output_lexical_sha256"])).otherwise("null"),
        "opaque_source_refs": F.when(some, refs).otherwise("[]"),
        "output_lexical_count": own["output_lexical_count"].cast("string"),
        "output_lexical_sha256": quoted(own["output_lexical_sha256"]),
        "output_text_sha256": quoted(own["output_text_sha256"]),
        "schema_version": F.lit(str(ATTESTATION_VERSION)),
    }
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}"))


def attestation_roots(records: DataFrame, group: str, order: str) -> DataFrame:
    """group, root and n of the records (text, items, retrieval_role) in order: one digest of the canonical JSON list of their attestations.

    Each stands with its place among all records of the group; table children have a place but no attestation.  No list is built: the
    digest runs over the records as a stream (``ordered_digests``).
    """
    placed = numbered(records.select(group, order, "text", "items", "retrieval_role"), group, [order])
    own = placed.where(F.coalesce(F.col("retrieval_role"), F.lit("")) != "table_child").select(group, "number", attested(F.col("text"), F.col("items")).alias("a"))
    entry = F.concat(F.lit('{"attestation":'), F.col("a"), F.lit(',"record_index":'), F.col("number").cast("string"), F.lit("}"))
    return ordered_digests(own, group, ["number"], entry, ",", "[", "]")
