"""Headings of structured documents: the order of their items, the scopes that headings open, and the records bound to them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators.corpus import numbered
from corpusmill.operators.folds import folded
from corpusmill.operators.records import root_paths
from corpusmill.session import cut

# --- order of items


def repaired_places(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``place`` as it is after the repair of wrapped pages.

    ``nodes`` are the children of a document's body: doc, place, page, top, bottom, left, right (y grows downwards; null for
    nodes without one page), label, words, marker (its text if that is an outline marker, else null), page_height, page_width
    and ``structural`` (in a range of pages that is left alone).  A page of four nodes or more that jumps back up exactly once, by
    35 % of its height and 140 points at least, and between aligned nodes or to a centred marker, is a wrap.  If all that comes
    late stands above the rest, it goes first; or else, if it is at most four headings or short texts, each goes before the first
    node that stands below it.  The places of the page's nodes are kept; who has which changes.
    """
    page = W.partitionBy("doc", "page")
    along = page.orderBy("place")
    usable = ~F.col("structural") & ~F.col("label").isin("page_header", "page_footer") & F.col("page").isNotNull()
    own, rest = nodes.where(usable), nodes.where(~F.coalesce(usable, F.lit(False)))
    before = {c: F.lag(c).over(along) for c in ("top", "left", "right")}
    shared = F.greatest(F.lit(0.0), F.least(F.col("right"), before["right"]) - F.greatest(F.col("left"), before["left"]))
    narrower = F.least(F.col("right") - F.col("left"), before["right"] - before["left"])
    middle = (F.col("left") + F.col("right")) / 2
    centred = F.col("marker").isNotNull() & middle.between(F.col("page_width") * 0.35, F.col("page_width") * 0.65)
    jump = before["top"] - F.col("top") >= F.greatest(F.lit(140.0), F.col("page_height") * 0.35)
    wraps = jump & (((narrower > 0) & (shared / F.nullif(narrower, F.lit(0.0)) >= 0.5)) | centred)
    marked = own.withColumns({"__w": F.coalesce(wraps, F.lit(False)).cast("int"), "__i": F.row_number().over(along)})
    marked = marked.withColumns({"__late": F.sum("__w").over(along.rowsBetween(W.unboundedPreceding, 0)) > 0, "__n": F.sum("__w").over(page), "__size": F.count("*").over(page)})
    late, early = F.when(F.col("__late"), F.lit(1)), F.when(~F.col("__late"), F.lit(1))
    short = (F.col("label") == "section_header") | (F.col("words") <= 16)
    key = F.struct("top", "left", "place")
    told = marked.withColumns(
        {
            "__rotates": F.max(F.when(F.col("__late"), F.col("bottom"))).over(page) <= F.min(F.when(~F.col("__late"), F.col("top"))).over(page) + 4.0,
            "__inserts": (F.sum(late).over(page) <= 4) & (F.min(F.when(F.col("__late"), short.cast("int"))).over(page) == 1),
            "__early": F.collect_list(F.when(early == 1, F.struct(F.col("__i").alias("i"), key.alias("k")))).over(page),
        }
    )
    below = F.array_min(F.transform(F.filter("__early", lambda x: x["k"] > key), lambda x: x["i"]))
    # late nodes go before the first early one below them, among themselves by position; else behind all early ones
    slot = F.when(F.col("__late"), F.coalesce(below, F.col("__size") + 1)).otherwise(F.col("__i"))
    one = (F.col("__n") == 1) & (F.col("__size") >= 4) & F.col("page_height").isNotNull() & F.col("page_width").isNotNull()
    none = F.lit(0).cast("double")
    rank = F.when(one & F.col("__rotates"), F.struct((~F.col("__late")).cast("int").alias("a"), F.col("__i").alias("b"), none.alias("c"), none.alias("d")))
    rank = rank.when(one & F.col("__inserts"), F.struct(slot.cast("int").alias("a"), (~F.col("__late")).cast("int").alias("b"), F.when(F.col("__late"), F.col("top")).otherwise(0.0).alias("c"), F.when(F.col("__late"), F.col("left")).otherwise(0.0).alias("d")))
    rank = rank.otherwise(F.struct(F.lit(0).alias("a"), F.col("__i").alias("b"), none.alias("c"), none.alias("d")))
    placed = told.withColumns({"__rank": rank}).withColumn("__to", F.row_number().over(page.orderBy("__rank", "place")))
    places = F.array_sort(F.collect_list("place").over(page))
    moved = placed.withColumn("place", F.element_at(places, F.col("__to")))
    return moved.select(*nodes.columns).unionByName(rest)


def document_order(nodes: DataFrame) -> DataFrame:
    """doc, ref and ord (from 0) of the items of ``nodes`` (doc, ref, parent, place, item) in document order.

    That is the preorder of the tree below the body (parent null), of any depth; nodes that are no ``item`` are containers and
    have no place of their own.  Items that the body does not reach, below a missing parent or on a cycle, follow in the order of
    their places, as do those of a document without a tree.
    """
    id_of = F.struct("doc", "ref")
    own = nodes.select(id_of.alias("node"), F.when(F.col("parent").isNotNull(), F.struct(F.col("doc"), F.col("parent").alias("ref"))).alias("parent"), F.col("place").cast("long").alias("value"), "item")
    reached = root_paths(own.select("node", "parent", "value"))
    every = own.select("node", "item", "value").join(reached.select("node", "path"), "node", "left").where("item")
    keyed = every.select("node.doc", "node.ref", F.col("path").isNull().cast("int").alias("unseen"), F.coalesce("path", F.array("value")).alias("path"))
    return numbered(keyed, "doc", ["unseen", "path", "ref"]).select("doc", "ref", F.col("number").alias("ord"))


# --- scopes


@dataclass
class Scopes:
    """Open headings from the outermost in, as (level, at), and whether content has come since the last one."""

    open: list[tuple[int, int]] = field(default_factory=list)
    content: bool = True

    def heading(self, level: int, attested: bool, at: int, nested: bool) -> None:
        if nested and not self.content and self.open and not attested:
            level = max(level, self.open[-1][0] + 1)
        while self.open and self.open[-1][0] >= level:
            self.open.pop()
        self.open.append((level, at))
        self.content = False


@dataclass
class Stretch:
    """What a stretch of items does to any open scopes.

    Headings before the first content nest below what is open there, so they are kept as they are (``lead``).  Those after it do
    not: they close all that is open from level ``floor`` on, and leave the scopes ``tail``.  A reset closes all.
    """

    reset: bool = False
    lead: list[tuple[int, bool, int]] = field(default_factory=list)
    settled: bool = False
    floor: int | None = None
    tail: Scopes = field(default_factory=Scopes)

    def add(self, row: dict, nested: bool) -> None:
        if row["resets"]:
            self.reset, self.lead, self.settled, self.floor, self.tail = True, [], True, None, Scopes()
        elif row["level"] is not None:
            if not self.settled and nested:
                self.lead.append((row["level"], bool(row["attested"]), row["at"]))
                return
            self.settled = True
            self.tail.heading(row["level"], bool(row["attested"]), row["at"], nested)
            lowest = self.tail.open[0][0]
            if len(self.tail.open) == 1:  # nothing of the stretch is left above it, so it closed what was open before
                self.floor = lowest if self.floor is None else min(self.floor, lowest)
        elif row["content"]:
            if not self.settled:
                self.settled = True
            self.tail.content = True


def after_stretch(state: Scopes, own: Stretch, nested: bool) -> Scopes:
    out = Scopes() if own.reset else Scopes(list(state.open), state.content)
    for level, attested, at in own.lead:
        out.heading(level, attested, at, nested)
    if own.settled:
        if own.floor is not None:
            while out.open and out.open[-1][0] >= own.floor:
                out.open.pop()
        out.open += own.tail.open
        out.content = own.tail.content
    return out


def heading_paths(items: DataFrame, group: str, order: str, nested: bool = True) -> DataFrame:
    """group, order, ``path`` (orders of the headings in force, from the outermost in) and, of headings, ``before``: the path they met.

    ``items``: group, order (a long, unique in its group), level (of any depth; null for what is no heading), attested, content
    and resets (booleans; null is false).  A heading ends those of its level and deeper and stands in its own path.  With
    ``nested``, a heading that follows another one without content between them goes below it, unless its level is attested.
    A reset (a structural range, such as a table of contents) ends all.

    The open scopes are handed on from range to range (``folds``), so a document may lie in many tasks; a summary is as long as the
    stack is deep.
    """
    own = items.select(
        group, F.col(order).cast("long").alias("at"), F.col("level").cast("int").alias("level"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) if c in items.columns else F.lit(c == "content").alias(c) for c in ("attested", "content", "resets")],
    )

    def summary(rows: Iterable[dict]) -> Stretch:
        out = Stretch()
        for row in rows:
            out.add(row, nested)
        return out

    def walk(state: Scopes, rows: Iterable[dict]) -> Iterator[tuple]:
        here, path = Scopes(list(state.open), state.content), [at for _, at in state.open]
        for row in rows:
            before = None
            if row["resets"]:
                here, path = Scopes(), []
            elif row["level"] is not None:
                before = path
                here.heading(row["level"], row["attested"], row["at"], nested)
                path = [at for _, at in here.open]
            elif row["content"]:
                here.content = True
            yield row[group], row["at"], path, before

    kind = dict(items.dtypes)[group]
    found = folded(own, group, ["at"], Scopes(), summary, lambda s, x: after_stretch(s, x, nested), walk, f"`{group}` {kind}, at long, path array<long>, before array<long>")
    return found.withColumnRenamed("at", order)


def scope_ends(paths: DataFrame, group: str, order: str) -> DataFrame:
    """group, heading, depth, first and last order of the stretch in which each heading is in force."""
    each = paths.select(group, order, F.posexplode("path").alias("depth", "heading"))
    return each.groupBy(group, "heading").agg(F.min("depth").alias("depth"), F.min(order).alias("first"), F.max(order).alias("last"))


# --- records


def risen_paths(items: DataFrame, paths: DataFrame, group: str, order: str) -> DataFrame:
    """``paths`` of items, taken back to what stood before each heading that is physically below the item on its page.

    ``items``: group, order, page, top.  Going back may lead to an earlier heading that is below the item too, so it is done until
    none is left; each round drops a heading that comes later than all those left to look at.
    """
    at = items.where("page is not null").select(group, F.col(order).alias("heading"), F.col("page").alias("hp"), F.col("top").alias("ht"))
    heads = cut(paths.where("before is not null").select(group, F.col(order).alias("heading"), "before").join(at, [group, "heading"]))
    state = paths.where("before is null").select(group, order, "path").join(items.select(group, order, "page", "top"), [group, order], "left")
    state = cut(state.withColumn("open", F.lit(True)))
    settled = None
    while True:
        asked = state.where("open and page is not null").select(group, order, "page", "top", F.explode("path").alias("heading"))
        low = asked.join(heads.drop("before"), [group, "heading"]).where((F.col("hp") == F.col("page")) & (F.col("ht") > F.col("top") + 0.5))
        worst = low.groupBy(group, order).agg(F.max("heading").alias("heading"))
        risen = cut(worst.join(heads.select(group, "heading", "before"), [group, "heading"]).select(group, order, F.col("before").alias("__to")))
        if risen.isEmpty():
            return state.select(group, order, "path")
        state = cut(state.join(risen, [group, order], "left").withColumn("open", F.col("__to").isNotNull() & ~F.col("__to").eqNullSafe(F.col("path"))).withColumn("path", F.coalesce("__to", "path")).drop("__to"))


def record_scopes(refs: DataFrame, paths: DataFrame, group: str, order: str) -> DataFrame:
    """group, record, path, conflict and rank of records, of the paths of the items they are made of (``refs``: group, record, order).

    Items of unlike paths make a conflict; their common beginning is the record's path.  The rank is that of its first item.
    """
    own = refs.join(paths.select(group, order, "path"), [group, order])
    # the common beginning of all paths is that of the least and the greatest of them
    least, most = F.min("path"), F.max("path")
    found = own.groupBy(group, "record").agg(least.alias("a"), most.alias("b"), F.min(order).alias("rank"))
    same = F.transform(F.sequence(F.lit(0), F.size("a")), lambda n: F.slice("a", F.lit(1), n))
    common = F.filter(same, lambda p: p == F.slice("b", F.lit(1), F.size(p)))
    path = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.element_at(common, -1))
    return found.select(group, "record", path.alias("path"), (F.col("a") != F.col("b")).alias("conflict"), "rank")


def heading_bindings(records: DataFrame, displays: DataFrame, titles: DataFrame, group: str) -> DataFrame:
    """group, record, bound (headings of its path that it displays), unbound (displays of no such heading), missing (headings it does not
    display) and direct: the headings that this record is the first to claim.

    ``records``: as of record_scopes; ``displays``: group, record, display (canonical text of a heading it shows, in order ``n``);
    ``titles``: group, heading, title (canonical text).
    """
    scope = records.select(group, "record", "rank", F.posexplode("path").alias("depth", "heading")).join(titles, [group, "heading"])
    shown = displays.select(group, "record", F.col("display").alias("title"), "n")
    both = scope.join(shown.groupBy(group, "record", "title").agg(F.min("n").alias("n")), [group, "record", "title"], "left")
    claimed = both.where("n is not null")
    owner = claimed.groupBy(group, "heading").agg(F.min(F.struct("rank", "record")).alias("o")).select(group, "heading", F.col("o.record").alias("record"), F.lit(True).alias("first"))
    told = both.join(owner, [group, "heading", "record"], "left")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("depth", "heading")))), lambda x: x["heading"])
    bound = told.groupBy(group, "record").agg(listed(F.col("n").isNotNull()).alias("bound"), listed(F.col("n").isNull()).alias("missing"), listed(F.col("first")).alias("direct"))
    unknown = shown.join(scope.select(group, "record", "title").distinct(), [group, "record", "title"], "left_anti")
    unknown = unknown.groupBy(group, "record").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]).alias("unbound"))
    out = records.select(group, "record", "conflict").join(bound, [group, "record"], "left").join(unknown, [group, "record"], "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(group, "record", "conflict", *[empty(c, "array<long>") for c in ("bound", "missing", "direct")], empty("unbound", "array<string>")).withColumn("valid", (F.size("missing") == 0) & (F.size("unbound") == 0))


def unclaimed_headings(paths: DataFrame, bindings: DataFrame, group: str, order: str) -> DataFrame:
    """group and heading of those that no record claims."""
    heads = paths.where("before is not null").select(group, F.col(order).alias("heading"))
    return heads.join(bindings.select(group, F.explode("direct").alias("heading")), [group, "heading"], "left_anti")
