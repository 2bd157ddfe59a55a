"""A Merkle manifest of a table: one tree a group, and one over the groups' roots, merged as a sparse forest.

A leaf is a digest of a row's fields.  The leaves of a group ascend by key; while a level holds more than one node, each run of
``arity`` consecutive ones (the last run may be shorter, even one) becomes the digest of their digests as hex text.  The last
one is the group's root; the roots, ordered by group, are the leaves of the tree above.

Rows are dealt by ranges of group and key, so each partition knows the places of its leaves and the sizes of their groups
(``ranges``).  It folds every run of siblings that it holds whole; what is left are *unresolved* nodes, a few for each level,
keyed by tree, level and index.  Such fragments form a commutative monoid: two merge by putting their nodes together and
folding each run that has become complete, whichever partitions it came from; ``treeReduce`` does so up to the root.  The
merge keeps the runs it folds.  They are all that a partition needs to prove its own rows: siblings that it does not hold
were either folded there or never needed.  Their number is that of partitions times levels, times arity, not that of rows.

Defined results: null fields count as such, not as empty ones; rows with a null group are a group, the first; a null key
stands first, and rows of equal keys ascend by leaf, repeated rows each being a leaf; an empty table has no root and an
empty result.  Columns other than those asked for take no part.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import ranges
from corpusmill.llm.common import crc32_sql

#: The tree over the groups' roots; the others bear the number of their group.
TOP = -1
HEX = 64


def digest(data: bytes) -> bytes:
    """SHA-256 as hex text."""
    return hashlib.sha256(data).hexdigest().encode()


def field_text(value: Column) -> Column:
    """A field in a leaf: ``-`` if null, else the bytes of its text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in fields]).cast("binary"), 256)


@dataclass
class Fragment:
    """Unresolved nodes by (tree, level, index), the sizes of their trees, and the nodes that merges have folded."""

    nodes: dict[tuple[int, int, int], bytes] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)
    folded: dict[tuple[int, int, int], bytes] = field(default_factory=dict)


def width(size: int, level: int, arity: int) -> int:
    """How many nodes a level of a tree of ``size`` leaves holds."""
    for _ in range(level):
        size = -(-size // arity)
    return size


def merge(a: Fragment, b: Fragment, arity: int = 2) -> Fragment:
    """Both fragments' nodes with every run folded that is now complete."""
    out = Fragment({**a.nodes, **b.nodes}, {**a.sizes, **b.sizes}, {**a.folded, **b.folded})
    todo = list(b.nodes if len(b.nodes) < len(a.nodes) else a.nodes)
    while todo:
        tree, level, index = todo.pop()
        if (tree, level, index) not in out.nodes:
            continue
        across = width(out.sizes[tree], level, arity)
        if across == 1:
            if tree != TOP:  # a group's root is a leaf of the tree above
                out.nodes[TOP, 0, tree] = out.nodes.pop((tree, level, index))
                todo.append((TOP, 0, tree))
            continue
        first = index - index % arity
        run = [(tree, level, i) for i in range(first, min(first + arity, across))]
        if all(k in out.nodes for k in run):
            for k in run:
                out.folded[k] = out.nodes.pop(k)
            parent = (tree, level + 1, first // arity)
            out.nodes[parent] = digest(b"".join(out.folded[k] for k in run))
            todo.append(parent)
    return out


@dataclass
class Stack:
    """The nodes of one tree that a partition holds whole: for each level the first index and the digests end to end."""

    tree: int
    size: int
    levels: list[tuple[int, bytes]]
    arity: int

    @classmethod
    def over(cls, tree: int, size: int, first: int, leaves: bytes, arity: int) -> Stack:
        levels, across = [(first, leaves)], size
        while across > 1:
            at, data = levels[-1]
            end = at + len(data) // HEX
            low, high = -(-at // arity), -(-across // arity) if end == across else end // arity
            if low >= high:
                break
            runs = (data[HEX * (i * arity - at) : HEX * (i * arity + arity - at)] for i in range(low, high))
            levels.append((low, b"".join(map(digest, runs))))
            across = -(-across // arity)
        return cls(tree, size, levels, arity)

    @property
    def whole(self) -> bool:
        return len(self.levels[0][1]) == HEX * self.size

    def node(self, level: int, index: int) -> bytes | None:
        if level >= len(self.levels):
            return None
        first, data = self.levels[level]
        at = HEX * (index - first)
        return data[at : at + HEX] if 0 <= at < len(data) else None

    def unresolved(self) -> dict[tuple[int, int, int], bytes]:
        """The nodes whose runs are not folded here: at either end of a level, or all of the last one."""
        out = {}
        for level, (first, data) in enumerate(self.levels):
            left, right = range(first, first + len(data) // HEX), range(0)
            if level + 1 < len(self.levels):
                low, above = self.levels[level + 1]
                left, right = range(first, low * self.arity), range((low + len(above) // HEX) * self.arity, left.stop)
            for i in (*left, *right):
                out[self.tree, level, i] = self.node(level, i)
        return out


def stacks(found: ranges.Placed, groups: int, leaf: str, arity: int) -> tuple[list[Stack], Stack | None]:
    """The stacks of the groups in a partition, and the one over the roots of those groups that it holds whole."""
    column = found.table.column(leaf)
    own = []
    for a, b in zip(found.starts[:-1].tolist(), found.starts[1:].tolist()):
        leaves = b"".join([x.as_py().encode() for x in column.slice(a, b - a)])
        own.append(Stack.over(int(found.group[a]), int(found.total[a]), int(found.place[a]), leaves, arity))
    roots = [s for s in own if s.whole]
    top = Stack.over(TOP, groups, roots[0].tree, b"".join(s.levels[-1][1] for s in roots), arity) if roots else None
    return own, top


def fragment(found: ranges.Placed, groups: int, leaf: str, arity: int) -> Fragment:
    """What a partition leaves unresolved."""
    own, top = stacks(found, groups, leaf, arity)
    out = Fragment(sizes={TOP: groups})
    for s in own:
        if not s.whole:  # whole groups stand in the tree above
            out.nodes |= s.unresolved()
            out.sizes[s.tree] = s.size
    if top:
        out.nodes |= top.unresolved()
    return out


@dataclass
class Manifest:
    """The leaves in their ranges, the root, and the nodes that partitions share."""

    leaves: ranges.Dealt
    root: bytes
    shared: dict[tuple[int, int, int], bytes]
    group: str
    leaf: str
    arity: int


def manifest(leaves: DataFrame, group: str, key: str, leaf: str, arity: int = 2) -> Manifest | None:
    """The manifest of ``leaves`` (group, key, leaf as hex text, and whatever else is to stay beside them); None of no rows."""
    # rows of one leaf may be dealt apart in any order: the tree is the same
    dealt = ranges.dealt(leaves.withColumn("__salt", F.monotonically_increasing_id()), group, [key, leaf, "__salt"])
    if not dealt.groups:
        return None
    groups = dealt.groups
    edges = leaves.sparkSession.sparkContext.broadcast(dealt.edges)

    def fragments(batches):
        import pyarrow as pa

        found = ranges.placed(batches, edges.value, group)
        if found:
            own = fragment(found, groups, leaf, arity)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["fragment"])

    parts = dealt.rows.select(group, leaf, ranges.PART).mapInArrow(fragments, "fragment binary")
    whole = parts.rdd.map(lambda r: pickle.loads(r[0])).treeReduce(lambda a, b: merge(a, b, arity))
    (((tree, _, _), root),) = whole.nodes.items()
    if tree != TOP:
        raise RuntimeError("the forest has not become one tree")
    return Manifest(dealt, root, whole.folded, group, leaf, arity)


#: For each level from the leaf up: the node's place among its siblings, and the siblings.
Path = list[tuple[int, list[bytes]]]


def fold(node: bytes, path: Path) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for place, others in path:
        node = digest(b"".join([*others[:place], node, *others[place:]]))
    return node


def paths(found: ranges.Placed, own: Manifest | _Shared) -> Iterator[tuple[bytes, Path]]:
    """The subroot and the path of every leaf of a partition in turn."""
    stacked, top = stacks(found, own.groups, own.leaf, own.arity)

    def climb(stack: Stack | None, tree: int, size: int, index: int) -> Path:
        path, across, level = [], size, 0
        while across > 1:
            first = index - index % own.arity
            others = [i for i in range(first, min(first + own.arity, across)) if i != index]
            path.append((index - first, [stack and stack.node(level, i) or own.shared[tree, level, i] for i in others]))
            index, across, level = first // own.arity, -(-across // own.arity), level + 1
        return path

    for s in stacked:
        above = climb(top, TOP, own.groups, s.tree)
        subroot = top and top.node(0, s.tree) or own.shared.get((TOP, 0, s.tree), own.root)
        first, data = s.levels[0]
        for index in range(first, first + len(data) // HEX):
            yield subroot, climb(s, s.tree, s.size, index) + above


@dataclass
class _Shared:
    """What the tasks get of a manifest."""

    edges: list[ranges.Edge]
    groups: int
    shared: dict[tuple[int, int, int], bytes]
    root: bytes
    group: str
    leaf: str
    arity: int


def proven(own: Manifest, keep: list[str], values: dict[str, tuple[str, Callable]]) -> DataFrame:
    """Of every leaf the columns ``keep`` and, for each of ``values`` (type, function), what it makes of a row, its subroot, path and root."""
    spark = own.leaves.rows.sparkSession
    sent = spark.sparkContext.broadcast(_Shared(own.leaves.edges, own.leaves.groups, own.shared, own.root, own.group, own.leaf, own.arity))

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "boolean": pa.bool_(), "array<array<string>>": pa.list_(pa.list_(pa.string())), "array<int>": pa.list_(pa.int32())}
        found = ranges.placed(batches, sent.value.edges, sent.value.group)
        if not found:
            return
        walk = paths(found, sent.value)
        for batch in ranges.pieces(found.table):
            rows = [(row, *next(walk), sent.value.root) for row in batch.to_pylist()]
            made = [pa.array([f(*r) for r in rows], kinds[kind]) for kind, f in values.values()]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *made], names=[*keep, *values])

    kept = own.leaves.rows.select(*keep).schema.fields
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"`{n}` {kind}" for n, (kind, _) in values.items()]])
    return own.leaves.rows.mapInArrow(run, shape)


def row_proofs(own: Manifest, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every leaf with its subroot, its places in the runs of siblings and the siblings of each level."""
    return proven(
        own,
        keep,
        {
            "subroot": ("string", lambda row, subroot, path, root: subroot.decode()),
            "places": ("array<int>", lambda row, subroot, path, root: [p for p, _ in path]),
            "siblings": ("array<array<string>>", lambda row, subroot, path, root: [[x.decode() for x in s] for _, s in path]),
        },
    )


#: The fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proof_digests(docs: DataFrame) -> DataFrame:
    """Of every document its leaf, subroot and root, the digest of its proof, and the root that its row, perhaps tampered with, leads to."""
    own = [F.col(c) for c in FIELDS]
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    tampered = [more if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", "lang", leaf_digest(own).alias("leaf"), F.when(odd, leaf_digest(tampered)).alias("now"))
    built = manifest(leaves, "lang", "doc_id", "leaf")
    if built is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    out = proven(
        built,
        ["doc_id", "leaf"],
        {
            "subroot": ("string", lambda row, subroot, path, root: subroot.decode()),
            "root": ("string", lambda row, subroot, path, root: root.decode()),
            "proof_sha256": ("string", lambda row, subroot, path, root: digest(b"".join([x for _, s in path for x in s])).decode()),
            "folded_root": ("string", lambda row, subroot, path, root: fold((row["now"] or row["leaf"]).encode(), path).decode()),
        },
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """The same rows in DuckDB: both kinds of tree level after level by recursion, the fold as a reduction of a list of steps."""

    def leaf(n_chars: str) -> str:
        text = "coalesce(octet_length(encode(({0})::VARCHAR)) || ':' || ({0})::VARCHAR, '-')"
        return "sha256(" + " || ".join(text.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"

    def above(name: str, key: str) -> str:
        return (
            f"SELECT {key}, i // 2, sha256(string_agg(h, '' ORDER BY i)), level + 1, (n + 1) // 2 FROM {name} "
            f"WHERE n > 1 GROUP BY {key}, i // 2, level, n"
        )

    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    return f"""
WITH RECURSIVE cells AS MATERIALIZED (
  SELECT doc_id, {leaf("n_chars")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32_sql(digits)} % 7 = 0 THEN {leaf("n_chars::HUGEINT + 1")} END AS now,
    dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS g
  FROM documents
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS r,
    count(*) OVER (PARTITION BY g) AS n FROM cells
), low AS (
  SELECT g, i, leaf AS h, 0 AS level, n FROM leaves UNION ALL {above("low", "g")}
), roots AS MATERIALIZED (
  SELECT g, h, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS z, g AS i, h, 0 AS level, n FROM roots UNION ALL {above("high", "z")}
), steps AS (
  SELECT r, 0 AS part, w.level, (leaves.i >> w.level) & 1 AS side, s.h
  FROM leaves JOIN low w ON w.g = leaves.g AND w.i = leaves.i >> w.level AND w.n > 1
  LEFT JOIN low s ON s.g = w.g AND s.level = w.level AND s.i = xor(w.i, 1)
  UNION ALL
  SELECT r, 1, w.level, (leaves.g >> w.level) & 1, s.h
  FROM leaves JOIN high w ON w.i = leaves.g >> w.level AND w.n > 1
  LEFT JOIN high s ON s.level = w.level AND s.i = xor(w.i, 1)
), proofs AS (
  SELECT r, string_agg(h, '' ORDER BY part, level) AS proof, list(CASE WHEN h IS NULL THEN '2' ELSE side || h END ORDER BY part, level) AS steps
  FROM steps GROUP BY r
), folded AS (
  SELECT doc_id, leaf, roots.h AS subroot, high.h AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(now, leaf), coalesce(steps, [])),
      lambda a, s: sha256(CASE s[1] WHEN '0' THEN a || s[2:] WHEN '1' THEN s[2:] || a ELSE a END)) AS folded_root
  FROM leaves JOIN roots USING (g) JOIN high ON high.n = 1 LEFT JOIN proofs USING (r)
)
SELECT *, folded_root = root AS verified FROM folded"""
