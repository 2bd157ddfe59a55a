"""SimHash near-duplicates found with vantage-point trees.

Fingerprint: A-Z lower-cased, words split at ASCII white space, 3-word shingles with repeats
(fewer words: all of them as one; none: fingerprint zero), XXH64 (seed 42) of each; a bit is
set if it is set in over half of the hashes.

Distinct fingerprints at ``radius`` (2) or fewer differing bits are linked.  A tree of vantage
points, grown on a bounded sample, deals the distinct fingerprints into shards: at each node
those within the node's distance of its vantage point go one way, the others the other way
(home).  Two fingerprints within ``radius`` differ by at most ``radius`` in their distance to
any vantage point, so only fingerprints whose distance lies that near a node's boundary visit
the other side too.  Every shard (its homes and its visitors) is searched exactly by a tree of
its own with the same bounds, down to leaves compared in full, and gives a spanning forest of
the links it finds, never all pairs.  The forests are joined by alternating large-star and
small-star steps on distributed edges; the sample is all that the driver sees.

The sample only shapes the shards; every fingerprint is dealt and every link is found.

Defined results: null text counts as no words; rows with a null doc_id get a fingerprint, link
like others and never name a component unless no member has an id; repeated rows each stand in
the answer, and one of them in the deduplicated documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, lean

SEED = 42
SAMPLE, MOST_SAMPLED = 8192, 1 << 18
LEAF = 512


def simhash(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint's 64 bits as a long."""
    source = docs.select(*keep, F.col(text).alias("__text"))

    @lean
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.fromiter((simhash(t.as_py()) for t in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    from pyspark.sql import types as T

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def grow_tree(points, leaf: int, depth: int = 20, seed: int = 7):
    """A vantage-point tree: nested (vantage point, boundary, inner, outer), None at leaves."""
    import numpy as np

    chooser = np.random.default_rng(seed)

    def grow(own, left):
        if len(own) <= leaf or not left:
            return None
        best = None
        for c in chooser.choice(own, min(6, len(own)), replace=False):
            d = np.bitwise_count(own ^ c)
            for boundary in np.unique(np.quantile(d, (0.4, 0.5, 0.6), method="lower")):
                inner = int((d <= boundary).sum())
                if 0 < inner < len(own):
                    near = int(((d >= int(boundary) - 1) & (d <= int(boundary) + 2)).sum())
                    cost = near + 2 * abs(inner - len(own) / 2)
                    if best is None or cost < best[0]:
                        best = (cost, c, int(boundary), d <= boundary)
        if best is None:
            return None
        _, c, boundary, inside = best
        return (int(c), boundary, grow(own[inside], left - 1), grow(own[~inside], left - 1))

    return grow(points, depth)


def numbered(tree) -> tuple[list, int]:
    """The tree as a flat list of (vantage point, boundary, inner, outer): children below zero are shards -1-k."""
    flat: list = []
    shards = 0

    def put(node):
        nonlocal shards
        if node is None:
            shards += 1
            return -shards
        at = len(flat)
        flat.append(None)
        flat[at] = (node[0], node[1], put(node[2]), put(node[3]))
        return at

    put(tree)
    return flat, shards


def deal(fps, flat: list, radius: int):
    """(index, shard, home) of every fingerprint in its home shard and in those it visits."""
    import numpy as np

    out = []
    todo = [(0 if flat else -1, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        at, own, home = todo.pop()
        if not len(own):
            continue
        if at < 0:
            out.append((own, np.full(len(own), -1 - at, np.int32), home))
            continue
        c, boundary, inner, outer = flat[at]
        d = np.bitwise_count(fps[own] ^ np.uint64(c)).astype(np.int16)
        inside = d <= boundary
        # a link across the boundary is found on the outer side, which the inner one visits
        to_in = inside | (~home & (d - radius <= boundary))
        to_out = ~inside | (d + radius > boundary)
        todo.append((inner, own[to_in], home[to_in]))
        todo.append((outer, own[to_out], home[to_out] & ~inside[to_out]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def forest(fps, home, radius: int, leaf: int = LEAF):
    """Edges (child, root) joining the fingerprints of a shard that are linked, at least one of each link at home.

    The shard's own vantage-point tree ends in leaves; a leaf compares its homes with all it holds.
    """
    import numpy as np

    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    flat, _ = numbered(grow_tree(fps[home], leaf))
    todo = [(0 if flat else -1, np.arange(len(fps)), home)]
    while todo:
        at, own, at_home = todo.pop()
        homes = own[at_home]
        if not len(homes):
            continue
        if at >= 0:
            c, boundary, inner, outer = flat[at]
            d = np.bitwise_count(fps[own] ^ np.uint64(c)).astype(np.int16)
            inside = d <= boundary
            to_in = inside | (~at_home & (d - radius <= boundary))
            to_out = ~inside | (d + radius > boundary)
            todo.append((inner, own[to_in], at_home[to_in]))
            todo.append((outer, own[to_out], at_home[to_out] & ~inside[to_out]))
            continue
        step = max(1, 4_000_000 // len(own))
        for k in range(0, len(homes), step):
            rows, columns = np.nonzero(np.bitwise_count(fps[homes[k : k + step], None] ^ fps[None, own]) <= radius)
            for i, j in zip(homes[k + rows].tolist(), own[columns].tolist()):
                if i != j and (a := find(i)) != (b := find(j)):
                    root[max(a, b)] = min(a, b)
    roots = np.array([find(i) for i in range(len(fps))], np.int64)
    moved = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[moved], fps[roots[moved]]


def link_forest(distinct: DataFrame, radius: int = 2, sample: int = SAMPLE, shard_rows: int = 16384) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join exactly those linked directly or by others."""
    import numpy as np

    shards = -(-distinct.count() // shard_rows)
    picked = distinct.orderBy(F.xxhash64("fp")).limit(min(MOST_SAMPLED, max(sample, 16 * shards)))
    points = np.array([r[0] for r in picked.collect()], np.int64).view(np.uint64)
    flat, count = numbered(grow_tree(points, max(8, len(points) // shards), depth=24) if shards > 1 and len(points) > 16 else None)
    spark = distinct.sparkSession
    sent = spark.sparkContext.broadcast(flat)

    def deal_out(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows, shard, home = deal(fps, sent.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fps[rows].view(np.int64)), pa.array(shard), pa.array(home)], names=["fp", "shard", "home"])

    def search(table):
        import numpy as np
        import pyarrow as pa

        fps = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(fps)
        a, b = forest(fps[order], table.column("home").to_numpy()[order], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal_out, "fp long, shard int, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


#: Edges of a component search that one task holds; beyond, the steps are distributed.
EDGES_AT_ONCE = 1_000_000


def components(edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), the root being the component's least node.

    Each partition first replaces its edges by a spanning forest.  While more than ``at_once`` edges are left, alternating
    large-star and small-star steps follow, aggregates and joins cut off in the shared folder; the rest is one task's.
    """
    edges = cut(edges.mapInArrow(spanning, "a long, b long").distinct())
    if edges.count() <= at_once:
        return cut(edges.coalesce(1).mapInArrow(spanning, "a long, b long")).select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def spanning(batches):
    """Edges (node, least node of its component) of the nodes of all the batches' edges (a, b), taken in portions."""
    import numpy as np
    import pyarrow as pa

    nodes, roots = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged(parts):
        a, b = (np.concatenate(x) for x in zip((nodes, roots), *parts))
        ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = where[: len(a)], where[len(a) :]
        root = np.arange(len(ids))
        while True:  # the least root of either side, then shortcuts, until nothing moves
            low = np.minimum(root[a], root[b])
            before = root.copy()
            for side in (root[a], root[b], a, b):
                np.minimum.at(root, side, low)
            while not np.array_equal(short := root[root], root):
                root = short
            if np.array_equal(before, root):
                return ids, ids[root]

    parts, held = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            held += batch.num_rows
            if held > 500_000:
                nodes, roots = merged(parts)
                parts, held = [], 0
    if parts:
        nodes, roots = merged(parts)
    moved = nodes != roots
    for at in range(0, len(nodes), 100_000):
        keep = moved[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 100_000][keep]), pa.array(roots[at : at + 100_000][keep])], names=["a", "b"])


def near_prints(docs: DataFrame, radius: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """The kept columns and fp of every row, and (fp, root) of the fingerprints that are linked to others."""
    prints = cut(with_fingerprints(docs, keep=keep))
    roots = components(link_forest(cut(prints.select("fp").distinct()), radius))
    return prints, roots.withColumnRenamed("node", "fp")


#: A fingerprint of more rows than this, and than a thousandth of all, gets its name by a broadcast of a thousand names at most.
CROWD = 10_000


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Components are named over distinct fingerprints, so that no task gathers the rows of one component; nor are the rows of one
    crowded fingerprint, such as that of all empty texts, brought together to be named.
    """
    prints, roots = near_prints(docs.select("doc_id", "text"), radius)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = cut(least)
    names = least.groupBy("root").agg(F.min("least").alias("component_id"))
    # a component is named after its root, which may be any of many fingerprints
    named = cut(least.select("fp", "root", "n").join(names, "root").select("fp", "component_id", "n"))
    crowd = max(CROWD, (named.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot = F.broadcast(named.where(F.col("n") > crowd).drop("n"))
    rest = prints.join(hot, "fp", "left_anti").join(named.where(F.col("n") <= crowd).drop("n"), "fp")
    both = prints.join(hot, "fp").unionByName(rest)
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def hashable(docs: DataFrame) -> DataFrame:
    """``docs`` as ``row``, with text, whether doc_id is null, doc_id (0 for null) and hashes of the text and of the row."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        "text",
        F.col("doc_id").isNull().alias("__none"),
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("__id"),
        F.xxhash64("text").alias("__h"),
        F.xxhash64(*plain).alias("__r"),
    )


def one_of_each(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (see hashable) that are the least of a root of ``firsts`` (root, s: none, id, h, r), each once."""
    names = ["__none", "__id", "__h", "__r"]
    staying = firsts.groupBy("root").agg(F.min("s").alias("s")).select(*[F.col(f"s.{n[2:]}").alias(n) for n in names])
    # the same keys in both, so that the texts are dealt once
    return keyed.select("row", *names).join(staying, names, "left_semi").dropDuplicates(names).select("row.*")


def deduplicated(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of each component: the one with the least doc_id (then the least text hash, then the least row hash)."""
    keyed = hashable(docs)
    prints, roots = near_prints(keyed, radius, keep=("__none", "__id", "__h", "__r"))
    one = F.struct(F.col("__none").alias("none"), F.col("__id").alias("id"), F.col("__h").alias("h"), F.col("__r").alias("r"))
    firsts = prints.groupBy("fp").agg(F.min(one).alias("s")).join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "s")
    return one_of_each(keyed, firsts)
