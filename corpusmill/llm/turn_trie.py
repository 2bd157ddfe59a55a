"""A prefix trie of conversations, as succinct level-order (LOUDS) tries of prefix shards.

Turns are labelled by a digest of role and text and numbered within their conversation over ranges (``ranges``), so a long
conversation lies in many tasks.  A prefix is known by the sum of its labels times powers of two odd multipliers modulo
2^64 (2 x 60 random bits a label), which ranges can hand on.  Paths are cut at every ``stretch`` turns, and equal stretches
are counted first: copies of a conversation cost one path.

Stretches are worked off from the deepest up.  Within one, a node is *heavy* if more than ``heavy`` turns of distinct paths
lie below it.  Below the heavy nodes, each subtree is light as a whole: it goes to one shard, where numpy builds the LOUDS
bitvector and the label arrays level by level and sums up counts by ``add.at`` in reverse level order.  The heavy nodes, at
most the turns times their depth over ``heavy``, form a trie of their own that is merged apart, with the sums of the shards
below them.  What a stretch adds up to at its start is attached to the end of the stretch above.

Defined results: rows without a conv_id take no part; a null turn comes first, and turns of one number are ordered by the
digest of role and text; null roles and texts are empty; repeated rows are turns of their own; conversations without turns
after rebuilding are members of the root; an empty table has no nodes; columns of other names take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import ranges
from corpusmill.llm.common import crc32_sql, cut

#: Odd multipliers of the two lanes of a prefix; -r and r - 1 have few factors of two.
LANES = {"a": 0x9E3779B97F4A7C1B, "b": 0xC2B2AE3D27D4EB53}
STRETCH = 4096
LEAST_HEAVY, MOST_HEAVY, SHARE = 256, 1 << 20, 65536
WORDS = r"[^\x20\x09-\x0D]+"
NODE = "p binary, q binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def labelled(turns: DataFrame) -> DataFrame:
    """conv_id, turn, the label (a, b) and the words of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    half = lambda at: F.conv(F.substring(sha, at, 15), 16, 10).cast("long")
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", sha.alias("sha"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("w"))
    sha = F.col("sha")
    return own.select("conv_id", "turn", half(1).alias("a"), half(16).alias("b"), "w")


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, the turn's place in its conversation from 0, and its label and words."""
    dealt = ranges.dealt(labelled(turns), "conv_id", ["turn", "a", "b"])
    edges = turns.sparkSession.sparkContext.broadcast(dealt.edges)

    def run(batches):
        import pyarrow as pa

        found = ranges.placed(batches, edges.value, "conv_id")
        if found:
            yield from ranges.pieces(found.table.drop_columns(["turn"]).append_column("idx", pa.array(found.place)))

    return dealt.rows.mapInArrow(run, "conv_id long, a long, b long, w long, idx long")


def rebuilt_turns(turns: DataFrame, period: int = 20, heads: int = 4) -> DataFrame:
    """The turns of conversations rebuilt from the first h turns of conversation c - c % period and their own after the first h.

    h is the CRC-32 of the id's digits modulo ``heads``.  (conv_id, piece, idx) orders a conversation; a first row of piece -1
    stands for the conversation itself.
    """
    placed = placed_turns(turns)
    taken = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % heads
    convs = placed.where("idx = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % period).alias("base"), taken("conv_id").alias("h"))
    first = placed.where((F.col("idx") < heads - 1) & (F.col("conv_id") % period == 0)).withColumnRenamed("conv_id", "base")
    shared = convs.where("h > 0").join(first, "base").where("idx < h").select("conv_id", F.lit(0).alias("piece"), "idx", "a", "b", "w")
    own = placed.where(F.col("idx") >= taken("conv_id")).select("conv_id", F.lit(1).alias("piece"), "idx", "a", "b", "w")
    zero = F.lit(0).cast("long")
    itself = convs.select("conv_id", F.lit(-1).alias("piece"), zero.alias("idx"), zero.alias("a"), zero.alias("b"), zero.alias("w"))
    return itself.unionByName(shared).unionByName(own)


def ids_of(lanes) -> object:
    """Two arrays of words as an Arrow array of 16-byte ids."""
    import numpy as np
    import pyarrow as pa

    data = np.ascontiguousarray(np.stack(lanes, axis=1))
    offsets = np.arange(len(data) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def lanes_of(ids) -> tuple:
    """The words of 16-byte ids."""
    import numpy as np

    data = np.frombuffer(b"".join(ids.to_pylist()), np.uint64).reshape(-1, 2)
    return data[:, 0], data[:, 1]


def paths(rebuilt: ranges.Dealt, stretch: int) -> DataFrame:
    """Stretches of the conversations: conv_id, seg, at (depth of the first turn), ids before and after, labels and words."""
    edges = rebuilt.rows.sparkSession.sparkContext.broadcast(rebuilt.edges)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        found = ranges.placed(batches, edges.value, "conv_id", LANES)
        if not found:
            return
        turn = found.place > 0
        depth = found.place[turn]
        if not len(depth):
            return
        inner = (depth - 1) % stretch
        new = inner == 0
        new[0] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(depth)) - 1
        whole = (inner[first] == 0) & ((inner[last] == stretch - 1) | (depth[last] == found.total[turn][last] - 1))
        labels = {c: ranges.words_of(found.table, c)[turn] for c in (*LANES, "w")}
        before, after = [], []
        for (c, r), lane in zip(LANES.items(), found.lanes):
            power = np.fromiter((pow(r, int(d), ranges.WRAP) for d in depth[first]), np.uint64, len(first))
            before.append(lane[turn][first] - labels[c][first] * power)
            after.append(lane[turn][last])
        offsets = pa.array(np.append(first, len(depth)).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(labels[c].view(np.int64))) for c in (*LANES, "w")]
        conv = found.table.column("conv_id").to_numpy()[turn][first]
        columns = [pa.array(conv), pa.array((depth[first] - 1) // stretch), pa.array(depth[first]), pa.array(whole), ids_of(before), ids_of(after), *arrays]
        table = pa.Table.from_arrays(columns, names=["conv_id", "seg", "at", "whole", "p0", "p1", "a", "b", "w"])
        yield from ranges.pieces(table, 1000)

    shape = "conv_id long, seg long, at long, whole boolean, p0 binary, p1 binary, a array<long>, b array<long>, w array<long>"
    found = rebuilt.rows.mapInArrow(run, shape)
    # a stretch cut by the end of a range is put together again; there are at most two a range
    parts = F.sort_array(F.collect_list(F.struct("at", "p0", "p1", "a", "b", "w")))
    joined = found.where("not whole").groupBy("conv_id", "seg").agg(parts.alias("s"))
    flat = [F.flatten(F.col(f"s.{c}")).alias(c) for c in ("a", "b", "w")]
    names = ["conv_id", "seg", "at", "p0", "p1", "a", "b", "w"]
    mended = joined.select("conv_id", "seg", F.col("s")[0]["at"].alias("at"), F.col("s")[0]["p0"].alias("p0"), F.element_at("s", -1)["p1"].alias("p1"), *flat)
    return found.where("whole").select(*names).unionByName(mended.select(*names))


def flat_paths(batch) -> tuple:
    """Of the paths of a batch: starts, and for every turn its path, depth, id, label and words."""
    import numpy as np

    columns = {c: batch.column(c) for c in ("at", "p0", "a", "b", "w")}
    sizes = columns["a"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    path = np.repeat(np.arange(len(sizes)), sizes)
    at = columns["at"].to_numpy(zero_copy_only=False)
    depth = at[path] + np.arange(starts[-1]) - starts[path]
    labels = [columns[c].flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in LANES]
    ids = []
    low = int(depth.min(initial=1 << 62)) if len(depth) else 0
    for r, label, start in zip(LANES.values(), labels, lanes_of(columns["p0"])):
        powers = np.full(int(depth.max(initial=low)) - low + 1, r, np.uint64)
        powers[0] = pow(r, low, ranges.WRAP)
        total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(label * np.multiply.accumulate(powers)[depth - low])])
        ids.append(total[1:] - total[starts[path]] + start[path])
    return starts, path, depth, ids, labels, columns["w"].flatten().to_numpy(zero_copy_only=False)


@dataclass
class Heavy:
    """The heavy nodes of a stretch, ordered by the first word of their ids."""

    a: object
    b: object
    conv_id: object

    def find(self, ids):
        """The place of each id among the heavy nodes, -1 for light ones."""
        import numpy as np

        if not len(self.a):
            return np.full(len(ids[0]), -1)
        at = np.minimum(np.searchsorted(self.a, ids[0]), len(self.a) - 1)
        return np.where((self.a[at] == ids[0]) & (self.b[at] == ids[1]), at, -1)


def weighed(level: DataFrame, heavy: int) -> DataFrame:
    """The nodes of a stretch below which more than ``heavy`` turns of distinct paths lie, with their counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            starts, path, depth, ids, _, words = flat_paths(batch)
            if not len(path):
                continue
            size = np.diff(starts)
            before = lanes_of(batch.column("p0"))
            inside = np.arange(len(path)) > starts[path]
            above = [np.where(inside, np.roll(i, 1), p[path]) for i, p in zip(ids, before)]
            own = {c: batch.column(c).to_numpy(zero_copy_only=False)[path] for c in ("conv_id", "parent_conv", "n")}
            yield pa.RecordBatch.from_arrays(
                [
                    ids_of(ids), ids_of(above), pa.array(own["conv_id"]), pa.array(own["parent_conv"]), pa.array(depth), pa.array(words),
                    pa.array(own["n"]), pa.array(size[path] - (np.arange(len(path)) - starts[path])),
                ],
                names=["p", "q", "conv_id", "parent_conv", "depth", "w", "n", "below"],
            )

    rows = level.mapInArrow(run, "p binary, q binary, conv_id long, parent_conv long, depth long, w long, n long, below long")
    same = [F.min(c).alias(c) for c in ("q", "conv_id", "parent_conv", "depth", "w")]
    return rows.groupBy("p").agg(*same, F.sum("n").alias("n"), F.sum("below").alias("below")).where(F.col("below") > heavy)


class Louds:
    """A forest in level order: a bitvector of ones for children, closed by a zero for each node, after that of a root of roots."""

    def __init__(self, degrees):
        import numpy as np

        ends = np.cumsum(np.asarray(degrees) + 1)
        bits = np.ones(int(ends[-1]) if len(ends) else 0, np.uint8)
        bits[ends - 1] = 0
        self.size = len(degrees)
        self.length = len(bits)
        self.bits = np.packbits(bits)

    def _bits(self):
        import numpy as np

        return np.unpackbits(self.bits, count=self.length)

    def degrees(self):
        """How many children the root of roots and every node have."""
        import numpy as np

        ends = np.flatnonzero(self._bits() == 0)
        return np.diff(ends, prepend=-1) - 1

    def parents(self):
        """Of every node but the root of roots, in level order, how many nodes were closed before it."""
        import numpy as np

        bits = self._bits()
        return np.cumsum(bits == 0)[bits == 1]


def rolled_up(louds: Louds, levels: list[int], sums: list, least=None) -> None:
    """Adds ``sums`` and takes ``least`` of the nodes into their parents, from the last level to the first; node 0 is the root of roots."""
    import numpy as np

    parent = np.concatenate([[0], louds.parents()])
    for a, b in zip(levels[-2::-1], levels[:0:-1]):
        for s in sums:
            np.add.at(s, parent[a:b], s[a:b])
        if least is not None:
            np.minimum.at(least, parent[a:b], least[a:b])


def shard_trie(table) -> object:
    """The nodes of a shard's forest of paths (NODE), trees being told apart by the id before them."""
    import numpy as np
    import pyarrow as pa

    batch = table.combine_chunks().to_batches()[0]
    starts, _, _, ids, labels, words = flat_paths(batch)
    size = np.diff(starts)
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    before = lanes_of(batch.column("p0"))
    # level by level: paths that go on are sorted by node and label; a change of either is a new node
    node = np.unique(np.stack(before, axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    going, inner, made = np.arange(len(size)), 0, 1
    levels, degrees, turn_of, end = [1], [], [], np.zeros(len(size), np.int64)
    while True:
        going = going[size[going] > inner]
        if not len(going):
            break
        turn = starts[going] + inner
        order = np.lexsort((labels[1][turn], labels[0][turn], node[going]))
        going, turn = going[order], turn[order]
        key = (node[going], labels[0][turn], labels[1][turn])
        new = np.ones(len(going), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        fresh = np.flatnonzero(new)
        if inner:
            degrees.append(np.bincount(node[going][fresh] - levels[-2], minlength=levels[-1] - levels[-2]))
        else:
            degrees.append(np.array([len(fresh)]))
        node = node.copy()
        node[going] = made + np.cumsum(new) - 1
        end[going] = node[going]
        turn_of.append(turn[fresh])
        made += len(fresh)
        levels.append(made)
        inner += 1
    degrees.append(np.zeros(levels[-1] - levels[-2], np.int64))
    louds = Louds(np.concatenate(degrees))
    turn_of = np.concatenate(turn_of)
    n, kids, leaves, saved = (np.zeros(made, np.int64) for _ in range(4))
    least = np.full(made, np.iinfo(np.int64).max)
    np.add.at(n, end, column("n"))
    np.minimum.at(least, end, column("conv_id"))
    for total, name in ((kids, "kids"), (leaves, "leaves"), (saved, "saved")):
        np.add.at(total, end, column(name))
    kids += louds.degrees()
    leaves[1:] += kids[1:] == 0
    rolled_up(louds, levels, [n], least)
    own_words = words[turn_of]
    saved[1:] += (n[1:] - 1) * own_words
    rolled_up(louds, levels, [leaves, saved])
    path_of = np.searchsorted(starts, turn_of, "right") - 1
    parent = np.concatenate([[0], louds.parents()])[1:]
    top = parent == 0
    parent_conv = np.where(top, column("parent_conv")[path_of], least[parent])
    above = [np.where(top, p[path_of], i[turn_of - 1]) for p, i in zip(before, ids)]
    depth = column("at")[path_of] + turn_of - starts[path_of]
    numbers = [least[1:], depth, parent_conv, n[1:], kids[1:], leaves[1:], saved[1:]]
    names = ["p", "q", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "top"]
    return pa.Table.from_arrays([ids_of([i[turn_of] for i in ids]), ids_of(above), *map(pa.array, numbers), pa.array(top)], names=names)


def below_heavy(level: DataFrame, heavy: Heavy) -> DataFrame:
    """The paths from their first light node on, with the id of that node (top)."""
    sent = level.sparkSession.sparkContext.broadcast(heavy)
    names = ["top", "at", "p0", "conv_id", "parent_conv", "n", "kids", "leaves", "saved", "a", "b", "w"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            starts, path, depth, ids, _, _ = flat_paths(batch)
            if not len(path):
                continue
            place = sent.value.find(ids)
            skipped = np.bincount(path[place >= 0], minlength=batch.num_rows)
            light = np.flatnonzero(skipped < np.diff(starts))
            if not len(light):
                continue
            first = starts[light] + skipped[light]
            above = first - 1
            deep = skipped[light] > 0
            before = [np.where(deep, i[above], p[light]) for i, p in zip(ids, lanes_of(batch.column("p0")))]
            known = batch.column("parent_conv").to_numpy(zero_copy_only=False)[light]
            if len(sent.value.a):
                known = np.where(deep, sent.value.conv_id[place[above]], known)
            keep = np.arange(len(path)) - starts[path] >= skipped[path]
            offsets = pa.array(np.concatenate([[0], np.cumsum((np.diff(starts) - skipped)[light])]).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, batch.column(c).flatten().filter(pa.array(keep))) for c in (*LANES, "w")]
            own = [batch.column(c).take(pa.array(light)) for c in ("conv_id", "n", "kids", "leaves", "saved")]
            columns = [ids_of([i[first] for i in ids]), pa.array(depth[first]), ids_of(before), own[0], pa.array(known), *own[1:], *arrays]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    numbers = ", ".join(f"{c} long" for c in names[3:9])
    return level.mapInArrow(run, f"top binary, at long, p0 binary, {numbers}, a array<long>, b array<long>, w array<long>")


def merged_heavy(found: list, sums: dict) -> tuple[list[tuple], dict]:
    """The rows of a stretch's heavy nodes (NODE) with the sums of what hangs below them, and the sums by the ids above the stretch."""
    import numpy as np

    rank, order, levels = {}, [], [1]
    for depth in sorted({r.depth for r in found}):
        for r in sorted((r for r in found if r.depth == depth), key=lambda r: (rank.get(bytes(r.q), 0), bytes(r.p))):
            order.append(r)
            rank[bytes(r.p)] = len(order)
        levels.append(len(order) + 1)
    parent = np.array([rank.get(bytes(r.q), 0) for r in order], np.int64)
    louds = Louds(np.bincount(parent, minlength=len(order) + 1))
    hung = np.array([(0, 0, 0), *[sums.get(bytes(r.p), (0, 0, 0)) for r in order]], np.int64)
    kids, leaves, saved = louds.degrees() + hung[:, 0], hung[:, 1].copy(), hung[:, 2].copy()
    leaves[1:] += kids[1:] == 0
    saved[1:] += [(r.n - 1) * r.w for r in order]
    rolled_up(louds, levels, [leaves, saved])
    out, above = [], {}
    for i, r in enumerate(order, 1):
        up = int(parent[i - 1])
        out.append((r.p, r.q, r.conv_id, r.depth, order[up - 1].conv_id if up else r.parent_conv, r.n, int(kids[i]), int(leaves[i]), int(saved[i])))
        if not up:
            was = above.get(bytes(r.q), (0, 0, 0))
            above[bytes(r.q)] = (was[0] + 1, was[1] + int(leaves[i]), was[2] + int(saved[i]))
    return out, above


def member_ends(rebuilt: ranges.Dealt) -> DataFrame:
    """(p, conv_id): the id of the whole of every conversation."""
    edges = rebuilt.rows.sparkSession.sparkContext.broadcast(rebuilt.edges)

    def run(batches):
        import pyarrow as pa

        found = ranges.placed(batches, edges.value, "conv_id", LANES)
        if found:
            last = found.place == found.total - 1
            table = pa.Table.from_arrays([ids_of([x[last] for x in found.lanes]), found.table.column("conv_id").filter(pa.array(last))], names=["p", "conv_id"])
            yield from ranges.pieces(table)

    return rebuilt.rows.mapInArrow(run, "p binary, conv_id long")


def ends_digests(ends: DataFrame, piece: int = 50_000) -> DataFrame:
    """(p, sha): the SHA-256 of the ascending decimal conv_ids of each p, comma-joined.

    Ranges join their ids to texts of ``piece`` ids; those of a p that lies in several ranges are hashed one after another,
    as the definition of one digest demands, but as a stream of a few long texts.
    """
    dealt = ranges.dealt(ends, "p", ["conv_id"])
    edges = ends.sparkSession.sparkContext.broadcast(dealt.edges)

    def run(batches):
        import hashlib

        import pyarrow as pa

        found = ranges.placed(batches, edges.value, "p")
        if not found:
            return
        ids, p = found.table.column("conv_id").to_pylist(), found.table.column("p")
        out = {"p": [], "at": [], "sha": [], "ids": []}
        for a, b in zip(found.starts[:-1].tolist(), found.starts[1:].tolist()):
            whole = b - a == found.total[a]
            for at in range(a, b, b - a if whole else piece):
                text = ",".join(map(str, ids[at : b if whole else min(b, at + piece)]))
                for name, value in zip(out, (p[a].as_py(), int(found.place[at]), hashlib.sha256(text.encode()).hexdigest() if whole else None, None if whole else text)):
                    out[name].append(value)
        table = pa.table({"p": pa.array(out["p"], pa.binary()), "at": pa.array(out["at"], pa.int64()), "sha": pa.array(out["sha"], pa.string()), "ids": pa.array(out["ids"], pa.string())})
        yield from ranges.pieces(table, 1000)

    def streamed(batches):
        import hashlib

        import pyarrow as pa

        open_p, state = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([open_p], pa.binary()), pa.array([state.hexdigest()])], names=["p", "sha"])

        for batch in batches:
            for p, ids in zip(batch.column(0), batch.column(1)):
                p = p.as_py()
                if p != open_p:
                    if state:
                        yield done()
                    open_p, state = p, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
        if state:
            yield done()

    told = cut(dealt.rows.mapInArrow(run, "p binary, at long, sha string, ids string"))
    rest = told.where("sha is null").repartition("p").sortWithinPartitions("p", "at").select("p", "ids").mapInArrow(streamed, "p binary, sha string")
    return told.where("sha is not null").select("p", "sha").unionByName(rest)


def trie_nodes(rebuilt: DataFrame, stretch: int = STRETCH, heavy: int | None = None) -> DataFrame:
    """The nodes of the trie of ``rebuilt`` (conv_id, piece, idx, a, b, w), as conv_id, depth, parent_conv_id, counts and ends_sha256."""
    spark = rebuilt.sparkSession
    dealt = ranges.dealt(rebuilt, "conv_id", ["piece", "idx"], LANES)
    convs, least = dealt.rows.where("piece = -1").agg(F.count("*"), F.min("conv_id")).first()
    nodes = [spark.createDataFrame([], NODE)]
    if convs:
        same = [F.first(c).alias(c) for c in ("at", "p0", "a", "b", "w")]
        once = cut(paths(dealt, stretch).groupBy("seg", "p1").agg(*same, F.min("conv_id").alias("conv_id"), F.count("*").alias("n")))
        last, turns = once.agg(F.max("seg"), F.sum(F.size("a"))).first()
        turns = turns or 0
        heavy = heavy or min(MOST_HEAVY, max(LEAST_HEAVY, turns // SHARE))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // MOST_HEAVY)
        hung = spark.createDataFrame([], "p binary, kids long, leaves long, saved long")
        for seg in range(-1 if last is None else last, -1, -1):
            made, hung = _stretch_nodes(once, seg, hung, stretch, heavy, parts, least)
            nodes += made
        kids, leaves, saved = (hung.select("kids", "leaves", "saved").first() or (0, 0, 0)) if last is not None else (0, 0, 0)
        top = (bytes(16), None, least, 0, None, convs, kids, leaves or 1, saved)
        nodes.append(spark.createDataFrame([top], NODE))
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    ended = every.join(ends_digests(member_ends(dealt)), "p", "left") if convs else every.withColumn("sha", F.lit(None).cast("string"))
    return ended.withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256))).drop("p", "q", "sha")


def _stretch_nodes(once: DataFrame, seg: int, hung: DataFrame, stretch: int, heavy: int, parts: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of a stretch, and (p, kids, leaves, saved) of what it adds to the nodes that it starts from."""
    spark = once.sparkSession
    own = once.where(F.col("seg") == seg)
    if seg:
        ended = once.where((F.col("seg") == seg - 1) & (F.size("a") == stretch)).select(F.col("p1").alias("p0"), F.col("conv_id").alias("parent_conv"))
        own = own.join(ended, "p0")
    else:
        own = own.withColumn("parent_conv", F.lit(least).cast("long"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kids", "leaves", "saved")}
    level = own.join(hung.withColumnRenamed("p", "p1"), "p1", "left").select("at", "p0", "conv_id", "parent_conv", "n", *zero.values(), "a", "b", "w")
    found = weighed(level, heavy).collect()
    known = sorted((*_lanes(r.p), r.conv_id) for r in found)

    import numpy as np

    columns = [np.array(c, t) for c, t in zip(zip(*known), (np.uint64, np.uint64, np.int64))] if known else [np.zeros(0, np.int64)] * 3

    def shard(batches):
        table = ranges.gathered(batches)
        if table is not None:
            yield from ranges.pieces(shard_trie(table))

    dealt_out = below_heavy(level, Heavy(*columns)).repartition(parts, "top").mapInArrow(shard, f"{NODE}, top boolean")
    light = cut(dealt_out)
    sums = light.where("top").groupBy("q").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("q", "p")
    if not found:
        return [light.drop("top")], cut(sums)
    ids = F.broadcast(spark.createDataFrame([(r.p,) for r in found], "p binary"))
    below = {bytes(r.p): (r.kids, r.leaves, r.saved) for r in sums.unionByName(hung).join(ids, "p", "left_semi").groupBy("p").agg(*[F.sum(c).alias(c) for c in zero]).collect()}
    rows, above = merged_heavy(found, below)
    started = spark.createDataFrame([(k, *v) for k, v in above.items()], "p binary, kids long, leaves long, saved long")
    rest = sums.join(ids, "p", "left_anti").unionByName(started).groupBy("p").agg(*[F.sum(c).alias(c) for c in zero])
    return [light.drop("top"), spark.createDataFrame(rows, NODE)], cut(rest)


def _lanes(p) -> tuple[int, int]:
    return int.from_bytes(p[:8], "little"), int.from_bytes(p[8:], "little")


def prefix_trie(turns: DataFrame, stretch: int = STRETCH, heavy: int | None = None) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    return trie_nodes(rebuilt_turns(turns), stretch, heavy)


def oracle(period: int = 20, heads: int = 4) -> str:
    """The same nodes in DuckDB: prefixes by the digest of their turns' digests, subtree sums over the paths of smallest members."""
    digits = "list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    return f"""
WITH labelled AS (
  SELECT conv_id, turn, coalesce(text, '') AS t, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha
  FROM conversations WHERE conv_id IS NOT NULL
), own AS MATERIALIZED (
  SELECT conv_id, sha, len(regexp_extract_all(t, '{WORDS}')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) - 1 AS idx
  FROM labelled
), convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % {period} AS base, {crc32_sql(digits)} % {heads} AS h FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT c.conv_id, 0 AS piece, o.idx, o.sha, o.w FROM convs c JOIN own o ON o.conv_id = c.base AND o.idx < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.idx, o.sha, o.w FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.idx >= c.h
), paths AS MATERIALIZED (
  SELECT conv_id, w, row_number() OVER x AS d, sha256(string_agg(sha, '') OVER x) AS k FROM turns WINDOW x AS (PARTITION BY conv_id ORDER BY piece, idx)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), linked AS (
  SELECT *, lag(k) OVER x AS up, lead(k) OVER x AS down FROM paths WINDOW x AS (PARTITION BY conv_id ORDER BY d)
), nodes AS MATERIALIZED (
  SELECT k, d, min(conv_id) AS conv_id, min(up) AS up, count(*) AS n, min(w) AS w, count(DISTINCT down) AS kids,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE down IS NULL), '')) AS ends_sha256
  FROM linked GROUP BY k, d
), sums AS (
  SELECT p.k, count(*) FILTER (WHERE x.kids = 0) AS n_leaves, sum((x.n - 1) * x.w) AS saved_tokens
  FROM nodes x JOIN paths p ON p.conv_id = x.conv_id AND p.d <= x.d GROUP BY p.k
)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n AS n_convs, x.kids AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN sums s USING (k) LEFT JOIN nodes u ON u.k = x.up"""
