"""Near copies by exact shingle similarity, for the pipeline.

A text's set: A-Z lower-cased, words split at ASCII white space, the distinct 64-bit hashes of its
5-word shingles (fewer words: all of them as one; none: the empty set).  Two sets are linked at a
Jaccard similarity of 0.8 or more, and of each component of linked rows one row stays.

Equal sets meet in one representative first.  Under one order of all shingles, two linked sets of
n and m shingles share one of the first n - ceil(0.8 n) + 1 (m alike); so only these are sorted
together.  They travel as packed arrays, one for each batch and bucket.  Of the sets that meet at
a shingle, those that fit in size and in a parity bitmap (two bitmaps differ in no more bits than
their sets in shingles) are compared in full.  First every set meets the one that stands for its size
class at most of its shared shingles, then those that stand for it at the others, and at last all
others there; from the second step on only sets still in different components meet.  Where many do,
blocks of them meet in tasks that compare bitmaps and hand on only the pairs left, each pair at the first
such shingle that both have.  So large groups of copies make few pairs, and every link is found or already implied.

Before all that, sets are put together by SimHash, as operator 6 does it: fingerprints within two bits of one
another form components, each set of one is compared in full with the one that stands for it, and only sets that
are linked stay together.  Most near copies are joined by then; what SimHash cannot see, the shingles find.

The order puts frequent shingles last: shingles are counted by buckets before, and each place of a table
of fixed size holds the level of the most frequent one that falls on it.  So texts that share no more
than a common passage do not meet.  The order shapes the work, not the result; so do hash
collisions of packed shingles, which only make more pairs to compare.

Defined results: null and empty texts have the empty set, and one of all such rows stays; rows
with a null doc_id stay only if their group has no other; of repeated rows one stays; of rows equal
in doc_id and text but not elsewhere the one with the least row hash stays, whatever task is run
again; extra columns of any name are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, lean, portions, reread
from corpusmill.llm.simhash_dedup import components, hashable, link_forest, one_of_each, simhash

WIDTH = 5
#: Sets at a shingle that are paired outright, and of a block beyond; crowded shingles of a set that its rows know.
FEW, CROWD, KNOWN = 16, 4096, 256
#: Texts that begin with a shingle, from which on it counts as frequent; places that hold such levels, 16 MB in all, and of one row.
LEVELS, PLACES, BLOCK = (32, 256, 2048, 16384), 1 << 24, 1 << 13
LEAST_BITS = 256
#: Packed shingles of a bucket, on the mean, and at most at once in a task; partitions at most.
BUCKET, AT_ONCE, MOST_PARTITIONS = 250_000, 1_000_000, 20_000
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shingle_set(text: str | None):
    """The sorted distinct hashes of the text's shingles."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8").lower().split() if text else []
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    count = len(words) - WIDTH + 1
    mixed = np.zeros(count, np.uint64)
    for i, factor in enumerate(FACTORS):
        mixed += hashed[i : i + count] * np.uint64(factor)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(FACTORS[0])
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def linked(a, b) -> bool:
    """Whether two sets (sorted, distinct) have a similarity of 0.8 or more."""
    import numpy as np

    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def least_shared(n):
    """How many first shingles of a set of n, in one order for all sets, hold one that a linked set has among its own."""
    return n - (4 * n + 4) // 5 + 1


def prefix(own, levels):
    """The first shingles of a set: those of the least level of frequency, then by hash."""
    import numpy as np

    if not len(own):
        return own
    return own[np.lexsort((own, levels[own & np.uint64(PLACES - 1)]))[: least_shared(len(own))]]


def parities(own) -> bytes:
    """A power of two of bits, at least two a shingle: whether an odd number of the set's shingles falls on each."""
    import numpy as np

    bits = max(LEAST_BITS, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the larger one folded to the size of the other; never more than their sets do in shingles."""
    if len(x) > len(y):
        x, y = y, x
    folded = int.from_bytes(x)
    for at in range(0, len(y), len(x)):
        folded ^= int.from_bytes(y[at : at + len(x)])
    return folded.bit_count()


def size_class(n):
    """Classes of set sizes; sizes of linked sets lie in one class or in neighbours."""
    import numpy as np

    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.25) + 1e-9).astype(np.uint8)


def by_buckets(g, buckets: int, *columns):
    """Bucket, and the bytes of the shingles' low halves and of the columns beside them, for each bucket that has some."""
    import numpy as np

    bucket = (g >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((g.astype(np.uint32), bucket))
    bucket = bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(starts[1:], len(bucket)).tolist()
    sorted_ = [c[order] for c in (g.astype(np.uint32), *columns)]
    return bucket[starts], [[c[a:b].tobytes() for a, b in zip(starts.tolist(), ends)] for c in sorted_]


def frequency_levels(docs: DataFrame, buckets: int, partitions: int):
    """A level for every place (the low bits of a shingle's hash): 0, or how many of ``LEVELS`` the texts exceed that begin with such a shingle.

    Every text gives twice as many of its first shingles by hash as its prefix holds, equal sets of a batch once.  They are
    counted by buckets; what comes to the driver is ``PLACES`` bytes at most, whatever the corpus.
    """
    import numpy as np

    @lean
    def first_ones(batches):
        import numpy as np
        import pyarrow as pa

        for part in portions(batches, 0, 8_000_000):
            own = {s.tobytes(): s for s in (shingle_set(t.as_py()) for t in part.column(0))}
            g = np.concatenate([s[: 2 * least_shared(len(s))] for s in own.values()])
            if len(g):
                bucket, (blobs,) = by_buckets(g, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "shingles"])

    @lean
    def counted(batches):
        import numpy as np
        import pyarrow as pa

        def merged(parts):
            ids = np.concatenate([i for i, _ in parts])
            ids, where = np.unique(ids, return_inverse=True)
            return ids, np.bincount(where, np.concatenate([n for _, n in parts]), len(ids)).astype(np.int64)

        def levels(parts):
            ids, n = merged(parts)
            hot = n > LEVELS[0]
            place = (ids[hot] & np.uint32(PLACES - 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.searchsorted(LEVELS, n[hot]).astype(np.int8))], names=["place", "level"])

        last, parts, held = None, [], 0
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != last and parts:
                    yield levels(parts)
                    parts, held = [], 0
                last = bucket
                ids = np.frombuffer(blob, np.uint32)
                parts.append((ids, np.ones(len(ids), np.int64)))
                held += len(ids)
                if held > AT_ONCE:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
        if parts:
            yield levels(parts)

    @lean
    def blocks(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            place, level = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in np.unique(place // BLOCK).tolist():
                mine = place // BLOCK == block
                np.maximum.at(held.setdefault(block, np.zeros(BLOCK, np.int8)), place[mine] % BLOCK, level[mine])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "levels"])

    packed = docs.select("text").mapInArrow(first_ones, "bucket int, shingles binary")
    hot = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(counted, "place int, level byte")
    by_block = hot.withColumn("b", F.floor(F.col("place") / BLOCK)).repartition("b").select("place", "level").mapInArrow(blocks, "block int, levels binary")
    out = np.zeros(PLACES, np.int8)
    for block, levels in by_block.toLocalIterator():
        own = out[block * BLOCK : (block + 1) * BLOCK]
        np.maximum(own, np.frombuffer(levels, np.int8), out=own)
    return out


def set_rows(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, ``key`` (a hash of the row's set), its size ``n``, its parities ``bits`` and the text's SimHash ``fp``."""
    from pyspark.sql import types as T

    source = docs.select("text", *keep)

    @lean
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for part in portions(batches, 0):
            sets = [shingle_set(t.as_py()) for t in part.column(0)]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            sizes = np.array([len(s) for s in sets], np.int32)
            bits = pa.array([parities(s) for s in sets], pa.binary())
            fps = np.array([simhash(t.as_py()) for t in part.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(keys), pa.array(sizes), bits, pa.array(fps)], names=[*keep, "key", "n", "bits", "fp"])

    fields = [T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bits", T.BinaryType()), T.StructField("fp", T.LongType())]
    return source.mapInArrow(run, T.StructType([*source.schema.fields[1:], *fields]))


def packed_prefixes(docs: DataFrame, buckets: int, levels) -> DataFrame:
    """(bucket, shingles, classes, keys): the prefixes of the texts of ``docs``, packed by bucket; equal sets of a batch once."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    @lean
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for part in portions(batches, 0, 8_000_000):
            own: dict[int, tuple] = {}
            for t in part.column(0):
                s = shingle_set(t.as_py())
                if len(s) and (key := xxhash.xxh64_intdigest(s.tobytes())) not in own:
                    own[key] = prefix(s, sent.value), len(s)
            if not own:
                continue
            lengths = [len(p) for p, _ in own.values()]
            classes = np.repeat(size_class(np.array([n for _, n in own.values()])), lengths)
            keys = np.repeat(np.array(list(own), np.uint64), lengths)
            bucket, blobs = by_buckets(np.concatenate([p for p, _ in own.values()]), buckets, classes, keys)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "shingles", "classes", "keys"])

    return docs.select("text").mapInArrow(run, "bucket int, shingles binary, classes binary, keys binary")


class Meeting:
    """Sets that meet at the shingles of a bucket, taken in portions; what is carried over is one set a shingle and class."""

    def __init__(self):
        import numpy as np

        self.g, self.cls, self.key, self.told = np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, bool)

    def take(self, g, cls, key):
        """Rows (shingle, key, class, first) of the sets that share a shingle with another, each told once.

        ``first`` is the set that stands for the class, and for that one the set of the class below, else itself.
        """
        import numpy as np

        g, cls, key = (np.concatenate(x) for x in ((self.g, g), (self.cls, cls), (self.key, key)))
        told = np.concatenate([self.told, np.zeros(len(g) - len(self.told), bool)])
        new = np.arange(len(g)) >= len(self.g)
        order = np.lexsort((key, new, cls, g))
        g, cls, key, told = g[order], cls[order], key[order], told[order]
        opens_g = np.append(True, g[1:] != g[:-1])
        opens = opens_g | np.append(True, cls[1:] != cls[:-1])
        at = np.maximum.accumulate(np.where(opens, np.arange(len(g)), 0))
        group = np.cumsum(opens_g) - 1
        least, most = (f.reduceat(key, np.flatnonzero(opens_g)) for f in (np.minimum, np.maximum))
        meets = (least != most)[group]
        below = np.maximum(at - 1, 0)
        lower = opens & ~opens_g & (cls[below].astype(np.int16) + 1 == cls)
        first = np.where(lower, key[at[below]], key[at])
        out = meets & ~told & (opens | (key != key[at]))
        self.g, self.cls, self.key, self.told = g[opens], cls[opens], key[opens], (told | meets)[opens]
        return g[out], key[out], cls[out], first[out]


def shared_prefixes(packed: DataFrame, partitions: int) -> DataFrame:
    """(g, key, class, first): the sets that meet others at packed shingle g, and the one that each is to be compared with."""

    @lean
    def meet(batches):
        import numpy as np
        import pyarrow as pa

        def told(bucket, meeting, parts):
            found = meeting.take(*(np.frombuffer(b"".join(x), t) for x, t in zip(zip(*parts), (np.uint32, np.uint8, np.uint64))))
            g = (np.int64(bucket) << np.int64(32)) | found[0].astype(np.int64)
            for a in range(0, len(g), 100_000):
                own = [g[a : a + 100_000], *(x[a : a + 100_000] for x in found[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1].view(np.int64)), pa.array(own[2].astype(np.int16)), pa.array(own[3].view(np.int64))], names=["g", "key", "class", "first"])

        last, meeting, parts, held = None, None, [], 0
        for batch in batches:
            for row in batch.slice(0).to_pylist():
                if row["bucket"] != last:
                    if parts:
                        yield from told(last, meeting, parts)
                    last, meeting, parts, held = row["bucket"], Meeting(), [], 0
                parts.append((row["shingles"], row["classes"], row["keys"]))
                held += len(row["classes"])
                if held > AT_ONCE:
                    yield from told(last, meeting, parts)
                    parts, held = [], 0
        if parts:
            yield from told(last, meeting, parts)

    return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "g long, key long, class short, first long")


def possible(pairs: DataFrame, by_key: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sizes and bitmaps (key, n, bits) do not rule out a link: linked sets differ in a ninth of their shingles at most."""

    @lean
    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            apart = np.fromiter(map(bits_apart, batch.column(3).to_pylist(), batch.column(4).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(9 * apart <= batch.column(2).to_numpy()))

    a, b = (by_key.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab")
    near = 5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")
    both = pairs.join(a, "a").join(b, "b").where(near).select("a", "b", (F.col("n_a").cast("long") + F.col("n_b")).alias("n"), "bits_a", "bits_b")
    return both.mapInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, keyed: DataFrame, by_key: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of keys whose sets are linked."""
    left = cut(possible(pairs, by_key))
    asked = left.select(F.col("a").alias("key")).union(left.select("b")).distinct()
    return cut(compared(left, sets_of(keyed, cut(by_key.join(asked, "key", "left_semi").select(row_hash("one.id", "one.h").alias("__row"))))))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (key, grams) are linked."""

    @lean
    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for part in portions(portions(batches, 2), 3):
            good = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(part.column(2), part.column(3))]
            yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    a, b = (sets.select(F.col("key").alias(s), F.col("grams").alias(f"grams_{s}")) for s in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(compare, "a long, b long")


def row_hash(doc_id, text_hash):
    """A hash of a row's id and text hash."""
    return F.xxhash64(F.col(doc_id), F.col(text_hash))


def sets_of(keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """key and grams (the bytes of the whole set) of the rows of ``keyed`` (doc_id, __h, text) ``asked`` for by __row, and of a few more.

    A bitmap of 16 places a row, at most 16 MB, tells which rows are asked for, so that the others are not moved.
    """
    import numpy as np

    places = 1 << min(27, max(16, (16 * asked.count()).bit_length()))
    wanted = np.zeros(places >> 3, np.uint8)
    words = asked.select(F.shiftright(F.pmod("__row", F.lit(places)), 3).cast("int").alias("at"), F.expr("shiftright(128, int(pmod(__row, 8)))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    wanted[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    sent = keyed.sparkSession.sparkContext.broadcast(wanted)

    @lean
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for part in portions(batches, 0):
            at = part.column(1).to_numpy() % places
            part = part.filter(pa.array(sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))
            grams = [shingle_set(t.as_py()).tobytes() for t in part.column(0)]
            keys = np.array([xxhash.xxh64_intdigest(x) for x in grams], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(grams, pa.binary())], names=["key", "grams"])

    return keyed.select("text", row_hash("__id", "__h").alias("__row")).mapInArrow(run, "key long, grams binary").dropDuplicates(["key"])


def print_pairs(by_key: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys: every one and the one that stands for its component of fingerprints ``fp`` within two bits of one another."""
    roots = components(link_forest(cut(by_key.select("fp").distinct())))
    named = by_key.select("key", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("key").alias("a"), F.max("key").alias("most")).where("a <> most").select("root", "a")
    return named.join(firsts, "root").where("key <> a").select("a", F.col("key").alias("b"))


def set_roots(keyed: DataFrame, by_key: DataFrame) -> DataFrame:
    """(node, root) of the keys that are linked to others; ``by_key`` has key, n, bits, fp and one row of ``keyed`` for each."""
    spark = keyed.sparkSession
    total = by_key.agg(F.sum(F.col("n") - F.ceil(0.8 * F.col("n")) + 1)).first()[0] or 0
    buckets = max(1, min(1 << 31, -(-int(total) // BUCKET)))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets, MOST_PARTITIONS))
    buckets = max(buckets, partitions)
    packed = packed_prefixes(keyed, buckets, frequency_levels(keyed, buckets, partitions))
    shared = reread(shared_prefixes(packed, partitions), "shared-prefixes")
    counted = shared.where("first <> key").groupBy(F.col("first").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("n"))
    stars = reread(counted, "star-pairs")
    # each set and the one it meets oftenest; most of the other pairs are joined by these already, and their sets need not be moved
    printed = verified(print_pairs(by_key), keyed, by_key)
    nearest = cut(stars.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"))
    links = cut(printed.union(verified(unjoined(nearest, components(printed)), keyed, by_key)))
    roots = components(links)
    others = unjoined(stars.select("a", "b").join(nearest, ["a", "b"], "left_anti"), roots)
    links = cut(links.union(verified(others, keyed, by_key)))
    roots = components(links)
    members = shared.select("g", "key", "class").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = members.groupBy("g").agg(F.min("root").alias("__least"), F.max("root").alias("__most"), F.count("*").alias("held")).where("__least <> __most").select("g", "held")
    apart = reread(members.join(mixed, "g").distinct(), "members-apart")
    x, y = (apart.where(F.col("held") <= FEW).select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "class", "root")]) for s in "ab")
    across = x.join(y, "g").where((F.col("key_a") < F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & (F.abs(F.col("class_a") - F.col("class_b")) <= 1))
    across = across.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).union(crowded(apart.where(F.col("held") > FEW), by_key, partitions))
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = across.distinct().join(tested, ["a", "b"], "left_anti")
    late = verified(rest, keyed, by_key)
    return components(links.union(late)) if late.limit(1).count() else roots


def near_in_bits(keys, roots, sizes, bits, first, second):
    """Pairs of rows of ``first`` and ``second`` (places) in different components whose sizes and bitmaps do not rule out a link.

    ``first`` and ``second`` are the same rows or have none in common; each pair is given once.  Bitmaps are compared as matrices, those of one length with those of the same and of twice the length, folded.
    """
    import numpy as np

    def by_length(places):
        lengths = np.array([len(bits[i]) for i in places.tolist()], np.int64)
        return {int(n): places[lengths == n] for n in np.unique(lengths)}

    def matrix(places, width):
        rows = np.frombuffer(b"".join(bits[i] for i in places.tolist()), np.uint64).reshape(len(places), -1)
        return rows if rows.shape[1] == width else rows[:, :width] ^ rows[:, width:]

    one, two, alone = by_length(first), by_length(second), np.array_equal(first, second)
    for n in one:
        for m in (n // 2, n, 2 * n):
            if m not in two:
                continue
            width = min(n, m) // 8
            x, y = matrix(one[n], width), matrix(two[m], width)
            step = max(1, 2_000_000 // (len(y) * width))
            for at in range(0, len(x), step):
                mine, theirs = one[n][at : at + step], two[m]
                apart = np.bitwise_count(x[at : at + step, None] ^ y[None]).sum(axis=2, dtype=np.int64)
                a, b = sizes[mine][:, None], sizes[theirs][None]
                near = (9 * apart <= a + b) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (roots[mine][:, None] != roots[theirs][None])
                if alone:
                    near &= keys[mine][:, None] < keys[theirs][None]
                i, j = np.nonzero(near)
                i, j = keys[mine[i]], keys[theirs[j]]
                yield np.minimum(i, j), np.maximum(i, j)


def crowded(members: DataFrame, by_key: DataFrame, partitions: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that meet at a shingle with many others and whose bitmaps do not rule out a link.

    ``members``: g, key, root, held (how many meet there).  They are cut into blocks of about ``CROWD`` sets; every two blocks of a
    shingle meet in a task, which hands on only the pairs that are left, and of these only those that share no lesser shingle among the
    first ``KNOWN`` of either: a pair comes from one of its many shingles, not from all.
    """

    @lean
    def meet(batches):
        import numpy as np
        import pyarrow as pa

        def left(rows):
            block, keys, roots, sizes = (np.array([r[i] for r in rows], np.int64) for i in (3, 5, 6, 7))
            low = block == rows[0][1]
            one, two = np.flatnonzero(low), np.flatnonzero(block == rows[0][2])
            before: dict[int, frozenset] = {}

            def lesser(key):
                if key not in before:
                    own = np.frombuffer(known[key], ">i8")
                    before[key] = frozenset(own[own < rows[0][0]].tolist())
                return before[key]

            known = {r[5]: r[9] for r in rows}
            for a, b in near_in_bits(keys, roots, sizes, [r[8] for r in rows], one, two):
                fresh = np.fromiter((lesser(x).isdisjoint(lesser(y)) for x, y in zip(a.tolist(), b.tolist())), bool, len(a))
                yield pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh])], names=["a", "b"])

        last, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != last and rows:
                    yield from left(rows)
                    rows = []
                last = row[:3]
                rows.append(row)
        if rows:
            yield from left(rows)

    parts = F.ceil(F.col("held") / CROWD).cast("int")
    blocks = members.withColumn("block", F.pmod(F.xxhash64("key"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    own = members.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("g")), 1, KNOWN).alias("gs"))
    told = own.select("key", F.unhex(F.array_join(F.transform("gs", lambda g: F.lpad(F.hex(g), 16, "0")), "")).alias("known"))
    dealt = blocks.join(by_key.select("key", "n", "bits"), "key").join(told, "key").select("g", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "key", "root", F.col("n").cast("long").alias("n"), "bits", "known")
    return dealt.repartition(partitions, "g", "low", "high").sortWithinPartitions("g", "low", "high").mapInArrow(meet, "a long, b long")


def unjoined(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of keys that (node, root) does not hold in one component."""
    for s in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")), s, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the least doc_id (then the least text hash, then the least row hash)."""
    keyed = hashable(docs)
    rows = reread(set_rows(keyed, ("__none", "__id", "__h", "__r")), "shingle-sets")
    one = F.struct(F.col("__none").alias("none"), F.col("__id").alias("id"), F.col("__h").alias("h"), F.col("__r").alias("r"))
    by_key = rows.groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("fp").alias("fp"), F.min(one).alias("one"))
    roots = set_roots(keyed, reread(by_key, "distinct-sets").where("n > 0"))
    firsts = rows.groupBy("key").agg(F.min(one).alias("s")).join(roots.withColumnRenamed("node", "key"), "key", "left").select(F.coalesce("root", "key").alias("root"), "s")
    return one_of_each(keyed, firsts)
