"""Running places and sums of groups whose rows lie in many tasks.

Rows are dealt by ranges of group and order and written to the shared folder.  Each partition tells its first and its last
run of equal groups; the driver adds these up (two short records a partition) and every partition then continues where the
ones before it stop.  So no task ever holds a whole group.

A *lane* is a column of 64-bit words with a multiplier r: its running value is the sum of word * r^place modulo 2^64 over the
rows of the group so far, which ranges can hand on (r = 1 is a plain sum).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut

WRAP = 1 << 64
#: The range that a row lies in; a task's own number would change with unions.
PART = "__part"


@dataclass
class Edge:
    """What a partition continues: rows, lanes and number of its first group, and the whole size of its first and last one."""

    rows: int = 0
    lanes: list[int] = field(default_factory=list)
    group: int = 0
    first_total: int = 0
    last_total: int = 0


@dataclass
class Dealt:
    """Rows in ranges, the edges of the partitions, and how many groups there are."""

    rows: DataFrame
    edges: list[Edge]
    groups: int


def _powers(r: int, n: int):
    """r^0 to r^(n-1) modulo 2^64."""
    import numpy as np

    out = np.full(n, r, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs(table, group: str):
    """Starts of the runs of equal values in a sorted column, and the end of the last."""
    import numpy as np
    import pyarrow.compute as pc

    column = table.column(group).combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(1, np.int64)
    a, b = column.slice(0, n - 1), column.slice(1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], 1 + np.flatnonzero(differ | (nulls[1:] != nulls[:-1])), [n]])


def gathered(batches):
    """The rows of a partition as one table; None where there are none."""
    import pyarrow as pa

    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def words_of(table, name: str):
    """A long column as unsigned words."""
    import numpy as np

    return table.column(name).to_numpy().astype(np.int64).view(np.uint64)


def _local(table, starts, lanes: dict[str, int]):
    """Running lane values of the rows within their runs, as if every run began here."""
    import numpy as np

    n = table.num_rows
    begin = np.repeat(starts[:-1], np.diff(starts))
    place = np.arange(n) - begin
    out = []
    for name, r in lanes.items():
        powers = _powers(r, int(np.diff(starts).max(initial=0)))
        total = np.add.accumulate(words_of(table, name) * powers[place])
        before = np.concatenate([np.zeros(1, np.uint64), total])[begin]
        out.append(total - before)
    return place, out


def dealt(rows: DataFrame, group: str, order: list[str], lanes: dict[str, int] | None = None) -> Dealt:
    """``rows`` in ranges of group (nulls first) and order, sorted, with the edges of the ranges."""
    lanes = lanes or {}
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = cut(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(PART, F.spark_partition_id()))
    kind = ranged.schema[group].dataType.simpleString()

    def ends(batches):
        import pyarrow as pa

        table = gathered(batches)
        if table is None:
            return
        starts = runs(table, group)
        _, sums = _local(table, starts, lanes)
        first, last = int(starts[1]) - 1, table.num_rows - 1
        at = lambda row: [int(s.view("int64")[row]) for s in sums]
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "part": table.column(PART)[0].as_py(),
                    "runs": len(starts) - 1,
                    "first": table.column(group)[first].as_py(),
                    "first_rows": int(starts[1]),
                    "first_lanes": at(first),
                    "last": table.column(group)[last].as_py(),
                    "last_rows": int(starts[-1] - starts[-2]),
                    "last_lanes": at(last),
                }
            ],
            schema=pa.schema(
                [
                    ("part", pa.int32()), ("runs", pa.int64()), ("first", table.schema.field(group).type), ("first_rows", pa.int64()),
                    ("first_lanes", pa.list_(pa.int64())), ("last", table.schema.field(group).type), ("last_rows", pa.int64()),
                    ("last_lanes", pa.list_(pa.int64())),
                ]
            ),
        )

    shape = f"part int, runs long, first {kind}, first_rows long, first_lanes array<long>, last {kind}, last_rows long, last_lanes array<long>"
    told = sorted(ranged.select(group, PART, *lanes).mapInArrow(ends, shape).collect(), key=lambda r: r.part)
    edges = [Edge() for _ in range(ranged.rdd.getNumPartitions())]
    open_group, rows_so_far, so_far, groups = None, 0, [0] * len(lanes), 0
    sharing: list[tuple[int, str]] = []  # edges that wait for the total of the open group

    def close():
        for part, which in sharing:
            setattr(edges[part], which, rows_so_far)
        sharing.clear()

    def joined(n, before, after):
        return [(b + pow(r, n, WRAP) * a) % WRAP for r, b, a in zip(lanes.values(), before, after)]

    for t in told:
        if not groups or t.first != open_group:
            close()
            open_group, rows_so_far, so_far, groups = t.first, 0, [0] * len(lanes), groups + 1
        edge = edges[t.part]
        edge.rows, edge.lanes, edge.group = rows_so_far, so_far, groups - 1
        so_far, rows_so_far = joined(rows_so_far, so_far, t.first_lanes), rows_so_far + t.first_rows
        sharing.append((t.part, "first_total"))
        if t.runs > 1:
            close()
            open_group, rows_so_far, so_far, groups = t.last, t.last_rows, [x % WRAP for x in t.last_lanes], groups + t.runs - 1
        sharing.append((t.part, "last_total"))
    close()
    return Dealt(ranged, edges, groups)


@dataclass
class Placed:
    """A partition's rows with the place in their group, its size and number, the lanes so far, and the starts of the runs."""

    table: object
    starts: object
    place: object
    total: object
    group: object
    lanes: list


def placed(batches, edges: list[Edge], group: str, lanes: dict[str, int] | None = None) -> Placed | None:
    """The rows of a partition of ``dealt`` (PART among them), continued from its edge; None where there are none."""
    import numpy as np

    lanes, table = lanes or {}, gathered(batches)
    if table is None:
        return None
    edge = edges[table.column(PART)[0].as_py()]
    table = table.drop_columns([PART])
    starts = runs(table, group)
    place, sums = _local(table, starts, lanes)
    sizes, first = np.diff(starts), int(starts[1])
    whole = sizes.copy()
    whole[-1], whole[0] = edge.last_total, edge.first_total
    place[:first] += edge.rows
    for k, r in enumerate(lanes.values()):
        sums[k][:first] = np.uint64(edge.lanes[k]) + np.uint64(pow(r, edge.rows, WRAP)) * sums[k][:first]
    number = np.arange(len(sizes)) + edge.group
    return Placed(table, starts, place, np.repeat(whole, sizes), np.repeat(number, sizes), sums)


def pieces(table, rows: int = 10_000):
    """A table's rows as batches of bounded length."""
    return table.combine_chunks().to_batches(max_chunksize=rows)
