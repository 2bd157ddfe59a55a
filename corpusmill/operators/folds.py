"""Sequential rules over ordered groups whose rows lie in many tasks.

A rule is a fold: a state walks along the rows of a group.  Where what a stretch of rows does to any state can be summed up
(a monoid), the rows need not meet in one task: they are dealt by ranges of group and order, each range sums up its first and
its last group, the driver hands the states on from range to range (two summaries a range), and every range then walks its own
rows from the state it is given.  Rows are walked as a stream; no task holds a group.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut

PART = "__part"


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            yield from batch.slice(at, 4096).to_pylist()


def folded(
    rows: DataFrame,
    group: str,
    order: list[str],
    initial: Any,
    summary: Callable[[Iterable[dict]], Any],
    after: Callable[[Any, Any], Any],
    walk: Callable[[Any, Iterable[dict]], Iterator[tuple]],
    shape: str,
) -> DataFrame:
    """What ``walk`` yields, as rows of ``shape``, along the rows of each group (nulls first) in order, from the state ``initial``.

    ``summary`` sums up a stretch of rows, and ``after(state, summary)`` is the state behind it.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = cut(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(PART, F.spark_partition_id()))

    def summed(batches):
        import pyarrow as pa

        out, part = [], None
        for key, own in itertools.groupby(_rows(batches), lambda r: r[group]):
            first = next(own)
            part = first[PART]
            out[1:] = [(key, summary(itertools.chain([first], own)))]  # the first and the last group
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(out)], pa.binary())], names=["part", "ends"])

    told = sorted(ranged.mapInArrow(summed, "part int, ends binary").collect(), key=lambda r: r.part)
    given, open_key, state = {}, None, initial
    for t in told:
        ends = pickle.loads(t.ends)
        key, own = ends[0]
        if not given or key != open_key:
            state = initial
        given[t.part] = state
        state, open_key = after(state, own), key
        if len(ends) > 1:
            open_key, own = ends[-1]
            state = after(initial, own)
    sent = spark.sparkContext.broadcast(pickle.dumps(given))
    fields = spark.createDataFrame([], shape).schema

    def walked(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted, states, held = to_arrow_schema(fields), None, []

        def batch():
            columns = [pa.array(c, f.type) for c, f in zip(zip(*held), wanted)]
            return pa.RecordBatch.from_arrays(columns, schema=wanted)

        for _, own in itertools.groupby(_rows(batches), lambda r: r[group]):
            first = next(own)
            if states is None:
                states = pickle.loads(sent.value)
                state = states[first[PART]]
            else:
                state = initial
            for made in walk(state, itertools.chain([first], own)):
                held.append(made)
                if len(held) == 4096:
                    yield batch()
                    held = []
        if held:
            yield batch()

    return ranged.mapInArrow(walked, shape)
