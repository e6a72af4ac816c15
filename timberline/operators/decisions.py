"""Decisions that are taken one after another, over the cluster (GRF4, GRF5).

An item acts or not in the order of ids, and what it does depends on those of its
neighbours that come before it. Items are dealt by ranges of their place into blocks of
bounded size. A task walks its block once in order and decides what depends on decided
items only; what it depends on in other blocks is asked for, and the next round goes on
with the undecided rest. No group is gathered, whatever its size: a chain of items in one
order takes as many rounds as it has blocks, not as many as it has items.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.graph import checkpointed

#: Items of one block.
BLOCK = 1 << 16
#: Stands for a neighbour that is known to act.
_ACTS = (1 << 63) - 1
_STATE = "block int, id long, lower array<long>, names array<boolean>, act boolean"


def outcome(lower: Sequence[int], names: Sequence[bool], acts: dict[int, bool]) -> tuple[bool | None, int]:
    """Whether an item acts: as the last of its acting neighbours before it (``lower``, latest first) names it, and without one it does. None while that is open; and how many of ``lower`` matter."""
    seen = set()
    for at, (item, named) in enumerate(zip(lower, names, strict=True)):
        act = acts.get(item)
        if act is not False:
            seen.add(named)  # what follows if it acts
        if act:
            return (seen.pop() if len(seen) == 1 else None), at + 1
    seen.add(True)
    return (True if len(seen) == 1 else None), len(lower)


def _pass(table: pa.Table) -> pa.Table:
    """One walk through a block: items (with ``lower``) in order of id, and told decisions of others (without)."""
    columns = {c: table.column(c).to_pylist() for c in ("block", "id", "lower", "names", "act")}
    acts = {i: act for i, low, act in zip(columns["id"], columns["lower"], columns["act"], strict=True) if low is None} | {_ACTS: True}
    out = []
    for k in np.argsort(np.array(columns["id"], np.int64), kind="stable").tolist():
        if (low := columns["lower"][k]) is None:
            continue
        item, names = columns["id"][k], columns["names"][k]
        act, upto = outcome(low, names, acts)
        if act is not None:
            acts[item] = act
            out.append((columns["block"][k], item, [], [], act))
        else:
            open_ = [(_ACTS if acts.get(j) else j, n) for j, n in zip(low[:upto], names, strict=False) if acts.get(j) is not False]
            out.append((columns["block"][k], item, [j for j, _ in open_], [n for _, n in open_], None))
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.bool_())
    names = ("block", "id", "lower", "names", "act")
    return pa.table({c: pa.array([r[k] for r in out], kind) for k, (c, kind) in enumerate(zip(names, kinds, strict=True))})


def decided(items: DataFrame, *place: str | Column, block: int = BLOCK) -> DataFrame:
    """(id, act) of each of ``items`` (id, lower, names, and what ``place`` orders by) whose decision does not hang on ids that are no items.

    ``lower`` holds the neighbours before an item, the last of them first, and ``names``
    whether each of them would name the item if it acts. An item acts if the last acting
    one of them names it, or if none of them acts. Ids are distinct.
    """
    parts = max(1, -(-items.count() // block))
    dealt = items.repartitionByRange(parts, *place) if parts > 1 else items.coalesce(1)
    state = dealt.select(F.spark_partition_id().alias("block"), "id", "lower", "names", F.lit(None).cast("boolean").alias("act"))
    state, done = checkpointed(state), None
    told = None
    while True:
        rows = state if told is None else state.unionByName(told, allowMissingColumns=True)
        after = checkpointed(rows.groupBy("block").applyInArrow(_pass, _STATE))
        new = after.where(F.col("act").isNotNull()).select("id", "act")
        done = new if done is None else done.union(new)
        state = after.where(F.col("act").isNull())
        if new.isEmpty() or state.isEmpty():
            return done
        asked = state.select("block", F.explode("lower").alias("id")).distinct()
        told = asked.join(new.hint("merge"), "id").select("block", "id", "act")
