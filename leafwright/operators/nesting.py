"""Nested structure by one ordered scan: the tree of tag events, and what encloses a node.

Every document is cut into blocks of positions and each block is read once, in order, with a stack of what
is open.  A block need not know how the earlier ones ended:

* Of tag events a block is worth (closers without an opener, openers without a closer).  Such values
  combine associatively: the later block's closers take away from the earlier one's openers.
* Of nodes with an interval (``node_id``, ``last_id``) the elements that reach into a later block are copied
  to its front, which is its stack as the block before leaves it.

So a document of any length is as many tasks as it has blocks, and a nesting of any depth costs its depth
once per block; no node carries a list of what is above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafwright.operators.sequence import BLOCK
from leafwright.session import stored

_B = "__block"
_FLUSH = 100_000  # pairs handed back to Spark at once


def _with(schema: StructType, added: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(added).fields])


# tag events


class _Events:
    """Open elements of one block: positions and labels, and how many closers found none."""

    def __init__(self) -> None:
        self.open: list[tuple] = []
        self.surplus = 0

    def step(self, pos: int, label: str, step: int) -> tuple:
        """(level before the event, parent's position, parent's label)."""
        level = len(self.open) - self.surplus
        parent = self.open[-1] if self.open else (None, None)
        if step > 0:
            self.open.append((pos, label))
        elif step < 0:
            if self.open:
                self.open.pop()
            else:
                self.surplus += 1
        return level, *parent


def match_in_order(events: DataFrame, doc: str, pos: str, label: str, step: Column) -> DataFrame:
    """``depth`` and parent (``parent_<pos>``, ``parent_<label>``) of events that come document by document.

    For frames whose documents are rows of one task in order, as an explode leaves them: nothing is moved.
    """
    rows = events.withColumn("__step", step.cast("int"))
    schema = _with(rows.schema, f"depth long, parent_{pos} long, parent_{label} string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), _Events()
        for batch in batches:
            levels, above, labels = [], [], []
            cells = zip(*(batch.column(c).to_pylist() for c in (doc, pos, label, "__step")), strict=True)
            for key, p, name, s in cells:
                if key != current or p == 1:  # positions start at 1, also where a key comes twice
                    current, state = key, _Events()
                level, parent, tag = state.step(p, name, s)
                levels.append(level + 1)
                above.append(parent)
                labels.append(tag)
            yield _appended(batch, [pa.array(levels, pa.int64()), pa.array(above, pa.int64()), pa.array(labels, pa.string())], schema)

    return rows.mapInArrow(run, schema).drop("__step")


def _appended(batch: pa.RecordBatch, columns: list[pa.Array], schema: StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.fieldNames())


def match(events: DataFrame, doc: str, pos: str, label: str, step: Column, block: int = BLOCK) -> DataFrame:
    """``depth`` and parent (``parent_<pos>``, ``parent_<label>``) of events in any arrangement.

    One shuffle deals the blocks.  A block's value stands on its last row; only documents of several blocks
    have rows that wait for the blocks before.
    """
    parent = [f"parent_{pos}", f"parent_{label}"]
    rows = events.withColumn("__step", step.cast("int")).withColumn(_B, F.col(pos) - F.pmod(pos, F.lit(block)))
    dealt = rows.repartition(doc, _B).sortWithinPartitions(doc, _B, pos)
    value = "struct<net:long,open:array<struct<level:long,pos:long,label:string>>>"
    schema = _with(rows.schema, f"__level long, {parent[0]} long, {parent[1]} string, __value {value}")
    value_type = pa.struct(
        [("net", pa.int64()), ("open", pa.list_(pa.struct([("level", pa.int64()), ("pos", pa.int64()), ("label", pa.string())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, held = None, _Events(), None  # the last row waits: it may be its block's last

        def worth() -> dict:
            first = -state.surplus
            levels = [{"level": first + i + 1, "pos": p, "label": n} for i, (p, n) in enumerate(state.open)]
            return {"net": len(state.open) - state.surplus, "open": levels}

        def output(batch, found, values):
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.string()))]
            return _appended(batch, [*columns, pa.array(values, value_type)], schema)

        for batch in batches:
            keys = list(zip(batch.column(doc).to_pylist(), batch.column(_B).to_pylist()))
            cells = list(zip(*(batch.column(c).to_pylist() for c in (pos, label, "__step")), strict=True))
            found, values, at = [], [], 0
            for key, group in groupby(keys):
                size = sum(1 for _ in group)
                if key != current:
                    if values:
                        values[-1] = worth()
                    elif held is not None:
                        yield output(*held[:2], [worth()])
                        held = None
                    current, state = key, _Events()
                found += [state.step(*cell) for cell in cells[at : at + size]]
                values += [None] * size
                at += size
            if held is not None:
                yield output(*held[:2], [None])
                held = None
            if found:
                held = (batch.slice(len(found) - 1), found[-1:])
                if len(found) > 1:
                    yield output(batch.slice(0, len(found) - 1), found[:-1], values[:-1])
        if held is not None:
            yield output(*held, [worth()])

    matched = stored(dealt.mapInArrow(run, schema))  # read below by its rows and by its few values
    kept = [c for c in events.columns if c not in parent]
    first = matched.filter(F.col(_B) == 0).select(*kept, (F.col("__level") + 1).alias("depth"), *parent)
    before = Window.partitionBy(doc).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    values = matched.filter("__value IS NOT NULL").select(doc, _B, "__value").withColumn(
        "__base", F.coalesce(F.sum("__value.net").over(before), F.lit(0))
    )
    later = matched.filter(F.col(_B) > 0).join(values.select(doc, _B, "__base"), [doc, _B])
    later = later.withColumn("__level", F.col("__level") + F.col("__base"))
    # The innermost element left open at a level by an earlier block, for the levels that ask for one.
    left = values.select(doc, _B, F.explode("__value.open").alias("o"), "__base").select(
        doc, _B, (F.col("o.level") + F.col("__base")).alias("__level"), F.struct("o.pos", "o.label").alias("__open")
    )
    asked = later.filter(F.col(parent[0]).isNull()).select(doc, _B, "__level").distinct()
    line = left.unionByName(asked.withColumn("__open", F.lit(None).cast("struct<pos:long,label:string>")))
    earlier = Window.partitionBy(doc, "__level").orderBy(_B).rangeBetween(Window.unboundedPreceding, -1)
    answers = (
        line.withColumn("__found", F.last("__open", ignorenulls=True).over(earlier))
        .filter(F.col("__open").isNull()).select(doc, _B, "__level", "__found")
    )
    rest = later.join(answers, [doc, _B, "__level"], "left").select(
        *kept, (F.col("__level") + 1).alias("depth"),
        F.coalesce(parent[0], "__found.pos").alias(parent[0]), F.coalesce(parent[1], "__found.label").alias(parent[1]),
    )
    return first.unionByName(rest)


# nodes with intervals


def _in_blocks(nodes: DataFrame, keys: list[str], carried: Column, block: int) -> DataFrame:
    """Rows by block and position, led by copies of the carried elements that reach into the block."""
    cut = lambda c: F.col(c) - F.pmod(c, F.lit(block))
    own = nodes.withColumn(_B, cut("node_id")).withColumn("__copy", F.lit(False))
    reach = own.filter(carried & (cut("last_id") > F.col(_B)))
    narrow = [*keys, "node_id", "last_id", "tag", "__marks"]
    copies = reach.select(*narrow, F.explode(F.sequence(F.col(_B) + block, cut("last_id"), F.lit(block))).alias(_B), F.lit(True).alias("__copy"))
    both = own.unionByName(copies, allowMissingColumns=True)
    return both.repartition(*keys, _B).sortWithinPartitions(*keys, _B, "node_id")


def with_enclosing(
    nodes: DataFrame, marks: Column, counted: str, resets: list[str], keys: tuple[str, ...] = ("doc_id", "part"), block: int = BLOCK
) -> DataFrame:
    """What stands above each node: parent_tag, nearest (mark to the id of the innermost holder), level.

    ``marks`` is the array of names a node counts by for what is below it; how many different names there
    are is fixed by the caller.  ``level`` is one more than the ``counted`` elements above, counted from the
    innermost of ``resets`` on.  ``nodes`` are read twice.
    """
    keys = list(keys)
    rows = nodes.withColumn("__marks", marks)
    arranged = _in_blocks(rows, keys, F.lit(True), block)
    schema = _with(arranged.schema, "parent_tag string, nearest map<string,long>, level long")
    map_type = pa.map_(pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack, holders, seen, level = None, [], {}, [], 1
        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in (*keys, _B, "node_id", "last_id", "tag", "__marks", "__copy")))
            parents, nearest, levels, own = [], [], [], []
            for *key, node, last, tag, names, copied in cells:
                if key != current:
                    current, stack, holders, seen, level = key, [], {}, [], 1
                while stack and stack[-1][0] < node:
                    _, _, gone, level = stack.pop()
                    for name in gone:
                        holders[name].pop()
                        if not holders[name]:
                            del holders[name]
                    if gone:
                        seen = [(n, ids[-1]) for n, ids in holders.items()]
                own.append(not copied)
                parents.append(stack[-1][1] if stack else None)
                nearest.append(seen)
                levels.append(level)
                if last > node:
                    stack.append((last, tag, names, level))
                    for name in names:
                        holders.setdefault(name, []).append(node)
                    if names:
                        seen = [(n, ids[-1]) for n, ids in holders.items()]
                    level = 1 if tag in resets else level + (tag == counted)
            added = [pa.array(parents, pa.string()), pa.array(nearest, map_type), pa.array(levels, pa.int64())]
            yield _appended(batch, added, schema).filter(pa.array(own))

    return arranged.mapInArrow(run, schema).drop("__marks", "__copy", _B)


def with_owners(
    nodes: DataFrame, listed: Column, keys: tuple[str, ...] = ("doc_id", "part"), block: int = BLOCK
) -> DataFrame:
    """Each node once per listed element that it is or that encloses it: ``owner_id``, ``owner_tag``.

    The structural join of nodes with the listed ones.  ``nodes`` are read twice.
    """
    keys = list(keys)
    rows = nodes.withColumn("__marks", F.when(listed, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    arranged = _in_blocks(rows, keys, F.size("__marks") > 0, block)
    schema = _with(arranged.schema, "owner_id long, owner_tag string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack = None, []
        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in (*keys, _B, "node_id", "last_id", "tag", "__marks", "__copy")))
            at, owners = [], []

            def pairs(batch=batch):
                ids, tags = zip(*owners)
                return _appended(batch.take(pa.array(at)), [pa.array(ids, pa.int64()), pa.array(tags, pa.string())], schema)

            for i, (*key, node, last, tag, names, copied) in enumerate(cells):
                if key != current:
                    current, stack = key, []
                while stack and stack[-1][0] < node:
                    stack.pop()
                if names:
                    stack.append((last, (node, tag)))
                if not copied:
                    at += [i] * len(stack)
                    owners += [owner for _, owner in stack]
                    if len(at) >= _FLUSH:
                        yield pairs()
                        at.clear(), owners.clear()
            if at:
                yield pairs()

    return arranged.mapInArrow(run, schema).drop("__marks", "__copy", _B)
