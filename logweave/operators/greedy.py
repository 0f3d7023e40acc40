"""Exact greedy cutting of a long order into packs, block by block in parallel.

A pack grows row by row and closes after an eligible row once its bytes exceed ``max_size`` or its
rows exceed ``max_count``. Where a cut falls depends on the cut before, so this is a fold, but a block
of rows only needs to know how much the open pack already holds when the block starts. Because a later
start never cuts earlier, a block's answer as a function of that amount is a step function with few
steps. So:

1. every block is summarised on its own to its steps,
2. the steps of ``FAN_IN`` neighbouring blocks are composed to those of one larger block, level by level,
3. the largest blocks of a scope are walked in order, giving each the amount it starts with; what each starts
   with is handed down the same way to the smaller blocks inside it,
4. every block is cut on its own from that amount.

Steps 1 and 4 are the work and run in parallel over blocks: rows are shuffled to their block once, and a task takes its
blocks one after the other from sorted Arrow batches, so many small blocks cost little more than a few large ones. A block has no
more steps than one pack has rows, also after composing, so a group of step 2 or 3 holds at most ``FAN_IN`` times that, however hot
a scope or a run is. Neighbours are counted along the whole scope, also over the borders of coarser block columns such as log files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.functions.integers import floor_div
from logweave.operators.scan import spread

FAN_IN = 64
_NO_LIMIT = np.iinfo(np.int64).max // 4
STEP_COLUMNS = ("hi_cum", "hi_row", "bytes", "rows", "cuts")
ENTRY_COLUMNS = ("entry_bytes", "entry_rows", "entry_cuts")


class _Block:
    """Arrays of one sorted block and the cut that follows every possible pack start."""

    def __init__(self, run, size, eligible, max_size: int, max_count: int):
        self.n = len(run)
        self.run = run
        self.cum = np.concatenate(([0], np.cumsum(size)))
        self.max_size, self.max_count = max_size, max_count
        self.cuttable = np.flatnonzero(eligible)
        self.cut_cum = self.cum[self.cuttable + 1]
        change = np.flatnonzero(run[1:] != run[:-1]) + 1
        self.run_start = np.concatenate(([0], change))
        self.run_end = np.concatenate((change, [self.n]))

    def first_cut(self, bytes_before, rows_before):
        """Index into ``cuttable`` of the first cut when the open pack holds this much at row 0."""
        by_size = np.searchsorted(self.cut_cum, self.max_size - bytes_before, side="right")
        by_count = np.searchsorted(self.cuttable, self.max_count - rows_before, side="left")
        return np.minimum(by_size, by_count)

    def cut_after(self, start):
        """Row after which a pack that starts at row ``start`` is cut; ``n`` when it stays open."""
        index = self.first_cut(-self.cum[start], -start)
        return np.append(self.cuttable, self.n)[index]

    def steps(self):
        """Step function of a block with one run: (hi_cum, hi_row, bytes, rows, cuts) per step."""
        m = len(self.cuttable)
        following = np.append(self.first_cut(-self.cum[self.cuttable + 1], -(self.cuttable + 1)), m)
        last = np.arange(m + 1)
        count = np.append(np.ones(m, dtype=np.int64), 0)
        jump = following
        while True:  # double the jumps until every chain has reached its last cut
            move = jump < m
            if not move[:m].any():
                break
            last = np.where(move, last[np.minimum(jump, m)], last)
            count = np.where(move, count + count[np.minimum(jump, m)], count)
            jump = np.where(move, jump[np.minimum(jump, m)], jump)
        reach = min(int(self.first_cut(0, 0)) + 1, m)  # an empty pack is cut last
        last, count = last[:reach], count[:reach]
        edge = np.flatnonzero((last[1:] != last[:-1]) | (count[1:] != count[:-1]))
        edge = np.append(edge, reach - 1) if reach else edge
        closing = self.cuttable[last[edge]]
        return {
            "hi_cum": self.cut_cum[edge],
            "hi_row": self.cuttable[edge],
            "bytes": self.cum[self.n] - self.cum[closing + 1],
            "rows": self.n - closing - 1,
            "cuts": count[edge],
        }

    def cut_rows(self, entry_bytes: int, entry_rows: int) -> np.ndarray:
        """Flags of the rows after which a pack is cut by a limit."""
        starts = np.arange(self.n)
        run_end = np.repeat(self.run_end, self.run_end - self.run_start)
        cut = self.cut_after(starts)
        cut = np.where(cut < run_end, cut, self.n)
        following = np.where(cut < self.n, cut + 1, run_end).tolist()
        first = int(np.append(self.cuttable, self.n)[self.first_cut(entry_bytes, entry_rows)])
        first = first if first < self.run_end[0] else self.n
        flags = np.zeros(self.n, dtype=bool)
        if first < self.n:
            flags[first] = True
        at = first + 1 if first < self.n else int(self.run_end[0])
        visited = []
        while at < self.n:
            visited.append(at)
            at = following[at]
        closing = cut[visited] if visited else np.array([], dtype=np.int64)
        flags[closing[closing < self.n]] = True
        return flags

    def parts(self, flags: np.ndarray, entry_cuts: int) -> np.ndarray:
        """Cuts before each row within its run."""
        before = np.concatenate(([0], np.cumsum(flags)[:-1]))
        run_no = np.repeat(np.arange(len(self.run_start)), self.run_end - self.run_start)
        base = before[self.run_start]
        base[0] -= entry_cuts
        return before - base[run_no]


@dataclass
class _Steps:
    """One block's summary: what it adds without a cut (``bytes``, ``rows``), or where it ends whatever comes
    in if its run changes inside, and its steps."""

    head: int
    first_run: int
    last_run: int
    whole: tuple[int, int, int]
    steps: dict[str, np.ndarray]

    @classmethod
    def read(cls, summary: pa.Table) -> list[_Steps]:
        at = {c: summary[c].to_numpy() for c in (*STEP_COLUMNS, "first_run", "last_run")}
        heads = np.flatnonzero(at["hi_row"] == -1)  # each block's first row
        tails = np.append(heads[1:], summary.num_rows)
        return [
            cls(
                h, at["first_run"][h], at["last_run"][h], tuple(int(at[c][h]) for c in ("bytes", "rows", "cuts")),
                {c: at[c][h + 1 : t] for c in STEP_COLUMNS},
            )
            for h, t in zip(heads.tolist(), tails.tolist())
        ]

    def step(self, held, count, max_size: int, max_count: int):
        """Index of the step that an open pack of this much takes; the number of steps if it stays open."""
        return np.minimum(
            np.searchsorted(self.steps["hi_cum"], max_size - held, side="right"),
            np.searchsorted(self.steps["hi_row"], max_count - count, side="left"),
        )

    def ends(self, held: np.ndarray, count: np.ndarray, cuts: np.ndarray, max_size: int, max_count: int) -> list[np.ndarray]:
        """What is open after the block, and the cuts of its run, for each state before it in the same run."""
        index = self.step(held, count, max_size, max_count)
        cut = index < len(self.steps["hi_cum"])
        out = []
        for before, name, add in ((held, "bytes", self.whole[0]), (count, "rows", self.whole[1]), (cuts, "cuts", 0)):
            after = np.append(self.steps[name], 0)[index]
            out.append(np.where(cut, after + (before if name == "cuts" else 0), before + add))
        return out


def _walked(blocks: list[_Steps], start: tuple[int, int, int], max_size: int, max_count: int) -> np.ndarray:
    """What every block starts with: bytes and rows of the open pack, and the cuts of its run before it."""
    entries = np.zeros((len(blocks), 3), dtype=np.int64)
    run, state = blocks[0].first_run, start
    for i, block in enumerate(blocks):
        if run != block.first_run:
            state = (0, 0, 0)
        entries[i] = state
        run = block.last_run
        if block.first_run != run:
            state = block.whole
        else:
            state = tuple(int(x[0]) for x in block.ends(*(np.array([v]) for v in state), max_size, max_count))
    return entries


def _composed(blocks: list[_Steps], max_size: int, max_count: int) -> dict[str, np.ndarray]:
    """The summary of neighbouring blocks as one block."""
    none = np.zeros(0, np.int64)
    hi_cum, hi_row, ends = none, none, [none, none, none]
    one_run, run, whole = True, blocks[0].first_run, (0, 0, 0)
    for block in blocks:
        fresh = run != block.first_run
        run = block.last_run
        if fresh or block.first_run != run:  # from here on, the end does not depend on the beginning
            one_run, hi_cum, hi_row, ends = False, none, none, [none, none, none]
        if block.first_run != run:
            whole = block.whole
            continue
        ends = block.ends(*ends, max_size, max_count)
        state = (0, 0, 0) if fresh else whole
        if one_run:  # a pack that no block before has cut
            hi_cum, hi_row = (np.concatenate([a, block.steps[c] + add]) for a, c, add in ((hi_cum, "hi_cum", whole[0]), (hi_row, "hi_row", whole[1])))
            ends = [np.concatenate([a, block.steps[c]]) for a, c in zip(ends, ("bytes", "rows", "cuts"))]
            whole = (whole[0] + block.whole[0], whole[1] + block.whole[1], 0)
        else:
            whole = tuple(int(x[0]) for x in block.ends(*(np.array([v]) for v in state), max_size, max_count))
    reach = min(int(np.searchsorted(hi_cum, max_size, side="right")), int(np.searchsorted(hi_row, max_count, side="left"))) + 1
    hi_cum, hi_row, ends = hi_cum[:reach], hi_row[:reach], [x[:reach] for x in ends]  # an empty pack is cut last
    if len(hi_cum):
        changes = np.any([x[1:] != x[:-1] for x in ends], axis=0)
        edge = np.append(np.flatnonzero(changes), len(hi_cum) - 1)
        hi_cum, hi_row, ends = hi_cum[edge], hi_row[edge], [x[edge] for x in ends]
    columns = dict(zip(STEP_COLUMNS, zip((-1, -1, *whole), (hi_cum, hi_row, *ends))))
    out = {c: np.concatenate([[first], rest]).astype(np.int64) for c, (first, rest) in columns.items()}
    runs = {"first_run": blocks[0].first_run, "last_run": blocks[-1].last_run}
    return out | {c: np.full(len(out["hi_cum"]), v, np.int64) for c, v in runs.items()}


def _sorted(table: pa.Table, order: Sequence[str]) -> pa.Table:
    return table.take(pa.compute.sort_indices(table, sort_keys=[(c, "ascending") for c in order]))


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The first row of each run of equal keys."""
    changed = np.zeros(max(table.num_rows - 1, 0), bool)
    for key in keys:
        column = table[key]
        changed |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    return np.append(0, np.flatnonzero(changed) + 1)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, list[int], list[int]]]:
    """The batches of a partition sorted by ``keys`` as tables of whole groups, with their first and end rows. Held back is one group at most."""

    def cut(pieces: list[pa.RecordBatch]) -> tuple[pa.Table, list[int], list[int]]:
        table = pa.Table.from_batches(pieces).combine_chunks()
        starts = _starts(table, keys)
        return table, starts.tolist(), np.append(starts[1:], table.num_rows).tolist()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1][k][-1] != batch[k][0] for k in keys):
            yield cut(held)
            held = []
        last = int(_starts(pa.Table.from_batches([batch]), keys)[-1])
        if last:
            yield cut([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield cut(held)


def _inputs(table: pa.Table, names: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, size and eligibility of every row."""

    def column(role: str, default) -> np.ndarray:
        if names[role] is None:
            return np.full(table.num_rows, default)
        return table[names[role]].fill_null(default).to_numpy()

    return column("run", 0), column("size", 0), column("eligible", True)


def greedy_pack(
    df: DataFrame,
    scope: Sequence[str],
    block: Sequence[str],
    order: Sequence[str],
    size: str,
    max_size: int | None = None,
    max_count: int | None = None,
    eligible: str | None = None,
    run: str | None = None,
    base_size: int = 0,
    levels: int = 1,
    rows: int | None = None,
) -> DataFrame:
    """Add ``part`` (0-based within the run) and ``is_cut`` (row closed its part by a limit).

    scope   independent orders; block + order continue it, and a block bounds the rows that are held at once. No nulls in both.
    size, eligible, run  columns: bytes of a row (BIGINT), whether it may be cut after it (all rows
            without it), and a BIGINT where a new pack always starts when it changes along the order.
    base_size  bytes every pack holds before its first row.
    levels     how often blocks are composed before a scope is walked: a walk sees one summary for
               ``FAN_IN`` ** levels neighbouring blocks of its scope. A single block column is an integer and counts them by its value.
    rows       the most rows that ``df`` has, by which the number of tasks goes; without it they are counted.

    All columns pass through Python: leave out what the caller can join back.
    """
    scope, block, order = list(scope), list(block), list(order)
    max_size = _NO_LIMIT if max_size is None else max_size - base_size
    max_count = _NO_LIMIT if max_count is None else max_count
    names = {"size": size, "eligible": eligible, "run": run}
    keys, own_names = scope + block, df.columns
    key_types = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema]

    def summary(run: np.ndarray, size: np.ndarray, eligible: np.ndarray) -> dict[str, np.ndarray]:
        b = _Block(run, size, eligible, max_size, max_count)
        # the last run from a fresh start; with a single run that is the whole block without a cut
        if len(b.run_start) == 1:
            steps, whole = b.steps(), (int(b.cum[b.n]), b.n, 0)
        else:
            last = int(b.run_start[-1])
            tail = _Block(run[last:], size[last:], eligible[last:], max_size, max_count)
            cuts = np.flatnonzero(tail.cut_rows(0, 0))
            done = int(cuts[-1]) + 1 if len(cuts) else 0
            steps, whole = {}, (int(tail.cum[tail.n] - tail.cum[done]), tail.n - done, len(cuts))
        found = {c: np.append(steps.get(c, np.array([], np.int64)), v).astype(np.int64) for c, v in zip(STEP_COLUMNS, (-1, -1, *whole))}
        runs = {c: np.full(len(found["hi_cum"]), r, np.int64) for c, r in (("first_run", run[0]), ("last_run", run[-1]))}
        return found | runs

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in _whole_groups(batches, keys):
            columns = _inputs(table, names)
            found = [summary(*(c[a:z] for c in columns)) for a, z in zip(starts, ends)]
            arrays = [pa.array(np.concatenate([f[c] for f in found])) for c in step_names]
            rows = pa.array(np.repeat(starts, [len(f["hi_cum"]) for f in found]))
            yield from pa.Table.from_arrays([*(table[k].take(rows) for k in keys), *arrays], names=keys + step_names).to_batches()

    step_names = [*STEP_COLUMNS, "first_run", "last_run"]
    summary_types = [f"{c} bigint" for c in step_names]
    # one shuffle for both steps: the columns are the same, so Spark reuses it
    shuffled = spread(df.repartition(*keys), keys, df.count() if rows is None else rows)
    in_order = [*keys, *order]
    summaries = shuffled.sortWithinPartitions(*in_order).mapInArrow(summarise, ", ".join(key_types + summary_types))

    level_keys = [block] + [[f"__up{k}"] for k in range(1, levels + 1)]
    level_types = [", ".join(key_types)] + [", ".join([*key_types[: len(scope)], f"__up{k} bigint"]) for k in range(1, levels + 1)]

    def parent(frame: DataFrame, level: int) -> DataFrame:
        if level or len(block) == 1:
            number = F.col(level_keys[level][0])
        else:
            number = F.dense_rank().over(W.partitionBy(*scope).orderBy(*block)).cast("bigint") - 1
        return frame.withColumn(f"__up{level + 1}", floor_div(number, FAN_IN))

    def composing(level: int):
        own, upper = level_keys[level], scope + level_keys[level + 1]

        def compose(summary: pa.Table) -> pa.Table:
            steps = _composed(_Steps.read(_sorted(summary, [*own, "hi_row"])), max_size, max_count)
            arrays = [pa.repeat(summary[k][0], len(steps["hi_cum"])) for k in upper]
            return pa.Table.from_arrays(arrays + [pa.array(steps[c]) for c in step_names], names=upper + step_names)

        return compose

    def walking(level: int):
        own = scope + level_keys[level]

        def walk(summary: pa.Table, start: tuple[int, int, int]) -> pa.Table:
            summary = _sorted(summary, [*level_keys[level], "hi_row"])
            blocks = _Steps.read(summary)
            found = _walked(blocks, start, max_size, max_count)
            heads = pa.array([x.head for x in blocks])
            arrays = [summary[k].take(heads) for k in own] + [pa.array(found[:, c]) for c in range(3)]
            return pa.Table.from_arrays(arrays, names=own + list(ENTRY_COLUMNS))

        def from_top(summary: pa.Table) -> pa.Table:
            return walk(summary, (0, 0, 0))

        def from_above(summary: pa.Table, entry: pa.Table) -> pa.Table:
            return walk(summary, tuple(entry[c][0].as_py() for c in ENTRY_COLUMNS))

        return from_top if level == levels else from_above

    tiers = [summaries]
    for level in range(levels):
        tiers[level] = parent(tiers[level], level)
        grouped = tiers[level].groupBy(*scope, *level_keys[level + 1])
        tiers.append(grouped.applyInArrow(composing(level), ", ".join([level_types[level + 1], *summary_types])))
    entry_types = [f"{c} bigint" for c in ENTRY_COLUMNS]
    entries = tiers[-1].groupBy(*scope).applyInArrow(walking(levels), ", ".join([level_types[levels], *entry_types]))
    for level in reversed(range(levels)):
        upper = scope + level_keys[level + 1]
        pairs = tiers[level].groupBy(*upper).cogroup(entries.groupBy(*upper))
        entries = pairs.applyInArrow(walking(level), ", ".join([level_types[level], *entry_types]))

    out_schema = df.withColumns({"part": F.lit(0).cast("bigint"), "is_cut": F.lit(False)}).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in _whole_groups(batches, keys):
            columns, parts, flags = _inputs(table, names), [], []
            held, count, cuts = (table[c].to_numpy()[starts].tolist() for c in ENTRY_COLUMNS)
            for i, (a, z) in enumerate(zip(starts, ends)):
                b = _Block(*(c[a:z] for c in columns), max_size, max_count)
                flags.append(b.cut_rows(held[i], count[i]))
                parts.append(b.parts(flags[-1], cuts[i]))
            out = table.select(own_names).append_column("part", pa.array(np.concatenate(parts), pa.int64()))
            yield from out.append_column("is_cut", pa.array(np.concatenate(flags))).to_batches()

    # a shuffle that is asked for by name is never split by adaptive execution, so the join leaves blocks whole
    entered = shuffled.join(entries, keys).select(*own_names, *ENTRY_COLUMNS)
    return entered.sortWithinPartitions(*in_order).mapInArrow(cut, out_schema)
