"""As-of features of event histories in time slices: what a slice needs from before it is a day of rows and a combinable state.

Customers with many events are cut into slices of time, so that none of them is one task. A slice gets its own events, those
of the look-back before it, the state of all earlier slices, and when each attribute value it has was last seen before. Within
a task, rows of many slices are folded together: aggregates over a range of rows come from a tree of blocks, so that no frame is
computed again for each row and no sum is taken as a difference of larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.sources.files import checkpointed

SECOND = 1_000_000
SPANS = {"10m": 600 * SECOND, "1h": 3600 * SECOND, "24h": 86_400 * SECOND}
#: Weight of an event in the moving average.
EWM_ALPHA = 0.2
KEEP = 1 - EWM_ALPHA
ATTRIBUTES = ("merchant_id", "device_id", "country", "merchant_category")
UNIQUE = ("merchants", "devices", "countries")
FLAGS = ("failed", "declined", "present")
#: Events of a customer beyond which it is sliced; a slice has about so many, and a cell's at least.
SLICE_EVENTS = 100_000
#: Cells of a look-back, between which slices are cut. Twice as many halve what a slice has beyond its look-back, and send each
#: event of the densest customers to twice as many slices.
CELLS = 8
#: Cells of sliced customers that may be broadcast, some 200 bytes each.
BROADCAST = 200_000
#: Stands for a missing time, before all others.
NO_TIME = -(1 << 62)
#: Rows that a task folds together, if no single slice is larger.
ROWS = 65_536
#: Rows for which a task works out what they know of the past at a time.
PART_ROWS = 4_096

#: A state: rows, amounts that aren't null, their mean, squared deviations, highest, lowest, sum, and moving average.
COUNT, N, MEAN, M2, HIGH, LOW, SUM, AVERAGE = range(8)
_STATE = ("count", "n", "mean", "m2", "high", "low", "sum", "average")
_LAST = ("last_us", "last_latitude", "last_longitude")
_FLAG_STATE = tuple(f"{f}_{k}" for f in FLAGS for k in ("sum", "n"))

#: Columns that folding adds to a row; counts and gaps of the event's own past.
ROLLED = (
    "prior_count", "prior_sum", "prior_mean", "prior_high", "prior_std", "prior_average", *(f"{f}_rate" for f in FLAGS), "previous_us", "previous_latitude", "previous_longitude",
    *(f"{a}_{s}" for s in SPANS for a in ("count", "sum", "mean", "high", "std")), "low_1h", *(f"unique_{u}" for u in UNIQUE), *(f"new_{a}" for a in ATTRIBUTES), "merchant_hits", "merchant_last", "merchant_day",
)
_WHOLE = {"previous_us", "merchant_last"}


def nothing(n: int) -> np.ndarray:
    out = np.zeros((8, n))
    out[HIGH], out[LOW] = -np.inf, np.inf
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """States of stretches a and of b right after a, as one."""
    out = np.empty_like(a)
    n = a[N] + b[N]
    gap, part = b[MEAN] - a[MEAN], np.divide(b[N], n, out=np.zeros_like(n), where=n > 0)
    out[COUNT], out[N], out[SUM] = a[COUNT] + b[COUNT], n, a[SUM] + b[SUM]
    out[MEAN] = np.where(a[N] > 0, a[MEAN] + gap * part, b[MEAN])
    out[M2] = a[M2] + b[M2] + np.where(a[N] > 0, gap * gap * a[N] * part, 0.0)
    out[HIGH], out[LOW] = np.maximum(a[HIGH], b[HIGH]), np.minimum(a[LOW], b[LOW])
    out[AVERAGE] = a[AVERAGE] * KEEP ** b[COUNT] + b[AVERAGE]
    return out


class Blocks:
    """States of blocks of 1, 2, 4, ... rows of each group, counted from its first row; any range of rows is put together from at
    most two of each size, the same ones whatever rows come later or stand in other groups."""

    def __init__(self, leaves: np.ndarray, sizes: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            starts = np.cumsum(sizes) - sizes
            self.levels.append((leaves, starts))
            if sizes.max(initial=0) <= 1:
                break
            halves = (sizes + 1) // 2
            even = nothing(2 * halves.sum())
            at = np.arange(sizes.sum()) + np.repeat(2 * (np.cumsum(halves) - halves) - starts, sizes)
            even[:, at] = leaves
            leaves, sizes = joined(even[:, ::2], even[:, 1::2]), halves

    def over(self, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        first = self.levels[0][1][group]
        lo, hi, left, right = lo - first, hi - first, nothing(len(lo)), nothing(len(lo))
        live = np.flatnonzero(lo < hi)
        for blocks, starts in self.levels:
            if not len(live):
                break
            odd = live[lo[live] % 2 == 1]
            left[:, odd] = joined(left[:, odd], blocks[:, starts[group[odd]] + lo[odd]])
            lo[odd] += 1
            odd = live[hi[live] % 2 == 1]
            hi[odd] -= 1
            right[:, odd] = joined(blocks[:, starts[group[odd]] + hi[odd]], right[:, odd])
            lo[live] //= 2
            hi[live] //= 2
            live = live[lo[live] < hi[live]]
        return joined(left, right)


def _std(state: np.ndarray) -> np.ndarray:
    return np.sqrt(np.divide(state[M2], state[N], out=np.zeros_like(state[M2]), where=state[N] > 0))


def distinct(codes: np.ndarray, known: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many different known codes each range lo to hi has; both rise. A row counts for the ranges that reach over it but not
    over the next row of its code: those are neighbours, so each row adds one at a place and takes it off at another."""
    order = np.argsort(codes, kind="stable")
    following = np.full(len(codes), len(codes))
    same = codes[order][1:] == codes[order][:-1]
    following[order[:-1][same]] = order[1:][same]
    rows = np.flatnonzero(known)
    first = np.searchsorted(hi, rows, "right")
    end = np.minimum(np.searchsorted(hi, following[rows], "right"), np.searchsorted(lo, rows, "right"))
    rows = first < end
    change = np.bincount(first[rows], minlength=len(lo) + 1) - np.bincount(end[rows], minlength=len(lo) + 1)
    return change.cumsum()[: len(lo)]


def _numbers(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and which are there."""
    column = table[name].combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _stretches(table: pa.Table, where: np.ndarray) -> pa.Table | None:
    """The rows marked, as stretches of the table: nothing is copied."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], where, [False]]).astype(np.int8))).tolist()
    return pa.concat_tables([table.slice(a, b - a) for a, b in zip(edges[::2], edges[1::2], strict=True)]) if edges else None


def folded(table: pa.Table, look_back: int | None) -> pa.Table:
    """Own rows of whole slices with ROLLED; rows are sorted by slice and kind, events among them by time and id. A column
    `since` gives each row's look-back as a time of its own, beyond which none of its windows reaches. What is not a row's own
    is null; `row` and `state` may come as lists, as null numbers and structs take as much room as any."""
    empty = table.slice(0, 0).select(["row"])
    parts = list(folded_parts(table, look_back))
    return pa.concat_tables(parts) if parts else empty


def folded_parts(table: pa.Table, look_back: int | None) -> Iterator[pa.Table]:
    """folded() for PART_ROWS own rows at a time, so that most of what is worked out, and all that is given out, is held for so
    many rows only, however large the slices."""
    key, kind = table["key"].to_numpy(), table["kind"].to_numpy()
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    n_groups = group[-1] + 1
    parts = {0: {"state"}, 1: {"attribute", "value"}, 2: set(table.column_names) - {"state", "attribute", "value", "key", "kind"}}
    states, memory, events = (_stretches(table.select([c for c in table.column_names if c in of]), kind == k) for k, of in parts.items())
    listed = pa.types.is_list(table.schema.field("row").type)
    if events is None:
        return
    clipped = "since" in table.column_names
    del table
    g = group[kind == 2]
    own = events["own"].to_numpy(zero_copy_only=False).astype(bool)
    us = events["us"].to_numpy()
    amount, there = _numbers(events, "amount")
    n = len(us)

    before, last, flags_before = nothing(n_groups), np.zeros((3, n_groups)), np.zeros((len(_FLAG_STATE), n_groups))
    has_state = np.zeros(n_groups, bool)
    if states is not None:
        at = group[kind == 0]
        has_state[at] = True
        found = pc.list_flatten(states["state"]).to_numpy().reshape(len(at), -1).T
        for rows, first in ((before, 0), (flags_before, len(_STATE)), (last, len(_STATE) + len(_FLAG_STATE))):
            rows[:, at] = found[first : first + len(rows)]

    # an instant is its rank among those of the task, so that slice and instant fit in one number
    instants = np.unique(us)
    width = len(instants) + 1
    rank = np.searchsorted(instants, us)
    place = g * width + rank
    first_any = np.searchsorted(g, np.arange(n_groups))
    first_own = np.full(n_groups, n)
    np.minimum.at(first_own, g[own], np.flatnonzero(own))
    owned = np.flatnonzero(own)
    sinces = events["since"].to_numpy() if clipped else None

    def reach(mine: np.ndarray, span: int | None = None) -> np.ndarray | None:
        """Ranks of the instants from which windows of a span, or the whole look-back, of these rows are open; None: no bound."""
        back = None
        if clipped or look_back is not None:
            back = np.searchsorted(instants, sinces[mine] if clipped else us[mine] - look_back)
        if span is None:
            return back
        since = np.searchsorted(instants, us[mine] - span)
        return np.maximum(since, back) if clipped else since

    def opened(mine: np.ndarray, span: int) -> np.ndarray:
        return np.searchsorted(place, g[mine] * width + reach(mine, span))

    flags = []
    for flag in FLAGS:
        value, valid = _numbers(events, flag)
        flags.append([np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (value, valid)])

    attributes, unique = [], []
    day, end_of_past = opened(owned, SPANS["24h"]), np.searchsorted(place, place[owned])
    for k, name in enumerate(ATTRIBUTES):
        values = events[name].combine_chunks()
        old = memory.filter(pc.equal(memory["attribute"], k)) if memory is not None else None
        both = pa.concat_arrays([values, old["value"].combine_chunks()]) if old is not None else values
        codes = pc.dictionary_encode(both, null_encoding="encode").indices.to_numpy()
        many = int(codes.max(initial=0)) + 1
        code = g * many + codes[:n]
        if k < len(UNIQUE):
            unique.append(distinct(code, values.is_valid().to_numpy(zero_copy_only=False), day, end_of_past).astype(np.int32))
        order = np.argsort(code, kind="stable").astype(np.int32)
        remembered = group[kind == 1][memory["attribute"].to_numpy() == k] * many + codes[n:] if old is not None else None
        attributes.append((code, order, code[order] * width + rank[order], remembered))
    del day, end_of_past, values, old, both, codes, code, order, remembered, group, key, kind

    leaves = nothing(n)
    leaves[COUNT], leaves[N], leaves[MEAN], leaves[SUM] = 1, there, amount, amount
    leaves[HIGH], leaves[LOW] = np.where(there, amount, -np.inf), np.where(there, amount, np.inf)
    leaves[AVERAGE] = EWM_ALPHA * amount
    blocks = Blocks(leaves, np.bincount(g, minlength=n_groups))
    where = [us, *(events[c].to_numpy(zero_copy_only=False) for c in ("latitude", "longitude"))]

    for done in range(0, len(owned), PART_ROWS):
        mine = owned[done : done + PART_ROWS]
        gm, hi = g[mine], np.searchsorted(place, place[mine])
        back, since = reach(mine), {s: reach(mine, span) for s, span in SPANS.items()}
        lo = first_own[gm] if back is None else np.searchsorted(place, gm * width + back)
        prior = blocks.over(gm, lo, hi)
        # the average is seeded by the first event in sight, which weighs as much as all before it would
        seeded = (hi > lo) & ~has_state[gm]
        prior[AVERAGE] += np.where(seeded, KEEP ** np.maximum(prior[COUNT], 0) * amount[np.minimum(lo, n - 1)], 0.0)
        if back is None:
            prior = joined(before[:, gm], prior)
        some = prior[COUNT] > 0
        out: dict[str, np.ndarray] = {
            "prior_count": prior[COUNT], "prior_sum": prior[SUM], "prior_mean": prior[MEAN], "prior_high": np.where(prior[N] > 0, prior[HIGH], 0.0), "prior_std": _std(prior), "prior_average": np.where(some, prior[AVERAGE], 0.0),
        }
        for k, (flag, (sums, counts)) in enumerate(zip(FLAGS, flags, strict=True)):
            yes, of = sums[hi] - sums[lo], counts[hi] - counts[lo]
            if back is None:
                yes, of = yes + flags_before[2 * k, gm], of + flags_before[2 * k + 1, gm]
            out[f"{flag}_rate"] = np.divide(yes, of, out=np.zeros(len(mine)), where=of > 0)

        inside = hi > (first_any[gm] if back is None else lo)
        at = np.maximum(hi - 1, 0)
        known = inside | (has_state[gm] if back is None else False)
        for k, name in enumerate(("previous_us", "previous_latitude", "previous_longitude")):
            values = np.where(inside, where[k][at], last[k, gm].astype(where[k].dtype))
            out[name] = np.ma.masked_array(values, ~known)

        for s in SPANS:
            part = blocks.over(gm, np.searchsorted(place, gm * width + since[s]), hi)
            out |= {f"count_{s}": part[COUNT], f"sum_{s}": part[SUM], f"mean_{s}": part[MEAN], f"high_{s}": np.where(part[N] > 0, part[HIGH], 0.0), f"std_{s}": _std(part)}
            if s == "1h":
                out["low_1h"] = np.where(part[N] > 0, part[LOW], 0.0)

        for k, (name, (code, order, sorted_places, remembered)) in enumerate(zip(ATTRIBUTES, attributes, strict=True)):
            at_own = code[mine] * width
            end = np.searchsorted(sorted_places, at_own + rank[mine])
            seen = end > np.searchsorted(sorted_places, at_own + (back if back is not None else 0))
            if remembered is not None:
                seen |= np.isin(code[mine], remembered)
            out[f"new_{name}"] = (~seen).astype(float)
            if name == "merchant_id":
                hour, day = (np.searchsorted(sorted_places, at_own + since[s]) for s in ("1h", "24h"))
                out["merchant_hits"], out["merchant_day"] = (end - hour).astype(float), (end - day).astype(float)
                out["merchant_last"] = np.ma.masked_array(us[order[np.maximum(end - 1, 0)]], end <= hour)
            if k < len(UNIQUE):
                out[f"unique_{UNIQUE[k]}"] = unique[k][done : done + PART_ROWS].astype(float)

        stretch = slice(mine[0], mine[-1] + 1)
        rows = events["row"].slice(stretch.start, stretch.stop - stretch.start)
        rows = pc.list_flatten(rows) if listed else rows.filter(pa.array(own[stretch]))
        columns = [pa.array(np.ma.getdata(out[c]), pa.int64() if c in _WHOLE else pa.float64(), mask=np.ma.getmaskarray(out[c])) for c in ROLLED]
        yield pa.table([rows, *columns], ["row", *ROLLED])


def _let_go(held: list[pa.RecordBatch]) -> pa.Table:
    """The batches as a table; the list holds them no longer."""
    table = pa.Table.from_batches(held)
    held.clear()
    return table


def _whole_slices(batches: Iterator[pa.RecordBatch], look_back: int | None) -> Iterator[pa.RecordBatch]:
    """folded() over as many whole slices at a time as come to ROWS, or over a larger one alone."""
    whole: list[pa.RecordBatch] = []
    last: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch["key"].to_numpy()
        ended = [0] if last and last[-1]["key"][-1].as_py() != key[0] else []
        ended = [*ended, *(np.flatnonzero(key[1:] != key[:-1])[-1:] + 1)]
        if ended:
            whole += [*last, batch.slice(0, ended[-1])]
            last, batch = [], batch.slice(ended[-1])
        last.append(batch)
        if whole and sum(b.num_rows for b in (*whole, *last)) >= ROWS:
            for part in folded_parts(_let_go(whole), look_back):
                yield from part.combine_chunks().to_batches()
    if last:
        whole += last
        last.clear()
        for part in folded_parts(_let_go(whole), look_back):
            yield from part.combine_chunks().to_batches()


def _running(pdf: pd.DataFrame) -> pd.DataFrame:
    """States before each slice of one customer, from those of its slices."""
    pdf = pdf.sort_values("slice")
    state, out = nothing(1), []
    for k, row in enumerate(pdf.to_dict("records")):
        if k:
            out.append({"c": row["c"], "slice": row["slice"], **dict(zip((f"state_{s}" for s in _STATE), state[:, 0].tolist(), strict=True))})
        own = np.array([[row[s]] for s in _STATE], float)
        if not k:
            own[AVERAGE] += KEEP ** row["count"] * row["first_amount"]
        state = joined(state, own)
    return pd.DataFrame(out, columns=["c", "slice", *(f"state_{s}" for s in _STATE)])


def _states(cut: DataFrame) -> DataFrame:
    """(c, slice, state_...) before each slice but the first, from rows with c, slice, us and id."""
    place = F.row_number().over(Window.partitionBy("c", "slice").orderBy(F.desc("us"), F.desc("id"))) - 1
    x = F.coalesce("amount", F.lit(0.0))
    by = cut.withColumn("place", place).groupBy("c", "slice")
    none = F.lit(0.0)
    own = {
        "count": F.count("*").cast("double"), "n": F.count("amount").cast("double"), "mean": F.coalesce(F.avg("amount"), none), "m2": F.coalesce(F.var_pop("amount") * F.count("amount"), none), "high": F.coalesce(F.max("amount"), F.lit(float("-inf"))),
        "low": F.coalesce(F.min("amount"), F.lit(float("inf"))), "sum": F.coalesce(F.sum("amount"), none), "average": F.sum(EWM_ALPHA * x * F.pow(F.lit(KEEP), "place")), "first_amount": F.min_by(x, F.struct("us", "id")),
    }
    flags = {f"own_{f}_{k}": fold.cast("double") for f in FLAGS for k, fold in (("sum", F.coalesce(F.sum(f), F.lit(0))), ("n", F.count(f)))}
    last = F.max(F.struct("us", "id", "latitude", "longitude")).alias("newest")
    slices = checkpointed(by.agg(*[v.alias(k) for k, v in (own | flags).items()], last))
    kinds = dict(slices.dtypes)
    folds = slices.select("c", "slice", *own).groupBy("c").applyInPandas(_running, f"c {kinds['c']}, slice bigint, " + ", ".join(f"state_{s} double" for s in _STATE))
    before = Window.partitionBy("c").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max("newest").over(before)
    rest = slices.select("c", "slice", *[F.sum(f"own_{x}").over(before).alias(f"state_{x}") for x in _FLAG_STATE], newest.alias("newest"))
    rest = rest.select("c", "slice", *[f"state_{x}" for x in _FLAG_STATE], *[F.col(f"newest.{x.removeprefix('last_')}").cast("double").alias(f"state_{x}") for x in _LAST]).where("newest is not null")
    return folds.alias("a").join(rest.alias("b"), F.col("a.c").eqNullSafe(F.col("b.c")) & (F.col("a.slice") == F.col("b.slice"))).select("a.*", *[f"b.state_{x}" for x in (*_FLAG_STATE, *_LAST)])


def _memories(cut: DataFrame) -> DataFrame:
    """(c, slice, attribute, value): values of a slice that an earlier slice of the customer had as well."""
    out = None
    for k, name in enumerate(ATTRIBUTES):
        met = cut.select("c", "slice", F.col(name).alias("value")).distinct()
        earlier = F.row_number().over(Window.partitionBy("c", "value").orderBy("slice")) > 1
        met = met.withColumn("earlier", earlier).where("earlier").select("c", "slice", F.lit(k).alias("attribute"), "value")
        out = met if out is None else out.unionByName(met)
    return out


def sliced(events: DataFrame, slice_events: int, look_back: int, ahead: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Rows with c, slice and own, those of sliced customers once more for each slice that looks back on them, or so far ahead;
    and which cells go to which slice: (c, cell, slice, later, sooner), or None if no customer has over slice_events rows.

    A look-back has CELLS cells. A slice is as many cells as hold slice_events rows, the last of them maybe beyond.
    """
    hot = checkpointed(events.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > slice_events).select(F.col("c").alias("hot")))
    n = hot.count()
    if not n:
        return events.withColumns({"slice": F.lit(0).cast("long"), "own": F.lit(True)}), None
    width = -(-look_back // CELLS)
    cell = F.floor(F.col("us") / width).cast("long")
    some = events.join(F.broadcast(hot) if n <= BROADCAST else hot, F.col("c").eqNullSafe(F.col("hot")), "left_semi")
    one = Window.partitionBy("c").orderBy("cell")
    cells = some.groupBy("c", cell.alias("cell")).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(one) - F.col("n"))
    cells = cells.select("c", "cell", F.floor(F.col("before") / slice_events).cast("long").alias("slice"))
    later = F.filter(F.collect_set("slice").over(one.rangeBetween(1, CELLS)), lambda s: s > F.col("slice"))
    near = F.collect_list(F.struct("slice", "cell")).over(one.rangeBetween(-(-(-ahead // width)), -1)) if ahead else F.array().cast("array<struct<slice:bigint,cell:bigint>>")
    cells = checkpointed(cells.select("c", "cell", "slice", later.alias("later"), F.filter(near, lambda x: x["slice"] < F.col("slice")).alias("sooner")))
    few = (F.broadcast(cells) if cells.count() <= BROADCAST else cells).alias("d")
    rows = events.withColumn("cell", cell).alias("e").join(few, F.col("e.c").eqNullSafe(F.col("d.c")) & (F.col("e.cell") == F.col("d.cell")), "left")
    soon = F.array_distinct(F.transform(F.filter("d.sooner", lambda x: F.col("us") < (x["cell"] + 1) * width + ahead), lambda x: x["slice"]))
    lent = F.transform(F.concat("d.later", soon), lambda s: F.struct(s.alias("slice"), F.lit(False).alias("own")))
    home = F.array(F.struct(F.coalesce("d.slice", F.lit(0).cast("long")).alias("slice"), F.lit(True).alias("own")))
    rows = rows.select(*[f"e.{c}" for c in events.columns], F.explode(F.when(F.col("d.slice").isNull(), home).otherwise(F.concat(home, lent))).alias("at"))
    return rows.select("*", "at.slice", "at.own").drop("at"), cells


def with_past(events: DataFrame, us, history_seconds: int | None = None, slice_events: int = SLICE_EVENTS) -> DataFrame:
    """(row, ROLLED...): each event as a struct, and what it knows of its customer's strictly earlier events.

    The window is all of them, or those of the last `history_seconds`. `us` is the time in microseconds. Null amounts count
    as events without an amount; null attributes are a value of their own, but none of the distinct ones; events without a time
    come before all others. A customer of over
    slice_events events is cut into slices of whole cells (an eighth of the look-back, a day at least); a slice, and of the
    look-back before it what windows ask for, are what one task holds of a customer.
    """
    span = max(SPANS.values()) if history_seconds is None else max(SPANS["24h"], history_seconds * SECOND)
    flags = {"failed": F.col("transaction_status") != "approved", "declined": F.col("transaction_status") == "declined", "present": F.col("card_present")}
    every = [F.col(f"`{c}`") for c in events.columns]
    rows = events.select(
        F.struct(*every).alias("row"), F.col("customer_id").alias("c"), F.coalesce(us, F.lit(NO_TIME)).alias("us"), F.col("event_id").alias("id"), F.col("transaction_amount").cast("double").alias("amount"),
        *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")], *[F.col(c).cast("string").alias(c) for c in ATTRIBUTES], *[v.cast("int").alias(k) for k, v in flags.items()],
    )
    rows, days = sliced(rows, slice_events, span)
    ready = rows.withColumn("kind", F.lit(2))
    if days is not None:  # of what a slice looks back on, only what windows read is sent
        ready = ready.withColumn("row", F.when(F.col("own"), F.array("row")))
    extra = {"attribute": "int", "value": "string", "state": "array<double>"}
    if days is not None and history_seconds is None:
        names = days.select(F.col("c").alias("hot")).distinct()
        cut = rows.where("own").join(F.broadcast(names) if days.count() <= BROADCAST else names, F.col("c").eqNullSafe(F.col("hot")), "left_semi").drop("row")
        state = F.array(*[f"state_{x}" for x in (*_STATE, *_FLAG_STATE, *_LAST)]).alias("state")
        ready = ready.unionByName(_states(cut).select("c", "slice", state, F.lit(0).alias("kind")), allowMissingColumns=True)
        ready = ready.unionByName(_memories(cut).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    else:
        ready = ready.withColumns({c: F.lit(None).cast(t) for c, t in extra.items()})
    ready = ready.withColumn("key", F.xxhash64("c", "slice")).repartition("c", "slice").sortWithinPartitions("c", "slice", "kind", "us", "id").drop("c", "slice", "id")
    look_back = None if history_seconds is None else history_seconds * SECOND
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.LongType() if c in _WHOLE else T.DoubleType()) for c in ROLLED]])
    return ready.mapInArrow(lambda batches: _whole_slices(batches, look_back), schema)
