"""Parabolic stop-and-reverse, exact and without one task per symbol.

The stop depends on every earlier bar, but its state (direction, stop, extreme,
acceleration) forgets: two runs that reverse on the same bar go on identically.
So every slice runs at once, started from its halo instead of its true history,
and leaves one row: the state it was entered with and the state it left.  A
slice is right when its entry equals its predecessor's exit; the others run
again from that exit.  Rounds go on until all entries match, which makes the
result exact; a slice that starts the series is right from the outset, so each
round settles more.  Only these rows of states are written in a round.  The
bars lie stored as one array per slice, are read by the slices that run again,
and get their stops once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators.bars import SLICE_ROWS, series, slice_bars
from tickloom.session import stage

# Start, step and limit of the acceleration factor.
ACCELERATION, STEP, LIMIT = 0.02, 0.02, 0.20
# Bars a slice runs before its own first bar; reversals come far more often.
HALO = 256
# Stops are gathered in runs of this many, so that no long array is copied at every bar.
CHUNK = 64

PLACE = ["symbol", "slice"]


def _state(rising: str, stop: str, extreme: str, factor: str) -> str:
    return f"named_struct('rising', {rising}, 'stop', {stop}, 'extreme', {extreme}, 'factor', {factor})"


def _start(bars: str) -> str:
    """The state the first two of ``bars`` set; a single one falls from its high."""
    up = f"{bars}[1].c > {bars}[0].c"
    two = _state(up, f"IF({up}, {bars}[0].l, {bars}[0].h)", f"IF({up}, {bars}[1].h, {bars}[1].l)", f"{ACCELERATION}D")
    one = _state("false", f"{bars}[0].h", f"{bars}[0].l", f"{ACCELERATION}D")
    return f"IF(size({bars}) > 1, {two}, {one})"


def _next(s: str, e: str) -> str:
    """The state after bar ``e``; ``floor`` and ``ceil`` bound the stop by the two bars before."""
    moved = f"({s}.stop + {s}.factor * ({s}.extreme - {s}.stop))"
    stop = f"IF({s}.rising, least({moved}, {e}.floor), greatest({moved}, {e}.ceil))"
    quicker = f"least({s}.factor + {STEP}D, {LIMIT}D)"
    return (
        f"aggregate(cast(array() AS array<int>), {stop}, (stop, none) -> stop, stop -> CASE "
        f"WHEN {s}.rising AND {e}.l < stop THEN {_state('false', f'{s}.extreme', f'{e}.l', f'{STEP}D')} "
        f"WHEN {s}.rising AND {e}.h > {s}.extreme THEN {_state('true', 'stop', f'{e}.h', quicker)} "
        f"WHEN NOT {s}.rising AND {e}.h > stop THEN {_state('true', f'{s}.extreme', f'{e}.h', f'{STEP}D')} "
        f"WHEN NOT {s}.rising AND {e}.l < {s}.extreme THEN {_state('false', 'stop', f'{e}.l', quicker)} "
        f"ELSE {_state(f'{s}.rising', 'stop', f'{s}.extreme', f'{s}.factor')} END)"
    )


def _run(bars: str, entry: str) -> Column:
    """The state after all of ``bars``."""
    return F.expr(f"aggregate({bars}, {entry}, (s, e) -> {_next('s', 'e')})")


def _stops(bars: str, entry: str) -> str:
    """The stop of each of ``bars``."""
    none = "cast(array() AS array<double>)"
    one = f"aggregate(cast(array() AS array<int>), {_next('s.state', 'e')}, (x, none) -> x, x -> named_struct('state', x, 'out', concat(s.out, array(x.stop))))"
    inner = f"aggregate(slice({bars}, k * {CHUNK} + 1, {CHUNK}), named_struct('state', t.state, 'out', {none}), (s, e) -> {one})"
    both = f"aggregate(cast(array() AS array<int>), {inner}, (x, none) -> x, x -> named_struct('state', x.state, 'out', concat(t.out, x.out)))"
    chunks = f"sequence(0, (size({bars}) - 1) div {CHUNK})"
    return f"IF(size({bars}) = 0, {none}, aggregate({chunks}, named_struct('state', {entry}, 'out', {none}), (t, k) -> {both}, t -> t.out))"


# A slice's own bars that move the stop: the first two of a series only set the start.
MOVING = "slice(days, greatest(begin, IF(begin = 0, 2, 0)) + 1, size(days))"


def by_slice(sliced: DataFrame, **totals: Column) -> DataFrame:
    """One row per slice with own bars, stored: symbol, slice, begin (bars of halo), days (the bars in order) and ``totals`` over them.

    ``sliced`` needs ``HALO`` bars of halo for speed, three (and slices of three) for correctness.
    """
    before = {"floor": F.least(F.lag("l").over(series()), F.lag("l", 2).over(series())), "ceil": F.greatest(F.lag("h").over(series()), F.lag("h", 2).over(series()))}
    columns = ["i", *[c for c in sliced.columns if c not in ("i", *PLACE)], *before]
    # A halo that reaches past a slice's end belongs to no own bar of it.
    found = sliced.withColumns(before).groupBy(*PLACE).agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("days"), F.count_if(~F.col("own")).cast("int").alias("begin"),
        F.count_if("own").alias("_own"), *[total.alias(name) for name, total in totals.items()],
    )
    return stage(found.filter("_own > 0").drop("_own"))


def settled(slices: DataFrame) -> DataFrame:
    """Entry and exit state of every slice: symbol, slice, entry, exit."""
    guess = F.when(F.col("begin") == 0, F.expr(_start("days"))).otherwise(_run("slice(days, 3, begin - 2)", _start("days")))
    states = stage(slices.select(*PLACE, guess.alias("entry"), "days", "begin").select(*PLACE, "entry", _run(MOVING, "entry").alias("exit")))
    while True:
        left = states.select("symbol", (F.col("slice") + 1).alias("slice"), F.col("exit").alias("given"))
        broken = stage(states.join(left, PLACE).filter(~F.col("entry").eqNullSafe(F.col("given"))).select(*PLACE, F.col("given").alias("entry")))
        if broken.isEmpty():
            return states
        again = slices.join(broken, PLACE).select(*PLACE, "entry", _run(MOVING, "entry").alias("exit"))
        states = stage(states.join(broken, PLACE, "left_anti").unionByName(again))


def with_stops(slices: DataFrame, states: DataFrame, **arrays: Column) -> DataFrame:
    """The bars of all slices, halo too, with ``sar`` and ``p_sar`` (null on halo bars), further columns of ``states`` and an element of each of ``arrays``.

    Rows stay where their slice is: no exchange follows the join.
    """
    scalars = [c for c in states.columns if c not in (*PLACE, "entry", "exit")]
    first = "array_repeat(days[0].l, IF(begin = 0, least(2, size(days)), 0))"
    stops = F.expr(f"concat(array_repeat(cast(NULL AS double), begin), {first}, {_stops(MOVING, 'entry')})")
    zipped = F.arrays_zip(F.col("days").alias("day"), stops.alias("sar"), *[a.alias(name) for name, a in arrays.items()])
    # The stop a slice enters with is the one its predecessor's last bar showed.
    given = F.when(F.col("slice") > 0, F.col("entry.stop")).alias("_given")
    rows = slices.join(states.drop("exit"), PLACE).select(*PLACE, given, *scalars, F.explode(zipped).alias("z"))
    rows = rows.select(*PLACE, "_given", *scalars, *[F.col(f"z.{name}") for name in ("day", "sar", *arrays)])
    flat = rows.select(*PLACE, "day.*", "_given", F.round("sar", 4).alias("sar"), *scalars, *arrays).drop("floor", "ceil")
    before = F.coalesce(F.lag("sar").over(series()), F.round("_given", 4))
    return flat.withColumn("p_sar", F.when(F.col("own"), before)).drop("_given")


def parabolic_sar(sliced: DataFrame) -> DataFrame:
    """symbol, slice, i, ``sar`` (four places) and the bar before's ``p_sar`` of every own bar."""
    slices = by_slice(sliced.select(*PLACE, "own", "i", "h", "l", "c"))
    return with_stops(slices, settled(slices)).filter("own").select(*PLACE, "i", "sar", "p_sar")


def latest_stops(numbered: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """symbol, ``sar`` and ``p_sar`` of each symbol's last bar: all slices give their states, the last ones alone their stops."""
    slices = by_slice(slice_bars(numbered, HALO, slice_rows).select(*PLACE, "own", "i", "h", "l", "c"))
    last = slices.groupBy("symbol").agg(F.max("slice").alias("slice"))
    stops = with_stops(slices.join(last, PLACE), settled(slices))
    return stops.groupBy("symbol").agg(F.max_by(F.struct("sar", "p_sar"), "i").alias("_s")).select("symbol", "_s.*")
