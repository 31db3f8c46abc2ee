"""Sessions of events by gap, by closing events and by length, cut in lockstep over numpy arrays.

Clicks are dealt once into ranges of (client, ts, late, click), so that a client of any size takes as many tasks as its
rows ask for. An island is a client's run of timely clicks without an end or a gap in it; islands don't depend on each
other. A task flattens its islands into arrays; in each step every active island advances by one session, found by one
searchsorted over the composite key of island and time.

Only what lies at a range's borders is left for a second step, one row for each range: the head (the rows before the
first island that is known to begin in the range) and the tail (the open session at its end). The session that is open
where a range begins is the tail of the range before. A range that is all head has no tail of its own; what it makes of
the session it is given is a step function of that session's start (at most the clicks of one session's length), and
such functions are composed by doubling over written tables, in as many rounds as the logarithm of the longest run of
such ranges. The clicks of one session meet in one place at last, as its path asks for; nothing else does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import discard, materialise

#: Clicks of a range at most, as the sample that places the ranges' bounds has it.
RANGE_ROWS = 400_000

SESSION, TAIL, HEAD = 0, 1, 2
#: Bits of a head's flags.
FINAL, LATE = 1, 2


@dataclass(frozen=True)
class Rule:
    """Times in microseconds: from ``gap`` on a pause ends a session, and so does a click over ``length`` after its first."""

    gap: int
    length: int


def next_starts(ts: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Indices of the rows of ``ts`` that begin a session. ``first`` has the first row of each island, ascending; in an
    island ``ts`` ascends. All islands advance by one session a step."""
    if not len(first):
        return first
    last = np.append(first[1:], len(ts)) - 1
    size = [int(x) + length + 1 for x in (ts[last] - ts[first])]
    if len(first) > 1 and sum(size) >= 1 << 62:
        half = len(first) // 2
        cut = first[half]
        return np.concatenate((next_starts(ts[:cut], first[:half], length), cut + next_starts(ts[cut:], first[half:] - cut, length)))
    base = np.concatenate(([0], np.cumsum(np.array(size, dtype=np.int64))[:-1]))
    island = np.repeat(np.arange(len(first)), last - first + 1)
    key = base[island] + (ts - ts[first][island])
    now, found = first, [first]
    while len(now):
        then = np.searchsorted(key, key[now] + length, side="right")
        now = then[then <= last[island[now]]]
        found.append(now)
    return np.sort(np.concatenate(found))


class Rows:
    """The columns of consecutive rows as arrays; ``group`` numbers the clients."""

    def __init__(self, client: pa.Array, click: pa.Array, ts: np.ndarray, cents: np.ndarray, flags: np.ndarray):
        self.client, self.click, self.ts, self.cents = client, click, ts, cents
        self.final, self.timely = (flags & FINAL) > 0, (flags & LATE) == 0
        n = len(ts)
        change = pc.fill_null(pc.not_equal(client.slice(1), client.slice(0, n - 1)), True).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, dtype=bool)
        self.group = np.concatenate((np.zeros(min(n, 1), dtype=np.int64), np.cumsum(change)))

    def slice(self, a: int, b: int) -> Rows:
        flags = self.final[a:b] * FINAL + ~self.timely[a:b] * LATE
        return Rows(self.client.slice(a, b - a), self.click.slice(a, b - a), self.ts[a:b], self.cents[a:b], flags)

    def breaks(self, at: np.ndarray, gap: int) -> np.ndarray:
        """For each timely row of ``at`` but the first whether a session can't go on there: another client, end or gap."""
        a, b = at[:-1], at[1:]
        return (self.group[a] != self.group[b]) | self.final[a] | (self.ts[b] - self.ts[a] >= gap)


def reason(final: bool, pause: int, gap: int) -> str:
    """Why a click begins a session although its client has an earlier one: the first that holds."""
    return "end" if final else "gap" if pause >= gap else "length"


def cut(rows: Rows, at: np.ndarray, starts: np.ndarray, rule: Rule) -> dict[str, pa.Array]:
    """Sessions of the timely rows ``at``; ``starts`` are places in ``at`` and begin with 0. A session that no click of
    its client follows here is closed as if none ever would."""
    stop = np.append(starts[1:], len(at))
    first, last = at[starts], at[stop - 1]
    follows = np.append(first[1:], -1)
    same = np.append(rows.group[first[1:]] == rows.group[last[:-1]], False)
    pause = np.where(same, rows.ts[follows] - rows.ts[last], 0)
    closed = np.select([rows.final[last], ~same, pause >= rule.gap], ["end", "none", "gap"], "length")
    late = np.flatnonzero(~rows.timely)
    of = np.searchsorted(first, late, side="right") - 1
    of = of[(of >= 0) & (rows.group[first[of]] == rows.group[late])]
    clicks = rows.click.take(pa.array(at))
    path = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), clicks.cast(pa.string())), ",")
    return {
        "client": rows.client.take(pa.array(first)),
        "session": rows.click.take(pa.array(first)),
        "start": pa.array(rows.ts[first]),
        "end": pa.array(rows.ts[last]),
        "n_clicks": pa.array(stop - starts),
        "n_late": pa.array(np.bincount(of, minlength=len(starts)).astype(np.int64)),
        "cents": pa.array(np.add.reduceat(rows.cents[at], starts)),
        "closed_by": pa.array(closed.tolist(), pa.string()),
        "path": path,
    }


def _batch(schema: pa.Schema, columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _sessions(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rule: Rule) -> Iterator[pa.RecordBatch]:
    """A range's closed sessions, its head, and its tail unless the range is all head. An empty range has an empty head."""
    part = TaskContext.get().partitionId()
    table = pa.Table.from_batches(list(batches), pa.schema([schema.field("client"), pa.field("ts", pa.int64()), pa.field("flags", pa.int8()), pa.field("click", schema.field("session").type), pa.field("cents", pa.int64())]))
    table = table.combine_chunks()
    col = lambda name: table.column(name).combine_chunks()
    rows = Rows(col("client"), col("click"), col("ts").to_numpy(), col("cents").to_numpy(), col("flags").to_numpy())
    n, flags = len(rows.ts), col("flags").to_numpy()
    own = int(np.searchsorted(rows.group, 0, side="right"))
    at = np.flatnonzero(rows.timely)
    breaks = rows.breaks(at, rule.gap) if len(at) > 1 else np.zeros(0, dtype=bool)
    begins = at[1:][breaks]
    inside = begins[begins < own]
    end = int(inside[0]) if len(inside) else own
    after = "open" if end == n else "over" if end == own else reason(bool(rows.final[at[at < end][-1]]), rule.gap, rule.gap)
    lists = {"h_ts": rows.ts[:end], "h_cents": rows.cents[:end], "h_flags": flags[:end]}
    head = {k: pa.ListArray.from_arrays(pa.array([0, end], pa.int32()), pa.array(v)) for k, v in lists.items()}
    head |= {"h_click": pa.ListArray.from_arrays(pa.array([0, end], pa.int32()), rows.click.slice(0, end)), "after": pa.array([after])}
    head |= {"part": pa.array([part]), "kind": pa.array([HEAD])} | ({"client": rows.client.slice(0, 1)} if n else {})
    yield _batch(schema, head, 1)
    if end == n:
        return
    rest = rows.slice(end, n)
    at = np.flatnonzero(rest.timely)
    if len(at):
        first = np.concatenate(([0], np.flatnonzero(rest.breaks(at, rule.gap)) + 1)).astype(np.int64)
        found = cut(rest, at, next_starts(rest.ts[at], first, rule.length), rule)
        k = len(found["start"])
        open_ = rest.group[at[-1]] == rest.group[-1]
        kind = np.full(k, SESSION)
        kind[-1] = TAIL if open_ else SESSION
        yield _batch(schema, found | {"part": pa.array(np.full(k, part)), "kind": pa.array(kind)}, k)
        if open_:
            return
    # late clicks alone: the last client has no session yet
    yield _batch(schema, {"part": pa.array([part]), "kind": pa.array([TAIL]), "client": rest.client.slice(len(rest.ts) - 1)}, 1)


@dataclass
class State:
    """The session that is open where a range ends; ``start`` None: the last client has none."""

    client: object
    start: int | None = None
    session: object = None
    last: int | None = None
    final: bool = False


@dataclass
class Border:
    """What a range, or a run of them, makes of the open session that it is given.

    ``state`` is set: the same whatever it is given. Else all rows have one client, ``first`` and ``last`` are its timely
    clicks' times (None: there is none, and the session stays as it is), ``fresh`` what it ends with if given none, and a
    session that goes on and starts at s ends as the first of ``exits`` whose entry is over s + length, or else as it was.
    ``complete`` is False where each session meets such an entry, so that what follows adds none.
    """

    client: object
    state: State | None = None
    first: int | None = None
    last: int | None = None
    final: bool = False
    fresh: tuple | None = None
    entries: np.ndarray | None = None
    exits: list | None = None
    complete: bool = True

    def exit_of(self, session: tuple, length: int) -> tuple:
        i = int(np.searchsorted(self.entries, session[0] + length, side="right"))
        return self.exits[i] if i < len(self.entries) else session

    def given(self, s: State | None, rule: Rule) -> State:
        if self.state is not None:
            return self.state
        if self.client is None:
            return s or State(None)
        mine = s if s is not None and s.client == self.client else State(self.client)
        if self.first is None:
            return mine
        goes_on = mine.start is not None and not mine.final and self.first - mine.last < rule.gap
        start, session = self.exit_of((mine.start, mine.session), rule.length) if goes_on else self.fresh
        return State(self.client, start, session, self.last, self.final)


def whole(client, ts: np.ndarray, click: list, final: np.ndarray, rule: Rule) -> Border:
    """The border of a range whose timely clicks (``ts``, ``click``) are one island's."""
    if not len(ts):
        return Border(client)
    n = len(ts)
    then = np.searchsorted(ts, ts + rule.length, side="right")
    out = np.arange(n)
    while len(more := np.flatnonzero(then[out] < n)):
        out[more] = then[out[more]]
    met = min(n, int(then[0]) + 1)
    exits = [(int(ts[i]), click[i]) for i in out[:met]]
    return Border(client, None, int(ts[0]), int(ts[-1]), bool(final[-1]), exits[0], ts[:met], exits, met == n)


def then(a: Border, b: Border, rule: Rule) -> Border:
    """``a`` and after it ``b``."""
    if b.state is not None or a.state is not None:
        return Border(b.client, b.given(a.state, rule))
    if a.client is None or b.client is None:
        return b if a.client is None else a
    if a.client != b.client:
        return Border(b.client, b.given(None, rule))
    if a.first is None or b.first is None:
        return b if a.first is None else a
    if a.final or b.first - a.last >= rule.gap:
        return Border(b.client, b.given(None, rule))
    exits = [b.exit_of(x, rule.length) for x in a.exits]
    entries = a.entries
    if a.complete:
        entries, exits = np.concatenate((a.entries, b.entries)), exits + b.exits
    return Border(b.client, None, a.first, b.last, b.final, b.exit_of(a.fresh, rule.length), entries, exits, a.complete and b.complete)


def _border_type(client: str, click: str) -> str:
    session = f"struct<start: bigint, session: {click}>"
    return f"""known boolean, client {client}, open_start bigint, open_session {click}, open_last bigint, open_final boolean, first bigint, last bigint,
        final boolean, fresh {session}, entries array<bigint>, exits array<{session}>, complete boolean"""


_NAMES = "known client open_start open_session open_last open_final first last final fresh entries exits complete".split()


def _read(row: dict, prefix: str = "") -> Border:
    x = {k: row[prefix + k] for k in _NAMES}
    pair = lambda s: None if s is None else (s["start"], s["session"])
    if x["known"]:
        return Border(x["client"], State(x["client"], x["open_start"], x["open_session"], x["open_last"], bool(x["open_final"])))
    return Border(x["client"], None, x["first"], x["last"], bool(x["final"]), pair(x["fresh"]), np.array(x["entries"] or [], dtype=np.int64), [pair(s) for s in x["exits"] or []], bool(x["complete"]))


def _written(b: Border) -> dict:
    s = b.state
    if s is not None:
        return dict.fromkeys(_NAMES) | {"known": True, "client": s.client, "open_start": s.start, "open_session": s.session, "open_last": s.last, "open_final": s.final}
    pair = lambda x: None if x is None else {"start": x[0], "session": x[1]}
    own = {"known": False, "client": b.client, "first": b.first, "last": b.last, "final": b.final, "fresh": pair(b.fresh), "complete": b.complete}
    return dict.fromkeys(_NAMES) | own | {"entries": None if b.entries is None else b.entries.tolist(), "exits": b.exits and [pair(x) for x in b.exits]}


def _head(row: dict) -> Rows:
    n = len(row["h_ts"])
    click, client = pa.array(row["h_click"]), pa.array([row["client"]] * n)
    return Rows(client, click, np.array(row["h_ts"], dtype=np.int64), np.array(row["h_cents"], dtype=np.int64), np.array(row["h_flags"], dtype=np.int8))


def _whole_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            rows = _head(row)
            at = np.flatnonzero(rows.timely)
            border = whole(row["client"], rows.ts[at], [row["h_click"][j] for j in at], rows.final[at], rule)
            yield pa.RecordBatch.from_pylist([_written(border) | {"part": row["part"]}], schema=schema)


def _compose(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows of a border and, as b_..., the border before it; without one there is no session to be given."""
    for batch in batches:
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            own = _read(row)
            both = Border(own.client, own.given(None, rule)) if row["b_part"] is None else then(_read(row, "b_"), own, rule)
            yield pa.RecordBatch.from_pylist([_written(both) | {"part": row["part"]}], schema=schema)


def _incoming(first: DataFrame, client: str, click: str, rule: Rule) -> DataFrame:
    """Rows (part, border): the open session with which each range ends."""
    columns = f"part int, {_border_type(client, click)}"
    to_arrow = _arrow_schema(first.sparkSession, columns)
    tails = first.where(F.col("kind") == TAIL).select(
        "part", F.lit(True).alias("known"), "client", F.col("start").alias("open_start"), F.col("session").alias("open_session"), F.col("end").alias("open_last"), (F.col("closed_by") == "end").alias("open_final")
    )
    heads = first.where((F.col("kind") == HEAD) & (F.col("after") == "open")).select("part", "client", "h_ts", "h_click", "h_cents", "h_flags")
    found = heads.mapInArrow(lambda batches: _whole_rows(batches, to_arrow, rule), columns)
    now = materialise(tails.unionByName(found, allowMissingColumns=True))
    step = 1
    while now.where("not known").limit(1).count():
        before = now.select(F.col("part").alias("b_part"), (F.col("part") + step).alias("_to"), *[F.col(c).alias(f"b_{c}") for c in _NAMES])
        left = now.where("not known").join(before.hint("merge"), F.col("part") == F.col("_to"), "left").drop("_to")
        new = left.mapInArrow(lambda batches: _compose(batches, to_arrow, rule), columns)
        now, step = materialise(now.where("known").unionByName(new), now), 2 * step
    return now


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _heads(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rule: Rule) -> Iterator[pa.RecordBatch]:
    """The parts of sessions that a range's head has, its open session known. The last part says what closed a session."""
    for batch in batches:
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            rows, part = _head(row), row["part"]
            at = np.flatnonzero(rows.timely)
            ts, n = rows.ts[at], len(at)
            given = row["open_start"] if row["known"] and row["open_client"] == row["client"] else None
            began, open_final, why = 0, bool(row["open_final"]), None
            if given is not None and n:
                pause = int(ts[0]) - row["open_last"]
                if open_final or pause >= rule.gap or ts[0] - given > rule.length:
                    why = reason(open_final, pause, rule.gap)
                else:
                    began = int(np.searchsorted(ts, given + rule.length, side="right"))
                    why = "length" if began < n else None
            out = None
            if began < n:
                starts = next_starts(ts[began:], np.array([0]), rule.length)
                new = at[began:]
                own = rows.slice(int(new[0]), len(rows.ts))
                out = cut(own, new - new[0], starts, rule)
                closed = out["closed_by"].to_pylist()
                closed[-1] = row["after"] if row["after"] in ("end", "gap") else closed[-1]
                out["closed_by"] = pa.array(closed, pa.string())
                out["part"] = pa.array(np.full(len(starts), part))
            if given is not None:
                stop = int(at[began]) if began < n else len(rows.ts)
                held = at[:began]
                last_final = bool(rows.final[held[-1]]) if len(held) else open_final
                if why is None:
                    why = row["after"] if row["after"] in ("end", "gap") and n else "end" if last_final else "none"
                one = {
                    "client": pa.array([row["client"]]), "session": pa.array([row["open_session"]]), "start": pa.array([given]), "part": pa.array([part]),
                    "end": pa.array([int(rows.ts[held[-1]]) if len(held) else row["open_last"]]), "n_clicks": pa.array([len(held)]), "n_late": pa.array([int((~rows.timely[:stop]).sum())]),
                    "cents": pa.array([int(rows.cents[held].sum())]), "closed_by": pa.array([why]), "path": pa.array([",".join(str(row["h_click"][j]) for j in held) if len(held) else None], pa.string()),
                }
                yield _batch(schema, one, 1)
            if out is not None:
                yield _batch(schema, out, len(out["start"]))


def sessionise(
    clicks: DataFrame, gap_s: int = 900, length_s: int = 3600, late_s: int = 900, final_kinds: tuple[str, ...] = ("purchase", "signup"), final_value: float = 60.0,
    id_col: str = "click_id", client_col: str = "client_id", time_col: str = "ts", arrival_col: str = "arrived_at", kind_col: str = "kind", value_col: str = "value",
) -> DataFrame:
    """Sessions of clicks: (client, session, start, end, n_clicks, n_late, cents, closed_by, path), times in microseconds,
    path the click ids by time and id, comma-joined.

    A click belongs to its client's session unless the one before is final (``final_kinds`` of at least ``final_value``)
    or at least ``gap_s`` earlier, or the session's first is over ``length_s`` earlier. Clicks that arrive over ``late_s``
    after their time are late: they join no session and are counted in the one that began last at or before them, if any.

    Rows without a click id, client or time take no part; of rows that repeat a click id the least one (by time, client,
    then late, final and value) counts. A null arrival is timely, a null kind or value isn't final, a null value is 0
    cents, NaN too; values past 64 bits are the largest such number. Equal times are ordered by click id. A client with
    late clicks alone has no session. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rule = Rule(gap_s * 1_000_000, length_s * 1_000_000)
    late = F.coalesce(F.col(arrival_col) > F.col(time_col) + F.expr(f"interval '{late_s}' second"), F.lit(False))
    final = F.coalesce(F.col(kind_col).isin(*final_kinds) & (F.col(value_col) >= final_value), F.lit(False))
    there = clicks.where(F.col(id_col).isNotNull() & F.col(client_col).isNotNull() & F.col(time_col).isNotNull())
    flags = (final.cast("int") * FINAL + late.cast("int") * LATE).cast("byte")
    cents = F.coalesce(F.floor(100 * F.col(value_col).cast("double") + 0.5), F.lit(0)).cast("long")
    one = there.select(F.col(id_col).alias("click"), F.struct(F.col(time_col).alias("ts"), F.col(client_col).alias("client"), flags.alias("flags"), cents.alias("cents")).alias("r"))
    one = one.groupBy("click").agg(F.min("r").alias("r")).select("r.client", "r.ts", F.col("r.flags"), "click", "r.cents")
    spark = clicks.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-clicks.count() // RANGE_ROWS))
    key = ["client", "ts", F.col("flags").bitwiseAND(LATE), "click"]
    dealt = one.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    client, click = (dict(one.dtypes)[c] for c in ("client", "click"))
    session = f"part int, client {client}, session {click}, start bigint, end bigint, n_clicks bigint, n_late bigint, cents bigint, closed_by string, path string"
    ddl = f"kind int, {session}, after string, h_ts array<bigint>, h_click array<{click}>, h_cents array<bigint>, h_flags array<tinyint>"
    schema, part_schema = _arrow_schema(spark, ddl), _arrow_schema(spark, session)
    first = materialise(dealt.mapInArrow(lambda batches: _sessions(_plain(batches), schema, rule), ddl))

    given = _incoming(first, client, click, rule)
    heads = first.where(F.col("kind") == HEAD).select("part", "client", "after", "h_ts", "h_click", "h_cents", "h_flags")
    open_ = given.select((F.col("part") + 1).alias("part"), "known", F.col("client").alias("open_client"), "open_start", "open_session", "open_last", "open_final")
    pieces = heads.join(open_.hint("merge"), "part", "left").mapInArrow(lambda batches: _heads(batches, part_schema, rule), session)
    columns = "client session start end n_clicks n_late cents closed_by path".split()
    tails = first.where((F.col("kind") == TAIL) & F.col("start").isNotNull()).select("part", *columns)
    joined = (
        tails.unionByName(pieces)
        .groupBy("session")
        .agg(
            F.min("client").alias("client"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_clicks").alias("n_clicks"), F.sum("n_late").alias("n_late"), F.sum("cents").alias("cents"),
            F.max_by("closed_by", "part").alias("closed_by"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("part", "path")))), lambda x: x["path"]), ",").alias("path"),
        )
    )
    closed = first.where(F.col("kind") == SESSION).select(*columns)
    return closed.unionByName(joined.select(*columns))


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times as integers: microseconds since 1970, without a zone as if in UTC."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.timestamp("us")).cast(pa.int64()) if pa.types.is_timestamp(b.column(1).type) else b.column(1).cast(pa.int64()), b.column(2), b.column(3), b.column(4)], names=["client", "ts", "flags", "click", "cents"])
