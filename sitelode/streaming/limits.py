"""Stateful limits on event streams, and the same folds over a batch.

The folds depend on the order of events, so each key's events are folded one at a time in (ts, event_id)
order: in a batch over partitions sorted so, in a stream by a stateful operator that keeps the same small
state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..registry import query, table

#: Requests that a host may make in a sliding window of seconds; rejected ones don't count.
BUDGET, WINDOW = 30, 600
#: Requests in a window that a client's first event opens.
CLIENT_BUDGET, CLIENT_WINDOW = 20, 3600
#: Failures that open a breaker, seconds until it is tried again, successes that close it.
FAILURES, COOL, SUCCESSES = 5, 60, 3


class SlidingBudget:
    """Accepts while fewer than ``budget`` accepted events lie in the last ``window`` seconds."""

    def __init__(self, budget: int = BUDGET, window: float = WINDOW, kept=()):
        self.budget, self.window, self.kept = budget, window, deque(kept)

    def __call__(self, at: float) -> bool:
        while self.kept and self.kept[0] <= at - self.window:
            self.kept.popleft()
        if len(self.kept) >= self.budget:
            return False
        self.kept.append(at)
        return True

    def pack(self) -> list[float]:
        return list(self.kept)

    def unpack(self, values: list[float]) -> None:
        self.kept = deque(values)


class FirstEventWindow:
    """Accepts up to ``budget`` events in a window that the first event after the last window opens."""

    def __init__(self, budget: int = CLIENT_BUDGET, window: float = CLIENT_WINDOW):
        self.budget, self.window, self.start, self.n = budget, window, None, 0

    def __call__(self, at: float) -> bool:
        if self.start is None or at - self.start >= self.window:
            self.start, self.n = at, 0
        self.n += 1
        return self.n <= self.budget

    def pack(self) -> list[float]:
        return [] if self.start is None else [self.start, float(self.n)]

    def unpack(self, values: list[float]) -> None:
        self.start, self.n = (values[0], int(values[1])) if values else (None, 0)


class Gcra:
    """A rate of ``rate`` events a second with a burst, by the theoretical arrival time."""

    def __init__(self, rate: float = 0.001, burst: int = 3):
        self.step, self.slack, self.tat = 1 / rate, (burst - 1) / rate, None

    def __call__(self, at: float) -> bool:
        tat = at if self.tat is None else max(self.tat, at)
        if tat - at > self.slack:
            return False
        self.tat = tat + self.step
        return True

    def pack(self) -> list[float]:
        return [] if self.tat is None else [self.tat]

    def unpack(self, values: list[float]) -> None:
        self.tat = values[0] if values else None


class Gcras:
    """A cell for each domain and one for all together: an event passes if both let it, and only then counts in either.

    A domain's crawl delay takes the place of its rate, with a burst of twice the events a second, one at least.
    """

    def __init__(self, rate: float, burst: int, all_rate: float, all_burst: int, delays: dict[object, float] | None = None):
        self.rate, self.burst, self.delays = rate, burst, delays or {}
        self.cells: dict[object, Gcra] = {}
        self.all = Gcra(all_rate, all_burst)

    def cell(self, domain: object) -> Gcra:
        if domain not in self.cells:
            delay = self.delays.get(domain)
            self.cells[domain] = Gcra(self.rate, self.burst) if not delay else Gcra(1 / delay, max(1, int(2 / delay)))
        return self.cells[domain]

    def __call__(self, at: float, domain: object) -> bool:
        own = self.cell(domain)
        before = self.all.tat
        if not self.all(at):
            return False
        if not own(at):
            self.all.tat = before
            return False
        return True


class Breaker:
    """closed, open or half-open after each outcome."""

    def __init__(self, failures: int = FAILURES, cool: float = COOL, successes: int = SUCCESSES):
        self.failures, self.cool, self.successes = failures, cool, successes
        self.state, self.bad, self.good, self.since = "closed", 0, 0, 0.0

    def __call__(self, at: float, ok: bool) -> str:
        if self.state == "open" and at - self.since >= self.cool:
            self.state, self.good = "half-open", 0
        if self.state == "open":
            return self.state
        if ok:
            self.bad, self.good = 0, self.good + 1
            if self.state == "half-open" and self.good >= self.successes:
                self.state = "closed"
        else:
            self.bad += 1
            if self.state == "half-open" or self.bad >= self.failures:
                self.state, self.since, self.bad = "open", at, 0
        return self.state

    def pack(self) -> list[float]:
        return [float(("closed", "open", "half-open").index(self.state)), float(self.bad), float(self.good), self.since]

    def unpack(self, values: list[float]) -> None:
        self.state, self.bad, self.good, self.since = ("closed", "open", "half-open")[int(values[0])], int(values[1]), int(values[2]), values[3]


def folded(events: DataFrame, make, out: str, kind: str, outcome: bool = False) -> DataFrame:
    """event_id, key and what the fold that ``make`` starts for each key says of each event.

    Events come to a task sorted by key and time and go through in batches, so a crowded key costs time but
    no memory: only the fold's own state is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = step = None
        for batch in batches:
            said = []
            for key, at, ok in zip(batch["key"], batch["at"], batch["ok"]):
                if step is None or key != now:
                    now, step = key, make()
                said.append(step(at, ok) if outcome else step(at))
            batch[out] = said
            yield batch[["event_id", "key", out]]

    dealt = events.repartition("key").sortWithinPartitions("key", "at", "event_id")
    return dealt.mapInPandas(run, f"event_id long, key long, {out} {kind}")


def _events(spark, sf_dir, keys: int) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % keys).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at0"), (F.col("event_id") % 3 != 0).alias("ok")).withColumn("at", F.col("at0") / 1e6).drop("at0")


def _replay(keys: int, start: str, columns: str, step: str, out: str) -> str:
    """A recursive query that folds each key's events one after another. ``start``: the first state; ``step``: the next, from it and e."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id % {keys} AS key, epoch_us(ts) / CAST(1e6 AS DOUBLE) AS at_s, event_id % 3 <> 0 AS ok, row_number() OVER (PARTITION BY user_id % {keys} ORDER BY ts, event_id) AS i FROM events),
    s(key, i, event_id, {columns}, {out}) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), {start} FROM e UNION ALL {step})
    SELECT event_id, key, {out} FROM s WHERE i > 0"""


_NEXT = "FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1"


@query(
    "host_budget_sliding",
    _replay(3, "CAST([] AS DOUBLE[]), true", "kept", f"SELECT key, i, event_id, CASE WHEN len(live) < 20 THEN list_append(live, at_s) ELSE live END, len(live) < 20 FROM (SELECT e.key, e.i, e.event_id, e.at_s, list_filter(s.kept, lambda t: t > e.at_s - 7200) AS live {_NEXT})", "allowed"),
)
def host_budget_sliding(spark, sf_dir):
    return folded(_events(spark, sf_dir, 3), lambda: SlidingBudget(20, 7200), "allowed", "boolean")


@query(
    "ip_window",
    _replay(20, "CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), true", "opened, n", f"SELECT key, i, event_id, opened, n, n <= 3 FROM (SELECT e.key, e.i, e.event_id, CASE WHEN s.opened IS NULL OR e.at_s - s.opened >= 3600 THEN e.at_s ELSE s.opened END AS opened, CASE WHEN s.opened IS NULL OR e.at_s - s.opened >= 3600 THEN 1 ELSE s.n + 1 END AS n {_NEXT})", "allowed"),
)
def ip_window(spark, sf_dir):
    return folded(_events(spark, sf_dir, 20), lambda: FirstEventWindow(3, 3600), "allowed", "boolean")


@query(
    "gcra_replay",
    _replay(20, "CAST(NULL AS DOUBLE), true", "tat", f"SELECT key, i, event_id, CASE WHEN due - at_s > 2000 THEN tat ELSE due + 1000 END, NOT due - at_s > 2000 FROM (SELECT e.key, e.i, e.event_id, e.at_s, s.tat, coalesce(greatest(s.tat, e.at_s), e.at_s) AS due {_NEXT})", "allowed"),
)
def gcra_replay(spark, sf_dir):
    return folded(_events(spark, sf_dir, 20), Gcra, "allowed", "boolean")


@query(
    "breaker_states",
    _replay(
        20,
        "CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), 'closed'",
        "bad, good, since",
        f"""SELECT key, i, event_id,
          CASE WHEN st = 'open' THEN bad WHEN ok THEN 0 WHEN st = 'half-open' OR bad + 1 >= 2 THEN 0 ELSE bad + 1 END,
          CASE WHEN st <> 'open' AND ok THEN good + 1 ELSE good END,
          CASE WHEN st <> 'open' AND NOT ok AND (st = 'half-open' OR bad + 1 >= 2) THEN at_s ELSE since END,
          CASE WHEN st = 'open' THEN st WHEN ok THEN CASE WHEN st = 'half-open' AND good + 1 >= 2 THEN 'closed' ELSE st END WHEN st = 'half-open' OR bad + 1 >= 2 THEN 'open' ELSE st END
        FROM (SELECT e.key, e.i, e.event_id, e.at_s, e.ok, s.bad, s.since, CASE WHEN s.state = 'open' AND e.at_s - s.since >= 3600 THEN 'half-open' ELSE s.state END AS st, CASE WHEN s.state = 'open' AND e.at_s - s.since >= 3600 THEN 0 ELSE s.good END AS good {_NEXT})""",
        "state",
    ),
)
def breaker_states(spark, sf_dir):
    return folded(_events(spark, sf_dir, 20), lambda: Breaker(2, 3600, 2), "state", "string", True)


@query("daily_budget", "SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 200 AS allowed FROM events")
def daily_budget(spark, sf_dir, budget=200):
    """The first events of each UTC day, up to the budget."""
    return within_daily(table(spark, sf_dir, "events").select("event_id", "ts"), budget)


def within_daily(events: DataFrame, budget: int) -> DataFrame:
    """event_id and allowed, for ``events`` (event_id, ts): is an event among its UTC day's first ``budget``, by time and id?

    Minutes are counted first; only the events of the minute in which a day's budget runs out are numbered.
    """
    rows = events.select("event_id", "ts", F.col("ts").cast("date").alias("day"), F.date_trunc("minute", "ts").alias("minute"))
    sofar = F.sum("n").over(Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1))
    minutes = rows.groupBy("day", "minute").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(sofar, F.lit(0)))
    met = rows.join(minutes, ["day", "minute"])
    whole = met.where((F.col("before") >= budget) | (F.col("before") + F.col("n") <= budget)).select("event_id", (F.col("before") < budget).alias("allowed"))
    edge = met.where((F.col("before") < budget) & (F.col("before") + F.col("n") > budget))
    place = F.row_number().over(Window.partitionBy("day", "minute").orderBy("ts", "event_id"))
    return whole.unionByName(edge.select("event_id", (F.col("before") + place <= budget).alias("allowed")))


def folded_stream(events: DataFrame, make, out: str, kind: str, outcome: bool = False) -> DataFrame:
    """``folded`` on a stream (event_id, key, ts, and ok if outcomes count): the state of each key is what its fold packs.

    A micro-batch's events of a key are taken in order of time; the stream is expected to bring earlier
    batches first.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = make()
        if state.exists:
            fold.unpack(list(state.get[0]))
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        times = [t.timestamp() for t in rows["ts"]]
        rows[out] = [fold(t, ok) for t, ok in zip(times, rows["ok"])] if outcome else [fold(t) for t in times]
        state.update((fold.pack(),))
        yield rows[["event_id", "key", out]]

    return events.groupBy("key").applyInPandasWithState(step, f"event_id long, key long, {out} {kind}", "packed array<double>", "append", GroupStateTimeout.NoTimeout)


def sliding_stream(events: DataFrame, budget: int = BUDGET, window: int = WINDOW) -> DataFrame:
    """The sliding budget on a stream with event_id, key and ts: state is the accepted times in the window."""
    return folded_stream(events, lambda: SlidingBudget(budget, window), "allowed", "boolean")


def usage_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Daily usage on a stream: each event once, days closed by the watermark."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("total")).select(F.col("w.start").alias("day_utc"), "event_type", "total")


def first_seen_stream(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen before, on a stream."""
    return events.withWatermark("ts", late).dropDuplicates([key])
