"""Streams with state by series: a log of revisions, and alerts that need no new rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOG = "series_id string, week_idx long, version long, old double, new double, groups array<double>, note string"
ALERTS = "series_id string, last_idx long, at timestamp, kind string"
#: Transitions by state need this store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _label(idx: int) -> str:
    y, w, _ = date.fromordinal(idx * 7 + 1).isocalendar()
    return f"{y}-W{w:02d}"


def _implied(value: float, pct: float) -> float:
    return value / (1 + pct / 100)


class RevisionLog(StatefulProcessor):
    """Keeps each series' reports by week. A report revises the week before, and is revised by the week after, whichever comes later."""

    def __init__(self, tolerance: float):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weeks = handle.getMapState("weeks", "week_idx long", "value double, change_pct double, groups array<double>, groups_change_pct array<double>, revised boolean")

    def _get(self, idx: int):
        return self.weeks.getValue((idx,)) if self.weeks.containsKey((idx,)) else None

    def _entry(self, idx: int, version: int) -> dict | None:
        """What is to be logged of week idx now: a revision, or that there is none any more."""
        own, after = self._get(idx), self._get(idx + 1)
        if own is None:
            return None
        value, change, groups, groups_change, was = own
        new = _implied(after[0], after[1]) if after is not None and after[1] is not None and after[1] != -100 else None
        off = new is not None and value is not None and value != 0 and abs(new / value - 1) > self.tolerance
        if off != was:
            self.weeks.updateValue((idx,), (value, change, groups, groups_change, off))
        if not off:
            return {"week_idx": idx, "version": version, "old": value} if was else None
        fit = after[2] is not None and after[3] is not None and len(after[2]) == len(after[3])
        revised = [float(round(_implied(g, c))) for g, c in zip(after[2], after[3], strict=True)] if fit else groups
        return {"week_idx": idx, "version": version, "old": value, "new": float(round(new)), "groups": revised, "note": f"revised by the report of {_label(idx + 1)}, before {round(value)}"}

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        reports = sorted((r for chunk in rows for r in chunk.to_dict("records")), key=lambda r: r["version"])
        plain = lambda x: None if x is None or (isinstance(x, float) and x != x) else float(x)
        listed = lambda x: None if x is None or isinstance(x, float) else [float(v) for v in x]
        out = []
        for r in reports:
            idx, version = int(r["week_idx"]), int(r["version"])
            old = self._get(idx)
            self.weeks.updateValue((idx,), (plain(r["value"]), plain(r["change_pct"]), listed(r["groups"]), listed(r["groups_change_pct"]), old is not None and old[4]))
            out += [e for e in (self._entry(idx - 1, version), self._entry(idx, version)) if e]
        names = ["week_idx", "version", "old", "new", "groups", "note"]
        yield pd.DataFrame({"series_id": pd.Series([key[0]] * len(out), dtype="object"), **{n: pd.Series([e.get(n) for e in out], dtype="int64" if n in names[:2] else "float64" if n in names[2:4] else "object") for n in names}})

    def close(self) -> None:
        pass


def revision_log(reports: DataFrame, tolerance: float) -> DataFrame:
    """A log of revisions (LOG) of a stream of official reports (series_id, week_idx, version, value, change_pct, groups, groups_change_pct).

    version numbers reports as they came; rows of a batch are taken by it, so that the log doesn't depend on how rows came
    in batches. Reports may come any number of weeks late, and again; the last one of a week counts. new is null where
    a revision holds no longer. The newest entry of each week with a new value is what a batch over all reports gives.
    """
    return reports.groupBy("series_id").transformWithStateInPandas(RevisionLog(tolerance), LOG, "append", "none")


class StaleWatch(StatefulProcessor):
    """Keeps each series' latest week, and a timer for when it will be too old."""

    def __init__(self, weeks: int):
        self.weeks = weeks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "week_idx long, alerted boolean")

    def _due(self, idx: int) -> int:
        """Milliseconds of the Monday on which the week is so many weeks behind."""
        return ((idx + self.weeks) * 7 + 1 - date(1970, 1, 1).toordinal()) * 86_400_000

    def _frame(self, key, rows: list):
        import pandas as pd

        return pd.DataFrame({"series_id": pd.Series([key[0]] * len(rows), dtype="object"), "last_idx": pd.Series([r[0] for r in rows], dtype="int64"), "at": pd.to_datetime([r[1] for r in rows], unit="ms"), "kind": pd.Series([r[2] for r in rows], dtype="object")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        reports = sorted((r["at"].value // 1_000_000, int(r["week_idx"])) for chunk in rows for r in chunk.to_dict("records"))
        last, alerted = self.last.get() if self.last.exists() else (None, False)
        out = []
        for at, idx in reports:
            if last is not None and not alerted and at > self._due(last):  # due between two reports of one batch
                out.append((last, self._due(last), "alert"))
                alerted = True
            if last is None or idx > last:
                last = idx
                if alerted and at <= self._due(last):
                    out.append((last, at, "withdrawn"))
                    alerted = False
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((last, alerted))
        if not alerted:
            self.handle.registerTimer(self._due(last))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        last, alerted = self.last.get()
        self.last.update((last, True))
        yield self._frame(key, [] if alerted else [(last, self._due(last), "alert")])

    def close(self) -> None:
        pass


def stale_alerts(reports: DataFrame, weeks: int = 4, clock: str = "eventTime") -> DataFrame:
    """Alerts (ALERTS) of a stream of reports (series_id, week_idx, at): one when a series' latest week is so many weeks behind, and its withdrawal with the report that ends it.

    at is when a report came. With the clock eventTime time goes on with the reports of all series, so rows of a series of
    their own can drive it; with processingTime by the wall clock, without any rows. Rows of a batch are taken by at, and what falls due
    between two of them is told too, so that alerts don't depend on how rows came in batches.
    """
    timed = reports.withWatermark("at", "0 seconds") if clock == "eventTime" else reports
    return timed.groupBy("series_id").transformWithStateInPandas(StaleWatch(weeks), ALERTS, "append", clock)
