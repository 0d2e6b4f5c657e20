"""Staleness of quote feeds from keyed state: gap statistics per arrival, and silence.

``QuoteGaps`` keeps the newest stamp and the gaps of the last window of a symbol.
``Silence`` needs no rows to notice that a feed has stopped: it asks for a timer at
the instants at which the feed's state would change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.config import StalenessConfig
from tapeloom.functions.sorted_window import sliding_quantiles
from tapeloom.streaming.processors import in_groups

US = 1_000_000


def _us(stamps: pd.Series) -> np.ndarray:
    return stamps.astype("datetime64[us]").astype("int64").to_numpy()


class QuoteGaps(StatefulProcessor):
    """Gap, its trailing p50 and p95, age and ok / pause / kill class of every arriving quote.

    Quotes are taken in (recv_ts, seq) order. An out-of-order stamp gives no gap and
    does not move the newest stamp. State: that stamp, and the gaps that arrived
    within the window, which are rewritten once per micro-batch.
    """

    OUT = "symbol string, seq long, recv_ts timestamp, quote_ts timestamp, newest timestamp, gap_s double, gap_p50 double, gap_p95 double, age_s double, status string"

    def __init__(self, cfg: StalenessConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us long")
        self.gaps = handle.getListState("gaps", "recv_us long, gap_s double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["recv_ts", "seq"], kind="stable", ignore_index=True)
        recv, stamp = _us(batch["recv_ts"]), _us(batch["quote_ts"])
        start = self.newest.get()[0] if self.newest.exists() else None
        seen = np.maximum.accumulate(stamp if start is None else np.maximum(stamp, start))
        before = np.concatenate([[np.nan if start is None else start], seen[:-1].astype(float)])
        gap = np.where(stamp >= before, (stamp - before) / US, np.nan)
        earlier = [(int(a), float(g)) for a, g in self.gaps.get()] if self.gaps.exists() else []
        quantiles, left = sliding_quantiles(recv, gap, self.cfg.window_s * US, (0.5, 0.95), earlier)
        self.newest.update((int(seen[-1]),))
        if left:
            self.gaps.put(left)
        elif earlier:
            self.gaps.clear()
        age = (recv - seen) / US
        yield pd.DataFrame({
            "symbol": key[0], "seq": batch["seq"], "recv_ts": batch["recv_ts"], "quote_ts": batch["quote_ts"], "newest": pd.to_datetime(before, unit="us"),
            "gap_s": gap, "gap_p50": quantiles[:, 0], "gap_p95": quantiles[:, 1], "age_s": age,
            "status": np.select([age > self.cfg.kill_s, age > self.cfg.pause_s], ["kill", "pause"], "ok"),
        })


class Silence(StatefulProcessor):
    """RUNNING / PAUSED / KILLED of a feed by the time since its last row; KILLED is final.

    A change is stamped with the instant at which it became true: the last row plus the
    limit, or the row that ended a pause. Silence between two rows is found when the
    second one arrives, silence after the last row by a timer, so the output does not
    depend on how the rows were cut into micro-batches. The clock is the watermark
    (``clock="event"``) or the wall (``clock="wall"``, where rows count from their arrival).
    Keyed by a bucket of feeds, so that a call into Python costs many feeds and not one; the
    bucket wakes up when the first of its feeds would change.
    """

    OUT = "feed string, ts timestamp, before string, after string, silent_s double"

    def __init__(self, cfg: StalenessConfig, clock: str = "event"):
        if clock not in ("event", "wall"):
            raise ValueError("clock is event or wall")
        self.pause, self.kill, self.wall = int(cfg.pause_s * US), int(cfg.kill_s * US), clock == "wall"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "feeds array<string>, status array<string>, last_us array<long>")

    def _known(self) -> dict[str | None, tuple[str, int]]:
        if not self.state.exists():
            return {}
        feeds, status, last = self.state.get()
        return dict(zip(feeds, zip(status, last)))

    def _advance(self, feed: str | None, status: str, last: int, now: int, out: list) -> str:
        """Changes that silence since ``last`` has brought by ``now``."""
        if status == "RUNNING" and now - last > self.pause:
            out.append((feed, last + self.pause, "RUNNING", "PAUSED", self.pause / US))
            status = "PAUSED"
        if status == "PAUSED" and now - last > self.kill:
            out.append((feed, last + self.kill, "PAUSED", "KILLED", self.kill / US))
            status = "KILLED"
        return status

    def _frame(self, out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["feed", "ts", "before", "after", "silent_s"])
        return frame.assign(ts=pd.to_datetime(frame["ts"], unit="us"))

    def _keep(self, known: dict[str | None, tuple[str, int]]) -> None:
        """Store the feeds, and wake up when the first of them would change."""
        states = list(known.values())
        self.state.update((list(known), [s for s, _ in states], [last for _, last in states]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        limits = {"RUNNING": min(self.pause, self.kill), "PAUSED": self.kill}
        due = [last + limits[s] for s, last in states if s in limits]
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["feed", "ts"], kind="stable", ignore_index=True)
        stamps = _us(batch["ts"]).tolist()
        known, out = self._known(), []
        for feed, i, j in in_groups(batch, "feed"):
            arrived = [timerValues.getCurrentProcessingTimeInMs() * 1000] if self.wall else stamps[i:j]
            status, last = known.get(feed, ("RUNNING", arrived[0]))
            for at in arrived:
                status = self._advance(feed, status, last, at, out)
                if status == "KILLED":
                    break
                if status == "PAUSED":
                    out.append((feed, at, "PAUSED", "RUNNING", (at - last) / US))
                    status = "RUNNING"
                last = max(last, at)
            known[feed] = (status, last)
        self._keep(known)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = (timerValues.getCurrentProcessingTimeInMs() if self.wall else timerValues.getCurrentWatermarkInMs()) * 1000
        known, out = self._known(), []
        for feed, (status, last) in known.items():
            known[feed] = (self._advance(feed, status, last, now, out), last)
        self._keep(known)
        yield self._frame(out)
