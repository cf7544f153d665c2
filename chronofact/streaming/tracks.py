"""Text tracks as a stream: keyed state, event-time timers, each recording's frames in order whatever order they come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronofact.operators.tracking import TRACKS, advance, finished, grams, observed

#: Rows of the stream: an observation; a sampled frame, without a text; and a recording's end, with ``last``.
READING = "ts double, text string, confidence double, x1 double, y1 double, x2 double, y2 double, last boolean"
_OPEN = "norm string, text string, best double, length int, first double, last double, next double, count long, sum double, known long, x1 double, y1 double, x2 double, y2 double"
_BOX = ("x1", "y1", "x2", "y2")


def _none(v):
    return None if v is None or v != v else v


class TextTracks(StatefulProcessor):
    """One recording's open tracks, and the readings that the watermark has not passed yet.

    Readings wait until the watermark is at their time, so late ones within the allowed delay fall into their frame;
    a timer stands at each waiting time. Then frames are taken in order. A track leaves the state when a frame comes
    over ``max_gap`` after it was seen, all do at the recording's end, or after ``idle`` seconds without a frame. So the state
    holds what is on screen, and readings of the allowed delay.
    """

    def __init__(self, least: float, box: float, max_gap: float, idle: float) -> None:
        self.least, self.box, self.max_gap, self.idle = least, box, max_gap, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", READING)
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [x.split()[0] for x in READING.split(", ")]
        # The row that ends a stream has no reading.
        new = [tuple(_none(v) for v in r) for part in rows for r in part[names].itertuples(index=False, name=None) if r[0] == r[0] and r[0] is not None]
        if new:
            self.waiting.appendList(new)
        for ms in {int(r[0] * 1000) for r in new}:
            self.handle.registerTimer(ms)
        return iter(())

    def _tracks(self) -> list[dict]:
        out = []
        for r in self.open.get() if self.open.exists() else ():
            norm, text, best, length, first, last, following, count, total, known, *box = r
            out.append({"norm": norm, "grams": grams(norm), "text": text, "best": (best, length), "first": first, "last": last, "next": following, "count": count, "sum": total, "known": known, "box": tuple(box)})
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        video, passed = key[0], timerValues.getCurrentWatermarkInMs() / 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = [r for r in rows if int(r[0] * 1000) / 1000 <= passed]
        live, out = self._tracks(), []
        for t in sorted({r[0] for r in due if not r[7]}):
            new = [observed(r[1], r[2], r[3:7]) for r in due if r[0] == t and r[1] is not None]
            out += [finished(video, k, t) for k in advance(live, t, new, self.least, self.box, self.max_gap)]
        ends = [r[0] for r in due if r[7]]
        if ends:
            out += [finished(video, k, max(ends)) for k in live]
            live = []
        elif not due and live:
            # Only the timer of a recording that went quiet comes without a reading.
            quiet = [k for k in live if passed - k["last"] >= self.idle]
            out += [finished(video, k, k["last"]) for k in quiet]
            live = [k for k in live if k not in quiet]
        left = [r for r in rows if r not in due] if due else rows
        self.waiting.put(left) if left else self.waiting.clear()
        if live:
            self.open.put([(k["norm"], k["text"], float(k["best"][0]), int(k["best"][1]), k["first"], k["last"], k["next"], k["count"], k["sum"], k["known"], *k["box"]) for k in live])
            self.handle.registerTimer(int((max(k["last"] for k in live) + self.idle) * 1000))
        else:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in TRACKS.split(", ")])

    def close(self) -> None:
        pass


def stream_tracks(readings: DataFrame, least: float = 0.88, box: float = 0.30, max_gap: float = 3.0, idle: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """TRACKS rows of a stream of readings (video_id, at, and READING), ``at`` the event time of ``ts``, which is in seconds
    of the same clock. The session needs the RocksDB state store (``facts.run_available`` sets it while it runs)."""
    marked = readings.withWatermark("at", late)
    return marked.groupBy("video_id").transformWithStateInPandas(statefulProcessor=TextTracks(least, box, max_gap, idle), outputStructType=TRACKS, outputMode="Append", timeMode="EventTime")
