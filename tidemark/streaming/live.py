"""Live pieces: per-lane bounded watermarks with corrections, lane liveness, streaming window recording."""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class BoundedWatermark:
    """Progress per lane, watermark = progress - lateness. Events ahead of progress wait, as do all of a lane without any; events
    before the watermark count only as corrections, down to another lateness before it, of an event that is still held."""

    def __init__(self, lateness: int):
        if lateness < 0:
            raise ValueError("lateness must not be negative")
        self.lateness, self.progress, self.held, self.waiting = lateness, {}, {}, {}

    def advance(self, lane, progress: int) -> list[tuple]:
        """The waiting events that progress releases, in order of (time, event, revision); none if it does not move on."""
        if lane in self.progress and progress <= self.progress[lane]:
            return []
        self.progress[lane] = progress
        wait = self.waiting.get(lane, [])
        due = [w for w in wait if w[0] <= progress]
        self.waiting[lane] = [w for w in wait if w[0] > progress]
        out = [(e, r, self._accept(lane, t, e, r)) for t, e, r in due]
        held, low = self.held.setdefault(lane, {}), progress - 2 * self.lateness
        for e in [e for e, (_, t) in held.items() if t < low]:
            del held[e]
        return out

    def observe(self, lane, event, revision, time: int) -> tuple[str, object]:
        """(Buffered | Accepted | Corrected | Rejected, the revision that is retracted)."""
        if lane not in self.progress or time > self.progress[lane]:
            insort(self.waiting.setdefault(lane, []), (time, event, revision))
            return "Buffered", None
        return self._accept(lane, time, event, revision)

    def _accept(self, lane, time, event, revision):
        held, low = self.held.setdefault(lane, {}), self.progress[lane] - self.lateness
        was = held.get(event)
        if time < low and (was is None or time < low - self.lateness):
            return "Rejected", None
        if was is not None and was[0] == revision:
            return "Accepted", None
        held[event] = (revision, time)
        return ("Accepted", None) if was is None else ("Corrected", was[0])

    def lanes(self) -> set:
        return {*self.progress, *self.waiting}

    def remove(self, lane) -> bool:
        """Forget a lane; whether there was one."""
        known = lane in self.lanes()
        for d in (self.progress, self.held, self.waiting):
            d.pop(lane, None)
        return known


class Liveness:
    """Lanes are silent once `threshold` has passed since they were last seen (or since the start). A sighting is not before the
    start, the last check or the lane's last sighting; sightings of different lanes come in any order."""

    def __init__(self, lanes, started: int, threshold: int):
        lanes = list(lanes)
        if threshold <= 0 or not lanes or len(set(lanes)) < len(lanes):
            raise ValueError("liveness needs unique lanes and a threshold above zero")
        self.last, self.state, self.threshold, self.checked = dict.fromkeys(lanes, started), dict.fromkeys(lanes), threshold, started

    def observe(self, lane, t: int):
        if lane not in self.last:
            raise ValueError("the lane is not tracked")
        if t < max(self.checked, self.last[lane]):
            raise ValueError("a sighting may not move backwards")
        self.last[lane] = t
        if self.state[lane] != "Alive":
            self.state[lane] = "Alive"
            return [(lane, "Alive", t)]
        return []

    def check(self, horizon: int):
        if horizon < self.checked:
            raise ValueError("the horizon may not move backwards")
        self.checked = horizon
        out = []
        for lane, last in self.last.items():
            if self.state[lane] != "Silent" and horizon - last >= self.threshold:
                self.state[lane] = "Silent"
                out.append((lane, "Silent", last + self.threshold))
        return out


def watermark_stream(messages: DataFrame, lateness: int) -> DataFrame:
    """BoundedWatermark as a stateful stream, one lane's tracker a key: lane, seq, event, revision, outcome, retracted.

    messages: lane, seq (order of a lane's messages within a micro-batch), kind (Advance, Observe, Remove), event, revision,
    time (the new progress of an Advance). An Advance gives a row for every waiting event that it releases, and none if it does
    not move on; observations before any progress of their lane wait."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    out_form = "lane string, seq long, event string, revision string, outcome string, retracted string"

    def run(key, pdfs: Iterator[pd.DataFrame], state):
        lane, w, out = key[0], BoundedWatermark(lateness), []
        if state.exists:
            progress, held, waiting = json.loads(state.get[0])
            w.held[lane], w.waiting[lane] = {e: (r, t) for e, r, t in held}, [tuple(x) for x in waiting]
            if progress is not None:
                w.progress[lane] = progress
        rows = sorted((r for pdf in pdfs for r in pdf[["seq", "kind", "event", "revision", "time"]].itertuples(index=False, name=None)), key=lambda r: r[0])
        for seq, kind, event, revision, time in rows:
            if kind == "Remove":
                w.remove(lane)
            elif kind == "Advance":
                out += [(lane, seq, e, r, outcome, old) for e, r, (outcome, old) in w.advance(lane, int(time))]
            else:
                out.append((lane, seq, event, revision, *w.observe(lane, event, revision, int(time))))
        if lane in w.lanes():
            state.update((json.dumps([w.progress.get(lane), [[e, r, t] for e, (r, t) in w.held.get(lane, {}).items()], w.waiting.get(lane, [])]),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in out_form.split(", ")])

    return messages.groupBy("lane").applyInPandasWithState(run, out_form, "tracker string", "append", GroupStateTimeout.NoTimeout)


def silences(obs: DataFrame, threshold: int, horizon: int, lanes: DataFrame | None = None, started: int = 0) -> DataFrame:
    """Batch liveness at the final horizon and between sightings: every lane's silences of `threshold` or more, from where
    they count as silent until the next sighting (null: still silent at the horizon). lanes: tracked from `started` on, so one
    that is seen late or never is silent until then."""
    x = obs.select("lane", "pos")
    if lanes is not None:
        x = x.unionByName(lanes.select("lane", F.lit(started).cast("long").alias("pos")).distinct())
    x = x.withColumn("nxt", F.lead("pos").over(Window.partitionBy("lane").orderBy("pos")))
    return x.where(F.coalesce("nxt", F.lit(horizon)) - F.col("pos") >= threshold).select("lane", (F.col("pos") + threshold).alias("silent_at"), F.col("nxt").alias("alive_at"))


def record_stream(obs: DataFrame, enter_after: int = 1, exit_after: int = 1) -> DataFrame:
    """Window transitions of a stream of observations (key, source, partition_id, pos, active[, segments]): state is one open
    position a lane, its segments and the length of a pending run. Another segment context while active closes and reopens
    at the same position; a change of activity counts once it has been seen `enter_after` or `exit_after` times in a row.
    Rows of a micro-batch are taken in the order of pos; late ones (not after the lane's last) are dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    if min(enter_after, exit_after) < 1:
        raise ValueError("confirmations must be at least 1")
    obs = obs.withColumn("ctx", F.to_json("segments") if "segments" in obs.columns else F.lit("[]")).select("key", "source", "partition_id", "pos", "active", "ctx")

    def run(key, pdfs: Iterator[pd.DataFrame], state):
        last, opened, held, pending = state.get if state.exists else (-1, -1, "[]", 0)
        out = []
        for pos, active, ctx in sorted((int(p), bool(a), c) for pdf in pdfs for p, a, c in zip(pdf["pos"], pdf["active"], pdf["ctx"])):
            if pos <= last:
                continue
            last = pos
            if active == (opened >= 0):
                pending = 0
                if active and ctx != held:
                    out += [(*key, "Closed", opened, pos, held), (*key, "Opened", pos, pos, ctx)]
                    opened, held = pos, ctx
                continue
            pending += 1
            if pending < (enter_after if active else exit_after):
                continue
            pending = 0
            if active:
                opened, held = pos, ctx
                out.append((*key, "Opened", pos, pos, ctx))
            else:
                out.append((*key, "Closed", opened, pos, held))
                opened = -1
        state.update((last, opened, held, pending))
        yield pd.DataFrame(out, columns=["key", "source", "partition_id", "kind", "start_position", "position", "segments"])

    return obs.groupBy("key", "source", "partition_id").applyInPandasWithState(run, "key string, source string, partition_id string, kind string, start_position long, position long, segments string", "last long, opened long, held string, pending int", "append", GroupStateTimeout.NoTimeout)


def windows_so_far(emitted: DataFrame) -> DataFrame:
    """Windows of all transitions of record_stream up to now: closed ones by their Closed row, open ones by an Opened row that
    none has followed."""
    lane = ["key", "source", "partition_id", "start_position"]
    end = F.max(F.when(F.col("kind") == "Closed", F.col("position")))
    return emitted.groupBy(*lane).agg(end.alias("end_position"), F.first("segments").alias("segments"))


def live_batches(stream: DataFrame, sink, compare, store: str) -> object:
    """foreachBatch: the transitions of every micro-batch are appended to the table at `store` (a batch that is run again
    replaces its own part), and `compare(windows, horizon)` sees the windows of all batches so far, at the largest position
    yet; its result is handed to `sink`."""

    def each(batch, n):
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={n}")
        seen = spark.read.parquet(store).where(F.col("batch") <= n).drop("batch")
        h = seen.agg(F.max("position")).first()[0]
        if h is not None:
            sink(compare(windows_so_far(seen), h), n)

    return stream.writeStream.foreachBatch(each)


class Callbacks:
    """Handlers of emissions, called for each row of a committed batch of transitions; a handler that fails does not keep
    others from being called, and all errors are raised together afterwards. Rows are fetched a partition at a time."""

    def __init__(self):
        self.handlers: list[tuple[str | None, object]] = []

    def on_emission(self, fn):
        self.handlers.append((None, fn))
        return self

    def on_opened(self, fn):
        self.handlers.append(("Opened", fn))
        return self

    def on_closed(self, fn):
        self.handlers.append(("Closed", fn))
        return self

    def __call__(self, transitions: DataFrame, n: int = 0) -> None:
        wrong = []
        for row in transitions.toLocalIterator():
            for kind, fn in self.handlers:
                if kind in (None, row["kind"]):
                    try:
                        fn(row)
                    except Exception as e:
                        wrong.append(e)
        if wrong:
            raise ExceptionGroup("handlers failed", wrong)
