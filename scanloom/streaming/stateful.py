"""Stateful streaming operators: late positions, packets in order, scan boundaries, gates."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.align import known

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, drains: bool = False):
    """The store that keyed state needs, for the queries started inside.  drains: they end when all input is read, so state
    that goes by the clock must not keep them running."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS} | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if drains else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plain(kind: T.DataType):
    """A function that turns a value from pandas into one that a state of this type takes."""
    if isinstance(kind, T.ArrayType):
        inner = _plain(kind.elementType)
        return lambda v: None if v is None else [inner(x) for x in v]
    cast = int if isinstance(kind, T.IntegralType) else float if isinstance(kind, (T.FloatType, T.DoubleType)) else bool if isinstance(kind, T.BooleanType) else lambda v: v
    return lambda v: None if v is None or v != v and cast is not float else cast(v)


def _kinds(df: DataFrame, columns) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


#: Runs are dealt to this many groups of state: a group's runs share its calls of the state store.
BUCKETS = 4096
#: Numbers (of frames, of packets) whose state is read and written together.
BLOCK = 64


def _bucket(*keys: str):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")


class LatePositions(StatefulProcessor):
    """Holds frames until their position comes; a key's state is its position or its waiting frames.

    A second frame of a key is a frame of its own; a second position takes the place of the first.  keep_ms: how long a
    position or a waiting frame is kept after it was written.  The keys of a group share its lists, which are read whole."""

    def __init__(self, key: tuple[str, T.DataType], payload: list[tuple[str, T.DataType]], names: list[str], keep_ms: int | None):
        self.key, self.names, self.keep_ms, kind = _plain(key[1]), names, keep_ms, f"k {key[1].simpleString()}, at bigint"
        self.casts = [_plain(k) for _, k in payload]
        self.places = f"{kind}, cy double, cx double"
        self.frames = ", ".join([kind, *(f"`p{i}` {k.simpleString()}" for i, (_, k) in enumerate(payload))])

    def init(self, handle):
        self.place = handle.getListState("place", self.places, self.keep_ms)
        self.waiting = handle.getListState("waiting", self.frames, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        now = 0 if self.keep_ms is None else timerValues.getCurrentProcessingTimeInMs()
        live = lambda row: self.keep_ms is None or row[1] + self.keep_ms > now  # noqa: E731  rows that are written again keep their time
        frames, placed = [], {}
        for pdf in rows:
            # by their order, as pandas gets other names for some: group, key, whether it is a position, the frame's columns, cy, cx
            columns = [pdf.iloc[:, i] for i in range(len(key), pdf.shape[1])]
            for k, is_place, cy, cx, *values in zip(*columns[:2], *columns[-2:], *columns[2:-2]):
                k = self.key(k)
                if is_place:
                    placed[k] = (k, now, float(cy), float(cx))
                else:
                    frames.append((k, now, *(cast(v) for cast, v in zip(self.casts, values))))
        old = [tuple(p) for p in self.place.get() if live(p)] if self.place.exists() else []
        places = {p[0]: p for p in old} | placed
        if placed:
            if len(places) < len(old) + len(placed):
                self.place.put(list(places.values()))
            else:
                self.place.appendList(list(placed.values()))
        ready = [f for f in frames if f[0] in places]
        wait = [f for f in frames if f[0] not in places]
        if placed and self.waiting.exists():
            held = [(self.key(w[0]), w[1], *(cast(v) for cast, v in zip(self.casts, w[2:]))) for w in self.waiting.get() if live(w)]
            came = [w for w in held if w[0] in placed]
            if came:
                ready = came + ready
                wait = [w for w in held if w[0] not in placed] + wait
                self.waiting.clear()
        if wait:
            self.waiting.appendList(wait)
        if ready:
            known = list(zip(*(places[f[0]] for f in ready)))
            group = {k: [v] * len(ready) for k, v in zip(self.names, key[1:])}
            numbers, _, *values = zip(*ready)
            rest = self.names[len(group) :]
            yield pd.DataFrame(group | {n: list(c) for n, c in zip(rest, (numbers, *values))} | {"cy": list(known[2]), "cx": list(known[3])})

    def close(self):
        pass


def join_late(frames: DataFrame, positions: DataFrame, keys: tuple[str, ...] = ("frame_id",), keep_seconds: float | None = None) -> DataFrame:
    """The frames (keys and any other columns) with cy, cx as soon as both they and their position (keys, cy, cx) are there,
    whichever comes first.

    A position that is null, NaN or infinite in one axis is not there yet: its frame waits for another.  Where frame
    numbers start anew, run and scan belong into the keys.  The last key is the frame's number: 64 of them in a row are
    a group of state.  State of a key is freed keep_seconds after it was last written (processing time); None keeps it for
    ever."""
    *outer, last = keys
    kind = frames.schema[last].dataType
    payload = [c for c in frames.columns if c not in keys]
    kinds = [(c, frames.schema[c].dataType) for c in payload]
    group = F.floor(F.col(last) / BLOCK) if isinstance(kind, T.IntegralType) else F.xxhash64(last)
    own = [group.cast("bigint").alias("_block"), *outer, F.col(last).cast(kind).alias(last)]
    f = frames.select(*own, F.lit(False).alias("is_place"), *payload, F.lit(None).cast("double").alias("cy"), F.lit(None).cast("double").alias("cx"))
    p = positions.where(known("cy", "cx")).select(*own, F.lit(True).alias("is_place"), *[F.lit(None).cast(k).alias(c) for c, k in kinds], F.col("cy").cast("double").alias("cy"), F.col("cx").cast("double").alias("cx"))
    keep_ms = None if keep_seconds is None else max(1, int(keep_seconds * 1000))
    out = f"{_kinds(frames, [*keys, *payload])}, cy double, cx double"
    processor = LatePositions((last, kind), kinds, [*keys, *payload], keep_ms)
    return f.unionByName(p).groupBy("_block", *outer).transformWithStateInPandas(processor, out, "append", "none" if keep_ms is None else "processingTime")


class InOrder(StatefulProcessor):
    """Lets packets (number, x, y: samples of two channels) pass from 0 on without a gap; what comes early waits, what has
    passed is dropped.

    Packets wait by blocks of numbers, those of all runs of a group together, so a batch costs the blocks that it brings or
    lets pass.  patience: how many packets of a run may wait before a missing one is given up; None waits for ever."""

    def __init__(self, patience: int | None, kind: str):
        self.patience, self.kind = patience, kind

    def init(self, handle):
        self.turn = handle.getValueState("turn", f"run array<{self.kind}>, due array<bigint>, waiting array<bigint>")
        self.early = handle.getMapState("early", "block bigint", f"run array<{self.kind}>, n array<bigint>, x array<array<double>>, y array<array<double>>")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        turns = {run: [due, waiting] for run, due, waiting in zip(*self.turn.get())} if self.turn.exists() else {}
        blocks: dict[int, dict] = {}  # those looked at: packets by run and number
        changed, stored = set(), set()

        def block(b: int) -> dict:
            if b not in blocks:
                blocks[b] = {}
                if self.early.containsKey((b,)):
                    blocks[b] = {(run, n): (x, y) for run, n, x, y in zip(*self.early.getValue((b,)))}
                    stored.add(b)
            return blocks[b]

        touched = []
        for pdf in rows:
            for run, n, x, y in zip(pdf["run"].tolist(), pdf["number"].tolist(), pdf["x"], pdf["y"]):
                run = None if run != run else run
                if run not in turns:
                    turns[run] = [0, 0]
                touched.append(run)
                if n >= turns[run][0] and (run, n) not in block(n // BLOCK):
                    block(n // BLOCK)[run, n] = (x, y)
                    changed.add(n // BLOCK)
                    turns[run][1] += 1
        out = []
        for run in dict.fromkeys(touched):
            due, waiting = turns[run]
            while waiting:
                packet = block(due // BLOCK).pop((run, due), None)
                if packet is None:
                    if self.patience is None or waiting <= self.patience:
                        break
                    due = self._next(run, due, block, {*blocks, *(k[0] for k in self.early.keys())})
                    continue
                changed.add(due // BLOCK)
                out.append((run, due, list(packet[0]), list(packet[1])))
                due, waiting = due + 1, waiting - 1
            turns[run] = [due, waiting]
        for b in changed:
            if blocks[b]:
                runs, numbers = zip(*blocks[b])
                x, y = ([[float(v) for v in packet[i]] for packet in blocks[b].values()] for i in (0, 1))
                self.early.updateValue((b,), (list(runs), list(numbers), x, y))
            elif b in stored:
                self.early.removeKey((b,))
        self.turn.update((list(turns), *([t[i] for t in turns.values()] for i in (0, 1))))
        if out:
            yield pd.DataFrame(out, columns=["run", "number", "x", "y"])

    @staticmethod
    def _next(run, due: int, block, known: set[int]) -> int:
        """The least number of a run's waiting packets."""
        for b in sorted(known):
            numbers = [n for r, n in block(b) if r == run] if b >= due // BLOCK else []
            if numbers:
                return min(numbers)
        raise RuntimeError(f"packets of run {run} wait that are not there")

    def close(self):
        pass


def in_order(packets: DataFrame, patience: int | None = None) -> DataFrame:
    """run, number, x, y in order of number within each run (x, y: arrays of the two channels)."""
    kind = packets.schema["run"].dataType.simpleString()
    return packets.select(_bucket("run"), "run", "number", "x", "y").groupBy("_bucket").transformWithStateInPandas(InOrder(patience, kind), f"run {kind}, number bigint, x array<double>, y array<double>", "append", "none")


class ScanSplit(StatefulProcessor):
    """Counts scans: a number below the largest seen begins a new one, and the largest starts anew."""

    def init(self, handle):
        self.state = handle.getValueState("seen", "most bigint, seq bigint")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        most, seq = self.state.get() if self.state.exists() else (-1, 0)
        pdf = pd.concat(list(rows)).sort_values("arrival")
        seqs = []
        for n in pdf["number"]:
            if n < most:
                most, seq = -1, seq + 1
            most = max(most, int(n))
            seqs.append(seq)
        self.state.update((int(most), int(seq)))
        yield pd.DataFrame({"run": key[0], "arrival": pdf["arrival"].to_numpy(), "number": pdf["number"].to_numpy(), "scan_seq": seqs})

    def close(self):
        pass


def split_scans(rows: DataFrame) -> DataFrame:
    """run (of any type), arrival, number, scan_seq.  Within a micro-batch rows are taken by arrival; batches must come in
    order."""
    source = rows.select("run", "arrival", F.col("number").cast("bigint").alias("number"))
    return source.groupBy("run").transformWithStateInPandas(ScanSplit(), f"{_kinds(source, source.columns)}, scan_seq bigint", "append", "none")


class ScanEnds(StatefulProcessor):
    """Tells when a run's scan is over: when rows of a later one come, or when no rows come for idle_ms.

    Rows of a scan that was over already make it end once more."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "scan_seq bigint")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        scans = {int(s) for pdf in rows for s in pdf["scan_seq"].unique()}
        if self.open.exists():
            scans.add(self.open.get()[0])
        newest = max(scans)
        self.open.update((newest,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        over = sorted(scans - {newest})
        if over:
            yield pd.DataFrame({"run": [key[0]] * len(over), "scan_seq": over})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        if self.open.exists():
            over = self.open.get()[0]
            self.open.clear()
            yield pd.DataFrame({"run": [key[0]], "scan_seq": [over]})

    def close(self):
        pass


def scan_ends(rows: DataFrame, idle_seconds: float) -> DataFrame:
    """run, scan_seq of each scan that is over, of rows (run, scan_seq); the last one too, by the clock."""
    source = rows.select("run", F.col("scan_seq").cast("bigint").alias("scan_seq")).where("scan_seq IS NOT NULL")
    return source.groupBy("run").transformWithStateInPandas(ScanEnds(int(idle_seconds * 1000)), _kinds(source, source.columns), "append", "processingTime")


class SlowGate(StatefulProcessor):
    """Holds a run's frames until one of two columns (u, v) turns out to be the slow axis, then lets those pass that lie
    on its line.

    With `min_frames` known values both columns are fitted; the one of the larger share of frames on its line is
    locked if that is at least `least_share`.  Above `most_waiting` frames without a lock the gate gives up: all pass,
    then and later.  Frames without a value pend before the lock and pass after it."""

    def __init__(self, span: float | None, min_frames: int, least_share: float, most_waiting: int):
        self.span, self.min_frames, self.least_share, self.most_waiting = span, min_frames, least_share, most_waiting

    def init(self, handle):
        self.line = handle.getValueState("line", "axis int, a double, b double, tol double")  # axis -1: given up
        self.waiting = handle.getListState("waiting", "frame_id bigint, u double, v double")

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        from ..operators.lines import slow_axis_points

        new = pd.concat(list(rows))[["frame_id", "u", "v"]]
        if not self.line.exists():
            self.waiting.appendList([(int(f), float(u), float(v)) for f, u, v in new.itertuples(index=False)])
            new = pd.DataFrame(list(self.waiting.get()), columns=["frame_id", "u", "v"])
            values = [new[c].to_numpy(float) for c in ("u", "v")]
            found = slow_axis_points(new["frame_id"].to_numpy(float), values, self.span, self.min_frames, self.least_share)
            if found is None and len(new) <= self.most_waiting:
                return
            self.line.update(found or (-1, 0.0, 0.0, 0.0))
            self.waiting.clear()
        axis, a, b, tol = self.line.get()
        if axis >= 0:
            value = new["uv"[axis]].to_numpy(float)
            new = new[np.isnan(value) | (np.abs(value - (a + b * new["frame_id"].to_numpy(float))) <= tol)]
        if len(new):
            yield pd.DataFrame({"run": key[0], "frame_id": new["frame_id"].to_numpy(), "u": new["u"].to_numpy(float), "v": new["v"].to_numpy(float)})

    def close(self):
        pass


def slow_gate(rows: DataFrame, span: float | None = None, min_frames: int = 512, least_share: float = 0.6, most_waiting: int = 6000) -> DataFrame:
    """run, frame_id, u, v of the frames that the gate lets pass; span: the commanded range of the scan."""
    source = rows.select("run", F.col("frame_id").cast("bigint").alias("frame_id"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    return source.groupBy("run").transformWithStateInPandas(SlowGate(span, min_frames, least_share, most_waiting), f"run {source.schema['run'].dataType.simpleString()}, frame_id bigint, u double, v double", "append", "none")


class PointGate(StatefulProcessor):
    """Holds each run's samples until there are more than `least`; then those and all later ones pass.

    Only what has to wait is written into state: no more than `least` samples of a run."""

    def __init__(self, least: int, kind: str):
        self.least, self.kind = least, kind

    def init(self, handle):
        self.seen = handle.getValueState("seen", f"run array<{self.kind}>, n array<bigint>")  # n -1: open
        self.waiting = handle.getListState("waiting", f"run {self.kind}, sample bigint, x double, y double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        names = ["run", "sample", "x", "y"]
        new = pd.concat(list(rows))[names]
        seen = dict(zip(*self.seen.get())) if self.seen.exists() else {}
        before = dict(seen)
        for run, n in new.groupby("run", dropna=False, sort=False).size().items():
            run = None if run != run else run.item() if hasattr(run, "item") else run
            have = seen.get(run, 0)
            if have >= 0:
                seen[run] = have + n if have + n <= self.least else -1
        if seen != before:
            self.seen.update((list(seen), [int(n) for n in seen.values()]))
        open_runs = {run for run, n in seen.items() if n < 0}
        passes = new["run"].isin(open_runs - {None}) | (new["run"].isna() & (None in open_runs))
        hold = list(new[~passes].itertuples(index=False, name=None))
        hold = [(None if r != r else r, int(s), float(x), float(y)) for r, s, x, y in hold]
        out = [new[passes]]
        if any(before.get(run, 0) > 0 for run in open_runs):
            held = list(self.waiting.get())
            out.insert(0, pd.DataFrame([w for w in held if w[0] in open_runs], columns=names))
            hold = [tuple(w) for w in held if w[0] not in open_runs] + hold
            self.waiting.clear()
        if hold:
            self.waiting.appendList(hold)
        out = pd.concat([o for o in out if len(o)]) if any(map(len, out)) else out[0]
        if len(out):
            yield pd.DataFrame({"run": out["run"].to_numpy(), "sample": out["sample"].to_numpy(), "x": out["x"].to_numpy(float), "y": out["y"].to_numpy(float)})

    def close(self):
        pass


def min_points(samples: DataFrame, least: int) -> DataFrame:
    """run, sample, x, y: nothing of a run before it has more than `least` samples (points times samples a point)."""
    kind = samples.schema["run"].dataType.simpleString()
    return samples.select(_bucket("run"), "run", "sample", "x", "y").groupBy("_bucket").transformWithStateInPandas(PointGate(least, kind), f"run {kind}, sample bigint, x double, y double", "append", "none")


class PrefixRelease(StatefulProcessor):
    """Lets a run's frames pass in order of arrival (0, 1, ...) up to the first one whose position is not there yet."""

    def init(self, handle):
        self.due = handle.getValueState("due", "n bigint")
        self.frames = handle.getMapState("frames", "arrival bigint", "frame_id bigint")
        self.places = handle.getMapState("places", "frame_id bigint", "x double, y double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        for pdf in rows:
            for f, arrival, x, y in zip(pdf["frame_id"], pdf["arrival"], pdf["x"], pdf["y"]):
                if pd.isna(arrival):
                    self.places.updateValue((int(f),), (float(x), float(y)))
                else:
                    self.frames.updateValue((int(arrival),), (int(f),))
        n = self.due.get()[0] if self.due.exists() else 0
        out = []
        while self.frames.containsKey((n,)):
            frame = self.frames.getValue((n,))[0]
            if not self.places.containsKey((frame,)):
                break
            out.append((key[0], n, frame, *self.places.getValue((frame,))))
            self.frames.removeKey((n,))
            self.places.removeKey((frame,))
            n += 1
        self.due.update((n,))
        if out:
            yield pd.DataFrame(out, columns=["run", "arrival", "frame_id", "x", "y"])

    def close(self):
        pass


def release_prefix(frames: DataFrame, positions: DataFrame) -> DataFrame:
    """run, arrival, frame_id, x, y of frames (run, frame_id, arrival) whose own position (run, frame_id, x, y) and those
    of all frames before are there and known; both sides may come in any order."""
    kind = frames.schema["run"].dataType.simpleString()
    f = frames.select("run", "frame_id", F.col("arrival").cast("bigint").alias("arrival"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    both = f.unionByName(positions.where(known("x", "y")).select("run", "frame_id", F.lit(None).cast("bigint").alias("arrival"), "x", "y"))
    return both.groupBy("run").transformWithStateInPandas(PrefixRelease(), f"run {kind}, arrival bigint, frame_id bigint, x double, y double", "append", "none")
