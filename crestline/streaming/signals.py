"""Streams of packets: windows, ordered reassembly and edge trimming with state per channel.

Packets are (track_id, channel, seq, samples, last): numbered from 0 in each channel, in any order of arrival; the last one
of a channel says so, which flushes what is left. The results equal those of the batch operators over the same packets.

State is typed and held by Spark (transformWithState): how far a channel has come, a map of the packets ahead of a missing
one, a list of samples that make no window yet or frames of a silence that may still turn out to be the end. What a batch
does not need is not read. When a channel ends, all of it goes but a tombstone, by which packets that come again later emit
nothing. A channel that hears nothing for `idle_ms` is closed by a timer as if its last packet had come: what stands before
the first missing packet counts. Tombstones are dropped `keep_ms` after the end, if that is given; give it where tracks
never return under the same name.

Timers and typed state need the RocksDB state store, which these functions choose for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crestline.operators.windows import window_frames

WINDOWS = "track_id string, channel int, win long, n long, sum_sq double, rms double, peak double"
ORDERED = "track_id string, channel int, seq long, samples array<float>"
TRIMMED = "track_id string, channel int, frame_idx long, sample float"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Trimmer:
    """Edge trimming of frames (rows of an array, a column per channel): leading, passing, holding. A frame is as loud as its
    loudest channel. Works run by run of equal frames; one is never looked at twice."""

    def __init__(self, level: float, min_run: int, hysteresis: int):
        self.level, self.min_run, self.hysteresis = level, min_run, hysteresis
        self.phase, self.heard, self.streak, self.held = "leading", 0, 0, []

    def _released(self, run: np.ndarray) -> list[np.ndarray]:
        out, self.held = [*self.held, run], []
        return out

    def _run(self, run: np.ndarray, quiet: bool) -> list[np.ndarray]:
        if self.phase == "leading":
            if quiet:
                waiting = np.concatenate([*self.held, run])
                self.held = [waiting[len(waiting) // self.min_run * self.min_run :]]
                return []
            self.heard += len(run)
            if self.heard >= self.hysteresis:
                self.phase = "passing"
            return self._released(run)
        if self.phase == "passing":
            if not quiet:
                return [run]
            self.phase, self.held, self.streak, self.heard = "holding", [run], len(run), 0
            return []
        self.streak, self.heard = (self.streak + len(run), 0) if quiet else (0, self.heard + len(run))
        if self.heard >= self.hysteresis:
            self.phase = "passing"
            return self._released(run)
        self.held.append(run)
        return []

    def add(self, frames: np.ndarray) -> list[np.ndarray]:
        if not len(frames):
            return []
        quiet = np.abs(frames).max(axis=1).astype(np.float64) < self.level
        starts = [0, *(np.flatnonzero(quiet[1:] != quiet[:-1]) + 1).tolist()]
        return [part for a, b in zip(starts, [*starts[1:], len(frames)], strict=True) for part in self._run(frames[a:b], bool(quiet[a]))]

    def finish(self) -> list[np.ndarray]:
        return [] if self.phase == "holding" and self.streak >= self.min_run else self.held


class Channel(StatefulProcessor):
    """Packets of a channel in order, each once. Subclasses say what becomes of them."""

    def __init__(self, idle_ms: int | None, keep_ms: int | None):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "next long, end long, ahead long")
        self.ahead = handle.getMapState("ahead", "seq long", "samples array<float>")
        self.closed = handle.getValueState("closed", "next long", self.keep_ms) if self.keep_ms else handle.getValueState("closed", "next long")
        self.begin(handle)

    def close(self) -> None:
        pass

    def begin(self, handle: StatefulProcessorHandle) -> None:
        """Declares state of one's own."""

    def take(self, key: tuple, packets: list[tuple[int, np.ndarray]], ended: bool) -> Iterator[pd.DataFrame]:
        """Rows from the next packets; after the end nothing follows, and state of one's own is cleared."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.closed.exists():
            for _ in rows:
                pass
            return
        after, end, waiting = self.head.get() if self.head.exists() else (0, -1, 0)
        found: dict[int, object] = {}
        for frame in rows:
            for seq, samples, last in zip(frame["seq"].tolist(), frame["samples"], frame["last"].tolist(), strict=True):
                if last:
                    end = seq
                if seq >= after:
                    found.setdefault(seq, samples)
        ready = []
        while True:
            if waiting and self.ahead.containsKey((after,)):  # what came first counts
                samples = self.ahead.getValue((after,))[0]
                self.ahead.removeKey((after,))
                found.pop(after, None)
                waiting -= 1
            elif after in found:
                samples = found.pop(after)
            else:
                break
            ready.append((after, np.asarray([] if samples is None else samples, np.float32)))
            after += 1
        ended = 0 <= end < after
        yield from self.take(key, ready, ended)
        if ended:
            if self.idle_ms:
                self._no_timers()
            self._finished(after)
            return
        for seq, samples in found.items():
            if not (waiting and self.ahead.containsKey((seq,))):
                self.ahead.updateValue((seq,), ([] if samples is None else np.asarray(samples, np.float32).tolist(),))
                waiting += 1
        self.head.update((after, end, waiting))
        if self.idle_ms:
            self._no_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.closed.exists():
            return
        yield from self.take(key, [], True)
        self._finished(self.head.get()[0] if self.head.exists() else 0)

    def _no_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def _finished(self, after: int) -> None:
        self.head.clear()
        self.ahead.clear()
        self.closed.update((after,))


class OrderedChannel(Channel):
    def take(self, key: tuple, packets: list[tuple[int, np.ndarray]], ended: bool) -> Iterator[pd.DataFrame]:
        if packets:
            yield pd.DataFrame({"track_id": key[0], "channel": np.int32(key[1]), "seq": [seq for seq, _ in packets], "samples": [x for _, x in packets]})


class WindowChannel(Channel):
    """Cuts samples into windows; the rest becomes one at the end, if it has two frames. Samples that fill no window stay as
    the pieces they came in, and are joined once."""

    def __init__(self, frames: int, flush_tail: bool, idle_ms: int | None, keep_ms: int | None):
        super().__init__(idle_ms, keep_ms)
        self.frames, self.flush_tail = frames, flush_tail

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getListState("rest", "samples array<float>")
        self.done = handle.getValueState("done", "win long, held long")

    def take(self, key: tuple, packets: list[tuple[int, np.ndarray]], ended: bool) -> Iterator[pd.DataFrame]:
        win, held = self.done.get() if self.done.exists() else (0, 0)
        pieces = [x for _, x in packets if len(x)]
        total, rows = held + sum(map(len, pieces)), []
        if total >= self.frames or ended:
            old = [np.asarray(row[0], np.float32) for row in self.rest.get()] if held else []
            flat = np.concatenate([*old, *pieces]).astype(np.float64) if old or pieces else np.zeros(0)
            stops = list(range(self.frames, total + 1, self.frames))
            cut = stops[-1] if stops else 0
            parts = [flat[a - self.frames : a] for a in stops] + ([flat[cut:]] if ended and self.flush_tail and total - cut > 1 else [])
            for x in parts:
                sum_sq = float(x @ x)
                rows.append((win, len(x), sum_sq, float(np.sqrt(2 * sum_sq / len(x))), float(np.nan_to_num(np.abs(x), nan=0.0, posinf=np.inf).max())))
                win += 1
            self.rest.clear()
            held = 0 if ended else total - cut
            if held:
                self.rest.put([(flat[cut:].astype(np.float32).tolist(),)])
        elif pieces:
            self.rest.appendList([(x.tolist(),) for x in pieces])
            held = total
        if ended:
            self.done.clear()
        else:
            self.done.update((win, held))
        if rows:
            out = pd.DataFrame(rows, columns=["win", "n", "sum_sq", "rms", "peak"])
            out.insert(0, "channel", np.int32(key[1]))
            out.insert(0, "track_id", key[0])
            yield out


class TrimmedChannel(Channel):
    def __init__(self, level: float, min_run: int, hysteresis: int, channels: int, idle_ms: int | None, keep_ms: int | None):
        super().__init__(idle_ms, keep_ms)
        self.level, self.min_run, self.hysteresis, self.channels = level, min_run, hysteresis, channels

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("own", "phase string, heard long, streak long, count long, rest array<float>")
        self.held = handle.getListState("held", "samples array<float>")

    def take(self, key: tuple, packets: list[tuple[int, np.ndarray]], ended: bool) -> Iterator[pd.DataFrame]:
        trimmer, count, rest = Trimmer(self.level, self.min_run, self.hysteresis), 0, []
        if self.own.exists():
            trimmer.phase, trimmer.heard, trimmer.streak, count, rest = self.own.get()
            trimmer.held = [np.asarray(row[0], np.float32).reshape(-1, self.channels) for row in self.held.get()]
        before = list(trimmer.held)
        flat = np.concatenate([np.asarray(rest, np.float32), *(x for _, x in packets)])
        whole = len(flat) // self.channels * self.channels
        parts = trimmer.add(flat[:whole].reshape(-1, self.channels))
        if ended:
            parts = parts + trimmer.finish()
        kept = sum(map(len, parts))
        if kept:
            frames = np.repeat(np.arange(count, count + kept), self.channels)
            channel = np.tile(np.arange(key[1], key[1] + self.channels, dtype=np.int32), kept)
            yield pd.DataFrame({"track_id": key[0], "channel": channel, "frame_idx": frames, "sample": np.concatenate(parts).reshape(-1).astype(np.float32)})
        if ended:
            self.own.clear()
            self.held.clear()
            return
        self.own.update((trimmer.phase, trimmer.heard, trimmer.streak, count + kept, flat[whole:].tolist()))
        grown = len(trimmer.held) >= len(before) and all(a is b for a, b in zip(before, trimmer.held, strict=False))
        if grown:  # a silence goes on: what is held already stays where it is
            if len(trimmer.held) > len(before):
                self.held.appendList([(x.reshape(-1).tolist(),) for x in trimmer.held[len(before) :]])
        else:
            self.held.clear()
            if trimmer.held:
                self.held.put([(x.reshape(-1).tolist(),) for x in trimmer.held])


def _stateful(packets: DataFrame, processor: Channel, schema: str) -> DataFrame:
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = "ProcessingTime" if processor.idle_ms or processor.keep_ms else "None"
    return packets.groupBy("track_id", "channel").transformWithStateInPandas(processor, schema, "Append", timed)


def stream_windows(packets: DataFrame, sample_rate: int, flush_tail: bool = True, idle_ms: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """The windows of each channel as its packets arrive."""
    return _stateful(packets, WindowChannel(window_frames(sample_rate), flush_tail, idle_ms, keep_ms), WINDOWS)


def stream_ordered(packets: DataFrame, idle_ms: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """Packets in the order of their numbers, each once, as soon as none before it is missing."""
    return _stateful(packets, OrderedChannel(idle_ms, keep_ms), ORDERED)


def stream_trimmed(packets: DataFrame, level: float, min_run: int, hysteresis: int, channels: int = 1, idle_ms: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """Samples of tracks without long silences at the edges, frames numbered anew.

    With channels > 1 the samples of a packet are interleaved (packets may be cut within a frame) and all packets of a track
    carry one channel number, from which those of the result count up; a ragged last frame is left out.
    """
    return _stateful(packets, TrimmedChannel(level, min_run, hysteresis, channels, idle_ms, keep_ms), TRIMMED)
