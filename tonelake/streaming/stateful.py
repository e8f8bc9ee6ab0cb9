"""Stateful streaming: count windows, envelopes, resumable framing, fresh segments and stalls.

State is kept per stream and holds little, whatever is lost: sums of a bounded number of open windows, a remainder of bytes
and a bounded number of early ones, a time. Frames may come in any order, also across batches: a window's sums don't
depend on it, and displays wait for the window that is next.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonelake.plans.settings import Envelope, Settings
from tonelake.session import ready
from tonelake.sources.containers import icy
from tonelake.sources.files import AUDIO_TYPES

if TYPE_CHECKING:
    import pandas as pd

JSON = "state string"


def _load(state: GroupState, start: dict) -> dict:
    return json.loads(state.get[0]) if state.exists else start


def add_windows(s: dict, sums: list[tuple[int, list[int]]], n: int, patience: int, e: Envelope) -> list[tuple]:
    """Adds (window, [frames, sums and maxima of both sides]) to the state and takes out what is settled, in order.

    A window is settled when it is whole and none before it is awaited, or when one ``patience`` further on has been seen,
    whole or not: then it comes out if it is whole, and is left out for good if it isn't. So no more than ``patience``
    windows are open, whatever is lost.
    """
    for w, row in sums:
        if w >= s["next"]:
            old = s["open"].get(str(w), [0, 0, 0, 0, 0])
            s["open"][str(w)] = [old[0] + row[0], old[1] + row[1], old[2] + row[2], max(old[3], row[3]), max(old[4], row[4])]
    out, order = [], sorted(map(int, s["open"]))
    seen = order[-1] if order else -1
    for w in order:
        own = s["open"][str(w)]
        late = w <= seen - patience
        if not late and (own[0] < n or w > s["next"] and s["next"] > seen - patience):
            break
        del s["open"][str(w)]
        s["next"] = w + 1
        if own[0] < n:
            continue
        left = own[1] // n
        if left > s["display"]:
            s["display"], s["hold"] = min(s["display"] + e.attack, 255), e.hold
        elif s["hold"] == 0:
            s["display"] -= min(s["display"] - left, e.release)
        else:
            s["hold"] -= 1
        out.append((w, left, own[2] // n, own[3], own[4], s["display"]))
    s["next"] = max(s["next"], seen - patience + 1)
    return out


def vu_windows(pcm: DataFrame, frames: int | None = None, e: Envelope | None = None, patience: int = 64) -> DataFrame:
    """(stream_id, window_no, left_mean, right_mean, left_max, right_max, display) of whole windows, in order.

    As in batch, which leaves windows with lost frames out: so does this once a window ``patience`` further on is
    seen, and what comes later for one left out is ignored; state is bounded. ``display`` is the envelope of the left mean.
    """
    n, shape = frames or Settings().window, e or Settings().vu_bars

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        s = _load(state, {"open": {}, "next": 0, "display": 0, "hold": 0})
        came = pd.concat(list(parts)).groupby("window_no").agg({"n": "sum", "l": "sum", "r": "sum", "lm": "max", "rm": "max"})  # in order of windows
        for i in range(0, len(came), AT_ONCE):
            own = came.iloc[i : i + AT_ONCE]
            out = [(key[0], *row) for row in add_windows(s, list(zip(own.index.tolist(), own.to_numpy().tolist())), n, patience, shape)]
            yield pd.DataFrame(out, columns=["stream_id", "window_no", "left_mean", "right_mean", "left_max", "right_max", "display"])
        state.update((json.dumps(s),))

    schema = "stream_id string, window_no long, left_mean int, right_mean int, left_max int, right_max int, display int"
    return window_sums(pcm, n).groupBy("stream_id").applyInPandasWithState(run, schema, JSON, "append", GroupStateTimeout.NoTimeout)


#: Windows that are added to a state at a time, and sums that a task holds before it gives them out.
AT_ONCE = 4096


def window_sums(pcm: DataFrame, n: int) -> DataFrame:
    """(stream_id, window_no, n, l, r, lm, rm): frames, sums and maxima of both sides' levels, a row or several per window.

    Frames are dealt by stream and window, so what goes to a stream's state is a row per window, not its frames.
    """
    ready(pcm.sparkSession)

    def level(side: str) -> Column:
        return F.least(F.shiftright(F.abs(F.col(side).cast("long")), 23), F.lit(255)).cast("long")

    rows = pcm.where("frame_no IS NOT NULL").select("stream_id", F.expr(f"CAST((frame_no - pmod(frame_no, {n})) div {n} AS BIGINT)").alias("window_no"), F.lit(1).cast("long").alias("n"), level("left").alias("l"), level("right").alias("r"))
    rows = rows.withColumns({"lm": F.col("l"), "rm": F.col("r")})
    names = rows.columns
    how = list(zip(names[2:], ("sum", "sum", "sum", "max", "max")))

    def summed(tables: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(tables).group_by(names[:2]).aggregate(how)
        return pa.table([*(found.column(k) for k in names[:2]), *(found.column(f"{c}_{f}") for c, f in how)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(summed([pa.Table.from_batches([batch])]))
            if sum(map(len, held)) > AT_ONCE:
                held = [summed(held)]
                if len(held[0]) > AT_ONCE:
                    yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()

    return rows.repartition("stream_id", "window_no").mapInArrow(run, rows.schema)


#: Bytes that pieces may be ahead of what is missing before it counts as lost.
AHEAD = 1 << 20


def arrived(s: dict, pieces: list[tuple[int, bytes]], ahead: int = AHEAD) -> tuple[bytes, bool]:
    """What is at hand in a row, from the place s["at"] less its length on, and whether bytes before it were given up.

    Pieces come in any order and may repeat or overlap. Those too early wait, ``ahead`` bytes of them at most; beyond, what
    is missing is lost and the first of them is next.
    """
    for offset, data in pieces:
        held = base64.b64encode(data).decode()
        if offset + len(data) > s["at"] and len(held) > len(s["early"].get(str(offset), "")):
            s["early"][str(offset)] = held
    rest, lost = base64.b64decode(s["rest"]), False
    while s["early"]:
        first = min(map(int, s["early"]))
        if first > s["at"]:
            if sum(len(v) // 4 * 3 - v.count("=") for v in s["early"].values()) <= ahead:
                break
            rest, lost, s["at"] = b"", True, first
        data = base64.b64decode(s["early"].pop(str(first)))[s["at"] - first :]
        rest, s["at"] = rest + data, s["at"] + len(data)
    return rest, lost


def _pieces(parts: Iterator[pd.DataFrame]) -> list[tuple[int, bytes]]:
    return [(o, bytes(d)) for part in parts for o, d in zip(part["offset"].tolist(), part["data"].tolist()) if d is not None]


def icy_titles(pieces: DataFrame, metaint: int, ahead: int = AHEAD) -> DataFrame:
    """(stream_id, audio_pos, meta) of (stream_id, offset, data) arriving piecewise: a parser that resumes.

    What is left of a batch, up to a whole block, is kept as state; so are pieces that came too early, ``ahead`` bytes at most.
    Where a block begins is told by the one before, so after a loss nothing more comes until the stream begins anew at 0.
    """
    ready(pieces.sparkSession)
    start = {"at": 0, "played": 0, "rest": "", "early": {}}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        s, came, out = _load(state, dict(start, early={})), _pieces(parts), []
        if s.get("lost") and any(o == 0 for o, _ in came):
            s = dict(start, early={})
        if not s.get("lost"):
            rest, lost = arrived(s, came, ahead)
            used = 0
            while not lost and len(rest) > used + metaint and len(rest) >= used + metaint + 1 + rest[used + metaint] * 16:
                end = used + metaint + 1 + rest[used + metaint] * 16
                for _, audio, meta in icy(metaint)(rest[used:end]):
                    s["played"] += len(audio)
                    if meta:
                        out.append((key[0], s["played"], meta.decode("utf-8", "replace")))
                used = end
            s["rest"] = base64.b64encode(rest[used:]).decode()
            s = {"lost": True} if lost else s
        state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=["stream_id", "audio_pos", "meta"])

    return pieces.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, audio_pos long, meta string", JSON, "append", GroupStateTimeout.NoTimeout)


#: Packets of unknown programs that wait for the first program map.
UNTOLD = 4096


class Transport:
    """The state of an MPEG-TS stream: what programs and audio streams are known, and packets that came before."""

    def __init__(self, s: dict) -> None:
        self.s = s

    @staticmethod
    def new() -> dict:
        return {"at": 0, "rest": "", "early": {}, "maps": [], "pids": [], "untold": []}

    def packets(self, rest: bytes) -> list[tuple[int, int, bytes]]:
        """(packet number, pid, audio) of the packets at hand; what is left goes back to the state."""
        first, out = self.s["at"] - len(rest), []
        used = -first % 188
        while used + 188 <= len(rest):
            if (p := rest[used : used + 188])[0] == 0x47:
                out += self._packet((first + used) // 188, p)
            used += 188
        self.s["rest"] = base64.b64encode(rest[min(used, len(rest)) :] if used <= len(rest) else b"").decode()
        return out

    def _packet(self, no: int, p: bytes) -> list[tuple[int, int, bytes]]:
        pid, start = int.from_bytes(p[1:3], "big") & 0x1FFF, bool(p[1] & 0x40)
        if not p[3] & 0x10:
            return []
        body = p[5 + p[4] if p[3] & 0x20 else 4 :]
        if pid == 0 and start:
            self.s["maps"] = sorted({*self.s["maps"], *self._programs(body)})
        elif pid in self.s["maps"] and start:
            self.s["pids"] = sorted({*self.s["pids"], *self._audio(body)})
            told, self.s["untold"] = self.s["untold"], []
            return [row for n, k, first, b in told if k in self.s["pids"] for row in [(n, k, self._data(base64.b64decode(b), first))]]
        elif pid in self.s["pids"]:
            return [(no, pid, self._data(body, start))]
        elif not self.s["pids"]:
            self.s["untold"] = [*self.s["untold"], [no, pid, start, base64.b64encode(body).decode()]][-UNTOLD:]
        return []

    @staticmethod
    def _programs(body: bytes) -> list[int]:
        t = body[1 + body[0] :]
        n = (int.from_bytes(t[1:3], "big") & 0xFFF) - 9
        return [int.from_bytes(t[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, 8 + n // 4 * 4, 4) if int.from_bytes(t[i : i + 2], "big")]

    @staticmethod
    def _audio(body: bytes) -> list[int]:
        t = body[1 + body[0] :]
        if t[:1] != b"\x02":
            return []
        end, at, out = (int.from_bytes(t[1:3], "big") & 0xFFF) - 1, 12 + (int.from_bytes(t[10:12], "big") & 0xFFF), []
        while at + 5 <= min(end, len(t)):
            if t[at] in AUDIO_TYPES:
                out.append(int.from_bytes(t[at + 1 : at + 3], "big") & 0x1FFF)
            at += 5 + (int.from_bytes(t[at + 3 : at + 5], "big") & 0xFFF)
        return out

    @staticmethod
    def _data(body: bytes, start: bool) -> bytes:
        return body[9 + body[8] :] if start and body[:3] == b"\0\0\x01" and len(body) > 8 else body


def ts_audio(pieces: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """(stream_id, packet_no, pid, data) of (stream_id, offset, data) arriving piecewise, cut anywhere: as ``files.ts_audio``.

    State per stream: a part of a packet, the programs and audio streams told so far, and up to ``UNTOLD`` packets from before the
    first program map. After a loss it goes on with the next packet, whose place follows from its offset.
    """
    ready(pieces.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        ts = Transport(_load(state, Transport.new()))
        rest, _ = arrived(ts.s, _pieces(parts), ahead)
        out = [(key[0], *row) for row in ts.packets(rest)]
        state.update((json.dumps(ts.s),))
        yield pd.DataFrame(out, columns=["stream_id", "packet_no", "pid", "data"])

    return pieces.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, packet_no int, pid int, data binary", JSON, "append", GroupStateTimeout.NoTimeout)


def fresh_segments(segments: DataFrame) -> DataFrame:
    """(playlist_id, fetch_no, line_no, url): of each fetch of a playlist, the segments after the one played last."""
    ready(segments.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        s = _load(state, {"last": None})
        rows = pd.concat(list(parts)).sort_values(["fetch_no", "line_no"])
        out = []
        for fetch, own in rows.groupby("fetch_no"):
            urls = own["url"].tolist()
            after = len(urls) - urls[::-1].index(s["last"]) if s["last"] in urls else 0
            out += [(key[0], fetch, n, u) for n, u in zip(own["line_no"].tolist()[after:], urls[after:])]
            s["last"] = urls[-1] if urls else s["last"]
        state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=["playlist_id", "fetch_no", "line_no", "url"])

    return segments.groupBy("playlist_id").applyInPandasWithState(run, "playlist_id string, fetch_no long, line_no int, url string", JSON, "append", GroupStateTimeout.NoTimeout)


def stalls(arrivals: DataFrame, after_ms: int = 2000, lost: int = 5) -> DataFrame:
    """(stream_id, event, count) of (stream_id, n_bytes): 'slow stream' each time nothing comes for ``after_ms``, and
    'reconnect' in place of the ``lost``-th in a row. Any bytes start the count anew.
    """
    ready(arrivals.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        count, out = _load(state, {"count": 0})["count"], []
        if state.hasTimedOut:
            count += 1
            out.append((key[0], "reconnect" if count >= lost else "slow stream", count))
            count = 0 if count >= lost else count
        elif sum(int(p["n_bytes"].sum()) for p in parts):
            count = 0
        state.update((json.dumps({"count": count}),))
        state.setTimeoutDuration(after_ms)
        yield pd.DataFrame(out, columns=["stream_id", "event", "count"])

    return arrivals.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, event string, count int", JSON, "append", GroupStateTimeout.ProcessingTimeTimeout)


def event_queue(events: DataFrame, limit: int = 1000, drain: int = 100, every_ms: int | None = None) -> DataFrame:
    """(stream_id, seq, e, s, dropped) of (stream_id, seq, e, s): a bounded queue per stream, drained ``drain`` a trigger.

    Events join in the order of ``seq``; once ``limit`` wait the newest are dropped, and ``dropped`` says how many were up
    to the event's own turn to leave. State is the waiting events, ``limit`` at most. With ``every_ms`` the queue is drained on without arrivals.
    """
    ready(events.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        s = _load(state, {"waiting": [], "dropped": 0})
        came = sorted((list(r) for part in parts for r in part[["seq", "e", "s"]].itertuples(index=False)), key=lambda r: r[0])
        room = limit - len(s["waiting"])
        s["waiting"] += [[int(n), None if pd.isna(e) else int(e), t] for n, e, t in came[:room]]
        s["dropped"] += max(0, len(came) - room)
        out, s["waiting"] = s["waiting"][:drain], s["waiting"][drain:]
        state.update((json.dumps(s),))
        if every_ms and s["waiting"]:
            state.setTimeoutDuration(every_ms)
        yield pd.DataFrame([(key[0], *r, s["dropped"]) for r in out], columns=["stream_id", "seq", "e", "s", "dropped"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if every_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, e int, s string, dropped long", JSON, "append", timeout)


def lyrics_due(positions: DataFrame, lines: DataFrame) -> DataFrame:
    """(stream_id, line_no, ts_ms, text, block_no) of (stream_id, block_no, time_ms, seek): each line with the first block whose
    time is strictly past the line's, as in batch, whatever the triggers.

    ``lines`` (stream_id, line_no, ts_ms, text) is a table: a song's lines are few and joined as one array. State is the
    number of lines shown and the last block seen. A position with ``seek`` moves back, or on, to the last line at or before
    it, from which lines are due again. Positions come in the order of block_no within a stream, across triggers.
    """
    ready(positions.sparkSession)
    of = lines.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ts_ms").cast("long").alias("ts_ms"), F.col("line_no").cast("int").alias("line_no"), "text"))).alias("lines"))
    rows = positions.select("stream_id", F.col("block_no").cast("long").alias("block_no"), F.col("time_ms").cast("long").alias("time_ms"), F.col("seek").cast("boolean").alias("seek")).join(of, "stream_id")

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        s, out = _load(state, {"next": 0}), []
        came = [r for part in parts for r in part.itertuples(index=False)]
        for r in sorted(came, key=lambda r: r.block_no):
            song = r.lines
            if r.seek:
                s["next"] = max(0, sum(x["ts_ms"] <= r.time_ms for x in song) - 1)
            while s["next"] < len(song) and song[s["next"]]["ts_ms"] < r.time_ms:
                x = song[s["next"]]
                out.append((key[0], x["line_no"], x["ts_ms"], x["text"], r.block_no))
                s["next"] += 1
        state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=["stream_id", "line_no", "ts_ms", "text", "block_no"])

    return rows.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, line_no int, ts_ms long, text string, block_no long", JSON, "append", GroupStateTimeout.NoTimeout)
