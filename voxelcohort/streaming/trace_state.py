"""The ordered-event contract on an unbounded stream, held in streaming state: no event is read twice.

Events wait until the watermark has passed their time, then they are judged in order of ``seq`` against their run's state:
the first position of each milestone, the number of training steps, and which cases were seen. Seen cases are bits of
fixed-size chunks, so a batch rewrites only the chunks it touches; they are dropped at the milestone that counts them. A
run that is silent for ``idle`` is over: its missing milestones are reported and its state goes.

Each call of Spark and each touch of a state has a cost of its own, far above that of judging an event. So runs are dealt
by hash to ``SHARDS`` state keys, and a batch reads and writes the state of a shard's runs together.

Every broken rule of ``operators.trace.trace_violations`` comes out once, plus ``late_event`` for an event that arrived
behind the watermark and ``sequence`` for one whose ``seq`` lies before events already judged; neither of the two is judged
further. For events whose times follow ``seq`` and that are not late, the rows equal the batch rules.

Defined results: rows with null ``run_id`` only move the watermark; rows with null ``seq`` or time are ``sequence``
violations; a repeated event is judged again; an empty stream gives nothing; a run that speaks again after ``idle`` begins anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from voxelcohort.functions import order_bucket, with_rank
from voxelcohort.operators import trace as contract
from voxelcohort.session import read_if_present, small_side

SHARDS = 512  # state keys of a stream; a checkpoint holds to them
CHUNK = 4_096  # seen cases a chunk of bits holds
PACKED = 10_000  # waiting events a list entry holds
FOUND = "run_id string, check string, key string, detail string"
FIELDS = ("run_id", "at", "seq", "type", "case_id", "role", "idx", "epoch")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _event(fields: list) -> tuple:
    run, at, seq, kind, case, role, idx, epoch = fields
    number = lambda x: None if x is None else int(x)
    return run, number(at), number(seq), kind, case, role, number(idx), number(epoch)


class RunJudge(StatefulProcessor):
    """State of the runs of one shard; ``handleInputRows`` and ``handleExpiredTimer`` are called by Spark."""

    def __init__(self, epochs: int, n_train: int, n_outer: int, idle_ms: int):
        self.epochs, self.n_train, self.n_outer, self.idle_ms = epochs, n_train, n_outer, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        # pending timers: when the first waiting event is due (null: none waits), when the first run may be over
        self.clock = handle.getValueState("clock", "due long, bell long")
        self.held = handle.getListState("held", "events string")
        self.runs = handle.getValueState("runs", "marks string")
        self.seen = handle.getMapState("seen", "kind string, chunk long", "bits string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:  # rows without a run
            return
        watermark, found, first = timerValues.getCurrentWatermarkInMs(), [], None
        for frame in rows:
            at, events = frame["at"].to_numpy(dtype=float), frame["event"].to_numpy()
            waits = at >= watermark  # false without a place in the order
            for event, placed in zip(events[~waits], ~np.isnan(at[~waits])):
                run, _, seq, kind, *_ = _event(json.loads(event))
                where = f"{run}/{'' if seq is None else seq}"
                found.append((run, "late_event", where, kind or "") if placed else (run, "sequence", where, ""))
            if waits.any():
                self._hold(events[waits].tolist())
                earliest = int(at[waits].min())
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            due, bell = self.clock.get() or (None, None)
            if due is None or first + 1 < due:
                self.handle.registerTimer(first + 1)
                self.clock.update((first + 1, bell))
        if found:
            yield self._table(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, clock = timerValues.getCurrentWatermarkInMs(), self.clock.get()
        if clock is None or min(x for x in clock if x is not None) > watermark:
            return  # an earlier timer of this batch has done the work
        packs = self.held.get() if clock[0] is not None else ()
        events = [_event(fields) for (pack,) in packs for fields in json.loads(pack)]
        ready = sorted((e for e in events if e[1] < watermark), key=lambda e: (e[0], e[2], e[1]))
        left = [e for e in events if e[1] >= watermark]
        kept = self.runs.get()
        marks: dict = json.loads(kept[0]) if kept else {}
        for run, at, *_ in events:
            mine = marks.setdefault(run, {"ckpt": None, "arch": None, "seal": None, "steps": 0, "seq": None, "heard": at, "labels": [0], "images": [0]})
            mine["heard"] = max(mine["heard"], at)
        chunks: dict = {}
        found = []
        for run, own in groupby(ready, key=lambda e: e[0]):
            mine = marks[run]
            for event in own:
                found += [(run, *broken) for broken in self._judge(event, mine, chunks)]
        names = {"ckpt": contract.CHECKPOINT, "arch": contract.ARCHIVE, "seal": contract.SEAL}
        for run in [run for run, mine in marks.items() if mine["heard"] + self.idle_ms < watermark]:
            mine = marks.pop(run)
            for kind in ("labels", "images"):
                self._forget(kind, run, mine, chunks)
            found += [(run, "milestone_missing", run, name) for mark, name in names.items() if mine[mark] is None]
        self._save(marks, chunks)
        if ready:
            self.held.clear()
            self._hold([json.dumps(e) for e in left])
        due = min((e[1] for e in left), default=None)
        self._set_clock(clock, None if due is None else due + 1, min((m["heard"] for m in marks.values()), default=None))
        if found:
            yield self._table(found)

    def _table(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["run_id", "check", "key", "detail"])

    def _hold(self, events: list[str]) -> None:
        for i in range(0, len(events), PACKED):
            self.held.appendValue((f"[{','.join(events[i:i + PACKED])}]",))

    def _save(self, marks: dict, chunks: dict) -> None:
        if marks:
            self.runs.update((json.dumps(marks),))
        else:
            self.runs.clear()
        for at, runs in chunks.items():
            if runs:
                self.seen.updateValue(at, (json.dumps({run: bits.hex() for run, bits in runs.items()}),))
            else:
                self.seen.removeKey(at)

    def _set_clock(self, old: tuple, due: int | None, heard: int | None) -> None:
        """Timers that are still to come stay; a new one is asked for where the old one has rung or comes too late."""
        if heard is None:
            self.clock.clear()
            return
        new = (due, heard + self.idle_ms + 1)
        for was, at in zip(old, new):
            if at is not None and at != was:
                self.handle.registerTimer(at)
        self.clock.update(new)

    def _chunk(self, kind: str, chunk: int, chunks: dict) -> dict:
        """Bits of the shard's runs in a chunk of cases."""
        at = (kind, chunk)
        if at not in chunks:
            stored = json.loads(self.seen.getValue(at)[0]) if self.seen.containsKey(at) else {}
            chunks[at] = {run: bytearray.fromhex(bits) for run, bits in stored.items()}
        return chunks[at]

    def _see(self, kind: str, run: str, idx: int, marks: dict, chunks: dict) -> None:
        """Mark a case as seen and count it if it is new; after the count come the chunks that hold the run's bits."""
        chunk, bit = divmod(idx, CHUNK)
        runs = self._chunk(kind, chunk, chunks)
        if run not in runs:
            runs[run] = bytearray()
            marks[kind].append(chunk)
        bits = runs[run]
        bits.extend(bytes(max(0, bit // 8 + 1 - len(bits))))
        if not bits[bit // 8] >> bit % 8 & 1:
            bits[bit // 8] |= 1 << bit % 8
            marks[kind][0] += 1

    def _forget(self, kind: str, run: str, marks: dict, chunks: dict) -> None:
        for chunk in marks[kind][1:]:
            self._chunk(kind, chunk, chunks).pop(run, None)
        del marks[kind][1:]

    def _judge(self, event: tuple, marks: dict, chunks: dict) -> list[tuple]:
        run, _, seq, kind, case, role, idx, epoch = event
        key, case, broken = f"{run}/{seq}", case or "", []
        if marks["seq"] is not None and seq < marks["seq"]:
            return [("sequence", key, kind or "")]
        marks["seq"] = seq
        past = {m: marks[m] is not None and marks[m] < seq for m in ("ckpt", "arch", "seal")}
        text = "" if epoch is None else str(epoch)
        if kind not in contract.ALLOWED:
            broken.append(("event_prohibited", kind or ""))
        if kind in (contract.TRAIN_IMAGE, contract.TRAIN_LABEL):
            broken += [("train_open_after_checkpoint", case)] * past["ckpt"] + [("train_case_outside", case)] * (role != "train")
            if kind == contract.TRAIN_LABEL and role == "train" and marks["ckpt"] is None:
                self._see("labels", run, idx, marks, chunks)
        elif kind == contract.STEP:
            marks["steps"] += 1
            wrong = epoch != marks["steps"] or epoch > self.epochs
            broken += [("step_after_checkpoint", text)] * past["ckpt"] + [("step_order", text)] * wrong
        elif kind == contract.CHECKPOINT:
            broken += [("checkpoint_repeated", "")] * past["ckpt"] + [("checkpoint_epoch", text)] * (epoch != self.epochs)
            if marks["ckpt"] is None:
                marks["ckpt"] = seq
                if marks["labels"][0] < self.n_train or marks["steps"] != self.epochs:
                    broken.append(("checkpoint_incomplete", f"{marks['labels'][0]}+{marks['steps']}"))
                self._forget("labels", run, marks, chunks)
        elif kind == contract.ARCHIVE:
            broken += [("archive_before_checkpoint", "")] * (not past["ckpt"]) + [("archive_repeated", "")] * past["arch"]
            marks["arch"] = seq if marks["arch"] is None else marks["arch"]
        elif kind == contract.OUTER_IMAGE:
            broken += [("inference_before_archive", case)] * (not (past["ckpt"] and past["arch"])) + [("inference_after_seal", case)] * past["seal"]
            broken += [("inference_case_outside", case)] * (role != "val")
            if role == "val" and marks["seal"] is None:
                self._see("images", run, idx, marks, chunks)
        elif kind == contract.SEAL:
            broken += [("seal_before_archive", "")] * (not past["arch"]) + [("seal_repeated", "")] * past["seal"]
            if marks["seal"] is None:
                marks["seal"] = seq
                if marks["images"][0] < self.n_outer:
                    broken.append(("seal_incomplete", str(marks["images"][0])))
                self._forget("images", run, marks, chunks)
        elif kind == contract.OUTER_LABEL:
            broken += [("label_before_seal", case)] * (not past["seal"]) + [("label_case_outside", case)] * (role != "val")
        return [(check, key, detail) for check, detail in broken]


def trace_state_violations(stream: DataFrame, roles: DataFrame, epochs: int, delay: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """Violations ``(run_id, check, key, detail)`` of a stream ``(run_id, seq, ts, type, case_id, epoch)``, as they are certain.

    ``delay`` is how far event times may lag behind the newest one, ``idle`` the silence that ends a run. ``roles`` is
    ``(case_id, role)`` with ``train`` or ``val``, one role a case. The session's state store becomes RocksDB.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    cases = roles.groupBy(F.col("case_id").cast("string").alias("case_id")).agg(F.min("role").alias("role"))
    ranked = with_rank(cases, ["role"], ["case_id"], order_bucket(cases, "case_id"), name="idx").select("case_id", "role", (F.col("idx") - 1).alias("idx"))
    known = small_side(ranked)
    sizes = {r["role"]: r["count"] for r in known.groupBy("role").count().collect()}
    idle_ms = spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {idle}"))).first()[0]
    # the time travels as a number, since Spark drops rows behind the watermark where it sees the time column
    events = (
        stream.withWatermark("ts", delay)
        .select(F.col("run_id").cast("string").alias("run_id"), F.unix_millis("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "type",
                F.col("case_id").cast("string").alias("case_id"), F.col("epoch").cast("int").alias("epoch"))
        .join(known, "case_id", "left")
    )
    # an event travels and waits as one text; without a place in the order it has no time to wait for
    shard = F.when(F.col("run_id").isNotNull(), F.pmod(F.xxhash64("run_id"), F.lit(SHARDS))).otherwise(-1)
    event = F.to_json(F.array(*[F.col(c).cast("string") for c in FIELDS]))
    dealt = events.withColumn("shard", shard).repartition("shard")  # an arrival of few files is not packed by few tasks
    packed = dealt.select("shard", F.when(F.col("seq").isNotNull(), F.col("at")).alias("at"), event.alias("event"))
    judge = RunJudge(epochs, sizes.get("train", 0), sizes.get("val", 0), idle_ms)
    return packed.groupBy("shard").transformWithStateInPandas(judge, FOUND, "Append", "EventTime")


def watch_trace_stream(
    stream: DataFrame, roles: DataFrame, epochs: int, path: str, checkpoint: str, delay: str = "10 minutes", idle: str = "1 day", once: bool = True
) -> StreamingQuery:
    """Append the violations to parquet under ``path``; ``once`` takes what is there and ends."""
    found = trace_state_violations(stream, roles, epochs, delay, idle)
    started = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (started.trigger(availableNow=True) if once else started).start()


def violations_so_far(spark: SparkSession, path: str) -> DataFrame:
    """(check, key, detail) written so far; empty before the first batch."""
    found = read_if_present(spark, path)
    return (spark.createDataFrame([], FOUND) if found is None else found).select("check", "key", "detail")
