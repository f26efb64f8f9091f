"""The lease machine of a run as a stream: one serial owner of state for each run.

Messages (run_id, kind, worker_id, job_id, lease_token, payload, at) come in any order and number; a
run's messages of one batch are taken by at. add opens job_id; claim, heartbeat, complete and fail
do as the table transitions of operators.queue do, under the same fences, and so do cancel,
clear_cancel, mark_failed, retry (job_id, or all failed jobs if null) and claim_merge; complete_merge
ends a merge for the worker that holds it. An unknown kind is not accepted. Late messages are turned
away by their token, not by a watermark.

Each message has one outcome, a retry one more for each job that it opens again. With expiry, leases
that end unrenewed are reported by a timer as outcomes of kind expired, once each; as in the store
such a lease may still complete until it is dealt anew. at is then in epoch seconds.

State is the jobs, those of near ids in one entry (see paged), and ordered sets of ids: of jobs that are
free to be dealt, of those leased until each second, of those that failed. A message reads and writes the
entries of the jobs that it names; a claim reads the least free id, and moves there what leases have ended
before it, each lease once. Nothing goes through all open jobs but a retry of all that failed, which goes
through those.

A run's messages of one batch may be any number: beyond HELD they wait in the state, in parts by at, and are
taken from there in order. Outcomes leave in frames of OUT rows, so memory is the same for any batch.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import namedtuple
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from .ordered import NODES, OrderedSets
from .paged import VALUES, Pages

MESSAGES = "run_id string, kind string, worker_id string, job_id bigint, lease_token string, payload string, at bigint"
OUTCOMES = "run_id string, kind string, worker_id string, job_id bigint, lease_token string, accepted boolean, state string, attempts int, at bigint, was string, was_attempts int, step int, run_state string, merge_state string, cancelled boolean"
COLUMNS = [x.split()[0] for x in OUTCOMES.split(", ")]

RUN = "state string, cancelled boolean, merge_state string, merge_worker_id string, unfinished bigint"
NEW_JOB = (S.PENDING, None, None, None, 0)
NEW_RUN = (S.RUNNING, False, S.PENDING, None, 0)
#: Ordered sets: jobs free to be dealt, seconds in which leases end, jobs leased until a second, jobs that failed, jobs to report at a second, times of messages that wait, parts of a time.
FREE, SECONDS, LEASES, FAILURES, DUE, TIMES, PARTS = range(7)
#: Messages of a run that are sorted in memory, messages of a part that waits, outcomes of a frame.
HELD, PART, OUT = 50_000, 5_000, 10_000
Message = namedtuple("Message", "kind worker_id job_id lease_token at")


def token(run_id: str, job_id: int, attempt: int, now: int) -> str:
    return hashlib.sha256(f"{run_id}|{job_id}|{attempt}|{now}".encode()).hexdigest()[:32]


class Leases(StatefulProcessor):
    """State: jobs, the run, ordered sets of ids, and messages that wait. Outcomes say what was before, and what the run is after."""

    def __init__(self, max_attempts: int = S.DEFAULT_MAX_ATTEMPTS, expiry: bool = False):
        self.max_attempts = max_attempts
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)
        self.jobs = Pages(handle.getMapState("jobs", "page bigint", VALUES))
        self.nodes = Pages(handle.getMapState("sets", NODES, VALUES))
        self.inbox = handle.getMapState("inbox", "at bigint, part bigint", "messages string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        (run_id,) = key
        self.index = OrderedSets(self.nodes)
        before = tuple(self.run.get()) if self.run.exists() else None
        self.now_run = before or NEW_RUN
        out, step = [], 0
        for m in self._in_order(rows):
            for row in self._one(run_id, m):
                out.append((*row, step, self.now_run[0], self.now_run[2], self.now_run[1]))
                step += 1
                if len(out) == OUT:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out = []
        if self.now_run != before:
            self.run.update(self.now_run)
        self._flush()
        yield pd.DataFrame(out, columns=COLUMNS)

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[object]:
        """Messages by at; of one at as they came."""
        pieces = self._pieces(rows)
        first, more = next(pieces), next(pieces, None)
        if more is None:
            yield from first.sort_values("at", kind="stable").itertuples()
            return
        part = 0
        for piece in itertools.chain([first, more], pieces):
            for at, those in piece.groupby("at", sort=False, dropna=False):
                self.index.add(TIMES, 0, int(at))
                columns = [[None if pd.isna(v) else v for v in those[c]] for c in ("kind", "worker_id", "lease_token")]
                jobs = [None if pd.isna(v) else int(v) for v in those["job_id"]]
                listed = list(zip(columns[0], columns[1], jobs, columns[2]))
                for k in range(0, len(listed), PART):
                    self.index.add(PARTS, int(at), part)
                    self.inbox.updateValue((int(at), part), (json.dumps(listed[k : k + PART]),))
                    part += 1
        while (at := self.index.least(TIMES, 0)) is not None:
            while (part := self.index.least(PARTS, at)) is not None:
                (listed,) = self.inbox.getValue((at, part))
                self.inbox.removeKey((at, part))
                self.index.remove(PARTS, at, part)
                for m in json.loads(listed):
                    yield Message(*m, at)
            self.index.remove(TIMES, 0, at)

    @staticmethod
    def _pieces(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What comes, in frames of about HELD rows."""
        held, n = [], 0
        for frame in rows:
            if held and n + len(frame) > HELD:
                yield pd.concat(held)
                held, n = [], 0
            held.append(frame)
            n += len(frame)
        if held:
            yield pd.concat(held)

    def _flush(self) -> None:
        self.index.flush()
        self.nodes.flush()
        self.jobs.flush()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        (run_id,) = key
        until = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1
        self.index, out, step = OrderedSets(self.nodes), [], 0
        run = tuple(self.run.get()) if self.run.exists() else NEW_RUN
        while (job := self.index.least(DUE, until)) is not None:
            self.index.remove(DUE, until, job)
            known = self._job(job)
            if known and known[0] == S.LEASED and known[3] == until:
                out.append((run_id, "expired", known[1], job, known[2], True, S.LEASED, known[4], until + 1, S.LEASED, known[4], step, run[0], run[2], run[1]))
                step += 1
            if len(out) == OUT:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        self._flush()
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass

    # ---- messages

    def _one(self, run_id: str, m: object) -> Iterable[tuple]:
        now = int(m.at)
        if m.kind == "claim":
            return [self._claim(run_id, m.worker_id, now)]
        if m.kind in ("add", "heartbeat", "complete", "fail"):
            return [self._of_job(run_id, m, now)]
        state, cancelled, merge, holder, unfinished = self.now_run
        accepted, opened = True, ()
        if m.kind == "cancel":
            cancelled = True
        elif m.kind == "clear_cancel":
            cancelled, state = False, S.RUNNING
        elif m.kind == "mark_failed":
            state, merge = S.FAILED, merge if merge == S.LEASED else S.FAILED
        elif m.kind == "retry":
            opened = self._reopen(None if pd.isna(m.job_id) else int(m.job_id))
            cancelled, state, merge = False, S.RUNNING, merge if merge == S.COMPLETED else S.PENDING
        elif m.kind == "claim_merge":
            accepted = not cancelled and merge == S.PENDING and unfinished == 0
            merge, holder = (S.LEASED, m.worker_id) if accepted else (merge, holder)
        elif m.kind == "complete_merge":
            accepted = merge == S.LEASED and holder == m.worker_id
            state, merge = (S.COMPLETED, S.COMPLETED) if accepted else (state, merge)
        else:
            accepted = False
        self.now_run = (state, cancelled, merge, holder, unfinished)
        told = merge if m.kind in ("claim_merge", "complete_merge") else state
        rows = [(run_id, m.kind, m.worker_id, None, None, accepted, told, None, now, None, None)]
        return itertools.chain(rows, ((run_id, m.kind, None, job, None, True, S.PENDING, 0, now, S.FAILED, attempts) for job, attempts in opened))

    def _claim(self, run_id: str, worker: str, now: int) -> tuple:
        job, known = (None, None) if self.now_run[1] else self._next(now)
        if job is None:
            return (run_id, "claim", worker, None, None, False, None, None, now, None, None)
        attempt = known[4] + 1
        given = token(run_id, job, attempt, now)
        self._put(job, known, (S.LEASED, worker, given, now + S.LEASE_SECONDS, attempt))
        return (run_id, "claim", worker, job, given, True, S.LEASED, attempt, now, known[0], known[4])

    def _of_job(self, run_id: str, m: object, now: int) -> tuple:
        job = None if pd.isna(m.job_id) else int(m.job_id)
        known = None if job is None else self._job(job)
        if m.kind == "add":
            fits = known is None and job is not None
            new = NEW_JOB if fits else None
            if fits:
                self.now_run = (*self.now_run[:4], self.now_run[4] + 1)
        else:
            fits = known is not None and known[0] == S.LEASED and known[1] == m.worker_id and known[2] == m.lease_token
            if m.kind == "heartbeat":
                fits = fits and known[3] >= now
                new = (S.LEASED, known[1], known[2], now + S.LEASE_SECONDS, known[4]) if fits else None
            else:
                new = (S.DONE if m.kind == "complete" else S.FAILED, None, None, None, known[4]) if fits else None
        if new:
            self._put(job, known, new)
        state, attempts = (new or known or (None,) * 5)[0], (new or known or (None,) * 5)[4]
        worker, given = (None, None) if m.kind == "add" else (m.worker_id, m.lease_token)
        return (run_id, m.kind, worker, job, given, bool(fits), state, attempts, now, *((known[0], known[4]) if known else (None, None)))

    def _reopen(self, job: int | None) -> Iterator[tuple[int, int]]:
        """Failed jobs, the one or all, are pending again without attempts; their ids and the attempts they had."""
        while (j := self.index.least(FAILURES, 0) if job is None else job) is not None:
            known = self._job(j)
            if known and known[0] == S.FAILED:
                self._put(j, known, NEW_JOB)
                yield j, known[4]
            if job is not None:
                break

    # ---- jobs

    def _job(self, job: int) -> tuple | None:
        return self.jobs.getValue((job,))

    def _put(self, job: int, old: tuple | None, new: tuple) -> None:
        if old:
            self._leave(job, old)
        self.jobs.updateValue((job,), new)
        if new[0] == S.DONE:
            self.now_run = (*self.now_run[:4], self.now_run[4] - 1)
            return
        if new[0] == S.LEASED:
            self._until(job, new[3])
            if self.expiry:
                self.index.add(DUE, new[3], job)
                self.handle.registerTimer((new[3] + 1) * 1000)
        elif new[0] == S.PENDING or new[4] < self.max_attempts:
            self.index.add(FREE, 0, job)
        if new[0] == S.FAILED:
            self.index.add(FAILURES, 0, job)

    def _until(self, job: int, second: int) -> None:
        self.index.add(LEASES, second, job)
        self.index.add(SECONDS, 0, second)

    def _leave(self, job: int, old: tuple) -> None:
        """Take a job out of the sets that it is in; a lease that has ended may be among the free ones already."""
        if old[0] == S.LEASED and self.index.remove(LEASES, old[3], job):
            if self.index.least(LEASES, old[3]) is None:
                self.index.remove(SECONDS, 0, old[3])
            return
        self.index.remove(FREE, 0, job)
        if old[0] == S.FAILED:
            self.index.remove(FAILURES, 0, job)

    def _next(self, now: int) -> tuple[int | None, tuple | None]:
        """The claimable job of the smallest id, and what it is."""
        while (second := self.index.least(SECONDS, 0)) is not None and second < now:
            while (job := self.index.least(LEASES, second)) is not None:
                self.index.remove(LEASES, second, job)
                self.index.add(FREE, 0, job)
            self.index.remove(SECONDS, 0, second)
        while (job := self.index.least(FREE, 0)) is not None:
            known = self._job(job)
            if known[0] != S.LEASED or known[3] < now:
                return job, known
            # a claim by a later clock found the lease ended; by this one's it runs on
            self.index.remove(FREE, 0, job)
            self._until(job, known[3])
        return None, None


def lease_stream(messages: DataFrame, max_attempts: int = S.DEFAULT_MAX_ATTEMPTS, expiry: bool = False) -> DataFrame:
    """Outcomes of a stream of messages. Needs the RocksDB state store provider.

    With expiry the query needs a processing-time trigger: timers keep an availableNow query from ending.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timers = "processingTime" if expiry else "none"
    return messages.groupBy("run_id").transformWithStateInPandas(Leases(max_attempts, expiry), OUTCOMES, "append", timers)
