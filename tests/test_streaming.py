"""The lease machine on a plain state, against a plain queue; its counts and progress behind a stream."""

import collections
import gc
import types
import weakref

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from quillflow import schemas as S
from quillflow.operators import queue, summary
from quillflow.streaming import leases, ordered, paged, progress


class FakeMap(dict):
    reads = 0

    def getValue(self, key):
        self.reads += 1
        return self.get(key)

    updateValue = dict.__setitem__

    def removeKey(self, key):
        self.pop(key, None)

    def iterator(self):
        raise AssertionError("nothing goes through a whole map")


class FakeValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class FakeHandle:
    def __init__(self):
        self.maps, self.values, self.timers = collections.defaultdict(FakeMap), collections.defaultdict(FakeValue), []

    def getMapState(self, name, *_):
        return self.maps[name]

    def getValueState(self, name, *_):
        return self.values[name]

    def registerTimer(self, ms):
        self.timers.append(ms)


MESSAGE_NAMES = [x.split()[0] for x in leases.MESSAGES.split(", ")]


def machine(max_attempts=2, **options):
    made = leases.Leases(max_attempts, **options)
    made.init(FakeHandle())
    return made


def step(made, rows):
    frame = pd.DataFrame([("r", *r) for r in rows], columns=MESSAGE_NAMES).astype({"job_id": "Int64"})
    return pd.concat(list(made.handleInputRows(("r",), iter([frame]), None)))


# ---- ordered sets


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.sampled_from([-(2**63), -70, -1, 0, 1, 63, 64, 4095, 4096, 10**9, 2**63 - 1]), st.booleans())))
def test_ordered_sets_as_sets(steps):
    state, plain = FakeMap(), set()
    sets = ordered.OrderedSets(state)
    for adds, number, flush in steps:
        if adds:
            assert sets.add(1, 2, number) == (number not in plain)
            plain.add(number)
        else:
            assert sets.remove(1, 2, number) == (number in plain)
            plain.discard(number)
        if flush:
            sets.flush()
            assert all(-(2**63) <= v[0] < 2**63 and v[0] for v in state.values())
            sets = ordered.OrderedSets(state)
        assert sets.least(1, 2) == min(plain, default=None) and sets.least(1, 3) is None
    sets.flush()
    assert bool(state) == bool(plain)


# ---- leases


class PlainQueue:
    """Every claim looks through all jobs."""

    def __init__(self, limit):
        self.jobs, self.limit = {}, limit

    def free(self, j, now):
        state, _, until, attempts = j
        return state == S.PENDING or state == S.LEASED and until < now or state == S.FAILED and attempts < self.limit

    def take(self, kind, worker, job, given, now):
        if kind == "claim":
            job = min((k for k, j in self.jobs.items() if self.free(j, now)), default=None)
            if job is None:
                return None, False
            attempts = self.jobs[job][3] + 1
            self.jobs[job] = (S.LEASED, leases.token("r", job, attempts, now), now + S.LEASE_SECONDS, attempts)
            return job, True
        known = self.jobs.get(job)
        if kind == "add":
            if known is None:
                self.jobs[job] = (S.PENDING, None, None, 0)
            return job, known is None
        if kind == "retry":
            hit = [k for k, j in self.jobs.items() if j[0] == S.FAILED and job in (None, k)]
            self.jobs |= dict.fromkeys(hit, (S.PENDING, None, None, 0))
            return None, True
        fits = known is not None and known[0] == S.LEASED and known[1] == given
        if fits and kind == "heartbeat" and known[2] >= now:
            self.jobs[job] = (*known[:2], now + S.LEASE_SECONDS, known[3])
        elif fits and kind != "heartbeat":
            self.jobs[job] = (S.DONE if kind == "complete" else S.FAILED, None, None, known[3])
        else:
            fits = False
        return job, fits


KINDS = st.sampled_from(["add", "claim", "claim", "heartbeat", "complete", "fail", "retry"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(KINDS, st.integers(1, 6), st.integers(0, 9)), max_size=8), max_size=10), st.lists(st.integers(-60, 160), min_size=10, max_size=10))
def test_leases_deal_as_a_plain_queue(batches, jumps):
    """Batches of messages at clocks that may go back between them; every lease keeps its own token."""
    made, plain, counts, now = machine(), PlainQueue(2), progress.Summaries(2), 1000
    counts.init(FakeHandle())
    for rows, jump in zip(batches, jumps):
        now += jump
        sent, expected = [], []
        for kind, job, wait in rows:
            now += wait
            given = plain.jobs.get(job, (None, None))[1]
            job = None if kind == "claim" or kind == "retry" and job == 6 else job
            sent.append((kind, "w", job, given, None, now))
            expected.append((kind, *plain.take(kind, "w", job, given, now)))
        if not sent:
            continue
        out = step(made, sent)
        heads = out[(out.kind != "retry") | out.job_id.isna()]
        assert [(o.kind, None if pd.isna(o.job_id) else o.job_id, bool(o.accepted)) for o in heads.itertuples()] == [(k, None if k == "retry" else j, a) for k, j, a in expected]
        assert {k: made._job(k)[0] for k in plain.jobs} == {k: j[0] for k, j in plain.jobs.items()}
        told = next(iter(counts.handleInputRows(("r",), iter([out.sample(frac=1, random_state=1)]), None))).iloc[0]
        states = collections.Counter(j[0] for j in plain.jobs.values())
        assert {s: told[s] for s in S.JOB_STATES} == {s: states[s] for s in S.JOB_STATES} and told.total == len(plain.jobs)
        assert told.retryable == sum(j[0] == S.FAILED and j[3] < 2 for j in plain.jobs.values())


def test_a_claim_among_a_million_open_jobs_reads_a_few_entries():
    made, n = machine(), 1_000_000
    frame = pd.DataFrame({"run_id": "r", "kind": "add", "worker_id": None, "job_id": range(1, n + 1), "lease_token": None, "payload": None, "at": 1})
    list(made.handleInputRows(("r",), iter([frame]), None))
    state = made.handle.maps
    for k in range(1, 4):
        for m in state.values():
            m.reads = 0
        out = step(made, [("claim", f"w{k}", None, None, None, 100 + k)])
        assert out.job_id.tolist() == [k] and sum(m.reads for m in state.values()) < 80
    for m in state.values():
        m.reads = 0
    out = step(made, [("claim", "w9", None, None, None, 1000)])  # the three leases have ended: each moves once
    assert out.job_id.tolist() == [1] and out.attempts.tolist() == [2] and sum(m.reads for m in state.values()) < 250


def test_expired_leases_are_reported_once_from_the_sets():
    made = machine(expiry=True)
    step(made, [("add", None, k, None, None, 1) for k in (1, 2, 3)] + [("claim", w, None, None, None, 10) for w in "abc"])
    step(made, [("heartbeat", "b", 2, leases.token("r", 2, 1, 10), None, 50), ("fail", "c", 3, leases.token("r", 3, 1, 10), None, 51)])
    assert sorted(set(made.handle.timers)) == [131_000, 171_000]
    due = lambda ms: pd.concat(list(made.handleExpiredTimer(("r",), None, types.SimpleNamespace(getExpiryTimeInMs=lambda: ms))))
    assert [(o.job_id, o.worker_id, o.at) for o in due(131_000).itertuples()] == [(1, "a", 131)]
    assert due(131_000).empty and due(171_000).job_id.tolist() == [2]


def _watched(frames, alive):
    """Frames as they are asked for; alive gets how many of those before are still held."""
    refs = []
    for frame in frames:
        gc.collect()
        alive.append(sum(r() is not None for r in refs))
        refs.append(weakref.ref(frame))
        yield frame
        del frame


def _mixed(n):
    """Messages of n jobs in no order, and the same ones by at: all added, half dealt, some done or failed."""
    given = lambda k: leases.token("r", k, 1, 2)
    rows = [("add", None, k, None, None, 1) for k in range(1, n + 1)] + [("claim", "w", None, None, None, 2) for _ in range(n // 2)]
    rows += [("complete" if k % 2 else "fail", "w", k, given(k), None, 3 + k % 5) for k in range(1, n + 1, 3)]
    mixed = pd.DataFrame([("r", *r) for r in rows], columns=MESSAGE_NAMES).sample(frac=1, random_state=3).astype({"job_id": "Int64"})
    return mixed


def test_a_batch_of_any_size_is_taken_in_order_without_holding_it(monkeypatch):
    whole = _mixed(3000)
    expected = pd.concat(list(machine().handleInputRows(("r",), iter([whole]), None)))
    for name, n in (("HELD", 500), ("PART", 60), ("OUT", 200)):
        monkeypatch.setattr(leases, name, n)
    alive, made = [], machine()
    got = list(made.handleInputRows(("r",), _watched((whole.iloc[k : k + 100].copy() for k in range(0, len(whole), 100)), alive), None))
    assert len(alive) > 50 and max(alive) <= 15 and max(map(len, got)) <= 200
    assert not made.handle.maps["inbox"]
    keys = ["kind", "job_id", "lease_token", "accepted", "state", "attempts", "at"]
    rows = lambda frame: collections.Counter(tuple(None if pd.isna(v) else v for v in r) for r in frame[keys].itertuples(index=False))
    assert rows(pd.concat(got)) == rows(expected) and pd.concat(got)["step"].tolist() == list(range(len(expected)))
    assert [made._job(k)[0] for k in (1, 2, 4)] == [S.DONE, S.LEASED, S.FAILED]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["put", "remove", "flush"]), st.sampled_from([-(2**63), -1, 0, 1, 1023, 1024, 2**40, 2**63 - 1]), st.integers(0, 3))))
def test_pages_as_a_map(steps):
    state, plain = FakeMap(), {}
    pages = paged.Pages(state)
    for what, number, value in steps:
        if what == "put":
            pages.updateValue((7, number), ("x", None, value))
            plain[number] = ("x", None, value)
        elif what == "remove":
            pages.removeKey((7, number))
            plain.pop(number, None)
        else:
            pages.flush()
            assert not pages.kept and bool(state) == bool(plain)
        assert pages.getValue((7, number)) == plain.get(number)


def test_jobs_of_a_batch_take_few_looks_at_the_state():
    made = machine()
    list(made.handleInputRows(("r",), iter([_mixed(3000)]), None))
    assert sum(m.reads for m in made.handle.maps.values()) < 300


# ---- counts behind a stream


def test_summaries_take_outcomes_frame_by_frame():
    """Frames in any order, none of which is held when the next one comes."""
    out = pd.concat(list(machine().handleInputRows(("r",), iter([_mixed(3000)]), None)))
    made, plain, alive = progress.Summaries(2), progress.Summaries(2), []
    made.init(FakeHandle())
    plain.init(FakeHandle())
    one = next(iter(plain.handleInputRows(("r",), iter([out]), None))).iloc[0]
    two = next(iter(made.handleInputRows(("r",), _watched((out.iloc[k : k + 100].copy() for k in reversed(range(0, len(out), 100))), alive), None))).iloc[0]
    assert len(alive) > 30 and max(alive) <= 1 and one.equals(two) and one.total == 3000


RUN = ("state", "merge_state", "cancel_requested", "total", "done", "leased", "failed", "pending", "retryable")


def test_summaries_follow_the_tables(spark, tmp_path):
    """After every batch equal to summary over tables that went through the same transitions."""
    t = leases.token
    config = "named_struct(" + ", ".join(f"'{k}', cast({2 if k == 'max_attempts' else 'null'} as {v})" for k, v in S.CONFIG_FIELDS.items()) + ")"
    runs = spark.sql(f"select r run_id, {config} config, 'running' state, false cancel_requested, 'pending' merge_state, cast(null as string) merge_worker_id, 90L started_at, 90L updated_at, cast(null as string) output_path, cast(null as string) error from values ('a'), ('b') v(r)")
    jobs = queue.add_jobs(spark.createDataFrame([], S.JOBS), spark.sql("select 'a' run_id, 'x' xhtml_path, array(cast(id as int)) locator, 's' source from range(3) union all select 'b', 'x', array(0), 's'"))
    waiting = lambda *rows: spark.createDataFrame(list(rows), "run_id string, worker_id string, turn int")
    asked = lambda *rows: spark.createDataFrame(list(rows), "run_id string, id long, worker_id string, lease_token string, result string, error string")
    m = lambda run, kind, at, worker=None, job=None, given=None: (run, kind, worker, job, given, None, at)

    batches, tables = [], []
    batches.append([m("a", "add", 90, job=k) for k in (1, 2, 3)] + [m("b", "add", 90, job=1)])
    tables.append((jobs, runs))
    batches.append([m("a", "claim", 100, "w"), m("a", "claim", 100, "v"), m("b", "claim", 100, "u"), m("b", "cancel", 101)])
    jobs, _ = queue.claim(jobs, runs, waiting(("a", "w", 0), ("a", "v", 1), ("b", "u", 0)), 100)
    runs = queue.request_cancel(runs, "b", 101)
    tables.append((jobs, runs))
    batches.append([m("a", "fail", 110, "w", 1, t("a", 1, 1, 100)), m("a", "complete", 111, "v", 2, t("a", 2, 1, 100)), m("b", "claim", 111, "u"), m("b", "complete", 112, "u", 1, "stale"), m("a", "mystery", 113)])
    jobs, _ = queue.fail(jobs, asked(("a", 1, "w", t("a", 1, 1, 100), None, "e")))
    jobs, _ = queue.complete(jobs, asked(("a", 2, "v", t("a", 2, 1, 100), "s", None), ("b", 1, "u", "stale", "s", None)))
    tables.append((jobs, runs))
    batches.append([m("a", "claim", 120, "w"), m("a", "fail", 121, "w", 1, t("a", 1, 2, 120)), m("a", "mark_failed", 122), m("b", "clear_cancel", 123)])
    jobs, _ = queue.claim(jobs, runs, waiting(("a", "w", 0)), 120)
    jobs, _ = queue.fail(jobs, asked(("a", 1, "w", t("a", 1, 2, 120), None, "e")))
    runs = queue.clear_cancel(queue.mark_failed(runs, "a", "e", 122), "b", 123)
    tables.append((jobs, runs))
    batches.append([m("a", "retry", 130), m("b", "claim_merge", 131, "u"), m("b", "complete", 132, "u", 1, t("b", 1, 1, 100)), m("b", "claim_merge", 133, "u")])
    jobs, runs, _ = queue.retry_failed(jobs, runs, "a", 130)
    jobs, _ = queue.complete(jobs, asked(("b", 1, "u", t("b", 1, 1, 100), "s", None)))
    runs, _ = queue.try_claim_merge(jobs, runs, waiting(("b", "u", 0)), 133)
    tables.append((jobs, runs))

    source, shown = str(tmp_path / "in"), {}
    for rows, (jobs, runs) in zip(batches, tables):
        spark.createDataFrame(rows, leases.MESSAGES).coalesce(1).write.mode("append").parquet(source)
        counts = progress.summaries(leases.lease_stream(spark.readStream.schema(leases.MESSAGES).parquet(source), 2), 2)
        show = lambda rows, _: shown.update({r["run_id"]: r for r in rows.collect()})
        q = progress.progress(counts, tables[0][1]).writeStream.outputMode("update").foreachBatch(show).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        expected = {r["run_id"]: r for r in summary.summary(jobs, runs).collect()}
        assert {k: [r[c] for c in RUN] for k, r in shown.items()} == {k: [r[c] for c in RUN] for k, r in expected.items()}
        assert all(shown[k][c] == r[c] for k, r in expected.items() for c in ("model", "thinking", "workers", "max_attempts", "started_at"))
    assert shown["b"]["line"] == "EPUB merging · 1/1" and shown["a"]["line"] == "EPUB translating · 1/3 complete · 0 active · 0 failed · 40s"
