import datetime

import pytest

from loamframe.operators import ledger
from loamframe.storage import fresh_path
from loamframe.streaming import dispatch

NOW = datetime.datetime(2024, 1, 1)


class Service:
    """Jobs that go on by one status each time they are asked, and write events of it."""

    def __init__(self, spark, events, fails=()):
        self.spark, self.events, self.fails, self.jobs, self.calls, self.files = spark, events, fails, {}, [], 0

    def write(self, rows):
        rows = [(j, n, NOW, status, backend, None, None) for j, n, status, backend in rows]
        self.files += 1
        self.spark.createDataFrame(rows, ledger.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(self.events)

    def launch(self, job, backend):
        self.calls.append((job, backend))
        if job in self.fails:
            return self.write([(job, 1, "start_failed", backend)])
        self.jobs[job] = (1, backend)
        return self.write([(job, 1, "created", backend)])

    def poll(self, last):
        """Each job's next event, and once more the one before it, behind it."""
        rows = []
        for job, (n, backend) in list(self.jobs.items()):
            if n < len(last):
                self.jobs[job] = (n + 1, backend)
                rows += [(job, n + 1, last[n], backend), (job, n, last[n - 1], backend)]
        if rows:
            self.write(rows)


def run(spark, service, path, backends, launch=None):
    query = dispatch.dispatch(spark, service.events, path, backends, launch or service.launch, files=1)
    query.awaitTermination()
    assert query.exception() is None


def test_jobs_run_to_their_end_within_capacity(spark):
    events, path = fresh_path(spark, "test-events"), fresh_path(spark, "test-dispatch")
    backends = spark.createDataFrame([("foo", 0, 2), ("bar", 1, 1)], "backend string, position int, capacity int")
    service = Service(spark, events, fails=("job-3",))
    service.write([(f"job-{k}", 0, "not_started", None) for k in range(5)])
    for _ in range(8):
        run(spark, service, path, backends)
        active = {r.backend: r.active for r in dispatch.load(spark, path).collect()}
        assert active.get("foo", 0) <= 2 and active.get("bar", 0) <= 1
        service.poll(["created", "running", "finished"])
        if all(n == 3 for n, _ in service.jobs.values()) and len(service.jobs) == 4:
            break
    run(spark, service, path, backends)
    assert {r.job_id: r.status for r in dispatch.states(spark, path).collect()} == {f"job-{k}": "start_failed" if k == 3 else "finished" for k in range(5)}
    assert sorted(j for j, _ in service.calls) == [f"job-{k}" for k in range(5)] and {b for _, b in service.calls} == {"foo", "bar"}


def test_a_batch_that_is_run_again_launches_the_same_jobs(spark, monkeypatch):
    events, path = fresh_path(spark, "test-events"), fresh_path(spark, "test-dispatch")
    backends = spark.createDataFrame([("foo", 0, 1)], "backend string, position int, capacity int")
    service = Service(spark, events)
    service.write([(f"job-{k}", 0, "not_started", None) for k in range(3)])

    def broken(job, backend):
        raise ConnectionError(job)

    with pytest.raises(Exception, match="job-0"):
        run(spark, service, path, backends, broken)
    run(spark, service, path, backends)
    assert {j for j, _ in service.calls} == {"job-0"}
    monkeypatch.setattr(dispatch, "MERGE_EVERY", 1)
    service.poll(["created", "finished"])
    run(spark, service, path, backends)
    assert {r.job_id: r.status for r in dispatch.states(spark, path).collect()}["job-0"] == "finished" and ("job-1", "foo") in service.calls


def test_retries():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return 7

    assert ledger.with_retries(call, 0) == 7 and ledger.with_retries(lambda: (_ for _ in ()).throw(ConnectionError()), 0, 2) is None


@pytest.mark.parametrize("active,expected", [([], {"j0": "x", "j1": "x", "j2": "y"}), ([("x", 2)], {"j0": "y"}), ([("x", 5), ("y", 0)], {"j0": "y"})])
def test_assignments_fill_backends_in_order(spark, active, expected):
    waiting = spark.createDataFrame([(f"j{k}",) for k in range(6)], "job_id string")
    backends = spark.createDataFrame([("x", 0, 2), ("y", 1, 1)], "backend string, position int, capacity int")
    busy = spark.createDataFrame(active, "backend string, active long")
    assert {r.job_id: r.backend for r in ledger.assignments(waiting, backends, busy).collect()} == expected
