import pytest

from quarryline.operators import queue as Q

JOBS = "id string, kind string, adapter string, created double"


@pytest.fixture
def made(spark, tmp_path):
    def make(*jobs, publish=False, gpu=1024, ready=True):
        own = Q.Queue(spark, str(tmp_path / "jobs"))
        own.submit(spark.createDataFrame(list(jobs), JOBS))
        adapters = spark.createDataFrame([("test", "training", ready, gpu), ("look", "research", True, 0), ("say", "proposal", True, 0)], "name string, kind string, ready boolean, gpu_mb int")
        return own, Q.Settings(adapters, {"research": 60, "training": 120, "proposal": 60}, 512, publish)
    return make


def states(own):
    return {r.id: (r.status, r.reason) for r in own.jobs().collect()}


FREE = Q.Memory(24000)


def test_busy_memory_never_launches(made):
    own, settings = made(("a", "training", "test", 1.0))
    for memory in (Q.Memory(24000, True), Q.Memory(1500)):
        assert own.claim(settings, memory).outcome == "blocked" and states(own) == {"a": ("blocked", Q.NO_MEMORY)}
    assert own.claim(settings, Q.Memory(None)).outcome == "blocked" and states(own) == {"a": ("blocked", Q.NO_INVENTORY)}
    assert own.claim(settings, Q.Memory(1536)).job["id"] == "a" and states(own) == {"a": ("running", "")}


def test_two_rounds(made):
    """A job that yields goes back into the queue with its time, and the kind that used less goes first."""
    own, settings = made(("a", "training", "test", 1.0), ("b", "research", "look", 2.0), ("c", "research", "look", 3.0))
    assert own.claim(settings, FREE).job["id"] == "a"
    assert own.claim(settings, FREE).outcome == "unresolved"
    assert own.settle(settings, "a", Q.AGAIN, 30.0, metrics={"checkpoint_step": 5, "source_count": -1, "other": 3}) == "queued"
    assert states(own)["a"] == ("queued", "checkpoint yielded")
    row = own.jobs().where("id = 'a'").first()
    assert (row.elapsed, row.metrics) == (30.0, '{"checkpoint_step": 5}')
    assert own.claim(settings, FREE).job["id"] == "b"
    assert own.settle(settings, "b", 0, 10.0) == "completed"  # 10 of 60 used by research, 30 of 120 by training
    assert own.claim(settings, FREE).job["id"] == "c"
    assert own.settle(settings, "c", 3, 50.0) == "failed" and states(own)["c"] == ("failed", "adapter exit 3")
    taken = own.claim(settings, FREE)
    assert taken.job["id"] == "a" and taken.job["elapsed"] == 30.0
    assert own.settle(settings, "a", 0, 151.0) == "blocked" and own.jobs().where("id = 'a'").first().elapsed == 181.0
    assert own.claim(settings, FREE).outcome == "idle" and own.version() == 9
    with pytest.raises(ValueError, match="not running"):
        own.settle(settings, "a", 0, 1.0)


def test_saved_choice_is_used_once_and_only_among_jobs_that_can_run(made):
    own, settings = made(("a", "training", "test", 1.0), ("b", "research", "look", 2.0), ("c", "research", "look", 3.0), ("p", "proposal", "say", 0.0))
    assert own.claim(settings, FREE).job["id"] == "a"
    assert states(own)["p"] == ("blocked", "publication disabled")
    own.settle(settings, "a", 0, 1.0, next_job="c")
    assert own.claim(settings, FREE).job["id"] == "c"
    own.settle(settings, "c", Q.AGAIN, 1.0, next_job="c")  # a job can't name itself, nor one that is not queued
    assert own.claim(settings, FREE).job["id"] == "b"
    own.settle(settings, "b", 0, 1.0, next_job="p")
    assert own.claim(settings, FREE).job["id"] == "c"


def test_adapters(made):
    own, settings = made(("a", "training", "unknown", 1.0), ("b", "research", "test", 1.0), ("c", "training", "test", 2.0), ready=False)
    assert own.claim(settings, FREE).outcome == "blocked" and set(states(own).values()) == {("blocked", "adapter not ready")}
    assert own.claim(settings, FREE).outcome == "idle"
    for bad in ({"budgets": {"x": 0}}, {"budgets": {"x": 3601}}, {"budgets": {}}, {"budgets": {"x": 5}, "reserve_mb": 511}):
        with pytest.raises(ValueError):
            Q.Settings(settings.adapters, **bad)


def test_one_of_two_writers_is_refused(made, monkeypatch):
    own, settings = made(("a", "training", "test", 1.0), ("b", "research", "look", 2.0))
    other = Q.Queue(own.spark, own.path)
    seen = own.version()
    monkeypatch.setattr(other, "version", lambda: seen)
    assert own.claim(settings, FREE).job["id"] == "a"
    assert other.claim(settings, FREE).outcome == "busy" and own.version() == seen + 1 and states(own)["a"][0] == "running"
    with pytest.raises(Q.Conflict):
        other.commit(own.jobs(), seen)
    with pytest.raises(ValueError, match="taken"):
        own.submit(own.spark.createDataFrame([("a", "training", "test", 9.0)], JOBS))
    # A result is written on top of what came between.
    late = Q.Queue(own.spark, own.path)
    versions = iter([own.version()])
    own.submit(own.spark.createDataFrame([("z", "research", "look", 9.0)], JOBS))
    monkeypatch.setattr(late, "version", lambda: next(versions, None) or own.version())
    assert late.settle(settings, "a", 0, 1.0) == "completed" and states(own) == {"a": ("completed", ""), "b": ("queued", ""), "z": ("queued", "")}
