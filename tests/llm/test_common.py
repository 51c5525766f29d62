"""Tables in the shared folder belong to the block that made them."""

import threading

import pyarrow as pa

from voxfield.llm.common import _made, drop, scratch, small_batches, store


def test_scratch_removes_its_own_tables_only(spark):
    before = store(spark.range(3))
    others, inner = [], []
    ready, done = threading.Event(), threading.Event()

    def beside():
        ready.wait(60)
        others.append(store(spark.range(5)))
        done.set()

    thread = threading.Thread(target=beside)
    thread.start()
    with scratch() as keep:
        temporary = store(spark.range(7))
        ready.set()
        done.wait(60)
        with scratch() as keep_inner:
            inner.append(store(spark.range(2)))
            passed = keep_inner(spark.range(4))
        result = keep(temporary.union(passed))
    thread.join()
    assert before.count() == 3 and others[0].count() == 5 and result.count() == 11
    assert {temporary._voxfield_path, inner[0]._voxfield_path, passed._voxfield_path}.isdisjoint(_made)
    drop(before, others[0], result)
    assert {before._voxfield_path, result._voxfield_path}.isdisjoint(_made)


def test_batches_get_no_larger(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        small_batches(spark, 50)
        sizes = lambda: {r[0] for r in spark.range(0, 300, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"id": [b.num_rows]}) for b in batches), "id long").collect()}
        assert sizes() == {50}
        small_batches(spark, 100)
        assert spark.conf.get(key) == "50"
        spark.conf.set(key, "0")  # no bound
        small_batches(spark, 100)
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)
