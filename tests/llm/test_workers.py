import pyarrow as pa
from pyspark import cloudpickle

from vitrine.llm import language_model, workers


def test_a_pickled_task_ends_the_memory_that_another_one_kept():
    @workers.tidy
    def task(batches):
        yield from batches

    workers.held("large", lambda: bytearray(10))
    sent = cloudpickle.loads(cloudpickle.dumps(task))
    assert list(sent([1])) == [1] and not workers._held


def test_blocks_are_unpacked_one_by_one():
    taken = []

    class Batch:
        num_rows = 3

        def slice(self, k, n):
            taken.append((k, n))
            return pa.record_batch({"block": pa.array([7 + k])})

    rows = language_model.entry_rows([Batch()])
    assert next(rows) == {"block": 7} and taken == [(0, 1)]
    assert [r["block"] for r in rows] == [8, 9]
