"""What a Python worker, which Spark keeps for the next step, holds after one."""

from __future__ import annotations

import numpy as np
import pytest

from folioscope.llm import packing, quality_classifier

#: MB that a worker may hold though nothing uses them.
UNUSED_MB = 24


def most_unused(spark) -> float:
    """MB that a worker's allocators keep, by what it takes less once they have given back all; the most of all workers."""

    def unused(batches):
        import ctypes
        import re
        import time

        import pyarrow as pa

        def mb():
            with open("/proc/self/smaps_rollup") as f:
                return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

        for _ in batches:
            pass
        before = mb()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        time.sleep(0.2)  # so that each idle worker gets one of these tasks
        yield pa.record_batch([pa.array([before - mb()])], names=["mb"])

    return max(r["mb"] for r in spark.range(32).repartition(32).mapInArrow(unused, "mb double").collect())


@pytest.fixture(scope="module")
def many_words(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz    "))
    path = str(tmp_path_factory.mktemp("words") / "docs")
    spark.createDataFrame([(k, "".join(rng.choice(letters, 4000))) for k in range(4000)], "doc_id long, text string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path).coalesce(1)


STEPS = {
    "packing": packing.pack_documents,
    "classifier": lambda docs: quality_classifier.keep_accepted(docs, quality_classifier.Model(np.zeros(1 << quality_classifier.BITS, np.float32), 0.0)),
}


@pytest.mark.parametrize("step", STEPS)
def test_a_worker_gives_back_what_it_freed(spark, many_words, step):
    most_unused(spark)  # what earlier steps left doesn't count
    STEPS[step](many_words).write.format("noop").mode("overwrite").save()
    assert most_unused(spark) < UNUSED_MB
