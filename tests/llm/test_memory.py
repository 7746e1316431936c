import subprocess
import sys
from pathlib import Path

import pytest

HELD = """
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import jaccard, packing


class Docs:  # gives the function that a worker runs
    dtypes = [("doc_id", "bigint"), ("text", "string")]

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def used():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", f.read()))) / 1024


def batches():
    rng = np.random.default_rng(1)
    words = np.array(["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 10, 20_000)])
    for _ in range(3):
        yield pa.RecordBatch.from_pydict({"doc_id": np.arange(4000), "text": [" ".join(words[rng.integers(0, len(words), 300)]) for _ in range(4000)]})


for _ in WHAT(batches()):
    pass
del _
held = used()
pa.default_memory_pool().release_unused()
__import__("ctypes").CDLL(None).malloc_trim(0)
print(held - used())
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc, trims by glibc")
@pytest.mark.parametrize("what", ["packing.token_pieces(Docs())", "jaccard.sign(Docs(), 5, 23, 6)"])
def test_a_worker_keeps_no_freed_memory(what):
    done = subprocess.run([sys.executable, "-c", HELD.replace("WHAT", what)], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 10


def test_plan_of_sequences_needs_no_python_worker(spark):
    from tidemark.llm.packing import pack

    pieces = spark.range(3).selectExpr("id AS doc_id", "0 AS piece", "id + 1 AS length")
    plan = pack(pieces)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "ExternalRDD" not in plan, plan
