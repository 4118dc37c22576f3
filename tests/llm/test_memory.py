"""What a Python worker holds after a task: it lives on beside tasks that run no Python, within the same limit."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: A worker's run without Spark: work arrays that are freed, with small objects between them that outlive the task, as in a cache.
WORKER = """
import numpy as np
import pyarrow as pa
from variorum.llm import common

class Frame:
    def mapInArrow(self, run, schema):
        return run

def held():
    return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:")) // 1024

kept = []
def work(b):
    arrays = [np.ones(n) for n in range(10_000, 4_000_000, 500_000)]
    kept.append([bytes(1000) for _ in arrays])
    return pa.record_batch({"n": [len(arrays)] * b.num_rows})

run = common.map_arrow(Frame(), work, "n bigint")
list(run(iter([pa.record_batch({"t": ["a"]})])))
before = held()
rows = sum(b.num_rows for b in run(pa.record_batch({"t": ["x" * 8000] * 2000}) for _ in range(20)))
print(rows, held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_a_worker_gives_back_what_it_no_longer_uses():
    out = subprocess.run([sys.executable, "-c", WORKER], env=os.environ | {"PYTHONPATH": REPO}, capture_output=True, text=True, timeout=120, check=True).stdout
    rows, mb = map(int, out.split())
    assert rows == 40_000 and mb < 40
