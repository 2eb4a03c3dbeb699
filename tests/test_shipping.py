"""Task code must not need the package on the executors."""

import subprocess
import sys

from pyspark import cloudpickle

from flowgauge.functions import nets
from flowgauge.operators import cpu as C
from flowgauge.streaming import keyed as L


def test_task_code_travels_by_value(tmp_path):
    blob = cloudpickle.dumps((C._mark(1000), nets.normal_sums, L._Cycles(1000, 2.5)))
    (tmp_path / "blob").write_bytes(blob)
    script = (
        "import pickle, sys\n"
        "mark, sums, cycles = pickle.load(open('blob', 'rb'))\n"
        "import pandas as pd\n"
        "rows = pd.DataFrame({'task_id': ['a', 'a'], 'ts_ms': [0, 1500], 'cpu_ns': [5, 9],\n"
        "                     'last_ms': pd.array([None, None], dtype='Int64'), 'last_ns': [0, 0]})\n"
        "assert list(mark(rows)['used_ns']) == [5, 4]\n"
        "assert 'flowgauge' not in sys.modules\n"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
