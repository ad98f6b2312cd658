import subprocess
import sys

from pyspark import cloudpickle

from shoplens.operators import neighbors, vectors


def test_worker_code_needs_no_package(tmp_path):
    """Functions run in Python workers load where the package is not on the path."""
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((neighbors.Best, vectors.hashed_counts)))
    code = ("import pickle; best, count = pickle.load(open('f.pkl', 'rb')); "
            "print(count(['a a'], 4).max())")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={},
                          capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "1.0", done.stderr
