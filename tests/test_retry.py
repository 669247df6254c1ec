"""Task loss: every operator result must be identical when each task's
first attempt fails and Spark re-runs it."""

import os
import subprocess
import sys


def test_results_survive_task_retries():
    script = os.path.join(os.path.dirname(os.path.abspath(__file__)), "retry_job.py")
    proc = subprocess.run([sys.executable, script], capture_output=True, text=True, timeout=600)
    lines = [ln for ln in proc.stdout.splitlines() if ln.startswith(("SAME", "DIFFERENT"))]
    assert lines, proc.stderr[-2000:]
    assert lines[-1].startswith("SAME"), lines[-1]
