"""What Python workers hold while they work, and what they keep."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import public_tokenizers

from quire.llm import bpe, shared

ANCHORS = """
import re, threading, time
import numpy as np, pyarrow as pa
from pathlib import Path
from quire.llm import substring

def anon():
    return int(re.search(r"RssAnon:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

def watch():
    while True:
        most[0] = max(most[0], anon())
        time.sleep(0.002)

class Rows:
    def mapInArrow(self, run, schema):
        return run

rng = np.random.default_rng(1)
vocab = np.array(["w%x" % k for k in range(50_000)])
texts = [" ".join(vocab[rng.integers(0, len(vocab), 400)]) for _ in range(6000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(range(6000)), pa.array(texts)], ["id", "tie", "text"])
before, most = anon(), [0]
threading.Thread(target=watch, daemon=True).start()
rows = sum(out.num_rows for out in substring._anchors(Rows(), 20)(iter([batch] * 2)))
print(rows, most[0] - before)
"""


def test_peak_of_a_worker():
    out = subprocess.run([sys.executable, "-c", ANCHORS], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=120)
    assert not out.returncode, out.stderr
    rows, peak = out.stdout.split()
    assert int(rows) > 100_000 and float(peak) < 60


def test_tasks_drop_what_other_operators_kept():
    path = public_tokenizers.path("word_bpe_49k.json")
    first = bpe.encoder(path)
    assert list(shared.steady(iter([]), "bpe")) == [] and bpe.encoder(path) is first
    assert list(shared.steady(iter([]))) == [] and not bpe._ENCODERS
    assert bpe.encoder(path) is not first and bpe.encoder(path).encode(["a b"]) == first.encode(["a b"])


def test_powers_of_very_long_texts_are_not_kept():
    n = 3 * shared.SLICE_BYTES
    whole = shared.powers(5, n)
    assert len(whole) == n and int(whole[n - 1]) == pow(5, n - 1, 1 << 64)
    assert 5 not in shared._POWERS and shared.powers(5, 10).tolist() == whole[:10].tolist()
