"""One text of 64 MB goes through the workers' code of op3, op4 and op6 in bounded memory."""

import subprocess
import sys
from pathlib import Path

WORK = """
import resource, sys
import numpy as np, pyarrow as pa
from redactrix.llm import ngram_join, quality_model, suffix_dedup, textnp
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
words = np.random.default_rng(1).integers(97, 123, 64 << 20, np.uint8)
words[::7] = 32
column = pa.array([words.tobytes().decode()], pa.string())
del words
data, offsets = textnp.text_bytes(column)
if sys.argv[1] == "op3":
    n = sum(len(r["text"]) for r in suffix_dedup.runs_of_texts(data, offsets))
elif sys.argv[1] == "op4":
    for i, j, h, t in ngram_join._sets(column, 5):
        n = int(ngram_join._signature(h, t, 1)[0][0])
else:
    m = quality_model.new_model(np.zeros((1, quality_model.N_FEATURES)))
    n = sum(len(quality_model.encode(m, x.astype(float), rows, held)["e"]) for _, _, _, x, _, rows, held in quality_model._passages([pa.record_batch({"text": column})]))
print(n, peak())
"""


def run(name):
    out = subprocess.run([sys.executable, "-c", WORK, name], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=300)
    n, mb = map(int, out.stdout.split())
    assert n > 100_000 and mb < 500, (name, n, mb)


def test_suffix_runs():
    run("op3")


def test_shingles():
    run("op4")


def test_passages():
    run("op6")
