"""What a Python worker still holds when its task has ended."""

import subprocess
import sys
from pathlib import Path

import public_tokenizers

from garimpo.llm import common

TASK = """
import gc, re, sys
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from garimpo.llm import common, packing
TaskContext.get = classmethod(lambda c: type("T", (), {"partitionId": lambda s: 0})())
def held():
    gc.collect()
    return sum(map(int, re.findall(r"Pss_Anon: +(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
cut = packing._cutter(public_tokenizers.path("byte_bpe_50k.json"), True, 0, 1024, False)
batch = lambda lo, n: pa.record_batch({"doc_id": [1], "text": [" ".join(f"x{chr(97 + i % 26)}{i}" for i in range(lo, lo + n))]})
list(cut([batch(0, 10)]))
before = held()
rows = sum(b.num_rows for b in cut(batch(k * 10_000, 10_000) for k in range(30)))
print(rows, held() - before)
"""


def test_idle_worker_holds_little():
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {root!r}); " + TASK.strip()], capture_output=True, text=True, timeout=300, check=True)
    rows, held = done.stdout.split()
    assert int(rows) > 30
    assert float(held) < 30, f"{held} MB"


def test_encoders_forget_at_a_tasks_end():
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = common.tokenizer(path).encode("one two two", add_special_tokens=False).ids
    run = common.tidied(lambda texts: common.encoder(path, True).encode(texts))
    for _ in range(2):  # the second task starts anew, with the same ids
        got = list(run([b"one two two"]))
        assert got == [b"".join(i.to_bytes(4, "little") for i in want)]
        assert not common.encoder(path, True).known and not common.encoder(path, True).known.old
