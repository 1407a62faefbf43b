"""Python workers serve many tasks; what one has freed must not stay with them."""

import tracemalloc

import pyarrow as pa
from tokenizers import Tokenizer

from coinstrata.llm import packing
from coinstrata.llm.common import map_in_slices
from coinstrata.llm.queries import tokenizer_path

SLICES = 4


def test_a_task_gives_back_what_it_freed(spark):
    """Each task fills 200 MB and frees them beneath a block that stays, which keeps the allocator from shrinking."""

    def fill(batches):
        import sys

        for b in batches:
            held = [bytes(1000) for _ in range(200_000)]
            sys.__dict__.setdefault("_stays", []).append(bytes(1000))
            del held
            yield b

    def resident(batches):
        for b in batches:
            kb = next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmRSS"))
            yield pa.RecordBatch.from_arrays([pa.array([kb] * b.num_rows, pa.int64())], names=["kb"])

    rows = spark.range(0, SLICES, 1, SLICES)
    before = max(r.kb for r in rows.mapInArrow(resident, "kb long").collect())
    assert map_in_slices(rows, fill, "id long").count() == SLICES
    after = max(r.kb for r in rows.mapInArrow(resident, "kb long").collect())
    assert after < before + 100_000, (before, after)


def test_tables_of_words_stay_small():
    """Far more distinct words than the tables hold; each of these words has a part that is new, and ids of its own."""
    words = packing.WordIds(tokenizer_path())
    alphabet = "bcdfghjklmnpqrstvwxz"
    tracemalloc.start()
    for i in range(0, 420_000, 1000):
        words.ids(" ".join("".join(alphabet[k // 20**d % 20] for d in range(5)) for k in range(i, i + 1000)).encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words.known and peak < 80e6, peak


def test_settings_are_read_without_the_vocabulary():
    class Parts:
        def __init__(self, whole):
            self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer

    assert packing.settings_of(Parts(Tokenizer.from_file(tokenizer_path()))) == packing.KNOWN
