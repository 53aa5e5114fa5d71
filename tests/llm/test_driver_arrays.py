"""Arrays of the driver, which don't grow with the counters of n-grams."""

import tracemalloc

import numpy as np

from granella.llm import ngram_join


def test_split_lists_need_no_array_of_all_counters():
    known = object.__new__(ngram_join.Levels)
    known.bits, known.split, known.floor, known.levels = 24, 50_000, 8, np.zeros(1 << 24, np.uint8)
    tracemalloc.start()
    assert not known.several()
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    known.levels[7] = 70
    assert known.several() and known.parts(np.array([7], np.uint64) << np.uint64(40))[0] > 1
