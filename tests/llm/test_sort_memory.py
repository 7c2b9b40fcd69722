"""The induced sort's memory doesn't grow with its text; LMS positions and names are found block by block."""

import random
import tracemalloc

import numpy as np

from tidemark.llm import induced_sort


def plain_lms(t):
    s = [False] * len(t)
    for p in range(len(t) - 2, -1, -1):
        s[p] = t[p] < t[p + 1] or (t[p] == t[p + 1] and s[p + 1])
    return [p for p in range(1, len(t)) if s[p] and not s[p - 1]]


def test_leftmost_and_names_by_blocks(tmp_path):
    rng = random.Random(2)
    for n in (1, 2, 7, 50, 200, 400):
        t = "".join(rng.choice("abc") for _ in range(n)) if n != 50 else "a" * n
        text = np.frombuffer(t.encode(), np.uint8)
        for held in (1, 3, 7, 1000):
            store = induced_sort.Store(str(tmp_path), held)
            lms = induced_sort.leftmost(text, store)
            assert lms.tolist() == plain_lms(t)
            if len(lms):
                name, different = induced_sort.names(text, lms, 1000, store)
                parts = [t[a : b + 1] + "~" for a, b in zip(lms.tolist(), lms.tolist()[1:])] + [t[lms[-1] :] + "\0~"]  # ended: last; the end: first
                rank = {p: k for k, p in enumerate(sorted(set(parts)))}
                assert name.tolist() == [rank[p] for p in parts] and different == len(rank)


def test_memory_is_flat(tmp_path):
    """Peak of what numpy and Python allocate (memory-mapped files apart): set by ``held``, not by the text."""
    rng = np.random.default_rng(1)
    words = [rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8).tobytes() for _ in range(3000)]
    long = b" ".join(words[k] for k in rng.integers(0, 3000, 1_700_000))
    peaks = []
    for n in (500_000, 8_000_000):
        path = tmp_path / f"text{n}"
        path.write_bytes(long[:n])
        tracemalloc.start()
        induced_sort.repeated(np.memmap(path, np.uint8, "r"), 400, str(tmp_path), small=1 << 14, held=1 << 14)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.6 * peaks[0] and peaks[1] < 12e6, peaks
