"""What a task holds does not grow with the pairs of places and items."""

import random
import tracemalloc

import pandas as pd

from tablegate.llm import decontaminate


def peak(function):
    tracemalloc.start()
    try:
        out = function()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_one_passage_of_many_items_in_many_documents():
    rnd = random.Random(1)
    passage = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(24))
    tests = decontaminate.TestSet([(k, f"u{k} {passage} v{k}") for k in range(1000)], 10)
    docs = pd.DataFrame({"id": [str(k) for k in range(1000)], "tag": range(1000), "text": [f"d{k} {passage} e{k}" for k in range(1000)],
                         "hits": [[] for _ in range(1000)], "ids": [[] for _ in range(1000)], "unnamed": 0})
    out, mb = peak(lambda: pd.concat(decontaminate._hits(iter([docs]), tests, True)))
    assert mb < 60
    assert all(len(h) == 1 and h[0] == {"start": 1, "stop": 25} for h in out["hits"])
    assert all(ids == list(range(1000)) for ids in out["ids"])


def test_a_block_of_items_is_held_in_flat_arrays():
    rnd = random.Random(2)
    items = [(k, " ".join(f"w{rnd.randint(0, 50_000)}" for _ in range(60))) for k in range(6000)]
    size = sum(len(t) for _, t in items)
    tests, mb = peak(lambda: decontaminate.TestSet(items, 10))
    assert size > 2_000_000 and len(tests.size) == 6000 * 51 and mb < 120
    kept = sum(a.nbytes for a in [tests.first, tests.items, tests.starts, tests.size, *tests.low, *tests.high])
    assert kept < 16 * size
