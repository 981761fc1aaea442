"""What a task holds stays bounded however much it reads."""

import tracemalloc
from collections import Counter

import pyarrow as pa

from weftline.llm import lattice


def batches(texts):
    for k, text in enumerate(texts):
        yield pa.RecordBatch.from_arrays([pa.array([text]), pa.array([k % 2 == 0])], names=["text", "train"])


def peak(texts) -> tuple[int, float]:
    """The words' counts in training texts together, and the most MB of memory that counting took."""
    tracemalloc.start()
    try:
        n = sum(sum(out.column("n_train").to_pylist()) for out in lattice.count_words(batches(texts)))
        return n, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_counting_many_words():
    n, most = peak(" ".join(f"w{k:x}" for k in range(a, a + 50_000)) for a in range(0, 3_600_000, 50_000))
    print("MB", most)
    assert n == 1_800_000 and most < 200


def test_counting_long_words():
    n, most = peak(f"{k:x}" * 200_000 for k in range(16, 144))
    print("MB", most)
    assert n == 64 and most < 200


def test_counts_do_not_depend_on_merges(monkeypatch):
    texts = [" ".join(f"é{(k * j) % 97}" for j in range(300)) + (" " + "x" * 500 * k if k % 5 == 0 else "") for k in range(40)] + ["", " \n"]
    want = Counter(w for k, t in enumerate(texts) for w in t.split() if k % 2 == 0)
    words = {w for t in texts for w in t.split()}
    for most, most_bytes in ((1 << 20, 1 << 24), (200, 1 << 24), (1 << 20, 900), (1, 1)):
        monkeypatch.setattr(lattice, "MERGE", most)
        monkeypatch.setattr(lattice, "MERGE_BYTES", most_bytes)
        got, hashes = Counter(), {}
        for out in lattice.count_words(batches(texts)):
            for h, w, n in zip(*(out.column(c).to_pylist() for c in ("hash", "word", "n_train"))):
                got[w] += n
                assert hashes.setdefault(w, h) == h
        assert set(got) == words and +got == want
