import numpy as np
import pyarrow as pa

from plinth.llm import _text as T


def test_words_and_offsets():
    words, offsets = T.split_words(pa.array(["  a b\n", None, "", "c"]))
    assert words.to_pylist() == ["a", "b", "c"] and offsets.tolist() == [0, 2, 2, 2, 3]


def test_normalised():
    assert T.normalised(pa.array(["Hello,", "!!", "«Été»"])).to_pylist() == ["hello", "!!", "été"]


def test_window_hashes_agree_with_equality():
    codes = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 7], np.uint64)
    for n in (2, 3, 5):
        h = T.window_hashes(codes, n)
        assert h[0] == h[6] and len(h) == len(codes) - n + 1
        assert len(set(h.tolist())) == len({tuple(codes[i : i + n]) for i in range(len(h))})


def test_count_words_and_pieces():
    texts = ["a b  c", None, "", " x\ty\n", "é ü"]
    assert T.count_words(pa.array(texts)).tolist() == [3, 0, 0, 2, 2]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    assert [len(p) for p in T.pieces(batch, "t", 4)] and sum(len(p) for p in T.pieces(batch, "t", 4)) == 5
