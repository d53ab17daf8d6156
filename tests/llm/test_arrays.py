import numpy as np
import pyarrow as pa

from textloom.llm import arrays as A


def test_blocks_keep_rows_apart_and_spans_do_not_join_them():
    texts = ["ab cd", None, "", "ef", "g" * 100]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts).slice(0)})
    seen = []
    for rows, data, bounds in A.blocks(iter([batch]), limit=8):
        start, end, row = A.spans(A.NOT_SPACE[data], bounds)
        words = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
        for i in range(rows.num_rows):
            seen.append([w for w, r in zip(words, row) if r == i])
    assert seen == [["ab", "cd"], [], [], ["ef"], ["g" * 100]]


def test_span_hashes_depend_on_the_bytes_alone():
    data = np.frombuffer(b"xxabcyyabczabd" + b"\0\0\0", np.uint8)
    sums = A.prefix_hashes(data)
    h = A.span_hashes(sums, np.array([2, 7, 11, 14, 14]), np.array([5, 10, 14, 15, 16]))
    assert h[0] == h[1] != h[2] and h[3] != h[4]


def test_equal_rows_of_words_have_equal_grams():
    words = np.array([5, 6, 7, 5, 6, 8], np.uint64)
    grams = A.gram_hashes(words, 2)
    assert grams[0] == grams[3] and len(set(grams.tolist())) == 4
    assert len(A.gram_hashes(words, 7)) == 0


def test_hashes_of_windows_are_those_of_spans():
    data = np.frombuffer(b"the cat the cat \xff\0\0the", np.uint8)
    sums = A.prefix_hashes(data)
    for size in (1, 4, len(data), len(data) + 1):
        starts = np.arange(max(len(data) - size + 1, 0))
        assert A.window_hashes(sums, size).tolist() == A.span_hashes(sums, starts, starts + size).tolist()
