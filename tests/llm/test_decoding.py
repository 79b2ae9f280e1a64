"""Decoding of many ids without an object for each."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tallyframe.llm import pieces


def test_decoding_makes_no_object_for_each_id():
    raw = [bytes([97 + i % 26]) * (i % 7) for i in range(1_000)]
    ids = np.random.default_rng(3).integers(300, 1_000, 1_000_000).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 1_000_001, 1_000), pa.int32()), pa.array(ids))
    tracemalloc.start()
    texts = pieces.decode_lists(lists, raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts == [b"".join(raw[i] for i in some).decode() for some in ids.reshape(1_000, 1_000).tolist()]
    assert peak < 30 << 20
    assert pieces.decode_lists(pa.array([None, [], [300]], pa.list_(pa.int32())), raw) == ["", "", raw[300].decode()]
    assert pieces.decode_lists(pa.array([None, []], pa.list_(pa.int32())), raw) == ["", ""]
