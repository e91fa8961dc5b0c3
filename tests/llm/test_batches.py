"""Stages that pass whole rows on hold a slice of them at a time, however large the batches are that Spark hands over."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from riskspark.llm import nearcopies, toxicity
from riskspark.llm.common import SLICE


class Frame:
    """Keeps the function that a stage gives to its tasks."""

    schema = None

    def mapInArrow(self, function, schema):
        self.run = function
        return self


def test_toxicity_passes_slices_on():
    texts = [None if n % 7 == 0 else f"text {n} " + "bad" * (n % 3 == 0) for n in range(10 * SLICE + 5)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    model = toxicity.Model({"bad": 9.0}, -6.0, base=-6.0)
    frame = toxicity.clean(Frame(), model)
    found = list(frame.run(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in found) <= SLICE
    score = model.scorer()
    assert [i for b in found for i in b.column("doc_id").to_pylist()] == [i for i, t in enumerate(texts) if score(t or "")[0] < toxicity.THRESHOLD]


def test_marked_rows_come_in_slices():
    nodes = [n * 7 - 50 for n in range(10 * SLICE + 5)]
    batch = pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "text": [str(n) for n in nodes]})
    bits = np.zeros(nearcopies._SLOTS // 8, np.uint8)
    for n in nodes[::3]:
        bits[(n % nearcopies._SLOTS) >> 3] |= 1 << ((n % nearcopies._SLOTS) & 7)
    for wanted, expected in ((True, nodes[::3]), (False, [n for at, n in enumerate(nodes) if at % 3])):
        frame = nearcopies._marked(Frame(), "node", bits, wanted)
        found = list(frame.run(iter([batch])))
        assert max(b.num_rows for b in found) <= SLICE
        assert [n for b in found for n in b.column("node").to_pylist()] == expected
