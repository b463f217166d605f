"""What the counting of a shard costs, against one counter for each document."""

import random
import time
from collections import Counter

import pyarrow as pa

from stridemill.llm.filter_audit import _Shard, number_of


def spent(work):
    def once():
        began = time.process_time()
        work()
        return time.process_time() - began
    return min(once() for _ in range(3))


def test_words_are_counted_a_chunk_at_a_time():
    draw = random.Random(13)
    texts = [" ".join(f"w{int(draw.paretovariate(0.6)) % 200_000}" for _ in range(400)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.StructArray.from_arrays([pa.array(range(len(texts)))], ["id"]), pa.array(texts)], ["row", "_text"])

    def by_chunks():
        shard = _Shard()
        for at in range(0, len(texts), 500):
            shard.add(batch, at, at + 500)
        assert len(shard.packed(number_of).column("rows")[0]) == len(texts)

    def by_document():
        numbers, terms = {}, []
        for text in texts:
            terms.append([(numbers.setdefault(w, len(numbers)), n) for w, n in Counter(text.encode().split()).items()])
    assert spent(by_chunks) < spent(by_document)
