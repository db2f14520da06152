"""Filling containers of fixed capacity with texts measured in tokens.

Bounded-space online best fit: a task keeps at most `max_open` open containers, found through a bitset whose bit f is
set while some open container has f free tokens. An item goes where the least space is left over; if none has room a
new container opens, and when too many are open the fullest closes. Tasks are independent, so nothing is shuffled and a
container's name, (task, number), repeats on a retried task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lakesearch.llm.bpe import TOKENIZERS, encoder
from lakesearch.sources.workers import ship

MAX_OPEN = 1024


class Packer:
    """Open containers of one capacity in one stream of items."""

    def __init__(self, capacity: int, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.mask = 0
        self.open: dict[int, list[int]] = {}
        self.n_open = self.opened = 0

    def _put(self, free: int, bin_: int) -> None:
        self.open.setdefault(free, []).append(bin_)
        self.mask |= 1 << free
        self.n_open += 1

    def _take(self, free: int) -> int:
        bins = self.open[free]
        bin_ = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.n_open -= 1
        return bin_

    def place(self, size: int) -> int:
        """The number of the container that an item of at most `capacity` goes into."""
        fitting = self.mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            bin_, free = self.opened, self.capacity
            self.opened += 1
        if free - size or not size:
            self._put(free - size, bin_)
            if self.n_open > self.max_open:
                self._take((self.mask & -self.mask).bit_length() - 1)
        return bin_


SCHEMA = "target_id int, doc_id bigint, piece_no int, token_start bigint, n_tokens int, container_id bigint"


def pack(df: DataFrame, record: str, text: str, targets: list[tuple[int, str, int]], folder: str = TOKENIZERS, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece and target (target_id, tokenizer, capacity): SCHEMA, with `record` as doc_id.

    A text is one piece unless it alone exceeds the capacity; then it is cut into full pieces and a rest. Null and empty
    texts are one piece of 0 tokens. container_id is unique within a target. Texts are measured once per tokenizer, all
    targets in one pass.
    """
    import pyspark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = pyspark.TaskContext.get().partitionId() << 40
        counters = {name: encoder(name, folder).count for _, name, _ in targets}
        packers = [(i, name, capacity, Packer(capacity, max_open)) for i, name, capacity in targets]
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = {name: [count(x) if x else 0 for x in texts] for name, count in counters.items()}
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for target, name, capacity, packer in packers:
                for doc, size in zip(docs, sizes[name], strict=True):
                    for no, start in enumerate(range(0, size or 1, capacity)):
                        n = min(capacity, size - start)
                        for column, x in zip(columns, (target, doc, no, start, n, first + packer.place(n)), strict=True):
                            column.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    ship(df.sparkSession)
    return df.select(record, text).mapInArrow(run, SCHEMA)
