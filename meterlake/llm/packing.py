"""Best-fit packing of documents into sequences: bounded-space, online.

Each text becomes its tokenizer's ids and an end id. Only documents longer than a sequence are cut: into whole
sequences, with what is left over as the first piece. A packing task takes pieces as they come. It has a fixed number
of open sequences; those with the same free space form a stack, and a bitset has a bit for each free space with a
stack that isn't empty, so that the least sufficient free space is the lowest bit left after a shift. A piece that fits
nowhere opens a sequence; when there are too many, the fullest closes first.

Scale: tokenizing is a map over the input's splits, written as small rows (no text, ids only if asked for). These rows
are merged, without a shuffle, into tasks of ``PIECES_A_TASK`` pieces or so, enough that the sequences which a task
leaves open don't count. A task's memory is its open sequences and one batch of rows.

Defined results: a null or empty text has only the end id; repeated rows are packed as often as they come; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

OPEN = 2048
PIECES_A_TASK = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | Callable[[], str], size: int, end_id: int, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers in ``ids`` if asked for.

    ``tokenizer`` is the file's path, or a function that finds it on the machine where it runs.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, end = encoder(tokenizer if isinstance(tokenizer, str) else tokenizer()), end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(words.as_py() or "") + end
                at, number, n = 0, 0, len(ids) // 4
                while at < n:
                    length = (n % size or size) if at == 0 else size
                    part = ids[4 * at : 4 * (at + length)]
                    for column, value in zip(rows, (doc, number, at, length, zlib.crc32(part), part)):
                        column.append(value)
                    at, number = at + length, number + 1
            yield pa.record_batch(rows, schema)

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


class OpenSequences:
    """At most ``bound`` sequences with free space, found by the least free space that suffices."""

    def __init__(self, size: int, bound: int) -> None:
        self.size, self.bound, self.open, self.made, self.free = size, bound, 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def _pop(self, space: int) -> int:
        found = self.stacks[space].pop()
        if not self.stacks[space]:
            self.free ^= 1 << space
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset for a piece."""
        if fits := self.free >> length:
            space = length + (fits & -fits).bit_length() - 1
            number = self._pop(space)
        else:
            if self.open >= self.bound and length < self.size:
                self._pop((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, number = self.size, self.made
            self.made += 1
        if left := space - length:
            self.stacks[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.size - space


def pack(cut: DataFrame, size: int, bound: int = OPEN) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``pieces``; each partition packs its own rows."""
    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences, first = OpenSequences(size, bound), TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [sequences.place(n) for n in batch.column(names.index("length")).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array([first + s for s, _ in found], pa.int64()), pa.array([o for _, o in found], pa.int64())], [*names, "sequence_id", "offset"])

    return cut.mapInArrow(place, T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, tokenizer: str | Callable[[], str], size: int = 2048, end_id: int = 0, bound: int = OPEN, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut all documents and pack their pieces; see the module for the columns."""
    cut = stage(pieces(docs, tokenizer, size, end_id, with_ids, doc_id, text), "pieces")
    return pack(cut.coalesce(max(1, -(-cut.count() // PIECES_A_TASK))), size, bound)
