"""Token ids as binary shards, compressed by Re-Pair grammars with random access to every document.

A shard holds consecutive documents in ascending order of their ids, about a million tokens. Its grammar comes from
repeated passes: a pass sorts (pair, place), takes the most frequent pairs, settles overlaps in favour of the more frequent
pair, and replaces what is left by a new nonterminal for each pair, until no pair has LEAST_USES uses side by side. Pairs
with an end id are left alone, so that a document is a run of symbols of its own. A shard stores its rules, the length of each rule's
expansion, and each document's first symbol and first token: one document, or a range of tokens in it, is decoded
without the rest.

Layout, little-endian: magic ``RPG2``; counts as unsigned 64-bit integers (documents, tokens, symbols, rules, least
nonterminal, documents without an id, which come first); document ids, each document's first token and first symbol (64 bits); both sides and the expansion length
of each rule (32 bits); the symbols' low 16 bits, then for each higher bit in use a plane of single bits.

Scale: documents are range-partitioned by id once; a task writes its shards as it goes, in rows of a Parquet table, so
they lie wherever Spark can write and a lost task is written again whole. Only one number for each partition, its
tokens, goes through the driver, to turn places in a partition into places in the corpus.

Ranges are cut by id, a hash of the text and a row number, so that rows with one id (or none) don't all go to one task. A
document longer than a shard is a shard of its own.

Defined results: a null or empty text has only the end id; null ids come first and stay null; rows with the same id follow
each other in the order of a hash of their texts; an empty table gives no shards; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SHARD_TOKENS = 1 << 20
LEAST_USES, TIER = 4, 8
MIX = np.uint64(0x9E3779B97F4A7C15)
SHARD = "partition int, shard int, start long, n_tokens long, n_docs long, payload binary"
MAGIC = b"RPG2"


def compress(ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, rules (two columns) and the least nonterminal for the ids of a shard.

    A pass takes the pairs with a TIER-th of the uses of the most frequent one or more. A pair that wasn't frequent can't
    become so, as places only vanish: a pass looks at the pairs that were frequent before and at those with a new symbol.
    The most frequent pair gives way to none, so every pass replaces it everywhere.
    """
    base = int(ids.max(initial=0)) + 1
    seq, rules, next_id = ids.astype(np.uint64), [], base
    live = np.ones(max(len(seq) - 1, 0), bool)
    while (room := (1 << 32) - next_id) > 0:
        n, end = len(seq), seq == end_id
        live &= ~(end[:-1] | end[1:])
        # in a run of one symbol every second place overlaps the one before
        same = np.flatnonzero((seq[:-1] == seq[1:]) & live)
        begins = np.diff(same, prepend=-2) != 1
        second = same[(np.arange(len(same)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 1]
        live[second] = False
        pair, place = _sorted_pairs(seq, np.flatnonzero(live), next_id)
        first = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
        uses = np.diff(first, append=len(pair))
        often = np.flatnonzero(uses >= max(LEAST_USES, uses.max(initial=0) / TIER))
        if not len(often):
            break
        later = place[np.repeat(uses >= LEAST_USES, uses)]
        # ties by a hash: in the order of symbols, ascending ids would give way to each other one by one
        tie = (pair[first[often]] * MIX) >> np.uint64(32)
        often = often[np.argsort(((uses.max() - uses[often]).astype(np.uint64) << np.uint64(32)) | tie, kind="stable")][:room]
        # each place's rank of its pair, 0 for the most frequent; a place gives way to a better neighbour
        none = len(often)
        of_group = np.full(len(first), none, np.int32)
        of_group[often] = np.arange(none, dtype=np.int32)
        mine = np.repeat(of_group, uses)
        place, mine = place[mine < none], mine[mine < none]
        rank = np.full(n + 1, none, np.int32)
        rank[place + 1] = mine
        best = (mine < rank[place]) & (mine < rank[place + 2])
        used = np.bincount(mine[best], minlength=none)
        good = np.flatnonzero(used >= LEAST_USES)
        symbol = np.zeros(none, np.uint64)
        symbol[good] = next_id + np.arange(len(good))
        symbols, at = symbol[mine[best]], place[best]
        at, symbols = at[symbols > 0], symbols[symbols > 0]
        left = np.zeros(none, np.int64)
        left[mine] = place
        left = left[good]
        rules.append(np.stack([seq[left], seq[left + 1]], 1).astype(np.uint32))
        live = np.zeros(n, bool)
        live[later] = True
        live[second] = live[second - 1]
        live[at] = live[at - 1] = True
        seq[at] = symbols
        keep = np.ones(n, bool)
        keep[at + 1] = False
        seq, live, next_id = seq[keep], live[keep][:-1], next_id + len(good)
    return seq.astype(np.uint32), np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), base


def _sorted_pairs(seq: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs at the given places, sorted by pair and place, and their places."""
    bits, place_bits = symbols.bit_length(), len(seq).bit_length()
    if 2 * bits + place_bits > 64:
        pair = seq[at] << np.uint64(32) | seq[at + 1]
        order = np.argsort(pair, kind="stable")
        return pair[order], at[order]
    code = (seq[at] << np.uint64(bits) | seq[at + 1]) << np.uint64(place_bits) | at.astype(np.uint64)
    code.sort()
    return code >> np.uint64(place_bits), (code & np.uint64((1 << place_bits) - 1)).astype(np.int64)


def levels(rules: np.ndarray, base: int) -> Iterator[slice]:
    """Stretches of rules whose sides are ids or rules of earlier stretches."""
    needs = np.maximum.accumulate(rules.astype(np.int64).max(1, initial=0)) - base
    start = 0
    while start < len(rules):
        stop = int(np.searchsorted(needs, start))
        yield slice(start, stop)
        start = stop


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids in each rule's expansion."""
    lengths = np.ones(base + len(rules), np.int64)
    for level in levels(rules, base):
        lengths[base:][level] = lengths[rules[level]].sum(1)
    return lengths[base:]


class Grammar:
    """The rules of a shard, written out: ids of every expansion one after the other."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, base: int) -> None:
        self.base = base
        # ids expand to themselves
        self.lengths = np.r_[np.ones(base, np.int32), lengths.astype(np.int32)]
        self.starts = np.r_[np.arange(base), base + np.cumsum(lengths) - lengths].astype(np.int64)
        self.flat = np.empty(base + int(lengths.sum()), np.uint32)
        self.flat[:base] = np.arange(base)
        at = base
        for level in levels(rules, base):
            out = self.expand(rules[level].ravel())
            self.flat[at : at + len(out)] = out
            at += len(out)

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        return self.lengths[symbols]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.lengths[symbols]
        begin = np.cumsum(sizes, dtype=np.int64)
        places = np.repeat(self.starts[symbols] - begin + sizes, sizes)
        places += np.arange(len(places))
        return self.flat[places]


def write_shard(doc_ids: list[int | None], texts: list[bytes], end_id: int) -> bytes:
    """A shard's bytes. ``texts``: the ids of each document, as little-endian unsigned 32-bit integers with the end id.

    Documents without an id (None) come first.
    """
    nulls = doc_ids.count(None)
    numbers = [0] * nulls + doc_ids[nulls:]
    ids = np.frombuffer(b"".join(texts), "<u4")
    first_token = np.r_[0, np.cumsum([len(t) // 4 for t in texts])].astype(np.int64)
    symbols, rules, base = compress(ids, end_id)
    lengths = expansion_lengths(rules, base)
    sizes = np.ones(len(symbols), np.int64)
    inner = symbols >= base
    sizes[inner] = lengths[symbols[inner] - base]
    ends = np.cumsum(sizes)
    first_symbol = np.r_[0, np.searchsorted(ends, first_token[1:]) + 1].astype(np.int64)
    counts = np.array([len(doc_ids), len(ids), len(symbols), len(rules), base, nulls], "<u8")
    planes = [np.packbits((symbols >> np.uint32(b)) & np.uint32(1)).tobytes() for b in range(16, max(16, int(symbols.max(initial=0)).bit_length()))]
    return b"".join([
        MAGIC, counts.tobytes(), np.asarray(numbers, "<i8").tobytes(), first_token.astype("<i8").tobytes(), first_symbol.astype("<i8").tobytes(),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), (symbols & np.uint32(0xFFFF)).astype("<u2").tobytes(), *planes,
    ])


class Shard:
    """Reads a shard's bytes; decodes documents one by one or all together."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        at = 4

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        docs, self.n_tokens, n_symbols, n_rules, base, self.nulls = (int(x) for x in take("<u8", 6))
        self.doc_ids, self.first_token, self.first_symbol = take("<i8", docs), take("<i8", docs + 1), take("<i8", docs + 1)
        rules, lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules).astype(np.int64)
        symbols = take("<u2", n_symbols).astype(np.uint32)
        for bit in range(16, 32):
            if at == len(payload):
                break
            symbols |= np.unpackbits(take("u1", -(-n_symbols // 8)), count=n_symbols).astype(np.uint32) << np.uint32(bit)
        self.symbols, self.grammar = symbols, Grammar(rules, lengths, base)

    def all_ids(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids of the i-th document, or of a range of its tokens: only the symbols that hold the range are expanded."""
        own = self.symbols[self.first_symbol[i] : self.first_symbol[i + 1]]
        ends = np.cumsum(self.grammar.sizes(own))
        n = int(self.first_token[i + 1] - self.first_token[i])
        start, stop, _ = slice(start, stop).indices(n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.grammar.expand(own[a:b])[start - skipped : stop - skipped]


def write(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int, shard_tokens: int = SHARD_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents as shards; the table of shards, each with its partition and its first token there."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        ids_of, end = encoder(tokenizer if isinstance(tokenizer, str) else tokenizer()), end_id.to_bytes(4, "little")
        part, number, start, size = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int] = []
        texts: list[bytes] = []

        def shard() -> pa.RecordBatch:
            payload = write_shard(doc_ids, texts, end_id)
            return pa.record_batch([[part], [number], [start], [size], [len(texts)], [payload]], schema)

        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(words.as_py() or "") + end
                doc_ids.append(doc)
                texts.append(ids)
                size += len(ids) // 4
                if size >= shard_tokens:
                    yield shard()
                    number, start, size = number + 1, start + size, 0
                    doc_ids.clear()
                    texts.clear()
        if texts:
            yield shard()

    schema = pa.schema([("partition", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())])
    order = ["doc_id", "hash", "row"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stage(ordered.mapInArrow(encode, SHARD), "shards")


def read(shards: DataFrame) -> DataFrame:
    """Every document from its shard: ``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids_crc32``."""
    before, at = {}, 0
    for part, n in sorted(shards.groupBy("partition").agg(F.sum("n_tokens")).collect()):  # a number for each partition
        before[part], at = at, at + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shard = Shard(payload.as_py())
                ids, first = shard.all_ids().astype("<u4"), shard.first_token
                yield pa.record_batch([
                    pa.array(shard.doc_ids, mask=np.arange(len(shard.doc_ids)) < shard.nulls), pa.array(first[:-1] + start + before[part]), pa.array(np.diff(first)),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(first[:-1], first[1:])], pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("partition", "start", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
