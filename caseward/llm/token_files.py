"""Operator 2: token ids in patched frame-of-reference files.

Encoding uses the tokenizers library: a task tells the chunks of its texts apart
(a blank and what follows it) and has the library encode each different chunk once;
a table of bounded size keeps chunks for the worker's next texts and tasks.  Chunks
end only where the byte-level pattern always cuts.

A file holds the ids of consecutive documents in blocks of 128.  A block stores
its minimum, a bit width that fits 95 % of its ids (less the minimum), those low
bits packed, and a list of exceptions: place and high bits.  A footer indexes the
start of every block, the documents and their numbers of ids.

    magic | blocks | block starts u64 | doc_id i64 | null flags u8 | n_tokens u64
          | n_ids u64 | n_blocks u64 | n_docs u64 | magic

Scale: one shuffle of the text by ranges of doc_id; each task writes one file of
its range as a stream and rereads it block by block.  Global starts come from one
row per file.  Files go to the shared folder under a temporary name and are moved
when complete, so a lost executor leaves nothing half written.

Defined results: a null text is encoded as the empty one and holds the end id
alone; a null doc_id comes first; rows with equal doc_id are ordered by their
text; texts are used whole; an empty table gives no file and an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseward.llm.files import located, written
from caseward.llm.slabs import ragged, slabs, worker_table
from caseward.sources.shared import stored

BLOCK = 128
PERCENTILE = 95
END_ID = 2
MAGIC = b"PFORIDS1"
_HEAD = 6
_SLAB = 4 << 20
#: Chunks of a worker's table, and ids of the longest chunk in it.
TABLE, LONGEST = 1 << 19, 64
#: Chunks handed to the library as one text, and blocks decoded at once.
_JOIN, _READ = 200, 8192


# Encoding


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin: at texts, and at single blanks between characters that are no white space."""
    n = len(data)
    blank = np.flatnonzero(data == 0x20)
    blank = blank[(blank > 0) & (blank < n - 1)]
    before, after = data[blank - 1], data[blank + 1]
    ok = (before > 0x20) & (after > 0x20)
    # Leading bytes of the white space outside ASCII: such neighbours are left together, which is always right.
    wide = np.zeros(256, bool)
    wide[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    ok &= ~wide[after] & ~wide[data[np.maximum(blank - 2, 0)]] & ~wide[data[np.maximum(blank - 3, 0)]]
    cuts = np.zeros(n + 1, bool)
    cuts[blank[ok]] = True
    cuts[starts[:-1]] = True
    cuts[n] = False
    return np.flatnonzero(cuts)


class Encoder:
    """Ids of many texts through the tokenizers library."""

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.opens[number] = token.startswith("Ġ")
        self.table = worker_table("chunks-" + hashlib.sha256(definition.encode()).hexdigest())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and the number of each."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def encoded(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different chunks in some order, where those of each begin, and their numbers.

        Plain words are handed over many at once; where their ids do not fall apart
        into one part for each, they are encoded one by one.
        """
        plain = pc.and_(pc.starts_with(terms, " "), pc.equal(pc.count_substring_regex(terms, r"\s|[^\x00-\x7F\pL]"), 1))
        for content in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(terms, content)))
        plain = plain.to_numpy(zero_copy_only=False)
        start, counts = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.flatnonzero(plain)
        bounds = np.append(np.arange(0, len(at), _JOIN), len(at))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), terms.take(pa.array(at)))
        flat, sizes = self._batch(pc.binary_join(lists, "").to_pylist())
        begin = np.flatnonzero(self.opens[flat])
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(begin, np.concatenate([[0], ends]))
        first = np.append(begin, -1)[cuts[:-1]]
        good = (np.diff(cuts) == np.diff(bounds)) & (first == ends - sizes)
        words, parts = np.repeat(good, np.diff(bounds)), np.repeat(good, np.diff(cuts))
        start[at[words]] = begin[parts]
        counts[at[words]] = np.diff(np.append(begin, len(flat)))[parts]
        single = np.concatenate([at[~words], np.flatnonzero(~plain)])
        more, sizes = self._batch(terms.take(pa.array(single)).to_pylist())
        start[single], counts[single] = len(flat) + np.cumsum(sizes) - sizes, sizes
        return np.concatenate([flat, more]), start, counts

    def terms(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different chunks in some order, where those of each begin, and their numbers.

        Chunks that this worker met lately are taken from its table.  A table beyond
        TABLE chunks is cut to half, and those met last stay.
        """
        t = self.table
        if not t:
            none = np.zeros(0, np.int64)
            t.update(terms=terms[:0], flat=none.astype(np.uint32), start=none, counts=none, last=none, turn=0)
        at = pc.fill_null(pc.index_in(terms, value_set=t["terms"]), -1).to_numpy().astype(np.int64)
        absent = np.flatnonzero(at < 0)
        fresh = terms.take(pa.array(absent))
        flat, start, counts = self.encoded(fresh)
        at[absent] = len(t["terms"]) + np.arange(len(absent))
        start = np.concatenate([t["start"], start + len(t["flat"])])
        flat, counts = np.concatenate([t["flat"], flat]), np.concatenate([t["counts"], counts])
        last = np.concatenate([t["last"], np.zeros(len(absent), np.int64)])
        last[at] = t["turn"] + 1
        met = pa.concat_arrays([t["terms"], fresh])
        keep = counts <= LONGEST
        if keep.sum() > TABLE:
            order = np.argsort(np.where(keep, -last, 1), kind="stable")
            keep[order[TABLE // 2 :]] = False
        if keep.all():
            t.update(terms=met, flat=flat, start=start, counts=counts, last=last)
        else:
            k = np.flatnonzero(keep)
            ends = np.cumsum(counts[k])
            t.update(terms=met.take(pa.array(k)), flat=flat[ragged(start[k], counts[k])], start=ends - counts[k], counts=counts[k], last=last[k])
        t["turn"] += 1
        return flat, start[at], counts[at]

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each text begin."""
        column = column.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        cuts = chunk_starts(data, starts)
        bounds = np.append(cuts, len(data)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(bounds), pa.py_buffer(data))
        coded = chunks.dictionary_encode()
        codes = coded.indices.to_numpy()
        flat, start, counts = self.terms(coded.dictionary.cast(pa.string()))
        lengths = counts[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat[ragged(start[codes], lengths)], ends[np.searchsorted(cuts, starts)]


# File format


def _width(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of ids (a multiple of 128, unsigned 32-bit), and where each block begins."""
    rows = ids.astype(np.uint64).reshape(-1, BLOCK)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    place = -(-BLOCK * PERCENTILE // 100) - 1
    width = _width(np.partition(rest, place, axis=1)[:, place])
    high = rest >> width.astype(np.uint64)[:, None]
    far = high > 0
    n_far = far.sum(axis=1)
    size = _HEAD + BLOCK // 8 * width + 5 * n_far
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.empty((len(rows), _HEAD), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = width, n_far
    out[starts[:, None] + np.arange(_HEAD)] = head
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        low = np.ascontiguousarray((rest[at] & np.uint64((1 << w) - 1)).T)
        words = np.zeros((BLOCK * w // 64, len(at)), np.uint64)
        for i in range(BLOCK):
            word, shift = divmod(i * w, 64)
            words[word] |= low[i] << np.uint64(shift)
            if shift + w > 64:
                words[word + 1] |= low[i] >> np.uint64(64 - shift)
        data = np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(at), -1)
        out[starts[at][:, None] + _HEAD + np.arange(data.shape[1])] = data
    block, where = np.nonzero(far)
    if len(block):
        number = np.arange(len(block)) - (np.cumsum(n_far) - n_far)[block]
        base = (starts + _HEAD + BLOCK // 8 * width)[block]
        out[base + number] = where
        tops = high[far].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + n_far[block] + 4 * number)[:, None] + np.arange(4)] = tops
    return out.tobytes(), starts


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` of the bytes."""
    head = data[starts[:, None] + np.arange(_HEAD)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0].astype(np.uint64)
    width, n_far = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    rest = np.zeros((len(starts), BLOCK), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        packed = data[starts[at][:, None] + _HEAD + np.arange(BLOCK * w // 8)]
        words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").T)
        low = np.empty((BLOCK, len(at)), np.uint64)
        for i in range(BLOCK):
            word, shift = divmod(i * w, 64)
            low[i] = words[word] >> np.uint64(shift)
            if shift + w > 64:
                low[i] |= words[word + 1] << np.uint64(64 - shift)
        rest[at] = (low & np.uint64((1 << w) - 1)).T
    total = int(n_far.sum())
    if total:
        block = np.repeat(np.arange(len(starts)), n_far)
        number = np.arange(total) - (np.cumsum(n_far) - n_far)[block]
        base = (starts + _HEAD + BLOCK // 8 * width)[block]
        tops = np.ascontiguousarray(data[(base + n_far[block] + 4 * number)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        rest[block, data[base + number]] |= tops.astype(np.uint64) << width[block].astype(np.uint64)
    return (rest + least[:, None]).astype(np.uint32).ravel()


class Writer:
    """Appends documents to a stream in the file format."""

    def __init__(self, stream):
        self.stream = stream
        self.at = self.stream.write(MAGIC)
        self.left = np.zeros(0, np.uint32)
        self.starts: list[np.ndarray] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_ids = 0

    def _blocks(self, ids: np.ndarray) -> None:
        data, starts = pack(ids)
        self.starts.append(starts + self.at)
        self.at += self.stream.write(data)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, nulls, counts))
        self.n_ids += len(ids)
        ids = np.concatenate([self.left, ids.astype(np.uint32)])
        whole = len(ids) // BLOCK * BLOCK
        if whole:
            self._blocks(ids[:whole])
        self.left = ids[whole:]

    def close(self) -> None:
        if len(self.left):
            self._blocks(np.append(self.left, np.repeat(self.left[-1:], BLOCK - len(self.left))))
        starts = np.concatenate(self.starts)
        docs, nulls, counts = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        for x, kind in ((starts, "<u8"), (docs, "<i8"), (nulls, "u1"), (counts, "<u8"), ([self.n_ids, len(starts), len(docs)], "<u8")):
            self.stream.write(np.asarray(x).astype(kind).tobytes())
        self.stream.write(MAGIC)


def read(file, size: int) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, ids before it in the file, its ids little-endian) of each document."""
    tail = 24 + len(MAGIC)
    file.seek(size - tail)
    end = file.read(tail)
    if end[24:] != MAGIC:
        raise ValueError("not a complete token file")
    n_ids, n_blocks, n_docs = np.frombuffer(end[:24], "<u8").tolist()
    footer = size - tail - n_blocks * 8 - n_docs * 17
    file.seek(footer)
    index = file.read(size - tail - footer)
    starts = np.frombuffer(index[: n_blocks * 8], "<u8").astype(np.int64)
    at = n_blocks * 8
    docs = np.frombuffer(index[at : at + n_docs * 8], "<i8")
    nulls = np.frombuffer(index[at + n_docs * 8 : at + n_docs * 9], "u1")
    counts = np.frombuffer(index[at + n_docs * 9 :], "<u8").astype(np.int64)
    ends = np.append(starts, footer)
    parts: list[np.ndarray] = []
    held = doc = before = 0
    for first in range(0, n_blocks, _READ):
        last = min(first + _READ, n_blocks)
        file.seek(int(ends[first]))
        data = np.frombuffer(file.read(int(ends[last] - ends[first])), np.uint8)
        ids = unpack(data, starts[first:last] - ends[first])
        if last == n_blocks:
            ids = ids[: n_ids - first * BLOCK]
        used = 0
        while doc < n_docs and held + len(ids) - used >= counts[doc]:
            take = int(counts[doc]) - held
            parts.append(ids[used : used + take])
            yield None if nulls[doc] else int(docs[doc]), before, np.concatenate(parts).astype("<u4").tobytes()
            before += int(counts[doc])
            used, held, parts = used + take, 0, []
            doc += 1
        if used < len(ids):
            parts.append(ids[used:])
            held += len(ids) - used


# Spark


def write_files(documents: DataFrame, definition: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write all texts in ascending doc_id order; returns (shard, path, n_ids, n_docs) of the files."""
    shared = documents.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = slabs(batches, "text", _SLAB)
        slab = next(todo, None)
        if slab is None:
            return
        context, encoder = TaskContext.get(), Encoder(shared.value)
        shard = context.partitionId()
        path = f"{folder}/shard-{shard:08d}.pfor"
        n_docs = 0
        with written(path, str(context.taskAttemptId())) as stream:
            writer = Writer(stream)
            while slab is not None:
                ids, starts = encoder.texts(slab.column("text"))
                ids = np.insert(ids, starts[1:], end_id)
                nulls = slab.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                numbers = slab.column("doc_id").fill_null(0).to_numpy()
                writer.add(numbers, nulls, np.diff(starts) + 1, ids)
                n_docs += slab.num_rows
                slab = next(todo, None)
            writer.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_ids": [writer.n_ids], "n_docs": [n_docs]})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return stored(rows.mapInArrow(run, "shard long, path string, n_ids long, n_docs long"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; start counts the ids of all documents before it."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids = zip(*rows, strict=True)
            sizes = [len(x) // 4 for x in ids]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip((doc, start, sizes, ids), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])

        for rows in batches:
            for path, base in zip(rows.column("path").to_pylist(), rows.column("base").to_pylist(), strict=True):
                system, where = located(path)
                held, size = [], 0
                with system.open_input_file(where) as file:
                    for doc, before, ids in read(file, file.size()):
                        held.append((doc, base + before, ids))
                        size += len(ids)
                        if size > _SLAB:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    n = max(1, files.count())
    return placed.select("path", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")

