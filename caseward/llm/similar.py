"""The pipeline's near-duplicates: every pair of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Method: SimHash fingerprints of the five-word shingles, found within a radius by
BK-trees, as in operator 5; then both whole sets decide.  ``op5_simhash_near_dedup``
has its own contract (three words, 3 of 64 bits).  Here a pair at 0.8 differs in about
ten bits, give or take three.  The radius is half the bits: of larger sets a bit
differs with a probability of about 0.15 at most, so fewer than one pair in a billion
lies beyond it; sets of at most ``SMALL`` shingles, whose bits vary more, are
searched at all 64.

Shards: at such a radius blocks of the fingerprint no longer deal the nodes, so
shingles do.  They have one order for all texts.  Of ``n`` shingles, the first
``n - ceil(0.8 n) + 1`` are a text's prefix; two texts that reach 0.8 share a
shingle of their prefixes (if not, one of them has too few left).  A shingle of
prefixes is a shard with a BK-tree of its own.  What a tree finds is compared by size
and position, then by profiles (how many shingles have each last byte: a bound on what
two sets can share), and a pair that can still reach 0.8 is held against both whole
sets.  A component is what such pairs link.

Scale: equal sets are one node.  Shingles common in a sample come last in the order,
so passages in many texts are hardly in a prefix; the sample places the order, which
may be any, and decides nothing else.  A shingle with more than ``PIECE`` nodes is
cut into pieces that meet pairwise.  Large groups are linked first, by stars at equal
bands of minimum hashes: nodes already in one component are not compared again.
Texts are not shuffled, save those of nodes with a candidate and of rows in a
component of several: a bitmap of their hashes sorts out the others first.

Defined results: words are split at ASCII white space, ASCII letters in lower case;
fewer words than a shingle make one shingle; texts without words are equal; texts
are used whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.llm.simhash import Forest, near_key
from caseward.llm.slabs import Words, joined, mixed, slabs, term_hashes, window_hashes
from caseward.operators.connected import connected_components
from caseward.sources.shared import Stored, stored

SHINGLE = 5
SEED = 42
#: Texts, and shingles of them, that place the order.
SAMPLE, COMMON = 4096, 1 << 17
#: Bands of minimum hashes that link large groups, and hashes of a band.
MINIMA, BAND = 2, 4
#: Bits by which the fingerprints of a pair differ at most; sets of up to SMALL shingles may differ in all.
RADIUS, SMALL = 32, 16
#: Most bits of the bitmap by which rows are sorted out before a join.
BITS = 1 << 27
#: Counts of a profile.
PROFILE = 256
#: Bytes of the sets of a bucket of a cluster.
CELL_BYTES = 8 << 20
#: Nodes that meet at a shingle in one task.
PIECE = 8192
_SLAB = 4 << 20
#: Candidate pairs sent at once, and (query, node) steps followed at once.
_PAIRS, _FRONTIER = 1 << 19, 1 << 18


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different shingles of each text, in ascending order."""
    words = Words(pc.ascii_lower(pc.fill_null(column, "")))
    terms = term_hashes(words.terms, SEED)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for width in range(1, SHINGLE + 1):
        if width < SHINGLE:
            at = words.starts[:-1][words.counts == width]
        else:
            at = np.flatnonzero(np.arange(len(terms)) - words.starts[words.rows] + width <= words.counts[words.rows])
        if len(at):
            rows.append(words.rows[at])
            hashes.append(window_hashes(terms, width, SEED)[at])
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _lists(row: np.ndarray, value: np.ndarray, size: int) -> pa.Array:
    """Values, ordered by row, as a list for each of ``size`` rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(size + 1)), pa.int32()), pa.array(value.view(np.int64)))


def fingerprints(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each set; ``starts``: where those of each text begin, with the end."""
    n = np.diff(starts)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), 8), np.uint8)
    if len(full):
        data = value.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            bits = np.unpackbits(data[:, byte], bitorder="little").reshape(-1, 8)
            counts = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int32)
            out[full, byte] = np.packbits(2 * counts > n[full, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64).ravel()


def profiles(row: np.ndarray, value: np.ndarray, size: int) -> pa.Array:
    """How many shingles of each text have each last byte; null where a count is beyond a byte."""
    counts = np.bincount(row * PROFILE + (value % np.uint64(PROFILE)).astype(np.int64), minlength=size * PROFILE).reshape(size, PROFILE)
    known = (counts < 256).all(axis=1).tolist()
    return pa.array([c.tobytes() if k else None for c, k in zip(counts.astype(np.uint8), known, strict=True)], pa.binary())


def possible(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs whose profiles leave room for enough common shingles; none that reaches the similarity is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            profile = {}
            for c in "xy":
                filled = batch.column(c).fill_null(b"\xff" * PROFILE).to_pylist()
                profile[c] = np.frombuffer(b"".join(filled), np.uint8).reshape(-1, PROFILE)
            unknown = (batch.column("x").is_null().to_numpy(zero_copy_only=False)) | batch.column("y").is_null().to_numpy(zero_copy_only=False)
            common = np.minimum(profile["x"], profile["y"]).sum(axis=1, dtype=np.int64)
            n = batch.column("m").to_numpy().astype(np.int64) + batch.column("n").to_numpy()
            stay = pa.array(unknown | (9 * common >= 4 * n))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(stay) for c in "ab"})

    nodes = marked.groupBy("fp").agg(F.max("n").alias("n"), F.min("profile").alias("profile"))
    one, two = nodes.selectExpr("fp AS a", "n AS m", "profile AS x"), nodes.selectExpr("fp AS b", "n", "profile AS y")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def common_shingles(documents: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, rank) of those in three texts of the sample or more, by shingle; the most common has the last rank."""
    marks = documents.select(F.xxhash64("text").alias("t")).distinct().orderBy("t").limit(sample).agg(F.max("t")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text", _SLAB):
            _, first = np.unique(slab.column("t").to_numpy(), return_index=True)
            _, value = shingle_sets(slab.column("text").take(pa.array(first)))
            yield pa.RecordBatch.from_pydict({"token": pa.array(value.view(np.int64))})

    if marks is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    chosen = documents.select(F.xxhash64("text").alias("t"), "text").filter(F.col("t") <= marks)
    counts = chosen.mapInArrow(run, "token long").groupBy("token").count().filter("count > 2")
    rows = counts.orderBy(F.desc("count"), "token").limit(COMMON).select("token").toArrow()
    tokens = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - order).astype(np.int64)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def prefixes(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, t (hash of the text), fp (hash of the shingle set), simhash, n shingles, the prefix (longs as bytes), its common shingles, minimum hashes, profile."""
    shared = documents.sparkSession.sparkContext.broadcast(common_shingles(documents, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        tokens, ranks = shared.value
        for slab in slabs(batches, "text", _SLAB):
            size = slab.num_rows
            row, value = shingle_sets(slab.column("text"))
            starts = np.searchsorted(row, np.arange(size + 1))
            n = np.diff(starts)
            fp = np.array([xxh64_intdigest(value[a:b].tobytes(), SEED) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], np.uint64)
            rank = np.zeros(len(value), np.int64)
            if len(tokens) and len(value):
                at = np.minimum(np.searchsorted(tokens, value), len(tokens) - 1)
                rank = np.where(tokens[at] == value, ranks[at], 0)
            order = np.lexsort((value, rank, row))
            head = order[(np.arange(len(row)) - starts[row]) < prefix_length(n)[row]]
            cuts = np.searchsorted(row[head], np.arange(size + 1)).tolist()
            prefix = [value[head[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            frequent = head[rank[head] > 0]
            full = np.flatnonzero(n)
            least = []
            for band in range(MINIMA if len(full) else 0):
                least.append(np.zeros(len(full), np.uint64))
                for m in range(band * BAND, (band + 1) * BAND):
                    least[-1] = mixed(least[-1], np.minimum.reduceat(mixed(value, np.full(1, SEED, np.uint64), m), starts[full]))
            minima = np.stack(least, axis=1).ravel() if least else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": slab.column("doc_id"),
                    "t": slab.column("t"),
                    "fp": pa.array(fp.view(np.int64)),
                    "simhash": pa.array(fingerprints(value, starts).view(np.int64)),
                    "n": pa.array(n, pa.int32()),
                    "prefix": pa.array(prefix, pa.binary()),
                    "common": _lists(row[frequent], value[frequent], size),
                    "minima": _lists(np.repeat(full, MINIMA), minima, size),
                    "profile": profiles(row, value, size),
                }
            )

    given = documents.select("doc_id", F.xxhash64("text").alias("t"), "text")
    kind = dict(documents.dtypes)["doc_id"]
    return given.mapInArrow(run, f"doc_id {kind}, t long, fp long, simhash long, n int, prefix binary, common array<long>, minima array<long>, profile binary")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a prefix."""
    for batch in batches:
        blobs = batch.column("prefix").to_pylist()
        sizes = np.array([len(b) // 8 for b in blobs], np.int64)
        owner = np.repeat(np.arange(len(blobs)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        given = {c: pa.array(batch.column(c).to_numpy()[owner]) for c in ("fp", "root", "simhash", "n")}
        token = np.frombuffer(b"".join(blobs), np.int64)
        yield pa.RecordBatch.from_pydict({"token": pa.array(token), **given, "pos": pa.array(place, pa.int32())})


def candidates(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of the pairs of a cell that its BK-tree finds and that can reach the similarity; rows come ordered by cell."""
    token, low, high, piece, fp, root, simhash, n, pos = (c.to_numpy() for c in rows.columns)
    new = (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    cells = np.concatenate([[0], np.cumsum(new)])
    many = np.bincount(cells)[cells] > 1
    cells, low, high, piece, fp, root, simhash, n, pos = (x[many] for x in (cells, low, high, piece, fp, root, simhash.view(np.uint64), n.astype(np.int64), pos.astype(np.int64)))
    # A cell of two pieces holds a tree of one, which the nodes of the other ask.
    nodes, asked = np.flatnonzero(piece == low), np.flatnonzero(piece == high)
    forest = Forest(simhash[nodes], cells[nodes])
    steps = np.cumsum(np.bincount(cells[nodes], minlength=int(cells.max()) + 1 if len(cells) else 1)[cells[asked]])
    start = 0
    while start < len(asked):
        base = steps[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(steps, base + _FRONTIER, side="right")))
        part = asked[start:stop]
        for q, node in forest.within(simhash[part], cells[part], np.where(n[part] <= SMALL, 64, RADIUS)):
            left, right = part[q], nodes[node]
            met = (root[left] != root[right]) & (5 * np.minimum(n[left], n[right]) >= 4 * np.maximum(n[left], n[right]))
            met &= 9 * np.minimum(n[left] - pos[left], n[right] - pos[right]) >= 4 * (n[left] + n[right])
            if met.any():
                a, b = fp[left[met]], fp[right[met]]
                yield np.minimum(a, b), np.maximum(a, b)
        start = stop


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by cell; cells that are whole are compared together."""

    def sent(parts: list) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate([np.stack(p, axis=1) for p in parts]), axis=0)
        return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    def found(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for pair in candidates(rows):
            parts.append(pair)
            size += len(pair[0])
            if size >= _PAIRS:
                yield sent(parts)
                parts, size = [], 0
        if parts:
            yield sent(parts)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(3)]
        if [batch.column(i)[0].as_py() for i in range(3)] == last:
            continue
        rows = joined(held)
        same = np.ones(rows.num_rows, bool)
        for i, x in enumerate(last):
            same &= rows.column(i).to_numpy() == x
        whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if whole:
            yield from found(rows.slice(0, whole))
        held = [rows.slice(whole)]
    if held:
        yield from found(joined(held))


def pairs(marked: DataFrame, placed: DataFrame, piece: int = PIECE) -> DataFrame:
    """(a, b) of the nodes that can reach the similarity and are not yet in one component."""
    nodes = marked.select("fp", "simhash", "n", "prefix").dropDuplicates(["fp"]).join(placed, "fp", "left")
    nodes = nodes.select("fp", F.coalesce("root", "fp").alias("root"), "simhash", "n", "prefix")
    rows = nodes.mapInArrow(_entries, "token long, fp long, root long, simhash long, n int, pos int")
    # Copies count as well here: more pieces than necessary do no harm.
    large = marked.select(F.explode("common").alias("token")).groupBy("token").count().filter(F.col("count") > piece)
    large = large.select("token", F.ceil(F.col("count") / piece).alias("parts"))
    rows = rows.join(large, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, CAST(parts - 1 AS INT))")))
    cells = rows.select("token", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "fp", "root", "simhash", "n", "pos")
    cells = cells.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    return cells.mapInArrow(_meet, "a long, b long").distinct()


def stars(marked: DataFrame) -> DataFrame:
    """(a, b) of nodes with an equal minimum hash and the least of these nodes."""
    rows = marked.select("fp", F.posexplode("minima").alias("number", "least")).distinct()
    hubs = rows.groupBy("number", "least").agg(F.min("fp").alias("a"), F.count("*").alias("size")).filter("size > 1").drop("size")
    return rows.join(hubs, ["number", "least"]).filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def _keyed(documents: DataFrame) -> DataFrame:
    rows = documents.withColumns({"_near_k": near_key(), "_near_t": F.xxhash64("text")})
    return rows.withColumn("_near_h", F.xxhash64("_near_k", "_near_t"))


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for the hash of each (_near_k, _near_t); other hashes may share it.

    It has 16 to 32 bits a key.  Spark makes it in blocks of 32768 bits, so what comes
    to the driver is at most ``BITS`` bits, whatever the number of keys.
    """
    size = min(max(1 << 20, 1 << (16 * keys.count()).bit_length()), BITS)
    at = F.pmod(F.xxhash64("_near_k", "_near_t"), F.lit(size)) + 1
    blocks = keys.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in blocks.toLocalIterator():
        bits[(r["block"] - 1) * 4096 : r["block"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def sorted_out(keyed: DataFrame, bits: np.ndarray, hit: bool) -> DataFrame:
    """The rows whose bit is set, or is not."""
    shared = keyed.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_near_h").to_numpy() % (8 * len(shared.value))
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1 == 1) == hit))

    return keyed.mapInArrow(run, keyed.schema)


_CELL = ["root", "low", "high"]


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by cell: the sets of a cell, then its pairs.  Pairs that reach the similarity, less those that others connect."""
    now, sets, above = None, {}, {}

    def root_of(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    for batch in batches:
        out = []
        for *cell, a, b, blob in zip(*(batch.column(c).to_pylist() for c in (*_CELL, "a", "b", "shingles")), strict=True):
            if cell != now:
                now, sets, above = cell, {}, {}
            if blob is not None:
                sets[a] = np.frombuffer(blob, np.uint64)
                continue
            one, two = root_of(a), root_of(b)
            if one == two:
                continue
            x, y = sets[a], sets[b]
            if len(x) < len(y):
                x, y = y, x
            at = np.minimum(x.searchsorted(y), len(x) - 1) if len(x) else np.zeros(0, np.int64)
            if 9 * int((x[at] == y).sum()) >= 4 * (len(x) + len(y)):
                above[max(one, two)] = min(one, two)
                out.append((a, b))
        if out:
            links = np.array(out, np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})


def verified(documents: DataFrame, marked: DataFrame, found: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """A spanning forest of the pairs whose whole sets reach the similarity.

    Pairs that hang together meet in one cell, to which every set is sent once; a
    larger cluster is cut into buckets of nodes, and a set goes to those pairs of
    buckets where it is asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text", _SLAB):
            row, value = shingle_sets(slab.column("text"))
            cuts = np.searchsorted(row, np.arange(slab.num_rows + 1)).tolist()
            blobs = [value[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"fp": slab.column("fp"), "shingles": pa.array(blobs, pa.binary())})

    asked = Stored(possible(found, marked), "candidates")
    clusters = connected_components(asked.read()).withColumnRenamed("node", "fp")
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("fp"), "root").distinct())
    rows = marked.groupBy("fp").agg(F.min(F.struct(near_key().alias("_near_k"), F.col("t").alias("_near_t"))).alias("row"), F.max("n").alias("n"))
    rows = Stored(rows.join(clusters, "fp").select("fp", "root", "n", "row.*"), "first")
    sizes = rows.read().groupBy("root").agg(F.sum(F.col("n").cast("long")).alias("n"))
    sizes = sizes.select("root", F.ceil(F.col("n") * 8 / cell_bytes).cast("int").alias("buckets"))
    buckets = F.pmod(F.xxhash64("fp"), F.greatest("buckets", F.lit(1))).cast("int")
    nodes = rows.read().select("fp", "root").join(sizes, "root").select("fp", "root", buckets.alias("bucket"))
    one, two = nodes.select(F.col("fp").alias("a"), "root", F.col("bucket").alias("x")), nodes.select(F.col("fp").alias("b"), F.col("bucket").alias("y"))
    pairs = asked.read().join(one, "a").join(two, "b").select("root", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"), "a", "b")
    pairs = Stored(pairs, "placed")
    wanted = pairs.read().select(*_CELL, F.explode(F.array("a", "b")).alias("fp")).distinct()
    texts = sorted_out(_keyed(documents.select("doc_id", "text")), bitmap(rows.read()), True)
    # Rows of one key have one text and are one node.
    chosen = texts.join(rows.read(), ["_near_k", "_near_t"]).dropDuplicates(["_near_k", "_near_t"]).select("fp", "text")
    sets = chosen.mapInArrow(run, "fp long, shingles binary").join(wanted, "fp").select(*_CELL, F.col("fp").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    rest = pairs.read().select(*_CELL, "a", "b", F.lit(None).cast("binary").alias("shingles"))
    met = sets.unionByName(rest).repartition(*_CELL).sortWithinPartitions(*_CELL, F.col("b").isNotNull(), "a", "b")
    links = stored(met.mapInArrow(_checked, "a long, b long"), "links")
    for table in (asked, rows, pairs):
        table.drop()
    return links


def grouped(documents: DataFrame, piece: int = PIECE, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, fp) of each row, and (fp, root) of each shingle set: its component."""
    marked = stored(prefixes(documents, sample), "prefixes")
    first = verified(documents, marked, stars(marked))
    links = first.unionByName(verified(documents, marked, pairs(marked, connected_components(first).withColumnRenamed("node", "fp"), piece)))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    nodes = marked.select("fp").distinct()
    return marked.select("doc_id", "t", "fp"), nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def deduplicated(documents: DataFrame, piece: int = PIECE, sample: int = SAMPLE) -> DataFrame:
    """One row of each component stays, with all columns: the smallest doc_id, null last, then the smallest text hash."""
    marked, placed = grouped(documents.select("doc_id", "text"), piece, sample)
    rows = marked.select(near_key().alias("_near_k"), F.col("t").alias("_near_t"), "fp").join(placed, "fp")
    row = F.struct("_near_k", "_near_t")
    several = rows.groupBy("root").agg(F.min(row).alias("best"), F.count("*").alias("size")).filter("size > 1")
    judged = rows.join(several, "root").select("_near_k", "_near_t", (row == F.col("best")).alias("_near_stays")).distinct()
    judged = stored(judged, "judged")
    keyed, bits = _keyed(documents), bitmap(judged)
    # A row that only shares a bit has no judgement and stays.
    hit = sorted_out(keyed, bits, True).join(judged, ["_near_k", "_near_t"], "left").filter(F.coalesce("_near_stays", F.lit(True)))
    hit = hit.dropDuplicates(["_near_k", "_near_t"])
    return sorted_out(keyed, bits, False).select(*documents.columns).unionByName(hit.select(*documents.columns))
