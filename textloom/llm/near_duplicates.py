"""Problem 5: rows whose texts differ by little, found by a grouped prefix join.

Alike are two texts of at least 12 words whose sets of distinct three-word runs share at least half of their union, that
is, of n and m runs they differ in at most (n + m) / 3. The join is exact; nothing is sampled or capped:

1. A count sketch of fixed size (2**20 counters) gives every run an order from rare to frequent. It bounds what is
   broadcast whatever the corpus holds; any order is right, a good one makes the join cheap. Documents with the same set
   of runs make one class; one of each takes part in the join.
2. All runs are spread over PARTS parts (more for longer texts). The differences of two alike texts add up over the
   parts, so in at least one part their runs there, a and b, differ in at most (a + b) / 3. Each part is joined by itself;
   what it needs of a text is a sixteenth of the runs' size: the keys and 128 parity bits, which go to a bucket with it.
3. Within a part alike sets share at least a - a/2 runs, so their prefixes of a - a/2 + l rarest runs share at least l.
   With the runs spread over KINDS kinds and l = KINDS + 1, two shared ones are of one kind (pigeonhole): pairs of prefix
   runs of one kind are the keys. Parts too small for that (fewer than 2 * l runs) also join by single prefix runs.
   A key goes to the bucket of its rarer run, so the texts that a bucket gets, and the bytes of a text that are sent,
   don't grow with the number of buckets beyond its a - a/2 + 1 rarer runs.
4. In a bucket, texts with the same keys, size and parity bits are collapsed into one group; pairs of groups that share a
   key are filtered by size and by parity (the bits in which two sets differ are at most the runs in which they differ),
   then expanded to their members. Groups of one key are filtered in blocks, as products of matrices; a key of more than
   HOT groups is split into blocks that are written once to the shared folder, and each pair of them goes to a task of its own.
5. Candidates are verified on the whole texts. Links go through connected components; pairs come from the components.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import shingles
from textloom.operators.graph import connected_components, pairs_within
from textloom.session import cut_lineage, partitions, spread, step_path

SKETCH_BITS = 20
CHUNKS = 16
#: Runs from which texts are split into parts, and from which into twice as many; texts below both bounds are one part.
SPLIT, WIDE = 48, 400
PARTS = 4
KINDS = 5
SHARED = KINDS + 1  # l above
#: Keys that one task of the join holds at a time, about, and keys that a text has for each of its runs, about.
BUCKET_KEYS, KEYS_PER_RUN = 8_000_000, 1.3
#: Groups of one key from which their pairs are filtered by matrix products, groups of a block of these, and groups
#: from which a key's blocks go to tasks of their own.
LARGE, BLOCK, HOT = 32, 2_048, 16_384
#: Pairs that a task holds before it sends them on.
HELD = 4_000_000
#: Texts whose keys are packed at a time; what a bucket gets of each such slab costs some 100 bytes besides.
SLAB = 20_000
#: Members that are no representatives, up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str | None]]:
    return np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64), batch.column(1).to_pylist()


def _counter(run: np.ndarray) -> np.ndarray:
    return (run >> np.uint64(shingles.RUN_BITS - SKETCH_BITS)).astype(np.int64)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _sums(doc: np.ndarray, run: np.ndarray, n: int) -> np.ndarray:
    """A hash of the set of runs of each text."""
    total = np.zeros(n, np.uint64)
    if len(doc):
        starts = _starts(doc)
        total[doc[starts]] = np.add.reduceat(shingles.mix(run + np.uint64(1)), starts)
    return total


def signatures(docs: DataFrame) -> DataFrame:
    """One reading of docs(id, text): (id, class, size) of each text that has enough words, and (chunk, counts), parts of
    how many texts hold a run, summed over the runs that share one of 2**20 counters; the other columns are null."""
    width = (1 << SKETCH_BITS) // CHUNKS
    names, kinds = ["id", "class", "size", "chunk", "counts"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            ids, texts = _texts(batch)
            doc, run, sizes = shingles.run_sets(texts)
            total += np.bincount(_counter(run), minlength=1 << SKETCH_BITS)
            whole = shingles.mix(_sums(doc, run, len(ids)) * np.uint64(31) + sizes.astype(np.uint64))
            has = sizes > 0
            some = int(has.sum())
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(whole[has].view(np.int64)), pa.array(np.minimum(sizes[has], 2**31 - 1).astype(np.int32)), pa.nulls(some, kinds[3]), pa.nulls(some, kinds[4])], names)
        if total.any():
            parts = [zlib.compress(total[i * width : (i + 1) * width].astype("<i8").tobytes(), 1) for i in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(CHUNKS, k) for k in kinds[:3]), pa.array(range(CHUNKS), kinds[3]), pa.array(parts, kinds[4])], names)

    return docs.mapInArrow(sign, "id long, class long, size int, chunk int, counts binary")


def frequency_sketch(parts: DataFrame) -> np.ndarray:
    """The 2**20 counters, from their parts(chunk, counts)."""
    width = (1 << SKETCH_BITS) // CHUNKS

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for part in batch.column(1):
                total += np.frombuffer(zlib.decompress(part.as_py()), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in parts.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():  # CHUNKS rows of a fixed size
        sketch[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(row["counts"])), "<i8")
    return np.minimum(sketch, 2**31 - 1).astype(np.int32)


def _ordered(texts: list[str | None], sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, run, sizes): the runs of each text from rare to frequent, ties by hash."""
    doc, run, sizes = shingles.run_sets(texts)
    rarity = np.minimum(sketch[_counter(run)], (1 << 26) - 1).astype(np.int64)
    order = shingles.sorted_by((doc << 26) | rarity)
    return doc, run[order], sizes


def _band(size: np.ndarray) -> np.ndarray:
    """0 below SPLIT runs, 1 below WIDE, and one more for each doubling."""
    return np.where(size < SPLIT, 0, np.where(size < WIDE, 1, np.floor(np.log2(np.maximum(size, 1) / WIDE)).astype(np.int64) + 2))


def _parity(start: np.ndarray, run: np.ndarray) -> np.ndarray:
    """128 bits for the runs from each start to the next one; each run flips one."""
    bit = shingles.mix(run + np.uint64(7)) >> np.uint64(57)
    flip = np.uint64(1) << (bit & np.uint64(63))
    high = bit >> np.uint64(6)
    return np.stack([np.bitwise_xor.reduceat(flip * (np.uint64(1) - high), start), np.bitwise_xor.reduceat(flip * high, start)], axis=1) if len(start) else np.zeros((0, 2), np.uint64)


def entries(doc: np.ndarray, run: np.ndarray, sizes: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bucket, doc, size, bits, keys, key) of each band: the parts of texts by bucket, in the order of bucket and text.

    size are the runs of the part and bits its parity, keys the number of its keys in that bucket, which stand in key.
    A pair of texts belongs to the band of its larger one: a text joins in its own band and in that of twice its size.
    """
    per = max(1, buckets // PARTS)
    for band in np.unique(np.concatenate([_band(sizes[sizes > 0]), _band(2 * sizes[sizes > 0])])) if len(doc) else []:
        parts = 1 if band == 0 else PARTS << max(0, int(band) - 1)
        near = ((_band(sizes) == band) | (_band(2 * sizes) == band))[doc]
        d, r = doc[near], run[near]
        mixed = shingles.mix(r ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        cell = d * parts + (mixed % np.uint64(parts)).astype(np.int64)
        order = shingles.sorted_by(cell)  # still from rare to frequent within a cell
        cell, r, mixed = cell[order], r[order], mixed[order]
        start = _starts(cell)
        used, size = cell[start], np.diff(np.append(start, len(cell)))
        number = np.repeat(np.arange(len(used)), size)
        place = np.arange(len(cell)) - start[number]
        base = size - -(-size // 2)
        bits = _parity(start, r)
        long = place < base[number] + SHARED
        own, x = number[long], mixed[long]
        kind = own * KINDS + (x // np.uint64(parts) % np.uint64(KINDS)).astype(np.int64)
        order = shingles.sorted_by(kind)
        own, x, kind = own[order], x[order], kind[order]
        who, key, home = [], [], []
        at, step = np.arange(len(kind)), 1
        while True:
            at = at[at + step < len(kind)]
            at = at[kind[at] == kind[at + step]]
            if not len(at):
                break
            who.append(own[at])
            key.append(shingles.mix(x[at] * np.uint64(3) + x[at + step] + np.uint64(band)))
            home.append(x[at])
            step += 1
        single = np.flatnonzero((size[number] < 2 * SHARED) & (place < base[number] + 1))
        who.append(number[single])
        key.append(shingles.mix(mixed[single] + np.uint64(0x5A5A5A5A + int(band))))
        home.append(mixed[single])
        who, key, home = np.concatenate(who), np.concatenate(key), np.concatenate(home)
        part = used[who] % parts % PARTS if band else (shingles.mix(home) % np.uint64(PARTS)).astype(np.int64)
        bucket = (part * per + (shingles.mix(home + np.uint64(9)) % np.uint64(per)).astype(np.int64)) % buckets
        order = shingles.sorted_by(bucket * len(used) + who)
        bucket, who, key = bucket[order], who[order], key[order]
        first = _starts(bucket * len(used) + who)
        entry = who[first]
        yield bucket[first], used[entry] // parts, size[entry], bits[entry], np.diff(np.append(first, len(who))), key


def _pack(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(x.astype(kind).tobytes(), 1)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _three_bytes(key: np.ndarray) -> bytes:
    """The lowest 24 bits: keys of one bucket that meet by chance only add pairs that the next filter drops."""
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes()


def _from_three_bytes(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return wide.view("<u4").ravel()


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    held: list[tuple[np.ndarray, list[str | None]]] = []
    for batch in batches:
        held.append(_texts(batch))
        if sum(len(x) for x, _ in held) >= SLAB:
            yield np.concatenate([x for x, _ in held]), [t for _, ts in held for t in ts]
            held = []
    if held:
        yield np.concatenate([x for x, _ in held]), [t for _, ts in held for t in ts]


def postings(docs: DataFrame, sketch, buckets: int) -> DataFrame:
    """The entries of each slab of texts, packed by bucket: (bucket, ids, sizes, counts, bits, keys)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slabs(batches):
            for bucket, doc, size, bits, count, key in entries(*_ordered(texts, sketch.value), buckets):
                some, first = np.unique(bucket, return_index=True)
                last = np.append(first[1:], len(bucket))
                ends = np.concatenate([[0], np.cumsum(count)])
                cut = list(zip(first.tolist(), last.tolist(), strict=True))
                columns = [
                    pa.array(some, pa.int32()),
                    pa.array([_pack(np.diff(ids[doc[i:j]], prepend=0), "<i8") for i, j in cut], pa.binary()),
                    pa.array([_pack(np.minimum(size[i:j], 2**31 - 1), "<i4") for i, j in cut], pa.binary()),
                    pa.array([_pack(count[i:j], "<i4") for i, j in cut], pa.binary()),
                    pa.array([bits[i:j].tobytes() for i, j in cut], pa.binary()),
                    pa.array([_three_bytes(key[ends[i] : ends[j]]) for i, j in cut], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "ids", "sizes", "counts", "bits", "keys"])

    return docs.mapInArrow(emit, "bucket int, ids binary, sizes binary, counts binary, bits binary, keys binary")


def _collapsed(count: np.ndarray, size: np.ndarray, bits: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, group): entries with the same keys, size and bits are one group; the first entry of each, and each one's group."""
    starts = np.cumsum(count) - count
    total = np.add.reduceat(shingles.mix(key.astype(np.uint64) + np.uint64(1)), starts)
    same = shingles.mix(shingles.mix(bits[:, 0] + total) + shingles.mix(bits[:, 1] + size.astype(np.uint64) * np.uint64(3)) + count.astype(np.uint64))
    _, first, group = np.unique(same, return_index=True, return_inverse=True)
    return first, group


def _signs(bits: np.ndarray) -> np.ndarray:
    """1 or -1 for each bit."""
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _near_blocks(n: np.ndarray, bits: np.ndarray, n2: np.ndarray, bits2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two blocks whose sizes and bits let them be alike, 1.5 * (128 - signs * signs2) <= n + n2, as one product."""
    one, few, few2 = np.float32(1), np.minimum(n, 192).astype(np.float32), np.minimum(n2, 192).astype(np.float32)  # 192 is always enough
    left = np.column_stack([_signs(bits) * np.float32(1.5), few, np.full(len(n), one)])
    right = np.column_stack([_signs(bits2), np.full(len(n2), one), few2])
    i, j = np.divmod(np.flatnonzero(left @ right.T >= 192), max(1, len(n2)))
    ok = 2 * np.minimum(n[i], n2[j]) >= np.maximum(n[i], n2[j])
    return i[ok], j[ok]


def _filtered(key: np.ndarray, who: np.ndarray, size: np.ndarray, bits: np.ndarray, hot: list[np.ndarray], most_groups: int) -> Iterator[np.ndarray]:
    """Pairs of groups that share a key and may be alike, as numbers (x << 32 | y); keys are sorted. Keys of more than
    most_groups are only noted in hot."""
    start = _starts(key)
    width = np.diff(np.append(start, len(key)))
    at = np.flatnonzero(np.repeat(width < LARGE, width))
    step = 1
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        for lo in range(0, len(at), 500_000):
            x, y = who[at[lo : lo + 500_000]].astype(np.int64), who[at[lo : lo + 500_000] + step].astype(np.int64)
            p, q = size[x], size[y]
            fit = np.flatnonzero((x != y) & (2 * np.minimum(p, q) >= np.maximum(p, q)))
            x, y, most = x[fit], y[fit], (p[fit] + q[fit]) // 3
            fit = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= most
            yield (np.minimum(x, y)[fit] << 32) | np.maximum(x, y)[fit]
        step += 1
    for k in np.flatnonzero(width >= LARGE):
        own = shingles.distinct(who[start[k] : start[k] + width[k]].astype(np.int64))
        if len(own) > most_groups:
            hot.append(own)
            continue
        own = own[np.argsort(size[own], kind="stable")]
        n = size[own]
        last = np.searchsorted(n, 2 * n, side="right")  # no group before that is more than twice as large
        for lo in range(0, len(own), BLOCK):
            hi = min(lo + BLOCK, len(own))
            for lo2 in range(lo, int(last[hi - 1]), BLOCK):
                hi2 = min(lo2 + BLOCK, len(own))
                i, j = _near_blocks(n[lo:hi], bits[own[lo:hi]], n[lo2:hi2], bits[own[lo2:hi2]])
                x, y = own[i + lo], own[j + lo2]
                ok = x < y if lo2 == lo else x != y
                x, y = x[ok], y[ok]
                yield (np.minimum(x, y) << 32) | np.maximum(x, y)


def _expanded(first: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a member of group x[i] and one of y[i], members lying at first[g] .. first[g] + size[g]."""
    weight, lo = np.cumsum(size[x] * size[y]), 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + HELD, side="right")))
        a, b = x[lo:hi], y[lo:hi]
        left = shingles.spans(first[a], size[a])
        rows = np.repeat(size[b], size[a])
        step = max(1, HELD // max(1, int(rows.max())))
        begin = np.repeat(first[b], size[a])
        for k in range(0, len(left), step):
            yield np.repeat(left[k : k + step], rows[k : k + step]), shingles.spans(begin[k : k + step], rows[k : k + step])
        lo = hi


def _pairs_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) & (a < b) if len(a) else np.zeros(0, bool)
    a, b = a[new], b[new]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.string())], ["a", "b", "file"])


def _sent(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of pairs of ids, the smaller first, each held back until there are HELD."""
    found, held = [], 0
    for x, y in pairs:
        if len(x):
            found.append((np.minimum(x, y), np.maximum(x, y)))
            held += len(x)
        if held > HELD:
            yield _pairs_batch(found)
            found, held = [], 0
    if found:
        yield _pairs_batch(found)


def _block(ids: np.ndarray, size: np.ndarray, bits: np.ndarray) -> bytes:
    return b"".join([len(ids).to_bytes(8, "little"), ids.astype("<i8").tobytes(), size.astype("<i8").tobytes(), np.ascontiguousarray(bits).tobytes()])


def _read_block(file: pa.NativeFile, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    file.seek(at)
    n = int.from_bytes(file.read(8), "little")
    raw = file.read(32 * n)
    return np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n : 16 * n], "<i8"), np.frombuffer(raw[16 * n :], "<u8").reshape(-1, 2)


def _write_blocks(folder: str, keys: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> pa.RecordBatch:
    """(a, b, file): the places in a new file of each two blocks of a key, (ids, sizes, bits) in the order of sizes, that may hold alike texts.

    The file has a name of its own for each run of a task, which may meet its texts in another order.
    """
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    name, place, left, right = uuid.uuid4().hex, 0, [], []
    with fs.open_output_stream(f"{path}/{name}") as out:
        for ids, size, bits in keys:
            cut = range(0, len(ids), most)
            at = []
            for lo in cut:
                raw = _block(ids[lo : lo + most], size[lo : lo + most], bits[lo : lo + most])
                out.write(raw)
                at.append(place)
                place += len(raw)
            for i, lo in enumerate(cut):
                for j in range(i, len(at)):
                    if size[cut[j]] <= 2 * size[min(lo + most, len(ids)) - 1]:
                        left.append(at[i])
                        right.append(at[j])
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array([name] * len(left), pa.string())], ["a", "b", "file"])


def _block_pairs(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the pairs of two blocks, or of one if they are the same, that may be alike; both are in the order of sizes."""
    (ids, n, bits), (ids2, n2, bits2) = one, two
    for lo in range(0, len(ids), BLOCK):
        hi = min(lo + BLOCK, len(ids))
        for lo2 in range(lo if same else 0, len(ids2), BLOCK):
            hi2 = min(lo2 + BLOCK, len(ids2))
            if n2[lo2] <= 2 * n[hi - 1] and n[lo] <= 2 * n2[hi2 - 1]:
                i, j = _near_blocks(n[lo:hi], bits[lo:hi], n2[lo2:hi2], bits2[lo2:hi2])
                yield ids[i + lo], ids2[j + lo2]


def candidate_pairs(packed: DataFrame, buckets: int, most_groups: int = HOT) -> DataFrame:
    """(a, b), a < b: texts of which one part shares a key and may be alike by its size and bits."""
    spark = packed.sparkSession
    folder = step_path(spark, "blocks")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for batch in batches:
            for row in batch.to_pylist():
                parts = (np.cumsum(_unpack(row["ids"], "<i8")), _unpack(row["sizes"], "<i4").astype(np.int64), _unpack(row["counts"], "<i4").astype(np.int64), np.frombuffer(row["bits"], "<u8").reshape(-1, 2), _from_three_bytes(row["keys"]))
                for column, part in zip(columns, parts, strict=True):
                    column.append(part)
        if not columns[0]:
            return
        ids, size, count, bits, key = (np.concatenate(c) for c in columns)
        columns.clear()
        first, group = _collapsed(count, size, bits, key)
        members = np.argsort(group, kind="stable")
        many = np.bincount(group)
        begin = np.cumsum(many) - many
        keys = shingles.spans((np.cumsum(count) - count)[first], count[first])
        both = np.sort((key[keys].astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(len(first)), count[first]).astype(np.uint64))
        met = np.zeros(len(both), bool)
        met[1:] = (both[1:] >> np.uint64(32)) == (both[:-1] >> np.uint64(32))
        met[:-1] |= met[1:]
        both = both[met]
        size, bits, ids = size[first], bits[first], ids[members]
        hot: list[np.ndarray] = []

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            inner = np.flatnonzero(many > 1)
            for x, y in _expanded(begin, many, inner, inner):
                yield ids[x], ids[y]
            held, n = [], 0
            found = _filtered((both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64), size, bits, hot, most_groups)
            for part in (*found, None):
                if part is not None:
                    held.append(part)
                    n += len(part)
                if held and (part is None or n > HELD):
                    pair = shingles.distinct(np.concatenate(held))
                    for x, y in _expanded(begin, many, pair >> 32, pair & 0xFFFFFFFF):
                        yield ids[x], ids[y]
                    held, n = [], 0

        def keys() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for own in hot:
                own = own[np.argsort(size[own], kind="stable")]
                yield ids[shingles.spans(begin[own], many[own])], np.repeat(size[own], many[own]), np.repeat(bits[own], many[own], axis=0)

        yield from _sent(pairs())
        if hot:
            yield _write_blocks(folder, keys(), most_groups)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for a, b, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with fs.open_input_file(f"{path}/{name}") as file:
                        one = _read_block(file, a)
                        two = one if a == b else _read_block(file, b)
                    yield from _block_pairs(one, two, a == b)

        yield from _sent(pairs())

    schema = "a long, b long, file string"
    told = cut_lineage(packed.repartitionById(buckets, "bucket").mapInArrow(match, schema))
    pairs, blocks = told.where("file is null").select("a", "b"), told.where("file is not null")
    some = blocks.count()
    if some:
        pairs = pairs.unionByName(blocks.repartition(min(some, partitions(spark))).mapInArrow(products, schema).select("a", "b"))
    return pairs.distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of docs(id, text) that are alike by their whole texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            spot: dict[str, int] = {}
            at = np.array([spot.setdefault(t, len(spot)) for t in batch.column(2).to_pylist() + batch.column(3).to_pylist()], np.int64)
            _, run, sizes = shingles.run_sets(list(spot))
            ok = shingles.alike_pairs(at[: len(a)], at[len(a) :], run, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["u", "v"])

    left, right = docs.select(F.col("id").alias("a"), F.col("text").alias("ta")), docs.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(check, "u long, v long")


def near_duplicate_groups(df: DataFrame, ident: str, text: str, most_groups: int = HOT) -> DataFrame:
    """(id, component) of every row of df whose text has enough words; the component is the smallest id of its class or of
    those linked to it.

    Null texts and those under 12 words are alike to none and stand in no row. A row that stands there twice under one id counts once
    (of different texts under one id each is looked at). Nothing alike, or no rows: no rows.
    """
    spark = df.sparkSession
    docs = spread(df.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null"))
    read = cut_lineage(signatures(docs))
    sketch = spark.sparkContext.broadcast(frequency_sketch(read.where("chunk is not null").select("chunk", "counts")))
    signed = read.where("id is not null").select("id", "class", "size")
    named = cut_lineage(signed.groupBy("class").agg(F.min("id").alias("rep"), F.first("size").alias("size")))
    totals = named.agg(F.sum("size").alias("runs"), F.count(F.lit(1)).alias("classes")).first()
    rest = signed.join(named.select(F.col("rep").alias("id")).distinct(), "id", "left_anti").select("id").distinct()
    rest = F.broadcast(rest) if signed.count() - totals["classes"] <= BROADCAST_IDS else rest
    buckets = 2 * PARTS * max(1, -(-int((totals["runs"] or 0) * KEYS_PER_RUN) // (2 * PARTS * BUCKET_KEYS)))
    pairs = cut_lineage(candidate_pairs(postings(docs.join(rest, "id", "left_anti"), sketch, buckets), buckets, most_groups))
    links = verified(pairs, docs.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"))
    parts = connected_components(links)
    rows = signed.join(named.select("class", "rep"), "class").select("id", "rep")
    return rows.join(parts, rows.rep == parts.node, "left").select("id", F.coalesce("component", "rep").alias("component"))


def near_duplicate_pairs(df: DataFrame, ident: str, text: str) -> DataFrame:
    """All pairs (a, b), a < b, of ids of df whose rows are in one group of near_duplicate_groups."""
    return pairs_within(near_duplicate_groups(df, ident, text), "component", "id", "a", "b")
