"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison inside pigeonhole tables.

Equal fingerprints are one node. A fingerprint is cut into BLOCKS blocks; two that differ in at most
RADIUS bits agree on BLOCKS - RADIUS whole blocks, so each choice of so many blocks is a table whose key is
those bits. Inside a key, rows lie side by side in vertical bit planes (64 planes, one lane a row); one XOR
of a plane with itself shifted by d lanes compares every row with the d-th row after it, and carry-save
counters add the planes up for 64 pairs a machine word. Words whose pairs all exceed the radius, lie in
different keys or are linked already are dropped as the planes go by. Only a spanning forest leaves a key,
never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.shared import buffer_of, cut, slices, steady

RADIUS = 4
#: Least and most blocks; a fingerprint has so many tables as there are choices of BLOCKS - RADIUS of them (15 to 70).
BLOCKS, MOST_BLOCKS = 6, 8
#: Fingerprints that a key holds on average before more blocks, so longer keys, are taken.
KEY_ROWS = 4
#: Rows of one key that a task compares with each other; a larger key is dealt out as pairs of such chunks.
CHUNK = 1 << 15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint_of(text: bytes, width: int, seed: int = 42) -> int:
    """The 64-bit fingerprint of a UTF-8 text: bit k is 1 if it is set in over half of the shingles' XXH64."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = h[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, tagged: bool = False) -> DataFrame:
    """(doc_id, fp long): the signed form of each text's fingerprint. Null and wordless texts have 0. tagged: and tag, the text's XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            for part in slices(batch):
                data, offsets = buffer_of(part.column(1))
                raw = data.tobytes()
                fps = np.array([fingerprint_of(raw[a:b], width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), *part.columns[2:]], ["doc_id", "fp", "tag"][: part.num_columns])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.xxhash64(text_col).alias("tag")] if tagged else []))
    return rows.mapInArrow(run, "doc_id long, fp long" + (", tag long" if tagged else ""))


def _masks(blocks: int, radius: int) -> list[int]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(x) - ((sum(x) >> 63) << 64) for x in combinations(parts, blocks - radius)]


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of machine words: bit r of row k is bit k of fingerprint r; two empty words follow."""
    n = len(fps)
    wide = np.zeros((-(-n // 64) + 2) * 64, np.uint64)
    wide[:n] = fps
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _near(planes: np.ndarray, words: np.ndarray, lanes: np.ndarray, d: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lanes (bits of `words`), those whose row and the row d (one value a word) after it differ in at most `radius` bits."""
    ahead, up = words + d // 64, (d % 64).astype(np.uint64)
    down, spill = (np.uint64(64) - up) & np.uint64(63), np.where(up > 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    levels = (radius + 1).bit_length()
    count = np.zeros((levels, len(words)), np.uint64)
    over = np.zeros(len(words), np.uint64)
    for k in range(64):
        row = planes[k]
        carry = row[words] ^ (row[ahead] >> up | row[ahead + 1] << down & spill)
        for level in range(levels):
            count[level], carry = count[level] ^ carry, count[level] & carry
        over |= carry
        if k % 8 == 7:
            lanes = lanes & ~(over | _above(count, radius))
            keep = lanes != 0
            if not keep.any():
                return words[:0], lanes[:0], d[:0]
            if not keep.all():
                words, lanes, d, ahead, up, down, spill, over = (x[keep] for x in (words, lanes, d, ahead, up, down, spill, over))
                count = count[:, keep]
    return words, lanes, d


def _above(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter (bit k in row k) exceeds radius."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for level in range(len(count) - 1, -1, -1):
        if radius >> level & 1:
            equal = equal & count[level]
        else:
            above |= equal & count[level]
            equal = equal & ~count[level]
    return above


def forest(fps: np.ndarray, keys: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row of its root) that span the rows of each key that are near each other. keys are sorted."""
    n = len(fps)
    parent = np.arange(n)
    if n < 2:
        return parent[:0], parent[:0]
    planes = _planes(fps)
    width = planes.shape[1] * 64
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.repeat(np.r_[begins[1:], n], np.diff(np.r_[begins, n]))
    rows, last = np.arange(n), int(np.diff(np.r_[begins, n]).max()) - 1
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(1, last + 1):
        rows = rows[rows + d < ends[rows]]
        open_rows = rows[parent[rows] != parent[rows + d]]
        if len(open_rows):
            flags = np.zeros(width, bool)
            flags[open_rows] = True
            lanes = np.packbits(flags, bitorder="little").view(np.uint64)
            words = np.flatnonzero(lanes)
            waiting.append((words, lanes[words], np.full(len(words), d)))
        # the first shifts link most of a cluster, so later ones wait for more work in one step
        if not waiting or d < last and sum(len(w) for w, _, _ in waiting) < min(1 << 13, d * 8):
            continue
        words, lanes, shifts = _near(planes, *(np.concatenate(x) for x in zip(*waiting)), radius)
        waiting = []
        if not len(words):
            continue
        at, bit = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        left = words[at] * 64 + bit
        for a, b in zip(left.tolist(), (left + shifts[at]).tolist()):
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(n))
    return moved, parent[moved]


def _linker(radius: int, columns: int):
    """Arrow function over rows (keys..., fp) sorted by key: each key's spanning links."""

    def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = forest(fps, keys, radius)
        return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in steady(batches):
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(columns + 1)]))
            rows += batch.num_rows
            if rows < 1 << 17:
                continue
            table = np.concatenate(held, axis=1)
            change = np.any(table[:columns, 1:] != table[:columns, :-1], axis=0)
            end = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
            if end:
                yield solve(np.cumsum(np.r_[0, change])[:end], table[columns, :end].view(np.uint64))
            held, rows = [table[:, end:]], table.shape[1] - end
        if rows:
            table = np.concatenate(held, axis=1)
            change = np.any(table[:columns, 1:] != table[:columns, :-1], axis=0)
            yield solve(np.cumsum(np.r_[0, change]), np.ascontiguousarray(table[columns]).view(np.uint64))

    return run


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks for n distinct fingerprints: the fewest whose keys, of 64 * (blocks - radius) / blocks bits, hold KEY_ROWS on average."""
    more = MOST_BLOCKS - BLOCKS
    return next((b for b in range(radius + 2, radius + 2 + more) if n <= KEY_ROWS << 64 * (b - radius) // b), radius + 2 + more)


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(fp) of distinct fingerprints -> (a, b): links that connect all fingerprints within `radius` bits.

    blocks: by the number of fingerprints unless given; any number above the radius finds the same pairs. The links span the graph of near pairs: two fingerprints are joined by a path if and only if a chain of
    near pairs joins them.
    """
    blocks = blocks or blocks_for(nodes.count(), radius)
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(_masks(blocks, radius)))))
    rows = nodes.select("fp", tables.alias("x")).select("x.t", "x.k", "fp")
    key = Window.partitionBy("t", "k")
    rows = rows.withColumn("r", F.row_number().over(key.orderBy("fp"))).withColumn("n", F.count("*").over(key))
    small = rows.where(f"n between 2 and {chunk}").select("t", "k", "fp").mapInArrow(_linker(radius, 2), "a long, b long")
    c, parts = F.expr(f"cast((r - 1) div {chunk} as int)"), F.expr(f"cast((n - 1) div {chunk} as int)")
    large = rows.where(f"n > {chunk}").select("t", "k", "fp", c.alias("c"), F.explode(F.sequence(F.lit(0), parts)).alias("o"))
    large = large.select("t", "k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    large = large.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fp").mapInArrow(_linker(radius, 4), "a long, b long")
    return small.unionAll(large)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): one row per document, component_id the smallest doc_id reachable by links.

    Empty, null and wordless texts have fingerprint 0 and are linked like any other. Repeated rows give repeated
    rows. An empty table gives no rows. A null id stays null; it is the smallest only where it stands alone.
    Other columns are not read, so their names may be anything.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    return _grouped(prints, radius).select("doc_id", "fp", "component_id")


def _grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (doc_id, fp and others) with root, the component of the fingerprint, and component_id, its smallest doc_id."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id, all columns as they were.

    A null doc_id counts as the greatest. Of rows of one doc_id in one group, the text with the least XXH64 stays, once; rows
    of one doc_id with far texts are in groups of their own. The chosen keys (doc_id and text hash) meet the rows in
    one shuffle, in which repeated rows are cut to one as well.
    """
    names = docs.columns
    flat = docs.toDF(*(f"x{k}" for k in range(len(names))))
    key, text = F.col(f"x{names.index('doc_id')}").cast("long"), F.col(f"x{names.index('text')}")
    prints = cut(fingerprints(docs.select("doc_id", "text"), tagged=True))
    known = lambda c: [F.coalesce(c, F.lit(0)).alias("_id"), c.isNull().alias("_none")]
    chosen = _grouped(prints).where("doc_id <=> component_id").groupBy("root").agg(F.first("doc_id").alias("doc_id"), F.min("tag").alias("_tag"))
    chosen = chosen.select(*known(F.col("doc_id")), "_tag")
    keys = ["_id", "_none", "_tag"]
    rows = flat.select("*", *known(key), F.xxhash64(text).alias("_tag")).join(chosen, keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(text))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop(*keys, "_rank").toDF(*names)


def fingerprint_hex(column: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
