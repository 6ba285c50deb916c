"""Substring dedup: windows of words that occurred earlier, found by backward search in FM-indexes of shards.

A corpus-wide index would make every document visit every shard. Here the shards are chosen by content instead: the
least hash among the short grams of a window is its anchor, so equal windows have equal anchors and meet in one shard.
Anchors that occur once are dropped at once; the stretches of text around the others, each distinct one once,
are indexed and streamed through the index of their shard. An anchor with very many different stretches around it (a
passage that many documents share) would fill its shard, so its stretches are first cut down to their windows that
occur twice, by counts of window hashes, and so become few again.
The index is compressed: a wavelet matrix over the Burrows-Wheeler transform of the shard's stretches and every
SAMPLE-th place of its suffix array, no text. Backward search gives the matching statistics of the stretches, as far as
WIDTH words: all ends of matches go backwards together, and one stops when its interval holds nothing but itself. The
intervals of matches that reach WIDTH are reported and their places worked out; the earliest place decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.folders import new_folder, remove_folder
from quire.llm.shared import Words, _mix, buffer_of, cut, powers, release, slices, steady, windows_hash

WIDTH = 20
#: Words of a gram; a window of WIDTH words has WIDTH - GRAM + 1 of them.
GRAM = 6
#: Stretches with words that one shard is dealt on average.
STRETCHES_PER_SHARD = 60_000
#: Distinct stretches around an anchor (as counted task by task) beyond which they are cut down before they are dealt.
HOT = 20_000
#: Every so many places of the suffix array are kept.
SAMPLE = 8
#: Hot anchors up to which they are broadcast.
BROADCAST_ANCHORS = 1 << 16
#: Stretches that a task remembers.
GIVEN = 1_000_000
_STEP = 0x5851F42D4C957F2D
_BACK = pow(_STEP, -1, 1 << 64)


# Anchors


def anchors_of(hashes: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their anchor: document, first window (word position in the buffer), windows, anchor hash.

    hashes: word hashes of consecutive documents; bounds: first word of each, and the end.
    """
    none = np.zeros(0, np.int64)
    grams = windows_hash(hashes, GRAM)
    span = width - GRAM + 1
    n = len(hashes) - width + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    low, place, have = grams, np.arange(len(grams)), 1
    while have < span:
        ahead = min(have, span - have)
        take = low[ahead:] < low[:-ahead]
        place = np.where(take, place[ahead:], place[:-ahead])
        low = np.where(take, low[ahead:], low[:-ahead])
        have += ahead
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(doc[:n] == doc[width - 1 :])
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    spot = place[starts]
    first = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])])
    count = np.diff(np.r_[first, len(starts)])
    return doc[starts[first]], starts[first], count, grams[spot[first]]


def stretch_hashes(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of hashes[start : start + size] for each row."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(_STEP, len(hashes)), out=sums[1:])
        raw = (sums[starts + sizes] - sums[starts]) * powers(_BACK, len(hashes) + 1)[starts]
        return _mix(raw + sizes.astype(np.uint64))


# The index of a shard


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, from the highest, a packed bit row and the ones before each word."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.rows, self.before, self.zeros = [], [], []
        at = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bits = (at >> level & 1).astype(bool)
            wide = np.zeros((len(bits) // 64 + 1) * 64, bool)
            wide[: len(bits)] = bits
            row = np.packbits(wide, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(row).astype(np.int64)
            self.rows.append(row)
            self.before.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(len(bits) - int(ones.sum()))
            at = np.concatenate([at[~bits], at[bits]])
        self.starts = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.rows[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.starts[symbol]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            row = self.rows[k][word]
            one = (row >> bit & np.uint64(1)).astype(np.int64)
            ones = self.before[k][word] + np.bitwise_count(row & ((np.uint64(1) << bit) - np.uint64(1)))
            at = np.where(one > 0, self.zeros[k] + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol, at - self.starts[symbol]


def suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array by doubling: places in the order of the text from there on, going on at its beginning after its end."""
    rank, have = text.astype(np.int64), 1
    while True:
        key = rank * (len(rank) + text.max(initial=0) + 2) + np.roll(rank, -have)
        order = np.argsort(key, kind="stable")
        new = key[order]
        new = np.cumsum(np.r_[0, new[1:] != new[:-1]]) if len(order) else new
        rank = np.empty(len(order), np.int64)
        rank[order] = new
        have *= 2
        if not len(new) or new[-1] == len(new) - 1 or have >= 2 * len(text):
            return order


class Index:
    """Compressed FM-index of stretches of symbols (1 and up), each followed by the separator 0."""

    def __init__(self, text: np.ndarray, size: int):
        order = suffixes(text)
        self.counts = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]
        self.wavelet = Wavelet(text[order - 1], size)
        kept = order % SAMPLE == 0
        self.rows = np.flatnonzero(kept).astype(np.int32)
        self.places = order[kept].astype(np.int32)

    def statistics(self, text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the ends start + width - 1, as far as `width`: how many symbols before each end occur at two or more
        places of the index, and the interval of those that reach `width`."""
        length = np.zeros(len(starts), np.int64)
        alive = np.arange(len(starts))
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.counts[-1])
        for back in range(width - 1, -1, -1):
            symbol = text[starts[alive] + back]
            low, high = (self.counts[symbol] + self.wavelet.rank(symbol, x) for x in (low, high)) if back < width - 1 else (self.counts[symbol], self.counts[symbol + 1])
            keep = high - low > 1
            alive, low, high = alive[keep], low[keep], high[keep]
            length[alive] += 1
            if not len(alive):
                break
        spans = np.zeros((2, len(starts)), np.int64)
        spans[:, alive] = low, high
        return length, spans[0], spans[1]

    def search(self, text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the windows text[start : start + width] occur at two or more places, and their intervals."""
        length, low, high = self.statistics(text, starts, width)
        found = np.flatnonzero(length == width)
        return found, low[found], high[found]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the text of rows of the index: back through the text to the next sampled place."""
        out, todo, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(todo):
            near = np.minimum(np.searchsorted(self.rows, at), len(self.rows) - 1)
            hit = self.rows[near] == at
            out[todo[hit]] = self.places[near[hit]] + steps
            todo, at, steps = todo[~hit], at[~hit], steps + 1
            if len(todo):
                symbol, before = self.wavelet.read(at)
                at = self.counts[symbol] + before
        return out


def earlier(stretches: list[np.ndarray], windows: np.ndarray, ids: np.ndarray, ties: np.ndarray, places: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each distinct stretch a bit mask of its windows whose words also start earlier.

    stretches: word symbols; windows: how many windows each has; ids, ties, places: where its first copy starts.
    """
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    flat = np.concatenate(stretches) if stretches else np.zeros(0, np.uint32)
    names, coded = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = coded + 1
    owner = np.repeat(np.arange(len(windows)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    index = Index(text, len(names) + 1)
    found, low, high = index.search(text, begins[owner] + offset, width)
    masks = np.zeros(len(stretches), np.int64)
    if not len(found):
        return masks
    # equal windows have equal intervals, so each interval is read once
    spans, which = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
    which = which.reshape(-1)
    size = spans[:, 1] - spans[:, 0]
    first = np.cumsum(size) - size
    at = index.locate(np.arange(int(size.sum())) + np.repeat(spans[:, 0] - first, size))
    stretch = np.searchsorted(ends, at, "right")
    start = places[stretch] + at - begins[stretch]
    order = np.lexsort((start, ties[stretch], ids[stretch]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    least = at[order[np.minimum.reduceat(rank, first)]]
    own = begins[owner[found]] + offset[found]
    best = least[which]
    b, o = np.searchsorted(ends, best, "right"), owner[found]
    best_start, own_start = places[b] + best - begins[b], places[o] + own - begins[o]
    before = (ids[b] < ids[o]) | (ids[b] == ids[o]) & ((ties[b] < ties[o]) | (ties[b] == ties[o]) & (best_start < own_start))
    np.bitwise_or.at(masks, o[before], np.int64(1) << offset[found][before])
    return masks


# Spark


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    """(id, tie, text): id orders nulls first; tie tells apart rows of one id with different texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"), *more)


def _anchors(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            for part in slices(batch):
                words = Words(*buffer_of(part.column(2)))
                doc, start, n, anchor = anchors_of(words.hashes(), words.bounds, width)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array((start - words.bounds[doc]).astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(anchor.view(np.int64))],
                    ["id", "tie", "start", "n", "anchor"],
                )

    return texts.mapInArrow(run, "id long, tie long, start int, n short, anchor long")


def _stretches(texts: DataFrame, repeated: DataFrame, width: int) -> DataFrame:
    """(anchor, stretch, id, tie, start, n, words): the stretches around repeated anchors; words as unsigned 32-bit hashes.

    A task gives the words with the first copy of a stretch that it meets (and again after it has met very many).
    """
    lists = repeated.groupBy("id", "tie").agg(F.array_sort(F.collect_set(F.struct("start", "n", "anchor"))).alias("runs"))
    # in order, so that the first copy that a task meets is its least
    joined = texts.join(lists, ["id", "tie"]).sortWithinPartitions("id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in steady(batches):
            for part in slices(batch):
                words = Words(*buffer_of(part.column(2)))
                hashes = words.hashes()
                runs = part.column(3)
                flat = runs.flatten()
                doc = np.repeat(np.arange(part.num_rows), runs.value_lengths().to_numpy())
                start, n, anchor = (flat.field(k).to_numpy() for k in range(3))
                at, size = words.bounds[doc] + start, n.astype(np.int64) + width - 1
                short = (hashes >> np.uint64(32)).astype("<u4").tobytes()
                stretch = stretch_hashes(hashes, at, size).view(np.int64)
                given = set() if len(given) > GIVEN else given
                body = []
                for key, a, s in zip(stretch.tolist(), at.tolist(), size.tolist()):
                    body.append(None if key in given else short[4 * a : 4 * (a + s)])
                    given.add(key)
                take = pa.array(doc)
                columns = [pa.array(anchor), pa.array(stretch), part.column(0).take(take), part.column(1).take(take), pa.array(start), pa.array(n), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "stretch", "id", "tie", "start", "n", "words"])

    return joined.select("id", "tie", "text", "runs").mapInArrow(run, "anchor long, stretch long, id long, tie long, start int, n short, words binary")


def _search(copies: DataFrame, width: int) -> DataFrame:
    """(shard, anchor, stretch, id, tie, start, n, words), sorted by shard -> (anchor, stretch, mask): each distinct stretch once.

    A stretch comes once from each task that met it at most, so a shard stays small however often a text is copied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            anchor, stretch, ids, ties, starts, n = (rows.column(k).to_numpy() for k in range(1, 7))
            order = np.lexsort((starts, ties, ids, stretch, anchor))
            first = order[np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])]]
            words = [np.frombuffer(w, "<u4") for w in rows.column(7).take(pa.array(first)).to_pylist()]
            masks = earlier(words, n[first].astype(np.int64), ids[first], ties[first], starts[first].astype(np.int64), width)
            return pa.RecordBatch.from_arrays([pa.array(anchor[first]), pa.array(stretch[first]), pa.array(masks)], ["anchor", "stretch", "mask"])

        shard = None
        for batch in steady(batches):
            of = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and shard != of[a]:
                    yield solve()
                    held = []
                shard = of[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield solve()

    return copies.mapInArrow(run, "anchor long, stretch long, mask long")


def _cut_down(found: DataFrame, hot: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The rows of found around hot anchors as runs of windows that occur twice; and each distinct run with its words, once, at
    the least place of a stretch that it is in.

    A window that occurs once, in a stretch that occurs once, can be no copy. Runs of equal words become one stretch.
    """
    stretches = found.join(hot, "anchor", "left_semi").groupBy("anchor", "stretch")
    stretches = stretches.agg(F.count("*").alias("copies"), F.max("words").alias("words"), F.min(F.struct("id", "tie", "start")).alias("place"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            words = [np.frombuffer(w.as_buffer(), "<u4") for w in batch.column(2)]
            hashes = [windows_hash(w.astype(np.uint64), width).view(np.int64) for w in words]
            take = pa.array(np.repeat(np.arange(len(words)), [len(h) for h in hashes]))
            k = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes]) if hashes else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(k), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))], ["anchor", "stretch", "k", "window"])

    each = stretches.select("anchor", "stretch", "words").mapInArrow(windows, "anchor long, stretch long, k int, window long")
    twice = each.groupBy("window").agg(F.count("*").alias("times")).where("times > 1").select("window")
    masks = each.join(twice, "window", "left_semi").groupBy("anchor", "stretch").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    kept = stretches.join(masks, ["anchor", "stretch"], "left").where("mask is not null or copies > 1")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            rows, runs, own, body = [], [], [], []
            for row, (copies, raw, mask) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 5)))):
                words = np.frombuffer(raw, "<u4")
                n = len(words) - width + 1
                mask = (1 << n) - 1 if copies > 1 else mask
                k = 0
                while mask >> k:
                    k += ((mask >> k) & -(mask >> k)).bit_length() - 1
                    size = ((~(mask >> k)) & ((mask >> k) + 1)).bit_length() - 1
                    part = words[k : k + size + width - 1]
                    rows.append(row), runs.append((k, size)), body.append(part.tobytes())
                    own.append(int(stretch_hashes(part.astype(np.uint64), np.zeros(1, np.int64), np.array([len(part)]))[0].view(np.int64)))
                    k += size
            take = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array([k for k, _ in runs], pa.int32()), pa.array([n for _, n in runs], pa.int16()), pa.array(own, pa.int64()), pa.array(body, pa.binary()), batch.column(5).take(take)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "stretch", "k", "n", "own", "words", "place"])

    schema = "anchor long, stretch long, k int, n short, own long, words binary, place struct<id: long, tie: long, start: int>"
    cuts = cut(kept.select("anchor", "stretch", "copies", "words", "mask", "place").mapInArrow(runs, schema))
    start = lambda base: (base + F.col("k")).alias("start")
    rows = found.select("anchor", "stretch", "id", "tie", "start").join(cuts.drop("words", "place"), ["anchor", "stretch"])
    rows = rows.select("anchor", F.col("own").alias("stretch"), "id", "tie", start(F.col("start")), "n")
    first = cuts.select("anchor", F.col("own").alias("stretch"), "place.id", "place.tie", start(F.col("place.start")), "n", "words")
    least = F.min_by(F.struct("n", "words"), F.struct("id", "tie", "start"))
    first = first.groupBy("anchor", "stretch").agg(F.min(F.struct("id", "tie", "start")).alias("p"), least.alias("w"))
    return rows, first.select("anchor", "stretch", "p.id", "p.tie", "p.start", "w.n", "w.words")


def _written(df: DataFrame, path: str) -> DataFrame:
    """df through a table in the shared folder; what made it can go."""
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.parquet(path)


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs (doc_id, text) -> (id, tie, spans): for each text with repeated windows the runs (start, mask) of windows to remove.

    The stretches and the spans are written to the shared folder, and the shuffle files behind them released, so that
    the texts' shuffles do not lie on disk together.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "stretches")
    texts = _texts(docs)
    anchors = _anchors(texts, width)
    often = anchors.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor")
    found = _written(_stretches(texts, anchors.join(often, "anchor", "left_semi"), width), folder)
    copies = found.where("words is not null")
    hot = cut(copies.groupBy("anchor").agg(F.count("*").alias("n")).where(f"n > {HOT}").select("anchor"))
    many = hot.count()
    if many:
        hot = F.broadcast(hot) if many <= BROADCAST_ANCHORS else hot
        rows, first = _cut_down(found, hot, width)
        cold = found.join(hot, "anchor", "left_anti")
        copies = cold.where("words is not null").unionByName(first)
        found = cold.drop("words").unionByName(rows)
    shards = max(1, -(-copies.count() // STRETCHES_PER_SHARD))
    copies = copies.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"), "*")
    masks = _search(copies.repartition("shard").sortWithinPartitions("shard"), width)
    place = F.struct("id", "tie", "start")
    first = found.groupBy("anchor", "stretch").agg(F.min(place).alias("first")).join(masks, ["anchor", "stretch"])
    full = F.expr("shiftleft(1L, cast(n as int)) - 1")
    spans = found.select("anchor", "stretch", "id", "tie", "start", "n").join(first, ["anchor", "stretch"])
    spans = spans.withColumn("mask", F.when(place == F.col("first"), F.col("mask")).otherwise(full)).where("mask <> 0")
    spans = _written(spans.groupBy("id", "tie").agg(F.collect_set(F.struct("start", "mask")).alias("spans")), new_folder(spark, "spans"))
    remove_folder(spark, folder)
    return spans


def _kept(text: bytes, spans: list[dict] | None, width: int) -> tuple[int, int, bytes]:
    """Words, removed words and the kept words joined by one space."""
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        start, mask = s["start"], s["mask"]
        while mask:
            bit = mask & -mask
            k = start + bit.bit_length() - 1
            edge[k] += 1
            edge[k + width] -= 1
            mask ^= bit
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def remove_repeats(docs: DataFrame, width: int = WIDTH, untouched: bool = False) -> DataFrame:
    """All columns of docs (doc_id, text and any others), text replaced by the kept words, and _n_words, _n_removed.

    The kept words are joined by one space; with `untouched`, texts that lose nothing stay as they are.
    A word goes if a window of `width` words over it also starts earlier: at a smaller doc_id, or earlier in the text.
    Null and short texts lose nothing (null becomes ''). A null doc_id comes first. Rows of one doc_id and text are one
    document; of one doc_id and other texts they are ordered by a hash of the text. An empty table gives no rows.
    """
    names = docs.columns
    plain = [f"x{k}" for k in range(len(names))]
    flat = docs.toDF(*plain)
    row = F.struct(*(F.col(c) for c in plain)).alias("row")
    spans = repeats(flat.select(F.col(f"x{names.index('doc_id')}").alias("doc_id"), F.col(f"x{names.index('text')}").alias("text")), width)
    at = names.index("text")
    keyed = flat.select(row, F.col(f"x{names.index('doc_id')}").alias("doc_id"), F.col(f"x{at}").alias("text"))
    keyed = _texts(keyed, "row").drop("text").join(spans, ["id", "tie"], "left")
    rows = keyed.select(*(F.col("row")[c].alias(c) for c in plain), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            for part in slices(batch, f"x{at}"):
                data, offsets = buffer_of(part.column(at))
                raw, cuts = data.tobytes(), offsets.tolist()
                done = [_kept(raw[a:b], s, width) for a, b, s in zip(cuts, cuts[1:], part.column(len(names)).to_pylist())]
                columns = part.columns[: len(names)]
                texts = [raw[a:b] if untouched and not g else t for (_, g, t), a, b in zip(done, cuts, cuts[1:])]
                columns[at] = pa.array([t.decode() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _, _ in done], pa.int64()), pa.array([g for _, g, _ in done], pa.int64())], [*plain, "_n_words", "_n_removed"])

    schema = flat.schema.add("_n_words", "long").add("_n_removed", "long")
    return rows.mapInArrow(run, schema).toDF(*names, "_n_words", "_n_removed")


