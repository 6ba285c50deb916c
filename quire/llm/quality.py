"""Quality rules: base counts, and perplexity under a modified Kneser-Ney model with bands for each language.

The model reads a text as its words, each followed by one space, in contexts of ORDER - 1 bytes that run across words.
A text's measure is its mean cost of a word. Nothing is left out or gathered in one place:

1. Tasks count the n-grams of what they read; Spark adds the counts up and works out the interpolated probability of
   every n-gram, order by order, with joins.
2. The probabilities are sorted arrays of 64-bit hashes with a log probability beside each. Up to MOST_BROADCAST n-grams
   they are one pair of arrays that every worker gets.
3. A larger model stays dealt by hash into shards. Texts are written in compressed blocks of some megabytes with the
   sorted hashes of their n-grams; the blocks ask the shards for their own and come back with an array as long as
   their hashes. So a worker holds one block or one shard, however large the corpus and its model are.
4. Texts are scored, and bands come from the scores.

Both ways give the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import Words, _mix, _SPACE, buffer_of, cut, shared_folder, slices, steady, windows_hash

ORDER = 5
START, SPACE = 1, 32
#: A language's band: its median cost of a word and so many robust deviations (for the text's length) each way. Chosen
#: from the documents of either label that it keeps and rejects on sf0.1 and check_s (README).
WIDTH = 4.0
#: A language's spread is its own, weighted by its texts, and that of all languages with this weight.
SHARED_TEXTS = 50
#: Distinct n-grams (of 12 bytes each in the arrays) up to which the model is broadcast.
MOST_BROADCAST = 1 << 22
#: Bytes of text in a block, n-gram positions worked on at a time, distinct n-grams that a task counts before it writes
#: them, and n-grams asked of a shard.
BLOCK_BYTES, STEP, HELD_GRAMS, SHARD_ROWS = 8 << 20, 1 << 18, 1 << 20, 1 << 19
BLOCKS_A_TASK = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 8 * ORDER) - 1)


def _grams(words: Words, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of words a to b - 1, and the space after each word: it and the ORDER - 1 bytes before, and the word's number.

    The newest byte is the lowest. A text starts with START, before which bytes count as 0.
    """
    lo = max(0, a - ORDER // 2)  # a word has two bytes at least, so these cover every context
    s, e = words.starts[lo:b], words.ends[lo:b]
    size = e - s + 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    owner = np.repeat(np.arange(len(s)), size)
    place = np.arange(total) - np.repeat(ends - size, size)
    data = words.data
    seq = np.where(place == (size - 1)[owner], SPACE, data[np.minimum(place + s[owner], max(0, len(data) - 1))]).astype(np.uint64) if total else np.zeros(0, np.uint64)
    first = np.isin(np.arange(lo, b), words.bounds[:-1])
    begin = np.zeros(total, np.int64)
    begin[(ends - size)[first]] = (ends - size)[first]
    depth = np.arange(total) - np.maximum.accumulate(begin) if total else begin
    if total and not first[0]:  # this text began earlier
        depth[: int(np.argmax(begin > 0)) if (begin > 0).any() else total] += ORDER
    value = seq.copy()
    for k in range(1, ORDER):
        back = np.zeros(total, np.uint64)
        back[k:] = seq[:-k]
        value |= np.where(depth >= k, back, np.where(depth == k - 1, START, 0).astype(np.uint64)) << np.uint64(8 * k)
    cut_at = int(ends[a - lo - 1]) if a > lo else 0
    return value[cut_at:], owner[cut_at:] + lo


def _steps(words: Words) -> Iterator[tuple[int, int]]:
    """Ranges of words of about STEP bytes (a longer word is a range of its own)."""
    sizes = np.r_[0, np.cumsum(words.ends - words.starts + 1)]
    at, n = 0, len(words.starts)
    while at < n:
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + STEP, "right")) - 1)
        yield at, end
        at = end


def _key(gram: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Hash of n-grams and their language hashes."""
    with np.errstate(over="ignore"):
        return _mix(gram * _GOLD + lang)


def lang_hash(name: str | None) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest((name or "").encode(), 7)


class Tongues:
    """Languages in the order in which they came, so that a number and an n-gram fit 64 bits."""

    def __init__(self) -> None:
        self.known: dict[str | None, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def numbers(self, column: pa.Array) -> np.ndarray:
        out = np.array([self.known.setdefault(x, len(self.known)) for x in column.to_pylist()], np.uint64)
        if len(self.hashes) < len(self.known):
            self.hashes = np.array([lang_hash(x) for x in self.known], np.uint64)
        return out

    def key(self, both: np.ndarray) -> np.ndarray:
        """Hashes of values of number << 8 * ORDER | n-gram."""
        return _key(both & _LOW, self.hashes[(both >> np.uint64(8 * ORDER)).astype(np.int64)])


def _numbered(words: Words, numbers: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Language number and n-gram of each position of words a to b - 1, and the text it is in."""
    value, owner = _grams(words, a, b)
    text = np.searchsorted(words.bounds, np.arange(a, b), "right") - 1
    text = text[owner - a]
    return numbers[text] << np.uint64(8 * ORDER) | value, text


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of n."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n[order], first)


def ngram_counts(rows: DataFrame, text: int, lang: int) -> DataFrame:
    """(lang, gram, n): language hash, n-gram and its count over all words of all texts; text and lang: places of these columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tongues, held, held_n, grams = Tongues(), [], [], 0

        def drain() -> Iterator[pa.RecordBatch]:
            both, n = _added(np.concatenate(held), np.concatenate(held_n))
            for at in range(0, len(both), 1 << 16):
                some = both[at : at + (1 << 16)]
                langs = tongues.hashes[(some >> np.uint64(8 * ORDER)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (langs, some & _LOW, n[at : at + (1 << 16)])], ["lang", "gram", "n"])

        for batch in steady(batches):
            for part in slices(batch, batch.schema.names[text]):
                words = Words(*buffer_of(part.column(text)))
                numbers = tongues.numbers(part.column(lang).cast(pa.string()))
                for a, b in _steps(words):
                    keys, n = np.unique(_numbered(words, numbers, a, b)[0], return_counts=True)
                    held.append(keys), held_n.append(n)
                    grams += len(keys)
                    if grams > HELD_GRAMS:
                        keys, n = _added(np.concatenate(held), np.concatenate(held_n))
                        held, held_n, grams = [keys], [n], len(keys)
                        if 2 * grams > HELD_GRAMS:
                            yield from drain()
                            held, held_n, grams = [], [], 0
                if len(tongues.known) > 1 << 16:  # numbers stay far from 24 bits
                    if held:
                        yield from drain()
                    tongues, held, held_n, grams = Tongues(), [], [], 0
        if held:
            yield from drain()

    return rows.mapInArrow(run, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


BLOCKS = "block long, packed binary, keys binary, n_keys long"
_BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _pack(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for part in parts:
            out.write_batch(part)
    return sink.getvalue().to_pybytes()


def write_blocks(rows: DataFrame, text: int, lang: int) -> DataFrame:
    """The rows in blocks (BLOCKS: rows, compressed, and the sorted hashes of their n-grams), written to the shared folder and read back."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base, number = (context.partitionId() if context else 0) << 32, 0
        tongues, parts, distinct, size = Tongues(), [], [], 0

        def block() -> pa.RecordBatch:
            keys = np.sort(tongues.key(np.unique(np.concatenate(distinct)) if distinct else np.zeros(0, np.uint64)))
            values = [[base + number], [_pack(parts)], [keys.tobytes()], [len(keys)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))], _BLOCK_NAMES)

        for batch in steady(batches):
            for part in slices(batch, batch.schema.names[text]):
                words = Words(*buffer_of(part.column(text)))
                numbers = tongues.numbers(part.column(lang).cast(pa.string()))
                for a, b in _steps(words):
                    distinct.append(np.unique(_numbered(words, numbers, a, b)[0]))
                    if len(distinct) > 16:
                        distinct = [np.unique(np.concatenate(distinct))]
                parts.append(part)
                size += len(words.data)
                if size >= BLOCK_BYTES:
                    yield block()
                    number, tongues, parts, distinct, size = number + 1, Tongues(), [], [], 0
        if parts:
            yield block()

    path = shared_folder(spark, "quality-blocks")
    rows.mapInArrow(run, BLOCKS).write.parquet(path)
    return spark.read.schema(BLOCKS).parquet(path)


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, gram, n) of distinct n-grams -> (lang, gram, p): the interpolated modified Kneser-Ney probability of the newest byte.

    Below the full order an n-gram counts the distinct ones that end in it. The discounts of an order are of all languages.
    A context has at most 256 n-grams, so no group is large.
    """
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        levels[order] = cut(levels[order + 1].groupBy("lang", _suffix(order).alias("gram")).agg(F.count("*").alias("n")))
    tallied = [levels[o].agg(F.lit(o).alias("order"), *(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))) for o in levels]
    tallies = {r["order"]: [max(1, r[f"n{k}"]) for k in (1, 2, 3, 4)] for r in reduce(DataFrame.unionAll, tallied).collect()}  # a row for each order
    below = None
    for order in range(1, ORDER + 1):
        n1, n2, n3, n4 = tallies[order]
        y = n1 / (n1 + 2 * n2)
        cuts = [min(max(k - (k + 1) * y * b / a, 0.0), 0.9 * k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off = F.when(F.col("n") == 1, cuts[0]).when(F.col("n") == 2, cuts[1]).otherwise(cuts[2])
        context = Window.partitionBy("lang", F.shiftright("gram", 8))
        rows = levels[order].withColumn("off", off).withColumn("total", F.sum("n").over(context)).withColumn("kept_off", F.sum("off").over(context))
        if below is None:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            rows = rows.join(below, (rows["lang"] == below["lang_"]) & (_suffix(order - 1) == below["gram_"]))
        gamma = F.greatest(F.col("kept_off"), 1e-9 * F.col("total")) / F.col("total")
        rows = rows.select("lang", "gram", (F.greatest(F.col("n") - F.col("off"), F.lit(0.0)) / F.col("total") + gamma * F.col("lower")).alias("p"))
        below = rows.select(F.col("lang").alias("lang_"), F.col("gram").alias("gram_"), F.col("p").alias("lower"))
    return rows


def hashed(model: DataFrame, bits: int = 0) -> DataFrame:
    """(lang, gram, p) -> (shard, key, log): the hash of each n-gram, its first bits, and its log probability (32 bits)."""
    shift = np.uint64(64 - max(1, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            lang, gram, p = (c.to_numpy() for c in batch.columns)
            key = _key(gram.view(np.uint64), lang.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array((key >> shift).astype(np.int64)), pa.array(key.view(np.int64)), pa.array(np.log(p).astype(np.float32))], ["shard", "key", "log"])

    return model.mapInArrow(run, "shard long, key long, log float")


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of rows (key, log) and the log probabilities beside them."""
    keys = rows.column("key").to_numpy().view(np.uint64) if rows.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("log").to_numpy().astype(np.float32)[order]


def block_logs(blocks: DataFrame, model: DataFrame) -> DataFrame:
    """(block, logs): log probabilities (32-bit floats) of each block's n-grams, in the order of its keys.

    Shards are ranges of hashes; their number follows the n-grams that all blocks ask for, so a shard stays small.
    """
    asked = blocks.agg(F.sum("n_keys")).first()[0] or 0
    bits = max(4, (asked // SHARD_ROWS).bit_length())
    shift = np.uint64(64 - bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            for k in range(batch.num_rows):
                keys = np.frombuffer(batch.column(1)[k].as_buffer(), np.uint64)
                shard = (keys >> shift).astype(np.int64)
                cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(keys) else np.zeros(1, np.int64)
                some = [keys[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]] if some else shard), pa.array([batch.column(0)[k].as_py()] * len(some), pa.int64()), pa.array(some, pa.binary())], ["shard", "block", "keys"])

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        keys, logs = _arrays(shard)
        out = [logs[np.searchsorted(keys, np.frombuffer(x.as_buffer(), np.uint64))].tobytes() for x in asked.column("keys")]
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "logs": pa.array(out, pa.binary())})

    wanted = blocks.select("block", "keys").mapInArrow(ask, "shard long, block long, keys binary")
    shards = hashed(model, bits)
    answers = wanted.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(answer, "block long, shard long, logs binary")
    joined = F.array_sort(F.collect_list(F.struct("shard", "logs")))
    return answers.groupBy("block").agg(joined.alias("logs"))


# Base rules


def _repeated(h: np.ndarray, width: int = 8) -> int:
    """Words of one text that lie in a window of `width` words found twice or more in it; h: the windows' hashes."""
    if len(h) < 2:
        return 0
    order = np.argsort(h)
    equal = h[order[1:]] == h[order[:-1]]
    if not equal.any():
        return 0
    edge = np.zeros(len(h) + width, np.int64)
    twice = np.zeros(len(h), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"
_NAMES = [c.split()[0] for c in STATS.split(", ")]


def columns(texts: pa.Array, langs: pa.Array, keys: np.ndarray, logs: np.ndarray) -> list[pa.Array]:
    """The columns STATS of texts; keys and logs: sorted n-gram hashes, all of the texts' among them, and their log probabilities."""
    data, offsets = buffer_of(texts)
    words = Words(data, offsets)
    a, b = words.bounds[:-1], words.bounds[1:]
    n_words, cost, tongues = b - a, np.zeros(len(a)), Tongues()
    numbers = tongues.numbers(langs)
    for i, j in _steps(words):
        both, text = _numbered(words, numbers, i, j)
        some, which = np.unique(both, return_inverse=True)
        cost -= np.bincount(text, logs[np.searchsorted(keys, tongues.key(some))].astype(np.float64)[which], len(a))

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(mask, dtype=np.int64 if len(mask) >> 31 else np.int32)]
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)

    windows, raw, cuts = windows_hash(words.hashes(), 8), data.tobytes(), offsets.tolist()
    counts = [
        n_words,
        within(((data & 0xC0) != 0x80) & ~_SPACE[data]),
        within(_SYMBOL[data]),
        np.array([_dup_lines(raw[i:j]) for i, j in zip(cuts, cuts[1:])], np.int64),
        np.array([_repeated(windows[i : max(i, j - 7)]) for i, j in zip(a.tolist(), b.tolist())], np.int64),
    ]
    return [*(pa.array(c, pa.int64()) for c in counts), pa.array(cost / np.maximum(n_words, 1), mask=n_words == 0)]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _dealt(blocks: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """blocks with more of each, in partitions of BLOCKS_A_TASK at most on average, so that a task's batches stay small."""
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // BLOCKS_A_TASK))
    return blocks.repartition(parts, "block").join(more.repartition(parts, "block"), "block", how)


SCORED = f"block long, pos long, doc_id long, lang string, {STATS}"
_SCORED = ["block", "pos", "doc_id", "lang", *_NAMES]


def score(rows: DataFrame, keys: np.ndarray, logs: np.ndarray, text: int, lang: int, doc_id: int | None = None) -> DataFrame:
    """SCORED of every row, under the whole model's sorted arrays; block and pos are null. log_ppl: mean of -log p over the words; null without words."""
    shared = rows.sparkSession.sparkContext.broadcast((keys, logs))  # at most MOST_BROADCAST n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            for part in slices(batch, batch.schema.names[text]):
                names, none = part.column(lang).cast(pa.string()), pa.nulls(part.num_rows, pa.int64())
                ids = part.column(doc_id) if doc_id is not None else none
                yield pa.RecordBatch.from_arrays([none, none, ids, names, *columns(part.column(text), names, *shared.value)], _SCORED)

    return rows.mapInArrow(run, SCORED)


def score_blocks(blocks: DataFrame, model: DataFrame, text: int, lang: int, doc_id: int | None = None) -> DataFrame:
    """SCORED of every row of the blocks; pos: its place in its block."""
    full = _dealt(blocks.select("block", "packed", "keys"), block_logs(blocks, model), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            for k in range(batch.num_rows):
                block, packed, keys, logs = (batch.column(c)[k] for c in range(4))
                keys = np.frombuffer(keys.as_buffer(), np.uint64)
                logs = np.frombuffer(b"".join(x["logs"] for x in logs.as_py() or []), np.float32)
                pos = 0
                for part in pa.ipc.open_stream(packed.as_buffer()):
                    names = part.column(lang).cast(pa.string())
                    ids = part.column(doc_id) if doc_id is not None else pa.nulls(part.num_rows, pa.int64())
                    at = pa.array(np.arange(pos, pos + part.num_rows, dtype=np.int64))
                    pos += part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * part.num_rows, pa.int64()), at, ids, names, *columns(part.column(text), names, keys, logs)], _SCORED)

    return full.mapInArrow(run, SCORED)


# Bands

#: Words beyond which a text's perplexity is not expected to lie closer to its language's.
FULL_LENGTH = 400
#: The least half width of a band at full length, in nats a word.
LEAST_WIDTH = 0.25
#: Languages up to which the bands are broadcast; beyond this they are joined by a shuffle.
BROADCAST_LANGUAGES = 1 << 16


def _with(rows: DataFrame, table: DataFrame, languages: int) -> DataFrame:
    """rows with the columns of a table of one row for each tongue."""
    return rows.join(F.broadcast(table) if languages <= BROADCAST_LANGUAGES else table, "tongue", "left")


def _tongue(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tongue", F.coalesce("lang", F.lit("")))


def bands(scored: DataFrame) -> DataFrame:
    """(tongue, middle, spread) of each language: the median cost of a word of the texts that pass the base rules, and a
    robust deviation (half the distance of the 16th and 84th percentiles) of (cost - median) * sqrt(words), the words
    counted up to FULL_LENGTH. Spreads of languages with few texts lean on that of all texts (SHARED_TEXTS), without
    a step; medians do not. The result is written; its columns are of one row for each language.
    """
    texts = _tongue(scored).where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("tongue", "n_words", "log_ppl")
    middle = cut(texts.groupBy("tongue").agg(F.percentile_approx("log_ppl", 0.5, 100_000).alias("middle"), F.count("*").alias("texts")))
    away = (F.col("log_ppl") - F.col("middle")) * _root()
    q = F.percentile_approx(away, [0.16, 0.84], 100_000)
    apart = _with(texts, middle, middle.count())
    spreads = apart.groupBy("tongue").agg(F.first("middle").alias("middle"), F.count("*").alias("texts"), q.alias("q"))
    every = apart.agg(q.alias("q")).first()  # one row
    shared = (every.q[1] - every.q[0]) / 2 if every.q else 0.0
    own = (F.col("q")[1] - F.col("q")[0]) / 2
    spread = F.sqrt((F.col("texts") * own * own + SHARED_TEXTS * shared * shared) / (F.col("texts") + SHARED_TEXTS))
    return cut(spreads.select("tongue", "middle", spread.alias("spread")))


def _root() -> Column:
    return F.sqrt(F.greatest(F.lit(1), F.least(F.col("n_words"), F.lit(FULL_LENGTH))).cast("double"))


def judge(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """scored with base_failed, lower, upper (the band of its language and length) and kept."""
    out = _with(_tongue(scored), limits, limits.count())
    half = F.greatest(WIDTH * F.coalesce("spread", F.lit(0.0)), F.lit(LEAST_WIDTH) * FULL_LENGTH**0.5) / _root()
    middle = F.coalesce("middle", "log_ppl")
    out = out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).withColumn("lower", middle - half).withColumn("upper", middle + half)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))).drop("tongue", "middle", "spread")


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, lang, STATS, base_failed, lower, upper, kept.

    Null and empty texts have no words, fail the base rules and are not kept. A null language counts as one of its own
    with the empty one. A language of a single text has that text as its median and keeps it. Ties and repeated rows
    are judged alike. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    model, size = _train(rows, 1, 2)
    if size <= MOST_BROADCAST:
        scored = score(rows, *_arrays(hashed(model).toArrow()), 1, 2, 0)
    else:
        scored = score_blocks(write_blocks(rows, 1, 2), model, 1, 2, 0)
    scored = cut(scored)
    return judge(scored, bands(scored)).drop("block", "pos")


def _train(rows: DataFrame, text: int, lang: int) -> tuple[DataFrame, int]:
    """The model (lang, gram, p) of rows, and its number of n-grams."""
    counts = cut(ngram_counts(rows, text, lang))
    return kneser_ney(counts), counts.count()


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with all columns of docs (of any names) as they were.

    Under a broadcast model the rows are scored again and dropped as they are read, so no text is shuffled or stored.
    Under a larger one the blocks hold whole rows, and what is kept is read out of them by its place. Neither needs ids.
    """
    text, lang = docs.columns.index("text"), docs.columns.index("lang")
    flat = docs.toDF(*(f"x{k}" for k in range(len(docs.columns))))
    model, size = _train(flat, text, lang)
    if size <= MOST_BROADCAST:
        keys, logs = _arrays(hashed(model).toArrow())
        limits = bands(cut(score(flat, keys, logs, text, lang)))
        if limits.count() <= BROADCAST_LANGUAGES:
            return _kept_again(flat, keys, logs, text, lang, {r.tongue: (r.middle, r.spread) for r in limits.collect()}).toDF(*docs.columns)
    return _kept_blocks(flat, model, text, lang).toDF(*docs.columns)


def _kept_again(flat: DataFrame, keys: np.ndarray, logs: np.ndarray, text: int, lang: int, limits: dict[str, tuple]) -> DataFrame:
    shared = flat.sparkSession.sparkContext.broadcast((keys, logs, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, limits = shared.value
        for batch in steady(batches):
            for part in slices(batch, batch.schema.names[text]):
                names = part.column(lang).cast(pa.string())
                n, _, _, _, repeats, cost = (c.to_numpy(zero_copy_only=False) for c in columns(part.column(text), names, keys, logs))
                band = [limits.get(x or "", (None, 0.0)) for x in names.to_pylist()]
                middle = np.array([np.nan if m is None else m for m, _ in band])
                middle = np.where(np.isnan(middle), cost, middle)
                half = np.maximum(WIDTH * np.array([w for _, w in band], float), LEAST_WIDTH * FULL_LENGTH**0.5) / np.sqrt(np.clip(n, 1, FULL_LENGTH).astype(float))
                yield part.filter(pa.array((n >= 20) & (100 * repeats <= 30 * n) & (middle - half <= cost) & (cost <= middle + half)))

    return flat.mapInArrow(run, flat.schema)


def _kept_blocks(flat: DataFrame, model: DataFrame, text: int, lang: int) -> DataFrame:
    blocks = write_blocks(flat, text, lang)
    scored = cut(score_blocks(blocks, model, text, lang))
    kept = judge(scored, bands(scored)).where("kept").groupBy("block").agg(F.collect_list("pos").alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            for k in range(batch.num_rows):
                places, at = np.sort(np.array(batch.column(1)[k].as_py(), np.int64)), 0
                for part in pa.ipc.open_stream(batch.column(0)[k].as_buffer()):
                    mine = places[np.searchsorted(places, at) : np.searchsorted(places, at + part.num_rows)] - at
                    at += part.num_rows
                    if len(mine):
                        yield part.take(pa.array(mine))

    full = _dealt(blocks.select("block", "packed"), kept, "inner").select("packed", "kept")
    return full.mapInArrow(run, flat.schema)
