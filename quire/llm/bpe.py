"""BPE encoding and decoding with public vocabularies, over contiguous rank arrays.

Texts are cut at white space into chunks whose tokens do not depend on what stands around them; each distinct
chunk is encoded once a worker. The words of the new chunks are rows of a matrix: part ids in place, and the rank
of every adjacent pair beside them. Each step scans the rows for the least rank, deletes the boundary there and
looks up the two neighbouring ranks, for all rows at once. Very long words use a heap over the same pairs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import buffer_of, keeps, slices, steady

NONE = np.int32((1 << 31) - 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Words of more parts than this go through the heap.
WIDE = 64
#: Distinct chunks that a worker keeps; beyond this it starts afresh.
KEEP = 400_000
#: Bytes of text that are encoded at a time; fewer leave the matrices of new words short.
ENCODED_BYTES = 2 << 20


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict.fromkeys(plain)
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class Merges:
    """Ranks and results of the merges of a vocabulary file, and the ids of single bytes inside and at the end of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        prefix = len(model.get("continuing_subword_prefix") or "")
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b[prefix:]] for a, b in pairs], np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.bits = np.uint64(max(8, int(4 * len(keys)).bit_length()))
        self._table(keys, first.astype(np.int32), made[first].astype(np.int32))
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(chars)}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.bytes = [b"".join(bytes([back[c]]) if c in back else c.encode() for c in names.get(i, "")) for i in range(max(names) + 1)]

    def _table(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """An open-addressed table of the pairs, at most a quarter full; -1: free."""
        self.keys = np.full((1 << int(self.bits)) + len(keys), -1, np.int64)
        self.ranks, self.made = np.full(len(self.keys), NONE, np.int32), np.zeros(len(self.keys), np.int32)
        at, todo = self._spot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]], self.made[at[put]] = keys[put], ranks[put], made[put]
            todo = np.setdiff1d(todo, put)
            at[todo] += 1

    def _spot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * _GOLD >> (np.uint64(64) - self.bits)).astype(np.int64)

    def _at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair is in the table, or a free place."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        at = self._spot(key)
        todo = np.flatnonzero((found := self.keys[at]) != key)
        todo = todo[found[todo] >= 0]
        while len(todo):
            at[todo] += 1
            found = self.keys[at[todo]]
            todo = todo[(found != key[todo]) & (found >= 0)]
        return at

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it never merges."""
        at = self._at(left.ravel(), right.ravel())
        key = left.ravel().astype(np.int64) * self.size + right.ravel()
        return np.where(self.keys[at] == key, self.ranks[at], NONE).reshape(left.shape)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs that merge become."""
        return self.made[self._at(left, right)]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        low = 0
        for width in (4, 8, 12, 16, 24, WIDE):
            high = int(np.searchsorted(sizes[order], width, "right"))
            for at in range(low, high, 1 << 14):
                self._rows(words, order[at : min(high, at + (1 << 14))], sizes, width, out)
            low = high
        for k in order[low:].tolist():
            out[k] = self._heap(words[k])
        return out

    def _rows(self, words: list[bytes], which: np.ndarray, sizes: np.ndarray, width: int, out: list[bytes]) -> None:
        n = sizes[which]
        flat = np.frombuffer(b"".join(words[k] for k in which.tolist()), np.uint8)
        lane = np.arange(width)
        filled = lane < n[:, None]
        parts = np.full((len(which), width), -1, np.int32)
        parts[filled] = self.inner[flat]
        ends = np.flatnonzero(n > 0)
        parts[ends, n[ends] - 1] = self.final[flat[np.cumsum(n)[ends] - 1]]
        ranks = np.full(parts.shape, NONE, np.int32)
        ranks[:, :-1] = self.look(parts[:, :-1], parts[:, 1:])
        while len(which):
            best = ranks.argmin(axis=1)
            row = np.arange(len(which))
            going = ranks[row, best] < NONE
            if not going.all():
                raw = parts[~going].astype("<u4").tobytes()
                for k, at, size in zip(which[~going].tolist(), range(0, len(raw), 4 * width), n[~going].tolist()):
                    out[k] = raw[at : at + 4 * size]
                which, parts, ranks, n, best = (x[going] for x in (which, parts, ranks, n, best))
                row = np.arange(len(which))
                if not len(which):
                    return
            parts[row, best] = self.merged(parts[row, best], parts[row, best + 1])
            shift = np.minimum(lane + (lane > best[:, None]), width - 1)
            parts, ranks = np.take_along_axis(parts, shift, axis=1), np.take_along_axis(ranks, shift, axis=1)
            parts[:, -1], ranks[:, -1], n = -1, NONE, n - 1
            for left in (best - 1, best):
                ok = (left >= 0) & (left < width - 1)
                r, at = row[ok], left[ok]
                ranks[r, at] = self.look(parts[r, at], parts[r, at + 1])

    def _heap(self, word: bytes) -> bytes:
        flat = np.frombuffer(word, np.uint8)
        ids = self.inner[flat]
        ids[-1] = self.final[flat[-1]]
        ranks, made = self.look(ids[:-1], ids[1:]).tolist(), self.merged(ids[:-1], ids[1:]).tolist()
        part, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, k, part[k], part[k + 1], m) for k, (r, m) in enumerate(zip(ranks, made)) if r < NONE]
        heapq.heapify(queue)
        while queue:
            _, k, a, b, m = heapq.heappop(queue)
            j = after[k]
            if part[k] != a or j >= n or part[j] != b:
                continue
            part[k], part[j], after[k] = m, -1, after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n:
                    x, y = part[left], part[after[left]]
                    rank = self.look(np.array([x]), np.array([y]))
                    if rank[0] < NONE:
                        heapq.heappush(queue, (int(rank[0]), left, x, y, int(self.merged(np.array([x]), np.array([y]))[0])))
        return np.array([x for x in part if x >= 0], "<u4").tobytes()


class Encoder:
    """Texts to ids for one vocabulary file. `lead`: byte-level vocabularies whose words start with their space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lead = self.library.normalizer is None
        self.special = re.compile("|".join(map(re.escape, self.merges.added))) if self.merges.added else None
        self.kept: dict = {}
        size = [len(b) for b in self.merges.bytes]
        self.sizes = np.array(size, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.merges.bytes), np.uint8)

    # Keys of chunks. Byte-level vocabularies: a key is a chunk without the space before it, or with the line break before
    # it; a chunk that follows neither has EDGE before it. Others: the bytes of a chunk between white space.

    EDGE = "\n\n"
    _WIDE = [chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) if c != 10]
    _PAIRS = ("  ", "\n\n", " \n", "\n ")
    #: Most chunks: letters of Latin-1, then punctuation of ASCII. The lines of a text are the chunks.
    _LEAD = re.compile("^([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|*#$%&]*)$|^.*$", re.M)
    _SUFFIX = re.compile("^([a-zß-öø-ÿ]+)([.,!?;:|*#$%&]*)$|^.*$", re.M)
    _BACK = {c: b for b, c in enumerate(byte_chars())}

    def _keys(self, text: str) -> list:
        if not self.lead:
            return text.encode().split()
        if not text:
            return []
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in self._PAIRS) or any(x in text for x in self._WIDE):
            # white space runs: cut before the last space of a run that a word follows
            parts = re.split(r"(?<=\S)(?=\s)|(?<=\s)(?= \S)", text) if not re.search(r"\s\Z|\A\s", text) else [text]
            return [self.EDGE + c for c in parts if c]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = self.EDGE + keys[0]
        return keys

    def _pieces(self, chunk: str) -> list:
        """Words (bytes) and ids (ints) of a chunk, by the library's own normaliser and splitter."""
        out: list = []
        at = 0
        for m in self.special.finditer(chunk) if self.special is not None and "|>" in chunk else ():
            out += self._plain(chunk[at : m.start()]) if m.start() > at else []
            out.append(self.merges.added[m[0]])
            at = m.end()
        return out + (self._plain(chunk[at:]) if at < len(chunk) else [])

    def _plain(self, chunk: str) -> list:
        if not self.lead:
            chunk = self.library.normalizer.normalize_str(chunk)
        back = self._BACK
        return [bytes(back[c] for c in piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk) if piece]

    def _split(self, keys: list) -> tuple[list[bytes], list[bytes], dict[int, list]]:
        """Two words for each chunk (empty: none), and by number the pieces of the chunks that are not of one or two words."""
        if self.lead:
            chunks = [k if k[:1] == "\n" else " " + k for k in keys]
            found, space = self._LEAD.findall("\n".join([k if "\n" not in k else "" for k in keys])), " "
        else:
            joined = b"\n".join(keys).decode()
            chunks, space = joined.split("\n"), ""
            # only characters whose lower case is one character of Latin-1 match
            found = self._SUFFIX.findall(joined.lower() if "İ" not in joined else joined)
        words, tails = zip(*found)
        odd = {k: self._pieces(chunks[k].removeprefix(self.EDGE)) for k, word in enumerate(words) if not word}
        heads = (space + f"\n{space}".join(words)).encode().split(b"\n")
        for k in odd:
            heads[k] = b""
        return heads, "\n".join(tails).encode().split(b"\n"), odd

    def learn(self, new: list) -> None:
        """Encode chunks that are not known yet: kept[key] is the ids as little-endian unsigned 32-bit integers."""
        heads, tails, odd = self._split(new)
        wanted = set(heads).union(tails, (p for ps in odd.values() for p in ps if type(p) is bytes)) - {b""}
        words = list(wanted)
        ids = dict(zip(words, self.merges.words(words)))
        ids[b""] = b""
        get = ids.__getitem__
        self.kept.update(zip(new, map(add, map(get, heads), map(get, tails))))
        for k, ps in odd.items():
            self.kept[new[k]] = b"".join([ids[p] if type(p) is bytes else p.to_bytes(4, "little") for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.kept) > KEEP:
            self.kept = {}
        keys = [self._keys(t) for t in texts]
        known = [list(map(self.kept.get, k)) for k in keys]
        gaps = [[i for i, ids in enumerate(x) if ids is None] for x in known]
        new = list({k[i] for k, g in zip(keys, gaps) for i in g})
        if new:
            self.learn(new)
            for k, x, g in zip(keys, known, gaps):
                for i in g:
                    x[i] = self.kept[k[i]]
        return [b"".join(x) for x in known]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, one after the other."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return b""
        return self.blob[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - size), size)].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; loaded once, and again after tasks of other operators."""
    keeps("bpe", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string) of each row: its ids and the text that they decode to.

    ids are little-endian unsigned 32-bit integers. Null and empty texts have no ids and decode to ''. The strings of
    added tokens in a text are those tokens. Bytes that are no UTF-8 decode to U+FFFD. Repeated rows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in steady(batches, "bpe"):
            for part in slices(batch, limit=ENCODED_BYTES):
                ids = enc.encode([t or "" for t in part.column(1).to_pylist()])
                texts = [enc.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")


def encode_bytes(enc: Encoder, column: pa.Array) -> list[bytes]:
    """Ids of each text of an Arrow column (null: '')."""
    data, offsets = buffer_of(column)
    raw = data.tobytes()
    return enc.encode([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
