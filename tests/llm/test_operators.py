"""The operators against brute force, on small tables with nulls, empty, long, tied and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import bpe, chat, fingerprint, html, packing, quality, simhash, substring, toxicity, warc
from quire.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, junk, nulls."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, hot = prose(45), prose(90)
    out: list[str | None] = [None, "", "   \n\t ", "A", "Ab", "abc d", "ﬁ ＡＢ ß x", "ﬁ ab SS x", prose(19), prose(20), prose(3000)]
    for k in range(60):
        out.append(prose(rng.randint(5, 120)))
        out.append(prose(30) + " " + passage + "\n" + prose(k % 7))
    out += [hot] * 30 + [hot.replace(vocab[0], vocab[1]) + " " + w for w in vocab[:20]]
    out += [" ".join(["spam eggs"] * 60), "x" * 5000, "<|endoftext|> a  b\r\n c", "퟿ ok 😀"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = [None, "en", "de"]
    return spark.createDataFrame([(k, t, langs[k % 3], "s", len(t or "")) for k, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, texts, empty):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    form = lambda t: " ".join(unicodedata.normalize("NFKC", t).lower().replace("ß", "ss").replace("ς", "σ").split())
    prints: dict[str, str] = {}
    for k, t in texts:
        t, following = t or "", texts[(k + 1) % len(texts)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for x, f in ((t, r.fingerprint), (edited, r.edited_fingerprint), (following, r.next_fingerprint)):
            assert prints.setdefault(form(x), f) == f
        assert r.near_edited == float(form(t) == form(edited))
    assert len(set(prints.values())) == len(prints)
    assert fingerprint.fingerprints(empty).count() == 0


def test_fingerprint_collisions_are_told_apart(spark):
    keys = spark.createDataFrame([("k", 3, "p"), ("k", 3, "p"), ("k", 4, "q"), ("m", 1, "r")], "key string, size int, proof string")
    assert sorted(r.fingerprint for r in fingerprint.resolve(keys).collect()) == ["k", "k-q", "m"]


def test_fingerprints_without_a_hash(docs, texts, monkeypatch):
    """With all texts in one bucket, the comparison of bytes alone tells them apart."""
    monkeypatch.setattr(fingerprint, "wide_hash", lambda form: F.when(F.length(form) % 2 == 0, "even").otherwise("odd"))
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    form = lambda t: " ".join(unicodedata.normalize("NFKC", t or "").lower().replace("ß", "ss").replace("ς", "σ").split())
    groups: dict[str, set] = {}
    for k, t in texts:
        groups.setdefault(form(t), set()).add(got[k])
    assert all(len(g) == 1 for g in groups.values())
    assert len({f for g in groups.values() for f in g}) == len(groups)


def test_ranges_find_neighbours_over_gaps(spark):
    ids = [None, -5, 0, 7, 7, 7, 1000, 10**12]
    rows = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    old, fingerprint.ROWS_PER_RANGE = fingerprint.ROWS_PER_RANGE, 2
    try:
        got = {r.text: r.next_text for r in fingerprint.with_next(rows).collect()}
    finally:
        fingerprint.ROWS_PER_RANGE = old
    assert got == {f"t{k}": f"t{(k + 1) % 8}" for k in range(8)}


def test_quality_counts(docs, texts, empty):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for k, t in texts:
        t = t or ""
        w = WORDS.findall(t)
        found: dict[tuple, list[int]] = {}
        for i in range(len(w) - 7):
            found.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {j for v in found.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.quality(empty).count() == 0
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == sorted(k for k, r in got.items() if r.kept)
    assert quality.keep_good(empty).count() == 0


def test_quality_band_is_four_deviations(spark):
    limits = spark.createDataFrame([("en", 1.6, 2.0)], "tongue string, middle double, spread double")
    away = (-6.5, -4.5, -3.5, -2.5, 0.0, 2.5, 3.5, 4.5, 6.5)
    rows = [(k, "en", 400, 0, 1.6 + d * 2.0 / 20) for k, d in enumerate(away)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, n_repeat_words long, log_ppl double")
    assert sorted(r.doc_id for r in quality.judge(scored, limits).where("kept").collect()) == [2, 3, 4, 5, 6]


def _kneser_ney(texts: list[tuple]) -> dict:
    """Probability of every (language, n-gram as bytes of the full order) by the book, over texts (text, language)."""
    n = quality.ORDER
    levels: dict[int, dict] = {k: {} for k in range(1, n + 1)}
    for text, lang in texts:
        line = b"\0" * (n - 2) + b"\1" + b"".join(w.encode() + b" " for w in WORDS.findall(text or ""))
        for i in range(n - 1, len(line)):
            key = (lang or "", line[i - n + 1 : i + 1])
            levels[n][key] = levels[n].get(key, 0) + 1
    for k in range(n - 1, 0, -1):
        for lang, g in levels[k + 1]:
            levels[k][lang, g[1:]] = levels[k].get((lang, g[1:]), 0) + 1
    below: dict = {}
    for k in range(1, n + 1):
        n1, n2, n3, n4 = (max(1, sum(v == c for v in levels[k].values())) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        off = [min(max(c - (c + 1) * y * b / a, 0), 0.9 * c) for c, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total, spare = {}, {}
        for (lang, g), c in levels[k].items():
            total[lang, g[:-1]] = total.get((lang, g[:-1]), 0) + c
            spare[lang, g[:-1]] = spare.get((lang, g[:-1]), 0) + off[min(c, 3) - 1]
        p = {}
        for (lang, g), c in levels[k].items():
            t = total[lang, g[:-1]]
            lower = below[lang, g[1:]] if k > 1 else 1 / 256
            p[lang, g] = max(c - off[min(c, 3) - 1], 0) / t + max(spare[lang, g[:-1]], 1e-9 * t) / t * lower
        below = p
    return below


def _rank(values: list, share: float) -> float:
    return sorted(values)[max(0, math.ceil(share * len(values)) - 1)]


@pytest.mark.parametrize("most", [quality.MOST_BROADCAST, 0])
def test_perplexity_and_verdict_equal_brute_force(spark, monkeypatch, most):
    """Under a broadcast model and under one that stays in shards."""
    monkeypatch.setattr(quality, "MOST_BROADCAST", most)
    rng = random.Random(11)
    words = {x: ["".join(rng.choice(a) for _ in range(rng.randint(1, 8))) for _ in range(60)] for x, a in (("en", "abcdeé"), ("de", "opqrst"), (None, "xyz"))}
    rows = []
    for k in range(160):
        lang = "en" if k < 90 else "de" if k < 130 else None
        own = [rng.choice(words[lang]) for _ in range(rng.randint(1, 80))]
        if k % 9 == 0:
            own = [w + "#$%"[i % 3] * 3 for i, w in enumerate(own)]
        rows.append((k, "  ".join(own) + ("\n" if k % 2 else ""), lang))
    rows += [(160, None, "en"), (161, "", None), (162, " \t", "de"), (163, rows[5][1], "en"), (164, " ".join(words["en"] * 2), "xx"), (None, rows[7][1], "en")]
    p = _kneser_ney([(t, x) for _, t, x in rows])
    cost = {}
    for at, (_, text, lang) in enumerate(rows):
        w = WORDS.findall(text or "")
        line = b"\0" * 3 + b"\1" + b"".join(x.encode() + b" " for x in w)
        cost[at] = sum(-math.log(p[lang or "", line[i - 4 : i + 1]]) for i in range(4, len(line))) / len(w) if w else None
    frame = spark.createDataFrame([(k, t, x, at) for at, (k, t, x) in enumerate(rows)], "doc_id long, text string, lang string, at int").repartition(3)
    got = sorted(((r.doc_id if r.doc_id is not None else 999, r) for r in quality.quality(frame).collect()), key=lambda x: x[0])
    want = sorted(((k if k is not None else 999, at) for at, (k, _, _) in enumerate(rows)), key=lambda x: x[0])
    failed = {}
    for (_, r), (_, at) in zip(got, want):
        failed[at] = r.base_failed
        assert r.log_ppl is None if cost[at] is None else abs(r.log_ppl - cost[at]) < 1e-4, at
    # the bands by the docstring
    n = {at: len(WORDS.findall(t or "")) for at, (_, t, _) in enumerate(rows)}
    root = {at: math.sqrt(min(400, max(1, n[at]))) for at in n}
    tongue = {at: x or "" for at, (_, _, x) in enumerate(rows)}
    middle = {x: _rank([cost[at] for at in n if tongue[at] == x and not failed[at]], 0.5) for x in set(tongue.values()) if any(tongue[at] == x and not failed[at] for at in n)}
    away = {at: (cost[at] - middle[tongue[at]]) * root[at] for at in n if not failed[at]}
    spread = lambda v: (_rank(v, 0.84) - _rank(v, 0.16)) / 2
    every = spread(list(away.values()))
    band = {}
    for x in middle:
        own = [a for at, a in away.items() if tongue[at] == x]
        band[x] = math.sqrt((len(own) * spread(own) ** 2 + 50 * every**2) / (len(own) + 50))
    kept = set()
    for (_, r), (_, at) in zip(got, want):
        half = max(4 * band.get(tongue[at], 0), 0.25 * 20) / root[at]
        margin = None if failed[at] else abs(cost[at] - middle[tongue[at]]) - half
        if margin is not None and abs(margin) < 1e-3:
            continue  # on the edge of the band: 32-bit logs decide
        assert r.kept == (margin is not None and margin < 0), at
        kept |= {at} if r.kept else set()
    assert any(at % 9 == 0 and at < 160 and not failed[at] and at not in kept for at in n), "no junk is rejected"
    assert sum(not failed[at] and at in kept for at in n) > 60
    wide = frame.withColumn("log_ppl", F.lit("own")).withColumn("block", F.lit(1))
    out = quality.keep_good(wide)
    assert out.columns == wide.columns
    flags = {at: r.kept for (_, r), (_, at) in zip(got, want)}
    assert sorted(r.at for r in out.collect()) == sorted(at for at in n if flags[at])


def test_ngrams_of_ranges_equal_those_of_the_whole():
    import pyarrow as pa

    from quire.llm.shared import Words, buffer_of

    rng = random.Random(8)
    texts = ["", "a", "ab c", None, " x ", "éé " * 5] + ["".join(rng.choice("ab  \n") for _ in range(40)) for _ in range(30)] + [""]
    words = Words(*buffer_of(pa.array(texts, pa.string())))
    whole, owner = quality._grams(words, 0, len(words.starts))
    for width in (1, 2, 3, 7):
        parts = [quality._grams(words, a, min(a + width, len(words.starts))) for a in range(0, len(words.starts), width)]
        assert np.array_equal(np.concatenate([v for v, _ in parts]), whole)
        assert np.array_equal(np.concatenate([o for _, o in parts]), owner)
    want = []
    for t in texts:
        line = b"\0" * 3 + b"\1" + b"".join(w.encode() + b" " for w in WORDS.findall(t or ""))
        want += [int.from_bytes(line[i - 4 : i + 1], "big") for i in range(4, len(line))]
    assert whole.tolist() == want


def _ids(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4") for _, x in texts], t


def test_bpe_round_trip(docs, texts, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, library = _ids(path, texts)
    got = {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    for (k, _), want in zip(texts, ids):
        assert bytes(got[k].ids) == want.tobytes()
        assert got[k].decoded == library.decode(want.tolist(), skip_special_tokens=False)
    assert bpe.round_trip(empty, path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_equals_the_library_on_odd_texts(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(path)
    rng = random.Random(2)
    alphabet = ["a", "B", "'s", "'ll", " ", "  ", "\n", "\t", "é", "é", " ", "23", "<|endoftext|>", "İ", "ß", "Σ", "!!", "漢", "😀", "\x1c", "　", "x" * 90, "|>", "Å"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing(docs, texts, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = {k: np.append(x, 2).astype("<u4") for (k, _), x in zip(texts, _ids(path, texts)[0])}
    rows = packing.pack(docs, path).toPandas()
    for k, own in rows.sort_values("start").groupby("doc_id"):
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert own.length.sum() == len(ids[k]) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[k][s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    padding = 0
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        n = int(own.length.sum())
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert n <= 4096
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    assert set(rows.doc_id) == set(ids)
    assert padding < 0.02 * rows.length.sum()
    assert packing.pack(empty, path).count() == 0


def test_sum_of_squares_choice():
    done = []
    packer = packing.Packer(lambda s, p: done.append(p), window=10, most_open=100)
    add = lambda k, n: packer.add(k, bytes(4 * n))
    add(1, 6), add(2, 6)
    assert packer.count[6] == 2
    add(3, 4)  # fills a window of level 6
    assert [[p[0] for p in w] for w in done] == [[2, 3]]
    add(4, 3)
    assert packer.count.tolist()[:10] == [0, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    packer.finish()
    assert sorted(sum(len(p[2]) // 4 for p in w) for w in done) == [1, 8, 10]


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "[\\INST] [\\\\/INST]", "<s> <\\s> [INST", None, "", "tail [", "😀\\"]
    rows = [(k % 4 - 1 if k % 11 else None, k, ["user", "assistant", "system", None, "a\nb[INST]\\"][k % 5], odd[k % len(odd)], 1) for k in range(80)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(frame.limit(0)).count() == 0


def _print(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = WORDS.findall(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, texts, empty):
    prints = np.array([_print(t or "") for _, t in texts], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(prints))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[k].fp & (1 << 64) - 1 for k, _ in texts] == prints.tolist()
    assert [got[k].component_id for k, _ in texts] == label.tolist()
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == sorted(set(label.tolist()))
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_first_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (7, d), (3, e), (7, e), (None, e)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, a), (0, b), (7, c), (7, d), (3, e)])


def test_simhash_large_keys_are_dealt_in_chunks(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 8)).astype(np.uint64)
    prints = np.unique(np.r_[base, (base[:, None] ^ flips).ravel(), (base ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])])
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(prints))
    for _ in range(30):
        label = np.array([label[row].min() for row in near])
    nodes = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components(simhash.links(nodes, chunk=2)).collect()}
    groups: dict[int, set] = {}
    for x, g in zip(prints.view(np.int64).tolist(), label):
        groups.setdefault(g, set()).add(found.get(x, x))
    assert all(len(roots) == 1 for roots in groups.values())
    assert len({r for roots in groups.values() for r in roots}) == len(groups)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 4), (9, 9), (10, 4)] + [(k, k + 1) for k in range(100, 130)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(2, 1), (3, 1), (5, 4), (10, 4)} | {(k, 100) for k in range(101, 131)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _kept(texts):
    seen: set[tuple] = set()
    for k, t in texts:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        yield k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)


@pytest.mark.parametrize("per_shard", [7, 60_000])
def test_substring(docs, texts, empty, per_shard, monkeypatch):
    monkeypatch.setattr(substring, "STRETCHES_PER_SHARD", per_shard)
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    for k, n, gone, kept in _kept(texts):
        assert (got[k]._n_words, got[k]._n_removed, got[k].text) == (n, gone, kept)
    same = {r.doc_id: r.text for r in substring.remove_repeats(docs, untouched=True).where("_n_removed = 0").collect()}
    assert all(t == (texts[k][1] or "") for k, t in same.items())
    assert substring.remove_repeats(empty).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = np.r_[rng.integers(1, 4, 400), 0]
    index = substring.Index(text, 4)
    starts = np.arange(0, 390)
    found, low, high = index.search(text, starts, 6)
    want = [sum((text[s : s + 6] == text[o : o + 6]).all() for o in range(len(text) - 5)) for s in starts]
    assert dict(zip(found.tolist(), (high - low).tolist())) == {int(s): n for s, n in zip(starts, want) if n > 1}
    for k, a, b in zip(found.tolist(), low.tolist(), high.tolist()):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [o for o in range(len(text) - 5) if (text[k : k + 6] == text[o : o + 6]).all()]


def test_matching_statistics():
    """How far back from each end the words occur twice, against brute force; stretches are apart."""
    rng = np.random.default_rng(4)
    text = np.concatenate([np.r_[rng.integers(1, 5, rng.integers(1, 30)), 0] for _ in range(25)])
    index = substring.Index(text, 5)
    assert sorted(index.locate(np.arange(len(text))).tolist()) == list(range(len(text)))
    starts = np.array([s for s in range(len(text) - 7) if (text[s : s + 7] > 0).all()])
    length, low, high = index.statistics(text, starts, 7)
    for s, n, a, b in zip(starts.tolist(), length.tolist(), low.tolist(), high.tolist()):
        times = [sum((text[o : o + k] == text[s + 7 - k : s + 7]).all() for o in range(len(text) - k + 1)) for k in range(1, 8)]
        assert n == sum(t > 1 for t in times)
        assert (b - a == times[6]) if n == 7 else (a == b == 0)


@pytest.mark.parametrize("hot", [0, 1, 5])
def test_substring_of_hot_anchors(spark, monkeypatch, hot):
    """A passage in very many surroundings, copies of it, periodic text; cut down before they are dealt."""
    monkeypatch.setattr(substring, "HOT", hot)
    rng = random.Random(hot)
    vocab = [f"w{k}" for k in range(150)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = prose(26)
    texts = [f"{prose(rng.randint(0, 30))} {passage} {prose(rng.randint(0, 30))}" for _ in range(60)]
    texts += [texts[3]] * 3 + [passage, " ".join(["a b c"] * 30), " ".join(["a b c"] * 20), prose(19), "", None, passage[:60] + " " + passage]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, n, gone, kept in _kept(sorted(rows)):
        assert (got[k]._n_words, got[k]._n_removed, got[k].text) == (n, gone, kept), k


@pytest.mark.parametrize("most_open", [1, 3, 64, 2048])
def test_packer_leaves_few_short_windows(most_open):
    """Documents that never pair up: the bound on open windows must not leave short sequences behind."""
    rng = random.Random(most_open)
    out: dict[int, list] = {}
    packer = packing.Packer(lambda k, pieces: out.setdefault(k, []).extend(pieces), 64, most_open)
    texts = {k: np.arange(rng.choice([0, 1, 33, 40, 50, 63, 64, 65, 200]) if k < 500 else 33, dtype="<u4") + 1000 * k for k in range(900)}
    for k, ids in texts.items():
        packer.add(k, ids.tobytes())
        assert packer.held <= most_open + 1 and packer.held == packer.count.sum() == sum(map(len, packer.open))
    packer.finish()
    sizes = [sum(len(p[2]) // 4 for p in pieces) for pieces in out.values()]
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes) and sum(n < 64 for n in sizes) <= 6
    for k, ids in texts.items():
        own = sorted((p[1], p[2]) for pieces in out.values() for p in pieces if p[0] == k)
        assert b"".join(raw for _, raw in own) == ids.tobytes()
        assert [s for s, _ in own] == np.cumsum([0, *(len(raw) // 4 for _, raw in own)])[:-1].tolist()


def test_toxicity_learns(spark, empty):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abdeghilmno") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for k in range(700):
        w = [rng.choice(vocab) for _ in range(rng.randint(3, 200))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["zorkface", "Zorkbag,", "zorkling!"]))
        rows.append((k, " ".join(w), 1))
        if k % 3:
            labels.append((k, int(toxic), None))
    rows += [(9001, None, 0), (9002, "", 0), (9003, "x " * 30_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = {r.doc_id: r.score for r in toxicity.scores(docs, marks).collect()}
    held = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 5 == 0) for k in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    assert got[9001] == got[9002] < 0.5
    left = {r.doc_id for r in toxicity.keep_clean(docs, marks).collect()}
    assert left == {k for k, s in got.items() if s < 0.5}
    assert {r.score for r in toxicity.scores(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity.scores(empty, marks).count() == 0


def test_toxicity_gradient():
    """Of every part of the network, through both layers, against slopes; a window shorter than the others, an unknown word, a word without letters."""
    rng = np.random.default_rng(2)
    net = {k: v.astype(np.float64) for k, v in toxicity.start(rng, 3).items()}
    chars = np.array([[1, 1, 1, 1], [97, 98, 0, 99], [98, 0, 0, 97]], np.uint8)
    ids, at, y = np.array([2, 0, 0, 3]), np.array([[0, 1, 2, 3], [3, 0, -1, -1], [1, 1, 0, -1]]), np.array([1.0, 0, 1])
    value, grad = toxicity.loss(net, chars, ids, at, y)
    assert value > 0 and set(grad) == set(net)
    for k, v in net.items():
        for place in {tuple(rng.integers(0, n) for n in v.shape) for _ in range(6)} | {np.unravel_index(np.abs(grad[k]).argmax(), v.shape)}:
            step = np.zeros_like(v)
            step[place] = 1e-4
            slope = (toxicity.loss(net | {k: v + step}, chars, ids, at, y)[0] - toxicity.loss(net | {k: v - step}, chars, ids, at, y)[0]) / 2e-4
            assert abs(slope - grad[k][place]) < 1e-7 + 1e-4 * abs(slope), (k, place)


def test_toxicity_reads_all_of_long_words():
    import pyarrow as pa

    from quire.llm.shared import Words, buffer_of

    texts = ["a " + "b" * 100 + " c", "", "x" * 24, "y" * 25, None]
    words = toxicity.pieces_of(Words(*buffer_of(pa.array(texts, pa.string()))))
    raw = words.data.tobytes()
    got = [[raw[words.starts[k] : words.ends[k]] for k in range(a, b)] for a, b in zip(words.bounds[:-1], words.bounds[1:])]
    assert got[0][0] == b"a" and got[0][-1] == b"c" and all(p == b"b" * len(p) and len(p) <= 24 for p in got[0][1:-1])
    assert sum(map(len, got[0][1:-1])) - 8 * (len(got[0]) - 3) == 100
    assert [len(g) for g in got[1:]] == [0, 1, 2, 0] and got[3] == [b"y" * 24, b"y" * 9]
    chars, size = toxicity.bytes_of(words, np.arange(len(words.starts)))
    assert chars[:, 0].tolist()[:3] == [1, 97, 0] and size[0] == 2 and (chars > 0).sum(axis=0).tolist() == size.tolist()


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div class="cookie-notice">Cookies</div>%s<aside>Side</aside><form>Find <input></form><div id="comments"><p>First! what a long comment this is, longer than all.</p></div><footer>&copy; 2024</footer></body></html>"""


def test_html(spark):
    pages = [
        ("http://a.org/1", PAGE % "<article><h1>T &amp; U</h1><p><b>one\n two<br>three<p>four &lt;5&gt;</p><ul><li>x<li>y</ul></article>", "T & U\n\none two three\n\nfour <5>\n\nx\n\ny"),
        ("http://a.org/2", PAGE % "<article><p>short</p></article>", "short"),
        ("http://b.org/1", PAGE % "<div class='post p12'><p>long text of the post number one</p><p>and more</p></div>", "long text of the post number one\n\nand more"),
        ("http://b.org/2", PAGE % "<div class='post p13'><p>tiny</p></div><div class='extra'><p>something that is not the article at all</p></div>", "tiny"),
        ("http://b.org/3", PAGE % "<div class='post p14'><p>yet another post with words</p></div>", "yet another post with words"),
        (None, None, ""), ("http://c.org", "", ""), ("http://c.org/x", "<p>bare <i>text</i>", "bare text"), ("http://c.org/y", "<<>&nbsp;</p", ""),
    ]
    frame = spark.createDataFrame([(k, u, h, "x") for k, (u, h, _) in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.main_text(frame).collect()}
    for k, (_, _, want) in enumerate(pages[:-1]):
        assert got[k] == want, k
    assert html.main_text(frame.limit(0)).count() == 0


def _alone(page: str) -> str:
    """The text of a page that is its host's only one."""
    path = html.best_path(page)
    return html.extract(page, [path] if path else [])


def test_html_names_and_places():
    assert _alone("<body><nav>menu</nav><div class='social-history'><p>The history of it</p></div></body>") == "The history of it"
    assert _alone("<body><div class='popular'><p>only text</p></div></body>") == "only text"
    assert _alone("<body><main><article><p>one</p></article><article><p>two two</p></article><aside>no</aside></main></body>") == "one\n\ntwo two"
    assert _alone("<body><p>intro</p><div><p>content of the page that is long enough to win</p></div></body>") == "intro\n\ncontent of the page that is long enough to win"
    assert _alone("<article><p>text <span class='ad'>BUY <b>NOW</b></span> more <span class='share'>Share <span>x</span></span> end</p><p>b</p></article>") == "text more end\n\nb"
    assert _alone("<article><p>a <span class='ad'>BUY<p>c</p><div id='comments'>d</div></article>") == "a\n\nc"
    # equal votes go to the path that sorts first
    assert html.extract("<div class='b'><p>bb</p></div><div class='a'><p>aa</p></div>", ["html>div.a", "html>div.b"]) == "aa"


@pytest.mark.parametrize("page", ["<ul>x" * 200_000, "<select>" * 125_000, "<div>" * 100_000 + "</p>" * 100_000, "<p>" + "<div>" * 100_000 + "</p>" * 100_000, "<span class=ad>" * 60_000, '<a "' * 250_000, "<div>" * 90_000 + "<header>" * 60_000, "<!--" * 250_000])
def test_html_takes_odd_pages_in_time(page):
    best = lambda p: min(_timed(p) for _ in range(2))
    half, whole = best(page[: len(page) // 2]), best(page)
    assert whole < 4 * half + 0.5


def _timed(page: str) -> float:
    began = time.process_time()
    _alone(page)
    return time.process_time() - began


def test_html_reads_very_long_pages(spark):
    text = "word " * 400_000
    rows = spark.createDataFrame([(1, "http://h/1", f"<article><p>{text}</p></article>"), (1, "http://h/1", f"<article><p>{text}</p></article>")], "page_id long, url string, html string")
    assert [len(r.text) for r in html.main_text(rows).collect()] == [len(text) - 1] * 2


def test_simhash_block_numbers_agree(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(12)}
    nodes = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    roots = [sorted((r.node, r.root) for r in components(simhash.links(nodes, blocks=b)).collect()) for b in (6, 7, 8)]
    assert roots[0] == roots[1] == roots[2] and roots[0]
    assert [simhash.blocks_for(n) for n in (0, 4 << 21, (4 << 21) + 1, (4 << 27) + 1, 1 << 50)] == [6, 6, 7, 8, 8]


def test_warc_commit_may_run_again(spark, tmp_path):
    import pyarrow as pa

    frame = spark.createDataFrame([(k, f"u{k}", f"{k} " * 90) for k in range(20)], "page_id long, url string, html string")
    uri = f"file://{tmp_path}/a"
    first = sorted(map(tuple, warc.write(frame, uri, rows_per_shard=7).collect()))
    attempts = spark.read.parquet(f"{uri}/attempts").toArrow().to_batches()
    assert [b.num_rows for b in warc._final_names(uri)(iter(attempts))] == [b.num_rows for b in attempts]
    lost = pa.RecordBatch.from_pylist([r | {"compressed_bytes": 1} for r in attempts[0].to_pylist()], schema=attempts[0].schema)
    with pytest.raises(OSError, match="not whole"):
        list(warc._final_names(uri)(iter([lost])))
    (tmp_path / "a" / ".shard-000000-0000.warc.gz.gone-1.tmp").write_bytes(b"half")
    again = warc.write(frame, uri, rows_per_shard=7)
    assert sorted(map(tuple, again.collect())) == first
    assert not list((tmp_path / "a").glob(".shard*")) and warc.read(again, uri).count() == 20


def test_warc(spark, tmp_path):
    long = "x" * 150
    rows = [(k, f"http://h/{k}", long if k % 3 == 0 else "short" if k % 3 == 1 else f"{k}" * 60) for k in range(40)] + [(5, "http://again", "5" * 60), (0, None, long), (None, "http://n\r\nX: y", long), (77, "u", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    uri = f"file://{tmp_path}/one"
    manifest = warc.write(frame, uri, rows_per_shard=10, roll_bytes=700)
    assert manifest.count() > 5
    got = warc.read(manifest, uri).collect()
    assert len(got) == len(rows)
    for r in got:
        body = [h or "" for k, _, h in rows if k == r.page_id]
        assert any((r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b.encode()).hexdigest()) for b in body)
        assert (r.record_type == "revisit") == (r.refers_to is not None)
    assert sum(r.record_type == "response" for r in got if r.payload_bytes == 150) == 1
    assert {r.refers_to for r in got if r.payload_bytes == 150 and r.record_type == "revisit"} == {0}
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
    again = warc.write(frame.repartition(2), f"file://{tmp_path}/two", rows_per_shard=10, roll_bytes=700)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect()))
    assert warc.archive(frame.limit(0), f"file://{tmp_path}/three").count() == 0


def test_pipeline(spark, tmp_path, docs, texts):
    """Every stage against brute force on the rows that it got; null and repeated ids, an empty table."""
    import corpus_pipeline

    extra = spark.createDataFrame([(None, texts[20][1], "en", "s", 9), (None, texts[20][1], "en", "s", 9), (20, texts[22][1], "de", "s", 7), (12, texts[12][1], None, "s", 3)], SCHEMA)
    docs = docs.unionByName(extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.createDataFrame([(12, 0, 1), (13, 1, 0)], "doc_id long, toxic int, quality int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    columns, frame, got = docs.columns, docs, [sorted(map(tuple, docs.collect()), key=str)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == columns, name
        got.append(sorted(map(tuple, frame.collect()), key=str))
    start, good, clean, single, cut = got
    # quality: the verdict of each text in its language
    said = {(r.doc_id, r.lang, r.n_words, r.log_ppl): r.kept for r in quality.quality(docs).collect()}
    assert len(good) == sum(said[k] for k in [(r.doc_id, r.lang, r.n_words, r.log_ppl) for r in quality.quality(docs).collect()])
    kept = {(r[1], r[2]) for r in good}
    assert [r for r in start if (r[1], r[2]) in kept] == good and all(len(WORDS.findall(r[1])) >= 20 for r in good)
    # toxicity: a score for each text
    model = toxicity.train(spark.createDataFrame(good, SCHEMA), marks)
    score = dict(zip([r[1] for r in good], toxicity.Scorer(model).scores(pa.array([r[1] for r in good], pa.string()))))
    assert [r for r in good if score[r[1]] < 0.5] == clean
    # near duplicates: one row of each group, of the smallest id
    prints = np.array([_print(r[1]) for r in clean], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(prints))
    while not np.array_equal(label, new := np.array([label[row].min() for row in near])):
        label = new
    tag = {r.text: r.tag for r in spark.createDataFrame([(x[1],) for x in clean], "text string").select("text", F.xxhash64("text").alias("tag")).collect()}
    firsts = [min((r for r, g in zip(clean, label) if g == k), key=lambda r: (r[0] is None, r[0] or 0, tag[r[1]])) for k in set(label.tolist())]
    assert sorted((str(r[0]), r[1]) for r in firsts) == sorted((str(r[0]), r[1]) for r in single) and set(single) <= set(clean)
    # repeated windows: ids in order, nulls first
    order = sorted(single, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {(r[0], r[2]): (t if gone else r[1]) for r, (_, _, gone, t) in zip(order, _kept([(r[0], r[1]) for r in order]))}
    assert {(r[0], r[2]): r[1] for r in cut} == want and all(r[4] == len(r[1]) for r in cut)
    # packing: every token of every document once
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    path = public_tokenizers.path("word_bpe_49k.json")
    sizes = {r[0]: len(x) + 1 for r, x in zip(cut, _ids(path, [(r[0], r[1]) for r in cut])[0])}
    packed: dict = {}
    for r in rows:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == sizes
    assert not list(tmp_path.glob("pipeline-*"))
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    marks.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


CLASHES = ["_n_words", "x0", "row", "spans", "log_ppl", "score", "fp", "component_id", "key", "id", "tie", "own", "place", "at", "value", "copy", "mask", "start", "shard", "payload", "digest", "host", "paths", "block", "pos", "tongue", "n", "_rank", "ids", "decoded"]


def test_clashing_columns(spark, docs):
    wide = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(CLASHES)))
    for step in (quality.keep_good, simhash.keep_first, substring.remove_repeats, lambda d: toxicity.keep_clean(d, d.select("doc_id", F.lit(0).alias("toxic")).limit(0))):
        out = step(wide)
        assert out.columns[: len(wide.columns)] == wide.columns
        assert out.count() > 0
    byte, word = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for step in (fingerprint.fingerprints, simhash.near_duplicates, lambda d: bpe.round_trip(d, byte), lambda d: packing.pack(d.coalesce(1).sortWithinPartitions("doc_id"), word)):
        assert same(step(wide), step(docs))


def test_clashing_columns_of_pages_and_turns(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<article><p>text {k % 3} " + "long " * 40 + "</p></article>") for k in range(9)], "page_id long, url string, html string")
    turns = spark.createDataFrame([(k // 3, k % 3, "user" if k % 3 == 0 else "assistant", f"t{k}") for k in range(9)], "conv_id long, turn long, role string, text string")
    widen = lambda d: d.select("*", *(F.lit(k).alias(n) for k, n in enumerate(CLASHES)))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(html.main_text(widen(pages)), html.main_text(pages))
    assert same(warc.archive(widen(pages), f"file://{tmp_path}/a"), warc.archive(pages, f"file://{tmp_path}/b"))
    assert same(chat.read_back(chat.format_chats(widen(turns))), chat.read_back(chat.format_chats(turns)))


def test_very_long_texts(spark, tmp_path):
    long = "word <p> [INST] " * 200_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.format_chats(turns)).collect()
    assert (r.loss_chars, r.loss_sha256) == (len(long), hashlib.sha256(long.encode()).hexdigest())
    pages = spark.createDataFrame([(1, "u", long), (2, "v", long)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive(pages, f"file://{tmp_path}/w").collect()}
    assert got[1].payload_digest == hashlib.sha256(long.encode()).hexdigest() and (got[2].record_type, got[2].refers_to) == ("revisit", 1)
    docs = spark.createDataFrame([(1, long, "en"), (2, "x" * 3_000_000, "en"), (3, "short text", "en")], "doc_id long, text string, lang string")
    assert [r.n_words for r in quality.quality(docs).orderBy("doc_id").collect()] == [600_000, 1, 2]
    assert toxicity.scores(docs, docs.select("doc_id", F.lit(0).alias("toxic"))).count() == 3


def test_languages_of_few_texts(spark):
    """One language, languages of one text, none at all: the middle is their own, the spread leans on all."""
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 40)}" for _ in range(60)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(40)), f"l{k}" if k > 30 else "en") for k in range(34)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert all(got[k].kept and abs((got[k].lower + got[k].upper) / 2 - got[k].log_ppl) < 1e-6 for k in (31, 32, 33))
    assert len({round(got[k].upper - got[k].lower, 9) for k in (31, 32, 33)}) == 1
    assert quality.quality(docs.where("doc_id < 5").withColumn("lang", F.lit(None).cast("string"))).count() == 5
