"""Rules that differ between engines, and cases that the tables do not hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import files as fx
from quire.functions import ranges
from quire.functions import text as tx
from quire.operators import fonts, images, pages, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("spec", "pages", "bad", "unparsable"),
    [
        ("1-3, 5, 8-", [0, 1, 2, 4, 7, 8, 9], [], False), ("1-2, 40-50", [0, 1], ["40-50"], False), ("99-120", [], ["99-120"], True), ("8-50", [7, 8, 9], ["8-50"], False),
        ("", [], [], False), ("-", list(range(10)), [], False), ("1 - 5", list(range(10)), [], False), ("0", [], ["0"], True), ("3-1", [], ["3-1"], True), ("9" * 20, [], ["9" * 20], True),
        ("a, 2", [1], ["a"], False), ("5-5", [4], [], False), ("2\n", [1], [], False),
    ],
)
def test_range_specs(spark, spec, pages, bad, unparsable):
    r = value(spark, ranges.parse_spec(F.lit(spec), F.lit(10)))
    assert (r.pages, r.out_of_bounds, r.unparsable) == (pages, bad, unparsable)


def test_rounding_and_padding(spark):
    assert value(spark, tx.half_up(F.lit(-2.5))) == -2
    assert value(spark, tx.half_up(F.lit(2.5))) == 3
    assert value(spark, tx.pad_number(F.lit(123), F.lit(2))) == "123"
    assert value(spark, tx.trim_all(F.lit("  a b\t"))) == "a b"
    assert value(spark, tx.sanitise(F.lit("a/b:c*?  d"))) == "a-b-c-- d"


def test_names(spark):
    assert value(spark, tx.stem(F.lit("a.b/c"))) == "a.b/c"
    assert value(spark, tx.as_pdf_name(F.lit(" .PDF "))) == "document.pdf"
    assert value(spark, tx.suffix_name(F.lit(".hidden"), F.lit("-x"))) == ".hidden-x"
    assert value(spark, tx.suffix_name(F.lit("a.tar.gz"), F.lit("-x"))) == "a.tar-x.gz"
    assert value(spark, tx.utf16_text(F.lit("00410E0100"))) == "Aก"


def test_sniffing(spark):
    head = lambda n: F.lit(bytes(n) + b"%PDF-1.7")
    assert value(spark, fx.kind(head(0))) == "pdf"
    assert value(spark, fx.kind(head(1024))) == "pdf"
    assert value(spark, fx.kind(head(1025))) == "unknown"
    assert value(spark, fx.kind(F.lit(b""))) == "unknown"


def test_errors(spark):
    code = lambda n, m: value(spark, fx.classify_error(F.lit(n), F.lit(m)))
    assert code("AbortError", "x") == "E_CANCELLED"
    assert code("DataCloneError", "could not be cloned") == "E_INTERNAL"
    assert code("Error", "Failed to parse PDF document: no xref table found") == "E_CORRUPT"
    assert code("Error", "Input document is encrypted") == "E_ENCRYPTED"


def test_drifting_baseline_starts_a_line(spark):
    """The first run of a line is its anchor: 10, 10.3, 10.5 with a tolerance of 1 are one line, 11.2 is not."""
    rows = [(1, 1, k, "x", float(k), -y, 2.0) for k, y in enumerate((10.0, 10.6, 11.0, 11.2, 20.0))]
    items = spark.createDataFrame(rows, "file_id long, page int, item_index int, text string, x double, y double, font_size double")
    assert [r.line_no for r in text.group_lines(items).orderBy("item_index").collect()] == [0, 0, 0, 1, 2]


def test_organize_cases(spark):
    rows = spark.createDataFrame([(1, k) for k in range(6)], "file_id long, page_index int")
    order = spark.createDataFrame([(1, k, p) for k, p in enumerate([4, 0, 2, 1, 5, 3])], "file_id long, at int, page_index int")
    gone = spark.createDataFrame([(1, 2), (1, 5)], "file_id long, page_index int")
    assert [r.page_index for r in pages.final_order(rows, order, gone).orderBy("pos").collect()] == [4, 0, 1, 3]


def test_compress_rules(spark):
    base = {"key": 1, "file_id": 1, "width": 2000, "height": 2000, "stored": 90_000, "filter": "FlateDecode", "colour": "rgb", "bits": 8, "is_mask": False, "is_mask_target": False, "sample_tricks": False}
    cases = [({}, None), ({"width": 60, "height": 60}, "too-small"), ({"filter": "JPXDecode"}, "unsupported-filter"), ({"filter": "DCTDecode", "colour": "cmyk"}, "unsupported-colour"), ({"is_mask": True, "sample_tricks": True}, "mask"), ({"sample_tricks": True}, "sample-tricks"), ({"bits": 1}, "unsupported-colour")]
    for change, reason in cases:
        frame = spark.createDataFrame([base | change])
        placed = spark.createDataFrame([(1, 144.0, 144.0)], "key long, width_pt double, height_pt double")
        row = images.plan(frame, placed).first()
        assert row.reason == reason
        if not change:
            assert (row.effective_dpi, row.target_width) == (1000, 300)


def test_fonts(spark):
    assert value(spark, fonts.fit_scale(F.lit(20.0), F.lit(None).cast("double"))) == 1.0
    assert value(spark, fonts.glyph_char(F.lit("uni0E01.alt"))) == "ก"
    assert value(spark, fonts.hex_codes(F.array(F.lit(65), F.lit(3)), 2)) == "<00410003>"


def test_files_without_pages_are_skipped(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, ""), (1, 2, 1, 2, ""), (1, 3, 2, 0, "1-2")], "job_id long, file_id long, ord long, page_count int, spec string")
    got = {r.file_id: (r.pages, r.error, r.warning) for r in pages.chosen_pages(rows).collect()}
    assert got == {1: ([], None, "W_FILE_SKIPPED"), 2: ([0, 1], None, None), 3: ([], None, "W_FILE_SKIPPED")}
    assert [r.file_id for r in pages.merge_map(pages.chosen_pages(rows)).collect()] == [2, 2]


def test_tounicode_targets_of_any_length(spark):
    cmap = "beginbfchar <01> <00660069> <02> <D83DDE00> <03> <D83D> <04> <41> endbfchar beginbfrange <10> <11> [<0391> <0392> <0393>] <20> <22> <0041> <30> <2F> <0050> endbfrange"
    rows = spark.createDataFrame([(1, cmap)], "font int, cmap string")
    got = {r.char: r.code for r in fonts.expand_tounicode(rows).collect()}
    assert got == {"fi": 1, "😀": 2, "�": 3, "Α": 16, "Β": 17, "Γ": 18, "A": 32, "B": 33, "C": 34}


def test_width_of_without_a_cross_join(spark):
    glyphs = spark.createDataFrame([(0, "a", 1, 500.0), (0, "b", 2, 250.0), (1, "a", 1, 100.0), (2, "z", 3, 9.0)], "font int, char string, code int, width double")
    texts = spark.createDataFrame([(1, "aab", 10.0), (2, "aa", 10.0), (3, "q", 10.0)], "id int, text string, size double")
    out = fonts.width_of(texts, glyphs)
    assert {(r.id, r.font): r.width for r in out.collect()} == {(1, 0): 12.5, (1, 1): None, (1, 2): None, (2, 0): 10.0, (2, 1): 2.0, (2, 2): None, (3, 0): None, (3, 1): None, (3, 2): None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_online_counts_equal_brute_force(spark):
    import random

    from quire.operators import presence

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", "z", None]), rng.choice([0, 44_999, 45_000, 45_001, rng.randrange(400_000)]), k) for k in range(300)]
    rows += [("a", "x", None, 300), ("c", None, 5, 301)]
    table = spark.createDataFrame(rows, "room string, id string, ms long, row_id long")
    got = {r.row_id: r.online for r in presence.online(table, presence.WINDOW_MS, "room").collect()}
    want = {k: None if ms is None else len({i for q, i, m, _ in rows if q == room and i is not None and m is not None and ms - 45_000 < m <= ms}) for room, _, ms, k in rows}
    assert got == want
    assert {r.row_id for r in presence.online(table).collect()} == set(want)


def test_presence_stream_keeps_and_drops_rooms(spark, tmp_path):
    """Batch by batch as all at once; the state of a room that nobody enters any more goes."""
    from quire.streaming import presence as S

    t = 1_700_000_000_000
    rows = [("a", "x", 0, 1), ("a", "y", 44_999, 2), ("b", "x", 10, 3), ("a", "x", 60_000, 4), ("a", "x", 4_000_000, 5), ("a", "z", 4_000_010, 6), ("b", "q", 4_000_020, 7), ("a", "z", 9_000_000, 8)]
    schema = "room string, id string, ms long, row_id long"
    table = spark.createDataFrame([(q, i, t + m, k) for q, i, m, k in rows], schema)
    source = tmp_path / "in"
    for k, part in enumerate((table.where("row_id <= 3"), table.where("row_id in (4)"), table.where("row_id in (5, 6, 7)"), table.where("row_id = 8"))):
        part.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        out = S.run_to_table(S.online_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    want = {k: len({i for q, i, m, _ in rows if q == room and ms - S.WINDOW_MS < m <= ms}) for room, _, ms, k in rows}
    assert {r.row_id: r.online for r in out.collect()} == want
    state = spark.read.format("statestore").load(str(tmp_path / "check"))
    assert {r.key.room for r in state.collect()} == {"a"}


def test_undo_equals_a_stack(spark):
    import random

    rng = random.Random(3)
    log = [(s, k, rng.choice(["apply", "apply", "undo"]) if s else "undo", 100 * s + k) for s in range(6) for k in range(rng.randint(1, 60))]
    rows = log[:]
    rng.shuffle(rows)
    got = {r.session_id: r.edits for r in text.undo_history(spark.createDataFrame(rows, "session_id int, seq int, op string, edit_id long")).collect()}
    want: dict[int, list[int]] = {}
    for s, _, op, e in log:
        stack = want.setdefault(s, [])
        if op == "apply":
            stack.append(e)
        elif stack:
            stack.pop()
    assert got == want


def test_edits_past_the_end_keep_what_others_put(spark):
    edit = lambda a, b, p: F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(p).alias("put"))
    edits = F.array(edit(9, 11, ""), edit(0, 3, "<A>"), edit(5, 5, "+"))
    rows = ["", "ab", "abcd", "abcdefg", "abcdefghij", "abcdefghijkl", "a😀cdéfghijk\u0301l", None]
    got = spark.createDataFrame([(x,) for x in rows], "t string").select(text.apply_edits(F.col("t"), edits).alias("v")).collect()
    assert [r.v for r in got] == [None if t is None else "<A>" + t[3:5] + "+" + t[5:9] + t[11:] for t in rows]
    # two edits at one place, none at all, a null put
    assert value(spark, text.apply_edits(F.lit("abc"), F.array(edit(1, 1, "2"), edit(1, 1, "1"), edit(1, 2, "B")))) == "a12Bc"
    assert value(spark, text.apply_edits(F.lit("abc"), F.filter(edits, lambda e: e["start"] < 0))) == "abc"
    assert value(spark, text.apply_edits(F.lit("abc"), F.array(edit(1, 2, None), edit(0, 1, "x")))) is None


def test_locate_equals_brute_force(spark):
    import math
    import random

    rng = random.Random(5)
    # a grid of halves has many ties; distances of exactly a tolerance, runs at one place, missing and far places
    spot = lambda: rng.choice([rng.randrange(-40, 40) / 2, rng.uniform(-300, 300), 1e30, -64.0, 0.0, -0.0])
    found = [(page, k * 7 % 101 + 101 * page, None if k % 17 == 3 else spot(), None if k % 19 == 4 else spot()) for page in range(3) for k in range(90)] + [(7, 1, None, None)]
    sizes = [None, -1.0, 3.0, 10.0, 64 / 0.6, 66.0, 126.0, 1e308]
    wanted = [(k, k % 4 if k % 50 else 7, None if k % 23 == 5 else spot(), spot(), sizes[k % 8], [None, -1, 0, 3, 89, 500][k % 6]) for k in range(600)]
    out = fonts.locate(spark.createDataFrame(wanted, "id long, page int, x double, y double, font_size double, ordinal int"), spark.createDataFrame(found, "page int, ord int, fx double, fy double"))

    def want(k, page, x, y, size, ordinal):
        ords = sorted(o for p, o, *_ in found if p == page)
        place = len(ords) - 1 if ordinal is None else min(ordinal, len(ords) - 1)
        near = min(((math.sqrt((fx - x) ** 2 + (fy - y) ** 2), o) for p, o, fx, fy in found if p == page and None not in (fx, fy, x, y)), default=(math.inf, None))
        return k, near[1] if near[0] <= max(2.0, (size or 0) * 0.6) else ords[place] if place >= 0 else None, len(ords)

    assert sorted(tuple(r) for r in out.collect()) == [want(*w) for w in wanted if w[1] != 3]
    # no row for each pair of a wanted and a found run
    assert "windowspecdefinition(id" not in out._jdf.queryExecution().optimizedPlan().toString()
