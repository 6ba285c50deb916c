"""Queries of the page-set operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ranges
from quire.operators import pages as P
from quire.plans import models as M


def _joined(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ",")


def split_extract_merged(spark: SparkSession, sf: str) -> DataFrame:
    return P.extract_merged(M.pages(spark, sf), M.selection(spark, sf))


def split_extract_separate(spark: SparkSession, sf: str) -> DataFrame:
    return P.extract_separate(M.pages(spark, sf), M.selection(spark, sf))


def split_every_n(spark: SparkSession, sf: str) -> DataFrame:
    return P.every_n(M.pages(spark, sf), 3)


def split_remove(spark: SparkSession, sf: str) -> DataFrame:
    return P.remove(M.pages(spark, sf), M.selection(spark, sf))


def split_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return P.split_ranges(P.page_counts(M.pages(spark, sf)), F.lit("2-3, 1, 5-, 40-50, 2 4"))


def split_status(spark: SparkSession, sf: str) -> DataFrame:
    files = P.page_counts(M.pages(spark, sf))
    return P.split_status(files, P.split_ranges(files, F.lit("5-, 7")), "ranges")


def split_outputs(spark: SparkSession, sf: str) -> DataFrame:
    plan = P.every_n(M.pages(spark, sf), 2)
    return P.split_outputs(plan, M.file_names(spark, sf), "<name>-<nn>", "pages", True)


def _order(spark: SparkSession, sf: str) -> DataFrame:
    """Even files: pages backwards with the first twice and one that does not exist."""
    own = M.pages(spark, sf).where("file_id % 2 = 0")
    back = own.select("file_id", (100 - F.col("page_index")).alias("at"), "page_index")
    return back.unionByName(own.where("page_index = 0").select("file_id", F.lit(200).alias("at"), "page_index")).unionByName(own.where("page_index = 0").select("file_id", F.lit(0).alias("at"), F.lit(99).alias("page_index")))


_ORDER = """
select file_id, 100 - page_index as slot, page_index from pg where file_id % 2 = 0
union all select file_id, 200, 0 from pg where file_id % 2 = 0 and page_index = 0
union all select file_id, page_index, page_index from pg where file_id % 2 <> 0
"""
_PG = "pg as (select conv_id as file_id, turn::int as page_index from conversations)"
_FINAL = f"with {_PG}, ord as ({_ORDER}) select file_id, row_number() over (partition by file_id order by slot) - 1 as pos, page_index from ord where not (page_index = 1 and file_id % 3 = 0)"


def _deleted(spark: SparkSession, sf: str) -> DataFrame:
    return M.pages(spark, sf).where("page_index = 1 and file_id % 3 = 0")


def organize_order(spark: SparkSession, sf: str) -> DataFrame:
    return P.final_order(M.pages(spark, sf), _order(spark, sf), _deleted(spark, sf))


def _rotations(spark: SparkSession, sf: str) -> DataFrame:
    return M.pages(spark, sf).where("(file_id + page_index) % 2 = 0").withColumn("quarter", (F.col("file_id") % 6 * 90 - 180).cast("int"))


def organize_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    return P.unchanged(organize_order(spark, sf), P.page_counts(M.pages(spark, sf)), _rotations(spark, sf))


def organize_rotate(spark: SparkSession, sf: str) -> DataFrame:
    return P.rotate(M.pages(spark, sf).withColumn("rotation", (F.col("page_index") * 90 - 90).cast("int")), _rotations(spark, sf))


def page_selectors(spark: SparkSession, sf: str) -> DataFrame:
    own, chosen = M.pages(spark, sf), M.selection(spark, sf)
    out = [P.selector(own, chosen, kind, 3, 1).withColumn("kind", F.lit(kind)) for kind in ("all", "none", "odd", "even", "invert", "range")]
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def page_move(spark: SparkSession, sf: str) -> DataFrame:
    files = P.page_counts(M.pages(spark, sf)).withColumn("order", F.sequence(F.lit(0), F.col("page_count") - 1))
    moves = {"first_to_last": (F.lit(0), F.lit(99)), "last_to_first": (F.col("page_count") - 1, F.lit(-3)), "second_up": (F.lit(1), F.lit(0))}
    cols = [F.array_join(P.move(F.col("order"), a, b).cast("array<string>"), ",").alias(k) for k, (a, b) in moves.items()]
    return files.select("file_id", *cols)


def range_spec_parse(spark: SparkSession, sf: str) -> DataFrame:
    files = P.page_counts(M.pages(spark, sf))
    # the specs are a fixed list of literals
    rows = files.withColumn("s", F.explode(F.array(*(F.struct(F.lit(k).alias("spec_id"), F.lit(s).alias("spec")) for k, s in enumerate(M.SPECS)))))
    rows = rows.withColumn("r", ranges.parse_spec(F.col("s.spec"), F.col("page_count")))
    return rows.select("file_id", "s.spec_id", _joined("r.pages").alias("pages"), F.array_join("r.out_of_bounds", ",").alias("out_of_bounds"), F.col("r.unparsable").alias("unparsable"))


_PARSE = f"""
with files as (select conv_id as file_id, count(*) as n from conversations group by 1),
specs as (select * from {M.SPECS_SQL}),
chunk as (select file_id, spec_id, n, generate_subscripts(cs, 1) as k, unnest(cs) as c from
    (select file_id, spec_id, n, list_filter(regexp_split_to_array(spec, '[,\\s]+'), lambda x: x <> '') as cs from files, specs) where len(cs) > 0),
part as (select *, regexp_matches(c, '^([0-9]+)?(-([0-9]+)?)?$') as ok, regexp_extract(c, '^([0-9]*)', 1) as a, contains(c, '-') as dash, regexp_extract(c, '-([0-9]*)$', 1) as b from chunk),
bound as (select *, case when not ok then null when a = '' then 1 else a::double end as lo,
    case when not ok then null when not dash then a::double when b = '' then n else b::double end as hi from part),
judged as (select *, not ok or lo < 1 or lo > n or hi < lo as bad from bound),
listed as (select file_id, spec_id, string_agg(distinct (p - 1)::bigint::varchar, ',' order by (p - 1)::bigint::varchar) as pages from
    (select file_id, spec_id, unnest(generate_series(lo::bigint, least(hi, n)::bigint)) as p from judged where not bad) group by all),
summed as (select file_id, spec_id, coalesce(string_agg(c, ',' order by k) filter (bad or hi > n), '') as out_of_bounds, bool_and(bad) as unparsable from judged group by all)
select f.file_id, s.spec_id, coalesce(l.pages, '') as pages, coalesce(m.out_of_bounds, '') as out_of_bounds, coalesce(m.unparsable, false) as unparsable
from files f cross join specs s left join listed l on l.file_id = f.file_id and l.spec_id = s.spec_id left join summed m on m.file_id = f.file_id and m.spec_id = s.spec_id
"""


def describe_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") - 1).alias("page_index"))
    return P.describe(rows)


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Five files a job, in reverse order of their ids, with specs of every kind."""
    files = P.page_counts(M.pages(spark, sf))
    spec = F.element_at(F.array(F.lit(None).cast("string"), F.lit("1-2"), F.lit("  "), F.lit("2, 1-"), F.lit("40-"), F.lit("2-90")), (F.col("file_id") % 6 + 1).cast("int"))
    return files.select(F.expr("file_id div 5").alias("job_id"), "file_id", (-F.col("file_id")).alias("ord"), "page_count", spec.alias("spec"))


def merge_page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return P.chosen_pages(_jobs(spark, sf)).select("job_id", "file_id", _joined("pages").alias("pages"), "error", "warning")


def merge_page_map(spark: SparkSession, sf: str) -> DataFrame:
    return P.merge_map(P.chosen_pages(_jobs(spark, sf)))


def merge_bookmarks(spark: SparkSession, sf: str) -> DataFrame:
    return P.merge_bookmarks(P.chosen_pages(_jobs(spark, sf)), M.file_names(spark, sf))


def outline_links(spark: SparkSession, sf: str) -> DataFrame:
    return P.outline_links(merge_bookmarks(spark, sf))


def merge_fit_geometry(spark: SparkSession, sf: str) -> DataFrame:
    sizes = M.read(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), (F.col("p_size") * 20.0 + 100).alias("width"), (F.col("p_partkey") % 50 * 20.0 + 100).alias("height"))
    return P.fit_geometry(sizes, F.lit(P.A4[0]), F.lit(P.A4[1]))


_CHOSEN = f"""{_PG}, jobs as (select file_id // 5 as job_id, file_id, -file_id as ord, n, case file_id % 6 when 1 then '1-2' when 3 then '2, 1-' when 4 then '40-' when 5 then '2-90' end as spec
    from (select file_id, count(*) as n from pg group by 1)),
chosen as (select j.*, p.page_index from jobs j join pg p using (file_id) where spec is null or spec = '1-2' and page_index <= 1 or spec = '2, 1-' or spec = '2-90' and page_index >= 1)"""

QUERIES = {
    f.__name__: f
    for f in (split_extract_merged, split_extract_separate, split_every_n, split_ranges, split_remove, split_status, split_outputs, organize_order, organize_unchanged, organize_rotate, page_selectors, page_move, range_spec_parse, describe_ranges, merge_page_map, merge_bookmarks, merge_page_ranges, merge_fit_geometry, outline_links)
}

ORACLE = {
    "split_extract_merged": f"select file_id, 0 as group_no, row_number() over (partition by file_id order by page_index) - 1 as pos, page_index from ({M.SELECTED})",
    "split_extract_separate": f"select file_id, row_number() over (partition by file_id order by page_index) - 1 as group_no, 0 as pos, page_index from ({M.SELECTED})",
    "split_every_n": "select conv_id as file_id, (turn // 3)::int as group_no, (turn % 3)::int as pos, turn::int as page_index from conversations",
    "split_remove": "select conv_id as file_id, 0 as group_no, row_number() over (partition by conv_id order by turn) - 1 as pos, turn::int as page_index from conversations where (conv_id + turn) % 3 <> 0",
    "split_ranges": """
        with c as (select conv_id, turn, count(*) over (partition by conv_id) as n from conversations),
        g as (select conv_id, turn, n, 0 as g from c where turn in (1, 2) and n >= 2 union all select conv_id, turn, n, 1 from c where turn = 0
            union all select conv_id, turn, n, 2 from c where turn >= 4 union all select conv_id, turn, n, 4 from c where turn in (1, 3))
        select conv_id as file_id, dense_rank() over (partition by conv_id order by g) - 1 as group_no, row_number() over (partition by conv_id, g order by turn) - 1 as pos, turn::int as page_index from g""",
    "split_status": """
        select conv_id as file_id, (count(*) >= 5)::int + (count(*) >= 7)::int as n_groups, case when count(*) < 5 then 'E_RANGE_OUT_OF_BOUNDS' end as error,
            case when count(*) >= 5 then 'W_BOOKMARKS_DROPPED' end as warning from conversations group by 1""",
    "split_outputs": f"""
        with g as (select conv_id as file_id, turn // 2 as group_no, count(*) as pages from conversations group by all), t as (select *, count(*) over (partition by file_id) as total from g),
        n as (select file_id, replace(regexp_replace(file_name, '\\.[^.]*$', ''), ':', '-') as base from ({M.FILE_NAMES}))
        select t.file_id, group_no::int as group_no, base || case when total = 1 then '-pages' else '-' || lpad((group_no + 1)::varchar, len(total::varchar)::int, '0') end || '.pdf' as name, pages, total > 1 as packed
        from t join n on t.file_id = n.file_id""",
    "organize_order": _FINAL,
    "organize_unchanged": f"""
        with fin as ({_FINAL}), n as (select conv_id as file_id, count(*) as n from conversations group by 1),
        s as (select file_id, count(*) as kept, bool_and(pos = page_index) as same from fin group by 1)
        select n.file_id, coalesce(kept, 0) = n and coalesce(same, true) and not (n.file_id % 6 not in (2) and exists (select 1 from conversations c where c.conv_id = n.file_id and (c.conv_id + c.turn) % 2 = 0)) as unchanged
        from n left join s on n.file_id = s.file_id""",
    "organize_rotate": """
        select conv_id as file_id, turn::int as page_index, ((((turn * 90 - 90) + case when (conv_id + turn) % 2 = 0 then conv_id % 6 * 90 - 180 else 0 end) % 360 + 360) % 360)::int as rotation from conversations""",
    "page_selectors": f"""
        with {_PG} select file_id, page_index, 'all' as kind from pg union all select file_id, page_index, 'odd' from pg where page_index % 2 = 0
        union all select file_id, page_index, 'even' from pg where page_index % 2 = 1 union all select file_id, page_index, 'range' from pg where page_index between 1 and 3
        union all select file_id, page_index, 'invert' from pg where (file_id + page_index) % 3 <> 0""",
    "page_move": """
        with f as (select conv_id as file_id, count(*) as n from conversations group by 1)
        select file_id, array_to_string(list_concat(range(1, n), [0]), ',') as first_to_last, array_to_string(list_concat([n - 1], range(0, n - 1)), ',') as last_to_first,
            case when n = 1 then '0' else array_to_string(list_concat([1, 0], range(2, n)), ',') end as second_up from f""",
    "range_spec_parse": _PARSE,
    "describe_ranges": """
        with d as (select distinct l_orderkey as file_id, l_linenumber as p from lineitem), r as (select *, p - row_number() over (partition by file_id order by p) as run from d),
        g as (select file_id, min(p) as a, max(p) as b from r group by file_id, run)
        select file_id, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as ranges from g group by 1""",
    "merge_page_map": f"with {_CHOSEN} select job_id, row_number() over (partition by job_id order by ord, page_index) - 1 as out_index, file_id, page_index from chosen",
    "merge_page_ranges": f"""
        with {_CHOSEN} select j.job_id, j.file_id, coalesce(string_agg(c.page_index::varchar, ',' order by c.page_index), '') as pages,
            case when j.spec = '40-' then 'E_RANGE_OUT_OF_BOUNDS' end as error, case when j.spec = '2-90' and j.n > 1 then 'W_RANGE_CLAMPED' end as warning
        from jobs j left join chosen c on c.file_id = j.file_id group by j.job_id, j.file_id, j.spec, j.n""",
    "merge_bookmarks": f"""
        with {_CHOSEN}, k as (select j.job_id, j.file_id, j.ord, count(c.page_index) as k from jobs j left join chosen c on c.file_id = j.file_id group by all)
        select job_id, ord, regexp_replace(file_name, '\\.[^.]*$', '') as title, coalesce(sum(k) over (partition by job_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint as page_index
        from k join ({M.FILE_NAMES}) n on n.file_id = k.file_id""",
    "merge_fit_geometry": """
        with s as (select p_partkey as page_id, p_size * 20.0::double + 100 as w, p_partkey % 50 * 20.0::double + 100 as h from part), t as (select *, least(595.28::double / w, 841.89::double / h) as scale from s)
        select page_id, scale, (595.28::double - w * scale) / 2 as x, (841.89::double - h * scale) / 2 as y, w <> 595.28::double or h <> 841.89::double as redrawn from t""",
    "outline_links": f"""
        with b as (select conv_id // 5 as job_id, -conv_id as ord, regexp_replace(file_name, '\\.[^.]*$', '') as title from (select distinct conv_id from conversations) c join ({M.FILE_NAMES}) n on n.file_id = c.conv_id)
        select job_id, ord, lag(ord) over w as prev_ord, lead(ord) over w as next_ord, min(ord) over (partition by job_id) as first_ord, max(ord) over (partition by job_id) as last_ord,
            count(*) over (partition by job_id) as entries, array_to_string(list_transform(string_split(title, ''), lambda c: '00' || upper(hex(c))), '') as title_hex
        from b window w as (partition by job_id order by ord)""",
}
