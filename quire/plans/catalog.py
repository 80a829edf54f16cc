"""Named queries over the supplied tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions import text as X
from quire.functions import wire as V
from quire.operators import faults as FA
from quire.operators import job as J
from quire.operators import library as LB
from quire.operators import merge as M
from quire.operators import recall as R
from quire.operators import segments as S
from quire.plans import prompts as P
from quire.plans import render as RE
from quire.sources import images as I
from quire.sources import tables as T
from quire.sources import transcripts as TR
from quire.streaming import progress as ST
from quire.streaming import run as RUN

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents")


# Pieces of SQL that the catalogue shares.
LINES = """lines as (
  select doc_id, unnest(range(len(a))) as row, unnest(a) as line from (
    select doc_id, string_split(regexp_replace(text, '\\r?\\n\\z', ''), chr(10)) as a from documents where text <> ''))"""
RAW = """raws as (
  select doc_id, case mod(doc_id, 6)
    when 0 then '```markdown' || chr(10) || text || chr(10) || '```'
    when 1 then '    ' || replace(text, chr(10), chr(10) || '    ')
    when 2 then replace(text, ' ', '   ')
    when 3 then text || chr(10) || '---UNCERTAIN---' || chr(10) || '- ' || split_part(text, ' ', 1) || chr(10) || '* none' || chr(10) || '• ' || split_part(text, ' ', 2)
    when 4 then '```' || chr(10) || text
    else chr(10) || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || text end as raw from documents)"""
RAW_LINES = f"""{RAW}, raw_lines as (
  select doc_id, unnest(range(len(a))) as row, unnest(a) as line from (
    select doc_id, string_split(regexp_replace(raw, '\\r?\\n\\z', ''), chr(10)) as a from raws where raw <> ''))"""
MARKED = f"""{LINES}, marked as (
  select doc_id, row, case
    when mod(row + doc_id, 11) = 0 then '- ' || line when mod(row + doc_id, 11) = 1 then '---' when mod(row + doc_id, 11) = 2 then '* ' || line
    when mod(row + doc_id, 11) = 3 and mod(doc_id, 3) = 0 then '   - ' || line when mod(row + doc_id, 11) = 4 then '1. ' || line
    when mod(row + doc_id, 11) = 5 and mod(doc_id, 5) = 0 then 'same again' when mod(row + doc_id, 11) = 6 and mod(doc_id, 5) = 0 then ' same again'
    else line end as line from lines)"""
FLAT = "trim(lower(regexp_replace(replace({0}, '[unclear:', ' '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"
NORMAL = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
RUNS = f"""{LINES}, profile as (
  select doc_id, row, 255 - least(255, length(line)) as brightness from lines
), islands as (
  select doc_id, row, row - row_number() over (partition by doc_id order by row) as island from profile where brightness >= 246
), runs as (
  select doc_id, min(row) as lo, max(row) + 1 as hi from islands group by doc_id, island
), pages as (
  select doc_id, count(*) as height, 11 as ceiling from profile group by doc_id
), counted as (
  select *, case when height <= ceiling then 1 else coalesce((select min(n) from range(2, 65) r(n)
    where cast(height as double) / n + 2e0 * (cast(height as double) * (18e0 / 100e0) / (n - 1)) <= ceiling), 64) end as n from pages
)"""
CUTS = f"""recursive {RUNS}, folded as (
  select doc_id, height, n, 0 as i, cast(null as bigint) as cut from counted
  union all
  select f.doc_id, f.height, f.n, f.i + 1, coalesce((
    select m from (select r.lo + (r.hi - r.lo) // 2 as m from runs r where r.doc_id = f.doc_id)
    where m is distinct from f.cut and abs(m - cast(f.height as double) * (f.i + 1) / f.n) <= cast(f.height as double) * 0.15e0
    order by abs(m - cast(f.height as double) * (f.i + 1) / f.n), m limit 1), cast(trunc(cast(f.height as double) * (f.i + 1) / f.n) as bigint))
  from folded f where f.i + 1 < f.n
), cuts as (
  select distinct doc_id, cut from folded where cut is not null
)"""
SECTIONS = f"""{CUTS}, edges as (
  select doc_id, cut, 0 as kind from cuts union all select doc_id, height, 1 from counted
), bases as (
  select e.doc_id, coalesce(lag(cut) over w, 0) as lo, cut as hi, row_number() over w - 1 as idx, count(*) over (partition by e.doc_id) as total, height
  from edges e join counted c on e.doc_id = c.doc_id window w as (partition by e.doc_id order by cut, kind)
), reached as (
  select *, case when total > 1 then cast(trunc(cast(height as double) * 18e0 / 100e0 / (total - 1)) as bigint) else 0 end as reach from bases
), spans as (
  select *, greatest(lo - reach, 0) as t, least(hi + reach, height) as b from reached
), trimmed as (
  select *, case when total > 1 then greatest(b - t - 11, 0) else 0 end as excess from spans
), sections as (
  select doc_id, height, idx, total,
    case when idx = 0 then t when idx + 1 = total then t + excess else t + excess // 2 end as top,
    case when idx = 0 then b - excess when idx + 1 = total then b else b - (excess - excess // 2) end as bottom from trimmed
)"""
PAIRS = f"""{SECTIONS}, read_ as (
  select s.doc_id, s.idx, l.row - s.top as pos, case when mod(l.row - s.top + s.idx, 9) = 0 then line || 'e' else line end as line, s.bottom - s.top as n
  from sections s join lines l on s.doc_id = l.doc_id and l.row >= s.top and l.row < s.bottom
), held as (
  select doc_id, idx, pos, line, n - ended as n from (
    select *, max(case when pos = n - 1 and line = '' then 1 else 0 end) over (partition by doc_id, idx) as ended from read_) where pos < n - ended
), ends as (
  select *, lower(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) as normal, regexp_replace(line, '\\s', '', 'g') = '' as blank from held
), grams as (
  select doc_id, idx, pos, g, count(*) as c from (select doc_id, idx, pos, substr(normal, i, 2) as g from ends, lateral (select unnest(range(1, length(normal))) as i) where pos < 14 or pos >= n - 14) group by all
), met as (
  select b.doc_id, b.idx, a.pos as i, b.pos as j, a.n as n_above, b.n as n_below, a.blank as a_blank, b.blank as b_blank, a.normal as an, b.normal as bn
  from ends a join ends b on a.doc_id = b.doc_id and b.idx = a.idx + 1 and a.pos >= a.n - 14 and b.pos < 14
), common as (
  select b.doc_id, b.idx, a.pos as i, b.pos as j, sum(least(a.c, b.c)) as s from grams a join grams b on a.doc_id = b.doc_id and b.idx = a.idx + 1 and a.g = b.g group by all
), sims as (
  select m.*, case when an = bn then 1e0 when length(an) < 2 or length(bn) < 2 then 0e0 else 2e0 * coalesce(s, 0) / (length(an) + length(bn) - 2) end as sim
  from met m left join common c on m.doc_id = c.doc_id and m.idx = c.idx and m.i = c.i and m.j = c.j
)"""
TURNS = """turns as (
  select conv_id as page, cast(turn as integer) as idx, case when role <> 'system' then text end as text,
    case when role = 'system' then 'failed' when length(text) > 300 then 'truncated' end as lapse from conversations)"""
TREE = """tree as (
  select 'r' || r_regionkey as id, '' as parent, r_name as name, 'folder' as kind, '' as file_type from region
  union all select 'n' || n_nationkey, case when mod(n_nationkey, 6) = 5 then 'trash' else 'r' || n_regionkey end, n_name, 'folder', '' from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey, c_name, 'document', case mod(c_custkey, 3) when 0 then 'pdf' when 1 then 'notebook' else '' end from customer
  union all select 's' || s_suppkey, 'n' || s_nationkey, s_name, 'document', 'epub' from supplier)"""


# ---- lines and raw answers


@query(f"with {LINES} select doc_id, row, line from lines")
def line_rows(spark, sf_dir):
    return T.line_relation(docs_of(spark, sf_dir))


@query(f"""with {RAW_LINES} select r.doc_id, coalesce(min(length(line) - length(regexp_replace(line, '^[ \\t]+', ''))) filter (where trim(line, ' ' || chr(9)) <> ''), 0) as indent
from raws r left join raw_lines l on r.doc_id = l.doc_id group by r.doc_id""")
def common_indent(spark, sf_dir):
    return T.raw_answers(docs_of(spark, sf_dir)).select("doc_id", X.common_indent(X.lines("raw")).cast("long").alias("indent"))


@query(f"""with {RAW} select doc_id, case when starts_with(raw, '```') and contains(raw, chr(10))
  then regexp_replace(regexp_replace(raw, '^[^\\n]*\\n', ''), '```\\s*$', '') else raw end as body from raws""")
def strip_fence(spark, sf_dir):
    return T.raw_answers(docs_of(spark, sf_dir)).select("doc_id", X.strip_fence(F.col("raw")).alias("body"))


@query(f"""with {RAW_LINES} select doc_id, row, regexp_extract(line, '^\\s*') || regexp_replace(regexp_replace(line, '^\\s*', ''), ' {{2,}}', ' ', 'g') as line from raw_lines""")
def collapse_spaces(spark, sf_dir):
    rows = T.raw_answers(docs_of(spark, sf_dir)).select("doc_id", F.posexplode(X.lines("raw")).alias("row", "line"))
    return rows.select("doc_id", "row", X.collapse_spaces(F.col("line")).alias("line"))


# The cleaned texts of ``raws`` (doc_id, raw).
CLEANED = f"""unfenced as (
  select doc_id, case when starts_with(trim(raw, ' ' || chr(10)), '```') and contains(trim(raw, ' ' || chr(10)), chr(10))
    then regexp_replace(regexp_replace(trim(raw, ' ' || chr(10)), '^[^\\n]*\\n', ''), '```\\s*$', '') else raw end as body from raws
), ls as (
  select doc_id, unnest(range(len(a))) as row, unnest(a) as line from (
    select doc_id, string_split(regexp_replace(body, '\\n\\z', ''), chr(10)) as a from unfenced where body <> '')
), tidy as (
  select doc_id, row, regexp_replace(line, '\\s+$', '') as line,
    coalesce(min(length(line) - length(ltrim(line))) filter (where trim(line) <> '') over (partition by doc_id), 0) as common from ls
), cut as (
  select doc_id, row, line, lag(line, 1, '') over (partition by doc_id order by row) as above,
    substr(line, cast(least(common, length(line) - length(ltrim(line))) as bigint) + 1) as rest from tidy
), squeezed as (
  select doc_id, row, regexp_extract(rest, '^\\s*') || regexp_replace(regexp_replace(rest, '^\\s*', ''), ' {{2,}}', ' ', 'g') as line from cut
  where not (line = '' and above = '')
), cleaned as (
  select u.doc_id, coalesce(regexp_replace(string_agg(s.line, chr(10) order by s.row), '^\\n+|\\n+$', '', 'g'), '') as cleaned
  from unfenced u left join squeezed s on u.doc_id = s.doc_id group by u.doc_id
)"""


@query(f"with {RAW}, {CLEANED} select doc_id, cleaned from cleaned")
def clean_text(spark, sf_dir):
    return T.raw_answers(docs_of(spark, sf_dir)).select("doc_id", X.clean("raw").alias("cleaned"))


@query(f"""with {RAW}, footer as (
  select doc_id, raw, strpos(raw, '---UNCERTAIN---') as at_ from raws
), ls as (
  select doc_id, unnest(range(len(a))) as row, unnest(a) as line from (
    select doc_id, string_split(substr(raw, at_ + 15), chr(10)) as a from footer where at_ > 0)
), kept as (
  select doc_id, row, trim(regexp_replace(trim(line), '^[-*• ]+', '')) as d from ls
)
select f.doc_id, length(case when at_ > 0 then substr(raw, 1, at_ - 1) else raw end) as body_chars,
  coalesce((select string_agg(d, '|' order by row) from kept k where k.doc_id = f.doc_id and d <> '' and lower(d) <> 'none' and strlen(d) <= 48), '') as doubts
from footer f""")
def split_footer(spark, sf_dir):
    raws = T.raw_answers(docs_of(spark, sf_dir))
    return raws.select("doc_id", F.length(X.footer_body("raw")).alias("body_chars"), F.array_join(X.doubts("raw"), "|").alias("doubts"))


@query()
def mark_doubts(spark, sf_dir):
    raws = T.raw_answers(docs_of(spark, sf_dir))
    return raws.select("doc_id", X.transcribed("raw").alias("text")).withColumn("marks", X.unclear_count("text"))


@query(f"select doc_id, {FLAT.format('text')} as flat from documents")
def flatten_text(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.flatten("text").alias("flat"))


@query(f"with {LINES} select doc_id, row, {NORMAL.format('line')} as normal from lines")
def normalise_line(spark, sf_dir):
    return T.line_relation(docs_of(spark, sf_dir)).select("doc_id", "row", X.normalise(F.col("line")).alias("normal"))


@query(f"""with {MARKED} select doc_id, row, regexp_matches(line, '^\\s*([-*] |[0-9]*\\. )') as bullet, regexp_matches(line, '^\\s*-{{3,}}\\s*$') as rule,
  lower(trim(line)) in ('', '[blank page]', '[blank]', '[empty]', '[no text]', '[no text detected]') as blank from marked""")
def line_kinds(spark, sf_dir):
    line = F.col("line")
    return T.marked_up(docs_of(spark, sf_dir)).select("doc_id", "row", X.is_bullet(line).alias("bullet"), X.is_rule(line).alias("rule"), X.is_blank_page(line).alias("blank"))


# ---- segmentation


@query(f"with {RUNS} select doc_id, lo as start, hi as \"end\" from runs")
def blank_runs(spark, sf_dir):
    _, gap, layout = T.layout_of_lines()
    return S.blank_runs(T.row_profile(docs_of(spark, sf_dir)), layout.blank_threshold, gap)


def _paged(spark, sf_dir) -> DataFrame:
    ceiling, gap, layout = T.layout_of_lines()
    return S.with_sections(S.pages(T.row_profile(docs_of(spark, sf_dir)), layout.blank_threshold, gap), ceiling)


@query(f"with {RUNS} select doc_id, height, n as sections from counted")
def section_count(spark, sf_dir):
    ceiling, gap, layout = T.layout_of_lines()
    pages = S.pages(T.row_profile(docs_of(spark, sf_dir)), layout.blank_threshold, gap)
    return pages.select("doc_id", "height", L.section_count(F.col("height"), ceiling).alias("sections"))


@query(f"with {CUTS} select c.doc_id, coalesce(string_agg(cut, ',' order by cut), '') as cuts from counted c left join cuts on c.doc_id = cuts.doc_id group by c.doc_id")
def cut_points(spark, sf_dir):
    return _paged(spark, sf_dir).select("doc_id", F.array_join(F.transform("cuts", lambda c: c.cast("string")), ",").alias("cuts"))


@query(f"with {SECTIONS} select doc_id, idx as section, total, top, bottom from sections")
def split_sections(spark, sf_dir):
    return S.section_rows(_paged(spark, sf_dir)).select("doc_id", F.col("index").alias("section"), "total", "top", "bottom")


@query(f"with {SECTIONS} select doc_id, idx as section, idx > 0 as overlaps_above, idx + 1 < total as overlaps_below, bottom - top as height from sections")
def section_edges(spark, sf_dir):
    rows = S.section_rows(_paged(spark, sf_dir))
    return rows.select("doc_id", F.col("index").alias("section"), (F.col("index") > 0).alias("overlaps_above"), (F.col("index") + 1 < F.col("total")).alias("overlaps_below"), (F.col("bottom") - F.col("top")).alias("height"))


@query(f"""with {SECTIONS}, spans2 as (
  select doc_id, top, height, coalesce(max(bottom) over (partition by doc_id order by top, bottom rows between unbounded preceding and 1 preceding), 0) as reached from sections)
select doc_id, reached as from_row, top as to_row from spans2 where top > reached
union all select doc_id, max(bottom), max(height) from sections group by doc_id having max(bottom) < max(height)""")
def coverage_gaps(spark, sf_dir):
    return S.coverage_gaps(S.section_rows(_paged(spark, sf_dir)))


@query("""select p_partkey, w as width, h as height, case when w * h <= 3891200 then w else greatest(cast(trunc(w * sqrt(3891200e0 / (w * h))) as bigint), 1) end as fit_width,
  case when w * h <= 3891200 then h else greatest(cast(trunc(h * sqrt(3891200e0 / (w * h))) as bigint), 1) end as fit_height
from (select p_partkey, p_size * 90 as w, cast(trunc(p_retailprice) as bigint) * 2 as h from part)""")
def fit_to_budget(spark, sf_dir):
    sized = T.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 90).alias("width"), (F.col("p_retailprice").cast("long") * 2).alias("height"))
    fit = L.budget_size(F.col("width"), F.col("height"))
    return sized.select("p_partkey", "width", "height", fit["width"].alias("fit_width"), fit["height"].alias("fit_height"))


@query("""select p_partkey, cast(trunc(sqrt(3891200e0 / greatest(cast(cast(p_size / 10e0 as float) as double), 0.1e0))) as integer) as width from part""")
def render_width(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select("p_partkey", L.render_width(F.col("p_size") / F.lit(10.0)).alias("width"))


@query("""with bytes_ as (
  select doc_id, i, cast('0x' || substr(h, i * 2 + 1, 2) as integer) as v
  from (select doc_id, rpad(hex(encode(text)), cast(ceil(strlen(text) / 48e0) as integer) * 96, '0') as h from documents), lateral (select unnest(range(0, length(h) // 2)) as i))
select doc_id, i // 48 as row, cast(sum(v) // 48 as integer) as brightness from bytes_ group by all""")
def image_profile(spark, sf_dir):
    return I.profile_rows(_text_images(spark, sf_dir), "doc_id")


def _text_images(spark, sf_dir) -> DataFrame:
    """Texts as raw RGB images, 16 pixels wide: the bytes of the text are the pixels, the last row is filled with black."""
    height = F.ceil(F.octet_length(X.text_of("text")) / 48).cast("int")
    data = F.unhex(F.rpad(F.hex(F.encode(X.text_of("text"), "UTF-8")), height * 96, F.lit("0")))
    return docs_of(spark, sf_dir).select("doc_id", F.lit(16).alias("width"), height.alias("height"), F.lit(3).alias("channels"), data.alias("data"))


@query("""select doc_id, 16 as width, h - 1 - mod(doc_id, 3) as height from (select doc_id, cast(ceil(strlen(text) / 48e0) as integer) as h from documents)
where h - 1 > mod(doc_id, 3)""")
def section_png(spark, sf_dir):
    """A section of each text's image as a PNG file, without the first rows and the last; sizes from the file's head."""
    cut = _text_images(spark, sf_dir).withColumn("top", (F.col("doc_id") % 3).cast("int")).withColumn("bottom", F.col("height") - 1)
    made = I.section_png(cut).where("error is null")
    number = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("long")
    return made.select("doc_id", number(17).cast("int").alias("width"), number(21).alias("height"))


# ---- similarity, seams and merging

GRAMS = """pairs as (
  select doc_id, row, {0} as a, {1} as b from (select doc_id, row, line, lead(line) over (partition by doc_id order by row) as below from lines) where below is not null
), grams as (
  select doc_id, row, 'a' as side, substr(a, i, 2) as g from pairs, lateral (select unnest(range(1, length(a))) as i)
  union all select doc_id, row, 'b', substr(b, i, 2) from pairs, lateral (select unnest(range(1, length(b))) as i)
), shared as (
  select doc_id, row, sum(least(ca, cb)) as s, sum(ca + cb) as n from (
    select doc_id, row, g, count(*) filter (where side = 'a') as ca, count(*) filter (where side = 'b') as cb from grams group by all) group by all
)""".format(NORMAL.format("line"), NORMAL.format("below"))


@query(f"""with {LINES}, {GRAMS} select p.doc_id, p.row, round(case when a = b then 1e0 when length(a) < 2 or length(b) < 2 then 0e0 else 2e0 * s / n end, 9) as sim
from pairs p left join shared h on p.doc_id = h.doc_id and p.row = h.row""")
def similarity_adjacent(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select("doc_id", X.lines("text").alias("_l")).select("doc_id", F.posexplode(F.zip_with(F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0))), F.slice("_l", 2, F.greatest(F.size("_l"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("row", "p"))
    return rows.select("doc_id", "row", F.round(X.similarity(F.col("p.a"), F.col("p.b")), 9).alias("sim"))


@query(f"""with {LINES}, normal as (select {NORMAL.format('line')} as w from lines)
select g as bigram, count(*) as n from (select substr(w, i, 2) as g from normal, lateral (select unnest(range(1, length(w))) as i)) group by g""")
def bigram_counts(spark, sf_dir):
    grams = T.line_relation(docs_of(spark, sf_dir)).select(F.explode(X.bigrams(X.normalise(F.col("line")))).alias("bigram"))
    return grams.groupBy("bigram").agg(F.count("*").alias("n"))


def _section_answers(spark, sf_dir) -> DataFrame:
    """(page, index, text): each section of a document as read, with every ninth line misread."""
    paged = _paged(spark, sf_dir).select("doc_id", F.explode("sections").alias("s"))
    docs = docs_of(spark, sf_dir).select("doc_id", X.lines("text").alias("_l"))
    joined = paged.join(docs, "doc_id")
    own = F.transform(F.slice("_l", F.col("s.top") + 1, F.greatest(F.col("s.bottom") - F.col("s.top"), F.lit(0))), lambda x, i: F.when((i + F.col("s.index")) % 9 == 0, F.concat(x, F.lit("e"))).otherwise(x))
    return joined.select(F.col("doc_id").alias("page"), F.col("s.index").alias("index"), F.array_join(own, "\n").alias("text"))


def _pairs(spark, sf_dir) -> DataFrame:
    """(page, index, above, below): neighbouring sections."""
    from pyspark.sql import Window

    answers = _section_answers(spark, sf_dir).withColumn("ls", X.lines("text"))
    return answers.withColumn("above", F.lag("ls").over(Window.partitionBy("page").orderBy("index"))).where("above is not null").select("page", "index", "above", F.col("ls").alias("below"))


@query(f"with {PAIRS} select doc_id as page, idx as \"index\", i, j, round(sim, 6) as sim from sims where sim >= 0.8e0")
def seam_pairs(spark, sf_dir):
    c = M.seam_candidates(_pairs(spark, sf_dir))
    return c.where(F.col("sim") >= M.ANCHOR).select("page", "index", "i", "j", F.round("sim", 6).alias("sim"))


@query(f"""with {PAIRS}, steps as (
  select *, a_blank and b_blank as blank, (a_blank and b_blank) or sim >= 0.62e0 as goes, i - j as diagonal from sims
), blocks as (
  select *, sum(case when goes then 0 else 1 end) over (partition by doc_id, idx, diagonal order by i) as block from steps
), runs2 as (
  select *, sum(case when goes then 1 else 0 end) over w as run, sum(case when goes and not blank then 1e0 else 0e0 end) over w as vouched,
    sum(case when goes and not blank then sim else 0e0 end) over w as agreed
  from blocks window w as (partition by doc_id, idx, diagonal, block order by i rows between current row and unbounded following)
), scored as (
  select *, round(vouched * 2 + agreed + cast(i as double) / greatest(n_above, 1) + (1 - cast(j as double) / greatest(n_below, 1)) * 0.5e0, 6) as score from runs2 where not a_blank and sim >= 0.8e0
), ranked as (
  select *, row_number() over (partition by doc_id, idx order by score desc, i, j) as rn from scored
)
select doc_id as page, idx as "index", i + run as keep, j + run as resume, score from ranked where rn = 1""")
def best_seam(spark, sf_dir):
    return M.best_seams(_pairs(spark, sf_dir))


@query()
def merge_pages(spark, sf_dir):
    return M.merge_pages(_section_answers(spark, sf_dir))


@query()
def merge_conversations(spark, sf_dir):
    return M.merge_pages(T.conversation_answers(spark, sf_dir))


# Copied blocks and all faults, over ``texts`` (doc_id, text), ``tl`` (doc_id, row, line) and ``full_``.
COPIES = """meaty as (
  select doc_id, row, row_number() over (partition by doc_id order by row) as k, lower(regexp_replace(line, '[^\\p{L}\\p{N}]', '', 'g')) as w from tl
  where strlen(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) > 8
), mgrams as (
  select doc_id, k, g, count(*) as c from (select doc_id, k, substr(w, i, 2) as g from meaty, lateral (select unnest(range(1, length(w))) as i)) group by all
), close_ as (
  select a.doc_id, a.k as p, b.k as q, a.w as aw, b.w as bw from meaty a join meaty b on a.doc_id = b.doc_id and b.k >= a.k + 3
  where a.w = b.w or (length(a.w) > 1 and length(b.w) > 1 and 20 * (least(length(a.w), length(b.w)) - 1) > 9 * (length(a.w) + length(b.w) - 2))
), alike as (
  select c.doc_id, c.p, c.q from close_ c left join mgrams x on x.doc_id = c.doc_id and x.k = c.p and c.aw <> c.bw left join mgrams y on y.doc_id = c.doc_id and y.k = c.q and y.g = x.g
  group by c.doc_id, c.p, c.q, c.aw, c.bw having c.aw = c.bw or 2e0 * sum(case when y.c is null then 0 else least(x.c, y.c) end) / (length(c.aw) + length(c.bw) - 2) > 0.9e0
), blocks_ as (
  select a.doc_id, a.p, a.q, row_number() over (partition by a.doc_id order by a.p, a.q) as rn
  from alike a join alike b on a.doc_id = b.doc_id and b.p = a.p + 1 and b.q = a.q + 1 join alike c on a.doc_id = c.doc_id and c.p = a.p + 2 and c.q = a.q + 2
), copied as (
  select b.doc_id, m.row as first_, n.row as second_ from blocks_ b join meaty m on b.doc_id = m.doc_id and b.p = m.k join meaty n on b.doc_id = n.doc_id and b.q = n.k where rn = 1
)"""
PLAIN_TEXT = f"""{LINES}, texts as (select doc_id, coalesce(text, '') as text from documents), tl as (select * from lines),
full_ as (select *, lag(line) over w as before, lead(line) over w as after from tl where trim(line) <> '' window w as (partition by doc_id order by row))"""
BROKEN = f"""{COPIES}, broken as (
  select doc_id, 1 as n, 'not empty' as rule from texts where trim(text, ' ' || chr(10)) = ''
  union select doc_id, 2, 'no code fence' from texts where starts_with(ltrim(text), '```')
  union select doc_id, 3, 'no preamble' from full_ where before is null and regexp_matches(lower(trim(line)), '^(here is|here''s|sure,|certainly|i''ve transcribed|the transcription|below is)')
  union select doc_id, 4, 'no rule between bullets' from full_ where regexp_matches(line, '^\\s*-{{3,}}\\s*$') and regexp_matches(before, '^\\s*([-*] |[0-9]*\\. )') and regexp_matches(after, '^\\s*([-*] |[0-9]*\\. )')
  union select doc_id, 5, 'nesting in twos' from tl where regexp_matches(line, '^\\s*([-*] |[0-9]*\\. )') and mod(length(line) - length(ltrim(line)), 2) <> 0
  union select doc_id, 6, 'no repetition loop' from (select doc_id, trim(line) as t, trim(lead(line) over w) as t1, trim(lead(line, 2) over w) as t2, trim(lead(line, 3) over w) as t3 from tl window w as (partition by doc_id order by row)) where t <> '' and t = t1 and t = t2 and t = t3
  union select doc_id, 7, 'no duplicated seam' from copied
), faulted as (
  select t.doc_id, coalesce(string_agg(rule, '; ' order by n), '') as faults from texts t left join broken b on t.doc_id = b.doc_id group by t.doc_id
)"""


# ---- the run

#: The prompt of every section of a relation like ``turns``.
PROMPTS_OF = """numbered as (
  select *, lag(text) over (partition by page order by idx) as previous, count(*) over (partition by page) as total from {0}
), ls as (
  select page, idx, unnest(range(len(a))) as row, unnest(a) as line from (select page, idx, string_split(previous, chr(10)) as a from numbered where previous <> '')
), full_ as (
  select *, row_number() over (partition by page, idx order by row desc) as back from ls where regexp_replace(line, '\\s', '', 'g') <> ''
), tails as (
  select page, idx, string_agg(line, chr(10) order by row) as tail from full_ where back <= 10 group by all
), prompts as (
  select n.page, n.idx as section, 'Write down what this image says as Markdown, line by line.' || chr(10) || case when total <= 1 then '' else chr(10)
  || case when n.idx = 0 then 'Top section' when n.idx + 1 >= total then 'Bottom section' else 'Middle section' end || ', ' || (n.idx + 1) || ' of ' || total || '.' || chr(10)
  || case when n.idx = 0 then 'The last line may be cut; leave it to the next section.' when n.idx + 1 >= total then 'The first lines were read already; go on after them.'
     else 'The first lines were read already and the last line may be cut.' end || chr(10)
  || case when n.idx > 0 and tail is not null then chr(10) || 'The section above ended so:' || chr(10) || '```' || chr(10) || tail || chr(10) || '```' || chr(10) else '' end end as prompt
from numbered n left join tails t on n.page = t.page and n.idx = t.idx)"""
PROMPTS = f"{TURNS}, {PROMPTS_OF.format('turns')}"



@query(f"with {TURNS} select page, idx as section, lag(text) over (partition by page order by idx) as previous from turns")
def previous_context(spark, sf_dir):
    return J.previous_text(T.conversation_answers(spark, sf_dir)).select("page", F.col("index").alias("section"), "previous")


@query(f"""with {TURNS}, ls as (
  select page, idx, unnest(range(len(a))) as row, unnest(a) as line from (select page, idx, string_split(text, chr(10)) as a from turns where text <> '')
), full_ as (
  select *, row_number() over (partition by page, idx order by row desc) as back from ls where regexp_replace(line, '\\s', '', 'g') <> ''
)
select t.page, t.idx as section, string_agg(f.line, chr(10) order by f.row) as tail from turns t left join full_ f on t.page = f.page and t.idx = f.idx and back <= 10 group by all""")
def context_tail(spark, sf_dir):
    return T.conversation_answers(spark, sf_dir).select("page", F.col("index").alias("section"), X.tail_lines("text").alias("tail"))


@query(f"with {PROMPTS} select page, section, prompt from prompts")
def section_prompt(spark, sf_dir):
    from pyspark.sql import Window

    told = J.previous_text(T.conversation_answers(spark, sf_dir)).withColumn("total", F.count("*").over(Window.partitionBy("page")))
    return told.select("page", F.col("index").alias("section"), P.for_section(F.col("index"), F.col("total"), F.col("previous")).alias("prompt"))


OFFSETS = f"""{TURNS}, counts as (select page, count(*) as sections from turns group by page), offsets as (
  select mod(page, 50) as grp, page, sections, cast(coalesce(sum(sections) over (partition by mod(page, 50) order by page rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from counts)"""


@query(f"with {OFFSETS} select grp, page, sections, \"offset\" from offsets")
def section_offsets(spark, sf_dir):
    return J.section_offsets(J.section_counts(T.conversation_answers(spark, sf_dir)), F.col("page") % 50)


@query(f"with {OFFSETS} select grp, \"offset\" + w as nth, page, w as within from offsets, lateral (select unnest(range(sections)) as w)")
def locate_section(spark, sf_dir):
    return J.located(J.section_offsets(J.section_counts(T.conversation_answers(spark, sf_dir)), F.col("page") % 50))


@query(f"""with {TURNS} select page, count(*) filter (where text is not null or lapse is not null) as done, count(*) as total,
  min(idx) filter (where text is null and lapse is null) as next_index, cast(count(*) filter (where text is not null or lapse is not null) as double) / count(*) as fraction from turns group by page""")
def progress(spark, sf_dir):
    return J.progress(T.conversation_answers(spark, sf_dir))


@query(f"""with {TURNS} select page, count(*) filter (where lapse = 'failed') as failed, count(*) filter (where lapse = 'truncated') as truncated,
  coalesce(string_agg(idx, ',' order by idx) filter (where lapse is not null), '') as lapsed from turns group by page""")
def lapse_summary(spark, sf_dir):
    return J.lapse_summary(T.conversation_answers(spark, sf_dir))


@query(f"""with {TURNS} select page, count(text) as answered, count(lapse) as lapsed, cast(coalesce(sum(length(text)), 0) as bigint) as characters from turns group by page""")
def stream_progress(spark, sf_dir):
    """The conversations as a stream of answers; an extension."""
    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType().add("conv_id", LongType()).add("turn", LongType()).add("role", StringType()).add("text", StringType())
    stream = T.answers_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque?"))  # a glob takes a file as well as a folder
    return ST.run_once(spark, ST.page_progress(stream), T.shared_folder(spark, "stream"))


@query(f"""with {TURNS} select page, cast(count(*) as integer) as total, cast(count(*) filter (where text is not null or lapse is not null) as integer) as done,
  cast(count(*) filter (where lapse = 'failed') as integer) as failed, cast(count(*) filter (where lapse = 'truncated') as integer) as truncated,
  cast(min(idx) filter (where text is null and lapse is null) as integer) as "index", coalesce(bool_or(regexp_replace(text, '\\s', '', 'g') <> ''), false) as answered from turns group by page""")
def stream_run(spark, sf_dir):
    """The conversations as a run that goes on by itself, up to each page's first section that nothing came for."""
    folder, kind = T.shared_folder(spark, "run"), "conv_id long, turn long, role string, text string"
    stream = T.answers_of(spark.readStream.schema(kind).parquet(f"{sf_dir}/conversations.parque?"))
    plan = J.section_counts(T.conversation_answers(spark, sf_dir)).select("page", F.col("sections").cast("int").alias("total"))
    RUN.run_available(spark, RUN.follow(stream, plan), folder)
    return RUN.latest(spark, folder).select("page", "total", "done", "failed", "truncated", "index", (F.col("text") != "").alias("answered"))


@query(f"""with {TURNS}, raws as (select page || ':' || idx as doc_id, text as raw from turns where text is not null), {CLEANED}
select page, idx as section, cleaned as text, lapse from turns left join cleaned on doc_id = page || ':' || idx""")
def accepted_lapses(spark, sf_dir):
    """Every turn as a section whose answer arrived whole, in part or not at all."""
    turns = T.conversation_answers(spark, sf_dir)
    taken = J.accept_lapses(turns.select("page", "index"), turns.select("page", "index", F.col("text").alias("raw"), "lapse"))
    return taken.select("page", F.col("index").alias("section"), "text", "lapse")


@query(f"""with {TURNS}, cut as (select page, idx, case when idx < mod(page, 4) then text end as text, case when idx < mod(page, 4) then lapse end as lapse from turns), {PROMPTS_OF.format('cut')},
waiting as (select page, min(idx) as idx from cut where text is null and lapse is null group by page)
select p.page, p.section, p.prompt from prompts p join waiting w on p.page = w.page and p.section = w.idx""")
def next_step(spark, sf_dir):
    """The next section to ask for on pages that were read up to some section."""
    known = lambda c: F.when(F.col("index") < F.col("page") % 4, F.col(c)).alias(c)
    return J.next_steps(T.conversation_answers(spark, sf_dir).select("page", "index", known("text"), known("lapse"))).select("page", F.col("index").alias("section"), "prompt")


def _finished(spark, sf_dir) -> DataFrame:
    """Fifty documents whose pages are conversations."""
    pages = J.merged_pages(T.conversation_answers(spark, sf_dir)).withColumn("source", F.concat(F.lit("scan "), (F.col("page") % 50).cast("string")))
    return J.finish(pages, F.col("page") % 50, F.lit("m"), F.lit("2024-01-02T03:04:05Z"))


@query(f"""with {TURNS}, pages as (select page, count(*) as sections, coalesce(bool_or(regexp_replace(text, '\\s', '', 'g') <> ''), false) as answered from turns group by page)
select mod(page, 50) as grp, 'scan ' || mod(page, 50) as source, cast(row_number() over (partition by mod(page, 50) order by page) as integer) as number, cast(sections as integer) as sections, answered from pages""")
def finish(spark, sf_dir):
    rows = _finished(spark, sf_dir).select("grp", "source", F.inline("pages"))
    return rows.select("grp", "source", "number", "sections", (F.col("text") != "").alias("answered"))


@query()
def finished_text(spark, sf_dir):
    return _finished(spark, sf_dir).select("grp", RE.body().alias("body"))


@query()
def accepted_answers(spark, sf_dir):
    turns = T.conversation_answers(spark, sf_dir)
    raw = T.raw_answers(turns.where("text is not null").select(F.col("page").alias("doc_id"), "index", "text"), "index")
    return J.accept(turns.select("page", "index"), raw.select(F.col("doc_id").alias("page"), "index", "raw"))


# ---- evaluation

HITS = f"""flat as (select doc_id, {FLAT.format('text')} as f from documents), asked as (select item_id, {FLAT.format('text')} as a from benchmark),
hits as (select doc_id, item_id, contains(f, a) or contains(replace(f, ' ', ''), replace(a, ' ', '')) as found from flat, asked)"""


@query(f"with {HITS} select doc_id, item_id from hits where found")
def anchor_hits(spark, sf_dir):
    return R.found_anchors(R.anchor_hits(docs_of(spark, sf_dir), T.table(spark, sf_dir, "benchmark")))


@query(f"with {HITS} select doc_id, count(*) filter (where found) as found, count(*) as total, cast(count(*) filter (where found) as double) / count(*) as fraction from hits group by doc_id")
def recall_by_document(spark, sf_dir):
    return R.recall(R.anchor_hits(docs_of(spark, sf_dir), T.table(spark, sf_dir, "benchmark")))


@query(f"with {HITS} select doc_id, coalesce(string_agg(item_id, ',' order by item_id) filter (where not found), '') as missing from hits group by doc_id")
def missing_anchors(spark, sf_dir):
    return R.missing(R.anchor_hits(docs_of(spark, sf_dir), T.table(spark, sf_dir, "benchmark")))


@query(f"""with {PROMPTS}, keyed as (select page * 1000000 + section as doc_id, {FLAT.format('prompt')} as f from prompts),
asked as (select conv_id * 1000000 + turn as item_id, {FLAT.format('text')} as a from conversations where text <> '')
select doc_id, item_id from keyed, asked where contains(f, a) or contains(replace(f, ' ', ''), replace(a, ' ', ''))""")
def leak_guard(spark, sf_dir):
    """Which prompts give away a turn's text, however short: those that quote the whole of it as context do."""
    key = lambda a, b: (F.col(a) * 1_000_000 + F.col(b))
    prompts = section_prompt(spark, sf_dir).select(key("page", "section").alias("doc_id"), F.col("prompt").alias("text"))
    turns = T.table(spark, sf_dir, "conversations").where("text <> ''")
    return R.found_anchors(R.anchor_hits(prompts, turns.select(key("conv_id", "turn").alias("item_id"), "text")))


@query(f"""with asked as (select text from benchmark union all select text from documents)
select {FLAT.format('text')} as anchor, count(*) as n from asked group by 1 having count(*) > 1""")
def repeated_anchors(spark, sf_dir):
    return R.repeated(T.table(spark, sf_dir, "benchmark").select("text").unionAll(docs_of(spark, sf_dir).select("text")))


@query("select doc_id, source from documents where contains(source, '1')")
def case_filter(spark, sf_dir):
    return FA.cases(docs_of(spark, sf_dir).select("doc_id", "source"), "1", "source")


MARKED_TEXT = f"""{MARKED}, texts as (
  select d.doc_id, case mod(d.doc_id, 7) when 0 then 'Here is the page:' || chr(10) when 1 then '```' || chr(10) else '' end
    || coalesce((select string_agg(line, chr(10) order by row) from marked m where m.doc_id = d.doc_id), '') as text from documents d
), tl as (
  select doc_id, unnest(range(len(a))) as row, unnest(a) as line from (select doc_id, string_split(regexp_replace(text, '\\r?\\n\\z', ''), chr(10)) as a from texts where text <> '')
), full_ as (select *, lag(line) over w as before, lead(line) over w as after from tl where trim(line) <> '' window w as (partition by doc_id order by row))"""


@query(f"with {MARKED_TEXT} select doc_id, starts_with(ltrim(text), '```') as fence from texts")
def fault_fence(spark, sf_dir):
    return FA.fault_details(T.marked_up_text(docs_of(spark, sf_dir))).select("doc_id", "fence")


@query(f"""with {MARKED_TEXT} select t.doc_id, (select trim(line) from full_ f where f.doc_id = t.doc_id and f.before is null
  and regexp_matches(lower(trim(line)), '^(here is|here''s|sure,|certainly|i''ve transcribed|the transcription|below is)')) as preamble from texts t""")
def fault_preamble(spark, sf_dir):
    return FA.fault_details(T.marked_up_text(docs_of(spark, sf_dir))).select("doc_id", "preamble")


@query(f"""with {MARKED_TEXT}, hit as (select doc_id, min(row) as r from full_ where regexp_matches(line, '^\\s*-{{3,}}\\s*$')
  and regexp_matches(before, '^\\s*([-*] |[0-9]*\\. )') and regexp_matches(after, '^\\s*([-*] |[0-9]*\\. )') group by doc_id)
select t.doc_id, r as rule_at from texts t left join hit on t.doc_id = hit.doc_id""")
def fault_rule(spark, sf_dir):
    return FA.fault_details(T.marked_up_text(docs_of(spark, sf_dir))).select("doc_id", "rule_at")


@query(f"""with {MARKED_TEXT}, hit as (select doc_id, row, length(line) - length(ltrim(line)) as indent from tl where regexp_matches(line, '^\\s*([-*] |[0-9]*\\. )'))
select t.doc_id, arg_min(row, row) filter (where mod(indent, 2) <> 0) as odd_at, arg_min(indent, row) filter (where mod(indent, 2) <> 0) as odd_indent
from texts t left join hit on t.doc_id = hit.doc_id group by t.doc_id""")
def fault_indent(spark, sf_dir):
    return FA.fault_details(T.marked_up_text(docs_of(spark, sf_dir))).select("doc_id", "odd_at", "odd_indent")


@query(f"""with {LINES}, islands as (
  select doc_id, row, trim(line) as t, sum(case when trim(line) = coalesce(below, '') and trim(line) <> '' then 0 else 1 end) over (partition by doc_id order by row) as island
  from (select *, trim(lag(line) over (partition by doc_id order by row)) as below from lines)
), hit as (select doc_id, min(row) as r, count(*) as n from islands where t <> '' group by doc_id, island having count(*) >= 4)
select d.doc_id, min(r) as repeat_at from documents d left join hit on d.doc_id = hit.doc_id group by d.doc_id""")
def fault_repetition(spark, sf_dir):
    return FA.fault_details(docs_of(spark, sf_dir)).select("doc_id", "repeat_at")


@query(f"with {PLAIN_TEXT}, {COPIES} select t.doc_id, first_ || ',' || second_ as places from texts t left join copied c on t.doc_id = c.doc_id")
def fault_duplicate(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.array_join(F.transform(FA.duplicated_block(X.lines("text")), lambda x: x.cast("string")), ",").alias("places"))


@query(f"with {MARKED_TEXT}, {BROKEN} select doc_id, faults from faulted")
def faults(spark, sf_dir):
    named = FA.fault_names(FA.fault_details(T.marked_up_text(docs_of(spark, sf_dir))))
    return named.select("doc_id", F.array_join("faults", "; ").alias("faults"))


@query(f"""with {RAW} select doc_id, (length(raw || '[unclear: ' || split_part(raw, ' ', 1) || ']') - length(replace(raw || '[unclear: ' || split_part(raw, ' ', 1) || ']', '[unclear:', ''))) // 9 as marks from raws""")
def unclear_count(spark, sf_dir):
    raws = T.raw_answers(docs_of(spark, sf_dir)).withColumn("raw", F.concat("raw", F.lit("[unclear: "), F.split_part("raw", F.lit(" "), F.lit(1)), F.lit("]")))
    return raws.select("doc_id", X.unclear_count("raw").alias("marks"))


def _scores(spark, sf_dir) -> tuple[DataFrame, R.Hits]:
    docs = docs_of(spark, sf_dir)
    hits = R.anchor_hits(docs, T.table(spark, sf_dir, "benchmark"))
    expected = T.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("expected"))
    return FA.grade(docs, R.recall_by_row(hits), expected), hits


SCORES = f"""{PLAIN_TEXT}, {BROKEN}, {HITS}, scored as (
  select f.doc_id, f.faults, h.fraction, coalesce(l.quality = 0, false) and not contains(t.text, '[unclear:') and trim(t.text, ' ' || chr(10)) <> '' as warned,
    (length(t.text) - length(replace(t.text, '[unclear:', ''))) // 9 as uncertainty, length(t.text) as characters, f.faults = '' and h.fraction >= 0.85e0 as passed
  from faulted f join texts t on f.doc_id = t.doc_id join (select doc_id, cast(count(*) filter (where found) as double) / count(*) as fraction from hits group by doc_id) h on f.doc_id = h.doc_id
  left join labels l on f.doc_id = l.doc_id)"""


@query(f"with {SCORES} select doc_id, fraction, faults, warned, uncertainty, characters, passed from scored")
def grade(spark, sf_dir):
    return _scores(spark, sf_dir)[0].drop("_row", "found", "total")


@query(f"""with {SCORES}, told as (select doc_id, count(*) filter (where found) as found, count(*) as total, string_agg(item_id, ',' order by item_id) filter (where not found) as missing from hits group by doc_id)
select s.doc_id, case when passed then 'PASS' else 'FAIL' end as verdict, 'recall ' || found || '/' || total || ' (' || cast(floor(fraction * 100 + 0.5e0) as bigint) || '%), ' || characters || ' chars, ' || uncertainty || ' unclear'
  || case when faults <> '' then chr(10) || 'faults: ' || faults else '' end || case when warned then chr(10) || 'warning: doubts expected, none marked' else '' end
  || case when missing is not null then chr(10) || 'missed: ' || missing else '' end as said from scored s join told t on s.doc_id = t.doc_id""")
def announce(spark, sf_dir):
    scores, hits = _scores(spark, sf_dir)
    return FA.announce(scores, R.missing_by_row(hits))


@query(f"with {SCORES} select count(*) filter (where passed) as passed, count(*) as total, round(avg(fraction), 9) as mean_recall from scored")
def report(spark, sf_dir):
    return FA.report(_scores(spark, sf_dir)[0])


# ---- rendering

PAGED = f"""{LINES}, parts as (
  select doc_id, row // 40 + 1 as number, string_agg(line, chr(10) order by row) as text from lines group by all
), paged as (
  select d.doc_id, source, lang, coalesce(number, 1) as number, trim(coalesce(p.text, ''), ' ' || chr(10)) as text, count(*) over (partition by d.doc_id) as n from documents d left join parts p on d.doc_id = p.doc_id)"""


@query(f"with {PAGED} select doc_id, coalesce(string_agg(text, chr(10) || chr(10) order by number) filter (where text <> ''), '') as body from paged group by doc_id")
def body(spark, sf_dir):
    return RE.paged(docs_of(spark, sf_dir)).select("doc_id", RE.body().alias("body"))


@query(f"""with {PAGED} select doc_id, '---' || chr(10) || 'source: ' || to_json(any_value(source))::varchar || chr(10) || 'processed: 2024-01-02T03:04:05Z' || chr(10) || 'pages: ' || any_value(n) || chr(10)
  || 'model: ' || to_json(any_value(lang))::varchar || chr(10) || '---' || chr(10) || chr(10)
  || string_agg(case when n > 1 then '## Page ' || number || chr(10) || chr(10) else '' end || text || chr(10), chr(10) || chr(10) order by number) as out from paged group by doc_id""")
def render_markdown(spark, sf_dir):
    return RE.paged(docs_of(spark, sf_dir)).select("doc_id", RE.markdown().alias("out"))


@query(f"""with {PAGED} select doc_id, rtrim(any_value(source) || ' — transcribed 2024-01-02T03:04:05Z' || chr(10) || chr(10)
  || string_agg(case when n > 1 then '--- Page ' || number || ' ---' || chr(10) || chr(10) else '' end || text || chr(10) || chr(10), '' order by number), ' ' || chr(10)) || chr(10) as out from paged group by doc_id""")
def render_text(spark, sf_dir):
    return RE.paged(docs_of(spark, sf_dir)).select("doc_id", RE.plain_text().alias("out"))


@query(f"with {PAGED} select doc_id, any_value(source) as source, any_value(lang) as model, any_value(n) as pages, string_agg(number || ':' || text, chr(10) order by number) as texts from paged group by doc_id")
def render_json(spark, sf_dir):
    made = RE.paged(docs_of(spark, sf_dir)).select("doc_id", RE.json().alias("j"))
    parsed = F.from_json("j", f"struct<source:string,model:string,processed:string,pages:{RE.PAGES}>")
    texts = F.array_join(F.transform("p.pages", lambda x: F.concat(x["number"].cast("string"), F.lit(":"), X.trim(x["text"]))), "\n")
    return made.select("doc_id", parsed.alias("p")).select("doc_id", "p.source", "p.model", F.size("p.pages").alias("pages"), texts.alias("texts"))


@query(f"""with {PAGED}, made as (select doc_id, any_value(source) as source, '---' || chr(10) || 'source: ' || to_json(any_value(source))::varchar || chr(10) || 'processed: 2024-01-02T03:04:05Z' || chr(10) || 'pages: ' || any_value(n) || chr(10)
  || 'model: ' || to_json(any_value(lang))::varchar || chr(10) || '---' || chr(10) || chr(10)
  || string_agg(case when n > 1 then '## Page ' || number || chr(10) || chr(10) else '' end || text || chr(10), chr(10) || chr(10) order by number) as body from paged group by doc_id)
select doc_id, source || '.md' as name, body from made""")
def saved_documents(spark, sf_dir):
    """Every document written to a file of its own, and the files read back by the lists of the tasks that wrote them."""
    folder = T.shared_folder(spark, "saved")
    rendered = RE.paged(docs_of(spark, sf_dir)).select("doc_id", RE.filename(F.col("source"), F.lit("markdown")).alias("name"), RE.markdown().alias("body"))
    TR.save(rendered, folder)
    return TR.load(spark, folder)


@query(f"with {PAGED} select doc_id as grp, coalesce(string_agg(text, chr(10) || chr(10) order by number) filter (where text <> ''), '') as text from paged group by doc_id")
def text_so_far(spark, sf_dir):
    pages = RE.paged(docs_of(spark, sf_dir)).select("doc_id", F.inline("pages")).select("doc_id", F.col("number").alias("page"), X.trim(F.col("text")).alias("text"))
    return J.text_so_far(pages, F.col("doc_id"))


@query("select doc_id, case when mod(doc_id, 4) = 0 then 'transcript' else source end || case mod(doc_id, 3) when 0 then '.md' when 1 then '.json' else '.txt' end as name from documents")
def filename(spark, sf_dir):
    fmt = F.when(F.col("doc_id") % 3 == 0, "markdown").when(F.col("doc_id") % 3 == 1, "json").otherwise("text")
    return docs_of(spark, sf_dir).select("doc_id", RE.filename(F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).otherwise(F.col("source")), fmt).alias("name"))


@query("""select page_id, coalesce(nullif(trim(regexp_replace(trim(replace(url, '/', '-')), '^\\.+|\\.+$', '', 'g')), ''), 'Untitled') as name from pages""")
def safe_filename(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", X.safe_filename("url").alias("name"))


@query("select page_id, regexp_replace(trim(url), '/+$', '') as url from pages")
def trimmed_url(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", X.base_url("url").alias("url"))


@query("select doc_id, 'data:image/png;base64,' || base64(encode(text)) as url from documents")
def data_url(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", V.data_url(F.encode("text", "UTF-8")).alias("url"))


@query("select doc_id, case when mod(doc_id, 2) = 0 then lang end as model, text as prompt, source as url, 4096 as max_tokens, false as stream from documents")
def chat_request(spark, sf_dir):
    made = docs_of(spark, sf_dir).select("doc_id", V.chat_request(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("text"), F.col("source")).alias("j"))
    at = lambda p: F.get_json_object("j", p)
    return made.select("doc_id", at("$.model").alias("model"), at("$.messages[0].content[0].text").alias("prompt"), at("$.messages[0].content[1].image_url.url").alias("url"), at("$.max_tokens").cast("int").alias("max_tokens"), at("$.stream").cast("boolean").alias("stream"))


# ---- the device's library


def _tree(spark, sf_dir) -> DataFrame:
    """Regions, nations and their customers and suppliers as a folder tree with some folders in the trash."""
    t = lambda n: T.table(spark, sf_dir, n)
    row = lambda d, i, p, n, k, f: d.select(i.alias("id"), p.alias("parent"), n.alias("name"), F.lit(k).alias("kind"), f.alias("file_type"))
    key = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    nation_parent = F.when(F.col("n_nationkey") % 6 == 5, F.lit("trash")).otherwise(key("r", "n_regionkey"))
    kind = F.when(F.col("c_custkey") % 3 == 0, F.lit("pdf")).when(F.col("c_custkey") % 3 == 1, F.lit("notebook")).otherwise(F.lit(""))
    return (
        row(t("region"), key("r", "r_regionkey"), F.lit(""), F.col("r_name"), "folder", F.lit(""))
        .unionByName(row(t("nation"), key("n", "n_nationkey"), nation_parent, F.col("n_name"), "folder", F.lit("")))
        .unionByName(row(t("customer"), key("c", "c_custkey"), key("n", "c_nationkey"), F.col("c_name"), "document", kind))
        .unionByName(row(t("supplier"), key("s", "s_suppkey"), key("n", "s_nationkey"), F.col("s_name"), "document", F.lit("epub")))
    )


@query(f"""with recursive {TREE}, reached as (
  select id, 0 as depth, name as path, kind = 'folder' as open_ from tree where parent = ''
  union all select t.id, r.depth + 1, r.path || '/' || t.name, t.kind = 'folder' from tree t join reached r on t.parent = r.id and r.open_)
select id, depth, path from reached""")
def library_walk(spark, sf_dir):
    return LB.walk(_tree(spark, sf_dir))


@query(f"""with {TREE} select id, name, parent as shelf, file_type in ('', 'notebook') as notebook,
  row_number() over (partition by parent order by file_type in ('', 'notebook') desc, lower(name), id) as rank from tree where kind = 'document' and parent <> 'trash'""")
def library_sorted(spark, sf_dir):
    return LB.sorted_rank(_tree(spark, sf_dir), F.col("parent"))


@query("""select event_id, case when mod(event_id, 5) <> 3 then case when mod(event_id, 7) = 0 then 'Untitled' else event_type end end as name,
  case when mod(event_id, 5) <> 3 then case when mod(event_id, 2) = 0 then 'folder' else 'document' end end as kind from events where mod(event_id, 5) <> 4""")
def parse_listing(spark, sf_dir):
    e = F.col("event_id")
    item = F.to_json(F.struct(
        F.when(e % 5 == 4, F.lit("")).otherwise(e.cast("string")).alias("ID"),
        F.when(e % 7 == 0, F.lit(" ")).when(e % 3 == 0, F.col("event_type")).alias("VissibleName"),
        F.when(e % 3 != 0, F.col("event_type")).otherwise(F.lit("other")).alias("VisibleName"),
        F.when(e % 2 == 0, F.lit("CollectionType")).otherwise(F.lit("DocumentType")).alias("Type"),
    ))
    body = F.when(e % 5 == 3, item).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    parsed = T.table(spark, sf_dir, "events").select("event_id", V.listing_items(body).alias("items"))
    one = parsed.select("event_id", F.explode_outer("items").alias("i"), F.col("items").isNull().alias("bad")).where("bad or i is not null")
    return one.select("event_id", F.col("i.name").alias("name"), F.col("i.kind").alias("kind"))


@query("""select page_id, regexp_matches(id, '^[A-Za-z0-9_-]{1,64}$') as valid, case when regexp_matches(id, '^[A-Za-z0-9_-]{1,64}$') then '/download/' || id || '/placeholder' end as path
from (select page_id, case mod(page_id, 4) when 0 then url when 1 then '' when 2 then replace(replace(replace(url, '/', '-'), ':', ''), '.', '_') else 'id_' || page_id end as id from pages)""")
def valid_ids(spark, sf_dir):
    k = F.col("page_id") % 4
    item = F.when(k == 0, F.col("url")).when(k == 1, F.lit("")).when(k == 2, F.translate("url", "/:.", "- _")).otherwise(F.concat(F.lit("id_"), F.col("page_id").cast("string")))
    item = F.when(k == 2, F.replace(F.replace(F.replace("url", F.lit("/"), F.lit("-")), F.lit(":"), F.lit("")), F.lit("."), F.lit("_"))).otherwise(item)
    return T.table(spark, sf_dir, "pages").select("page_id", X.valid_id(item).alias("valid"), V.download_path(item).alias("path"))


@query("""select event_id, case mod(event_id, 4) when 0 then event_type when 1 then event_type || event_id when 2 then 'm' else null end as model, mod(event_id, 4) = 1 as vision from events""")
def parse_props(spark, sf_dir):
    e, k = F.col("event_id"), F.col("event_id") % 4
    alias = F.when(k == 0, F.col("event_type"))
    path = F.when(k == 1, F.concat(F.lit("/models/"), "event_type", e.cast("string"), F.lit(".gguf.gguf"))).when(k == 2, F.lit("C:\\dir\\m.gguf"))
    body = F.when(k == 3, F.lit("not json")).otherwise(F.to_json(F.struct(alias.alias("model_alias"), path.alias("model_path"), F.when(k == 1, F.struct(F.lit(True).alias("vision"))).alias("modalities"))))
    return T.table(spark, sf_dir, "events").select("event_id", V.server_model(body).alias("model"), V.server_vision(body).alias("vision"))


@query("""select event_id, case mod(event_id, 5) when 0 then event_type when 1 then event_type end as text, mod(event_id, 5) = 1 as truncated,
  case mod(event_id, 5) when 2 then 'no completion' when 3 then 'no content' when 4 then 'unreadable' end as error from events""")
def parse_completion(spark, sf_dir):
    k = F.col("event_id") % 5
    choice = lambda text, why: F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"), F.lit(why).alias("finish_reason"))).alias("choices")))
    body = (
        F.when(k == 0, choice(F.col("event_type"), "stop")).when(k == 1, choice(F.col("event_type"), "length")).when(k == 2, F.lit('{"choices":[]}'))
        .when(k == 3, F.lit('{"choices":[{"finish_reason":"stop"}]}')).otherwise(F.lit("<html>"))
    )
    read = V.completion(body)
    return T.table(spark, sf_dir, "events").select("event_id", read["text"].alias("text"), read["truncated"].alias("truncated"), read["error"].alias("error"))


@query("""select user_id, event_id, row_number() over (partition by user_id order by case when mod(event_id, 9) = 0 then null else event_id end nulls last, event_id) as place from events""")
def page_order(spark, sf_dir):
    from pyspark.sql import Window

    path = F.when(F.col("event_id") % 9 == 0, F.lit("/tmp/page-x.png")).otherwise(F.concat(F.lit("/tmp/a-b/page-"), F.lpad(F.col("event_id").cast("string"), 7, "0"), F.lit(".png")))
    named = T.table(spark, sf_dir, "events").select("user_id", "event_id", V.page_number(path).alias("_n"))
    return named.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("_n"), "event_id")).alias("place"))


@query("select event_id, 'pdfinfo in-' || event_id || '.pdf' as command from events")
def page_count_command(spark, sf_dir):
    pdf = F.concat(F.lit("in-"), F.col("event_id").cast("string"), F.lit(".pdf"))
    return T.table(spark, sf_dir, "events").select("event_id", F.array_join(V.page_count_command(pdf), " ").alias("command"))


@query("select page_id, case when mod(page_id, 2) = 0 then '/thumbnail/id_' || page_id end as path from pages")
def thumbnail_path(spark, sf_dir):
    item = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("id_"), F.col("page_id").cast("string"))).otherwise(F.lit("../x"))
    return T.table(spark, sf_dir, "pages").select("page_id", V.thumbnail_path(item).alias("path"))


@query("select doc_id, text[1:5] = '%PDF-' or mod(doc_id, 3) = 0 as pdf from documents")
def is_pdf(spark, sf_dir):
    data = F.encode(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("%PDF-1.7\n"), "text")).otherwise(F.concat(F.lit(" "), "text")), "UTF-8")
    return docs_of(spark, sf_dir).select("doc_id", V.is_pdf(data).alias("pdf"))


@query("""select event_id, case when mod(event_id, 3) = 0 then cast(mod(event_id, 100) as integer) end as pages, 'pdftoppm -png -scale-to-x ' || mod(event_id, 2000) || ' -scale-to-y -1 in.pdf out' as command from events""")
def page_count(spark, sf_dir):
    e = F.col("event_id")
    said = F.when(e % 3 == 0, F.concat(F.lit("Title: x\nPages:   "), (e % 100).cast("string"), F.lit("\nSize: 1"))).when(e % 3 == 1, F.lit("Pages: many\nTitle")).otherwise(F.lit("no count"))
    return T.table(spark, sf_dir, "events").select("event_id", V.page_count(said).alias("pages"), F.array_join(V.render_command(F.lit("in.pdf"), e % 2000, F.lit("out")), " ").alias("command"))
