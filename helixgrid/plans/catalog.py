"""Queries over the star-schema tables, which take the place of reads, barcodes, transcripts and sequences, each with the
SQL that another engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import barcodes as B
from ..operators import fragments as G
from ..operators import intervals as I
from ..operators import qc as Q
from ..operators import segments as M
from ..operators import snv as V
from ..operators import transcriptome as T
from ..operators.storage import materialized, shared_path
from ..sources import alignments as A
from ..sources import fastq as FQ

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql4(x: str, n: int) -> str:
    return f"translate(lpad(to_base(cast({x} as bigint), 4), {n}, '0'), '0123', 'ACGT')"


def sqlrc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def read_key() -> Column:
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id")


# --- sequences and barcodes


@query(f"select l_linestatus region, {sql4('l_suppkey', 8)} barcode, count(*) n from lineitem group by all")
def barcode_histogram(spark, sf_dir):
    """How often each barcode was read; every second read is reverse."""
    b = S.base4("l_suppkey", 8)
    rev = F.col("l_linenumber") % 2 == 0
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("region"), F.when(rev, S.revcomp(b)).otherwise(b).alias("barcode"), rev.alias("rev"))
    return B.barcode_histogram(reads, ["region"], "barcode", "rev")


@query(f"select l_orderkey, l_linenumber, {sql4('l_orderkey', 12)} seq, {sqlrc(sql4('l_orderkey', 12))} rc, cast(hamming({sql4('l_orderkey', 12)}, {sqlrc(sql4('l_orderkey', 12))}) as int) distance from lineitem")
def revcomp_reads(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.base4("l_orderkey", 12).alias("seq"))
    x = x.withColumn("rc", S.revcomp("seq"))
    return x.withColumn("distance", S.hamming_fixed(F.col("seq"), F.col("rc"), 12))


@query(
    f"""with h as (select {sql4('l_suppkey', 8)} b, count(*) n from lineitem group by 1),
    o as (select distinct {sql4('s_suppkey', 8)} b from supplier where s_suppkey % 2 = 0),
    j as (select coalesce(h.n, 0) n, o.b is not null listed from h full join o using (b))
    select cast(sum(n) as bigint) total, cast(coalesce(sum(n) filter (where not listed), 0) as bigint) mismatches, count(*) filter (where listed and n > 0) n_seen,
    round(1 - sum(n) filter (where not listed) / sum(n)::double, 9) frac_exact from j"""
)
def whitelist_match_stats(spark, sf_dir):
    h = B.barcode_histogram(table(spark, sf_dir, "lineitem").select(S.base4("l_suppkey", 8).alias("barcode")), [])
    onlist = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(S.base4("s_suppkey", 8).alias("barcode"))
    return B.whitelist_stats(B.whitelist_counts(h, onlist)).withColumn("frac_exact", F.round("frac_exact", 9))


@query(f"select barcode, n, n >= 60 listed from (select {sql4('user_id', 6)} barcode, count(*) n from events group by 1)")
def whitelist_by_threshold(spark, sf_dir):
    h = B.barcode_histogram(table(spark, sf_dir, "events").select(S.base4("user_id", 6).alias("barcode")), [])
    return B.whitelist_counts(h, threshold=60)


def _listed(reads: DataFrame, onlist: DataFrame) -> DataFrame:
    h = B.barcode_histogram(reads, [])
    return B.whitelist_counts(h, onlist).where("listed").select("barcode", "n")


def sql_miss(x: str, key: str, n: int, every: int) -> str:
    """A base of every so many barcodes is another one."""
    p = f"cast(1 + {key} % {n} as int)"
    return f"case when {key} % {every} = 0 then substr({x}, 1, {p} - 1) || translate(substr({x}, {p}, 1), 'ACGT', 'CGTA') || substr({x}, {p} + 1) else {x} end"


def _miss(x: Column, key: str, n: int, every: int) -> Column:
    p = (1 + F.col(key) % n).cast("int")
    changed = F.concat(F.substr(x, F.lit(1), p - 1), F.translate(F.substr(x, p, F.lit(1)), "ACGT", "CGTA"), F.substr(x, p + 1, F.lit(n)))
    return F.when(F.col(key) % every == 0, changed).otherwise(x)


@query(
    f"""with r as (select event_id, {sql_miss(sql4('event_id % 3000', 10), 'event_id', 10, 3)} bc, 33 + event_id % 41 a, 33 + user_id % 8 * 5 b from events),
    d as (select distinct {sql4('p_partkey', 10)} cand from part),
    k as (select cand, count(r.bc) n from d left join r on r.bc = d.cand group by 1),
    u as (select distinct bc from r where bc not in (select cand from d)),
    near as (select bc, cand, n, list_filter(range(1, 11), lambda i: substr(bc, i, 1) <> substr(cand, i, 1))[1] p from u join k on hamming(bc, cand) = 1),
    s as (select event_id, cand, p, (1 + n) * power(10e0, -(least(case when p <= 5 then a else b end, 66) - 33) / 10e0) w from r join near using (bc)),
    m as (select *, w / sum(w) over (partition by event_id) share, row_number() over (partition by event_id order by w desc, p, cand) i from s),
    g as (select * from m where i = 1)
    select r.event_id, case when d.cand is not null then bc when share >= 0.9 then g.cand end corrected, round(case when d.cand is not null then 1 else coalesce(share, 0) end, 4) posterior,
    case when d.cand is not null then 'ok' when share is null then 'no_match' when share >= 0.9 then 'ok' else 'low_confidence' end status
    from r left join d on r.bc = d.cand left join g on g.event_id = r.event_id"""
)
def barcode_correct_1mm(spark, sf_dir):
    q = lambda c: F.chr((33 + c).cast("long"))
    qual = F.concat(F.repeat(q(F.col("event_id") % 41), 5), F.repeat(q(F.col("user_id") % 8 * 5), 5))
    reads = table(spark, sf_dir, "events").select("event_id", _miss(S.base4(F.col("event_id") % 3000, 10), "event_id", 10, 3).alias("barcode"), qual.alias("qual"))
    onlist = table(spark, sf_dir, "part").select(S.base4("p_partkey", 10).alias("barcode"))
    out = B.correct_barcodes(reads, _listed(reads.select("barcode"), onlist), ["event_id"], threshold=0.9)
    return out.select("event_id", "corrected", F.round("posterior", 4).alias("posterior"), "status")


@query(
    f"""with r as (select o_orderkey, {sql_miss(sql4('o_custkey', 9), 'o_orderkey', 9, 4)} bc, 33 + o_orderkey % 40 a, 33 + o_orderkey % 7 * 5 b from orders),
    d as (select distinct {sql4('c_custkey', 9)} cand from customer),
    k as (select cand, count(r.bc) n from d left join r on r.bc = d.cand group by 1),
    u as (select distinct bc from r where bc not in (select cand from d)),
    near as (select bc, cand, n, list_filter(range(1, 10), lambda i: substr(bc, i, 1) <> substr(cand, i, 1)) p from u join k on hamming(bc, cand) in (1, 2)),
    s as (select o_orderkey, cand, p, (1 + n) * power(10e0, -(least(case when p[1] <= 5 then a else b end, 66) - 33) / 10e0)
        * case when len(p) = 2 then power(10e0, -(least(case when p[2] <= 5 then a else b end, 66) - 33) / 10e0) else 1e0 end w from r join near using (bc)),
    m as (select *, w / sum(w) over (partition by o_orderkey) share, row_number() over (partition by o_orderkey order by w desc, p[1], substr(cand, p[1], 1), len(p), coalesce(p[2], 0), substr(cand, coalesce(p[2], 1), 1)) i from s),
    g as (select * from m where i = 1)
    select r.o_orderkey, case when d.cand is not null then bc when share >= 0.9 then g.cand end corrected, round(case when d.cand is not null then 1 else coalesce(share, 0) end, 4) posterior,
    case when d.cand is not null then 'ok' when share is null then 'no_match' when share >= 0.9 then 'ok' else 'low_confidence' end status
    from r left join d on r.bc = d.cand left join g on g.o_orderkey = r.o_orderkey"""
)
def barcode_correct_2mm(spark, sf_dir):
    q = lambda c: F.chr((33 + c).cast("long"))
    qual = F.concat(F.repeat(q(F.col("o_orderkey") % 40), 5), F.repeat(q(F.col("o_orderkey") % 7 * 5), 4))
    reads = table(spark, sf_dir, "orders").select("o_orderkey", _miss(S.base4("o_custkey", 9), "o_orderkey", 9, 4).alias("barcode"), qual.alias("qual"))
    onlist = table(spark, sf_dir, "customer").select(S.base4("c_custkey", 9).alias("barcode"))
    out = B.correct_barcodes(reads, _listed(reads.select("barcode"), onlist), ["o_orderkey"], distance=2, threshold=0.9)
    return out.select("o_orderkey", "corrected", F.round("posterior", 4).alias("posterior"), "status")


_ORDMAG = """with c as (select count(*) n from events group by user_id), t as (select count(*) total from c),
    r as (select n, row_number() over (order by n desc) - 1 rk from c), x as (select power(2e0, range) x from range(18)),
    tr as (select x, total, cast(least(round(0.01e0 * x), total - 1) as bigint) idx from x, t),
    w as (select tr.x, tr.total, count(*) w from tr join r b on b.rk = tr.idx join c on c.n >= greatest(round(0.1e0 * b.n), 1) group by all),
    best as (select total, x from w order by power(w - x, 2) / x, x limit 1),
    i2 as (select total, x, cast(least(round(0.01e0 * x), total - 1) as bigint) idx from best),
    top as (select i2.x, i2.total, count(*) top_n from i2 join r b on b.rk = i2.idx join c on c.n >= greatest(round(0.1e0 * b.n), 1) group by all)
    select cast(x as bigint) recovered, top_n, n threshold from top join r on rk = least(top_n, total - 1)"""


@query(_ORDMAG)
def cell_threshold_ordmag(spark, sf_dir):
    return B.ordmag_threshold(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")))


@query(
    """with r as (select n, row_number() over (order by n desc, barcode) rank from (select lpad(cast(user_id as varchar), 12, '0') barcode, count(*) n from events group by 1)),
    f as (select * from r where rank <= 10000), l as (select rank, n, (lead(ln(n)) over (order by rank) - ln(n)) / (lead(ln(rank)) over (order by rank) - ln(rank)) s from f),
    d as (select rank, n, round(abs(lead(s) over (order by rank) - s), 9) d from l)
    select rank, n from d where d is not null order by d desc, rank limit 1"""
)
def knee_point(spark, sf_dir):
    return B.knee_point(table(spark, sf_dir, "events").groupBy(F.lpad(F.col("user_id").cast("string"), 12, "0").alias("barcode")).agg(F.count("*").alias("n")))


@query(f"select {sql4('n_nationkey', 4)} || {sql4('r_regionkey', 3)} barcode from nation, region")
def onlist_product(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(S.base4("n_nationkey", 4).alias("barcode"))
    return B.onlist_product(a, table(spark, sf_dir, "region").select(S.base4("r_regionkey", 3).alias("barcode")))


@query(f"select s_suppkey, {sql4('s_suppkey', 10)} barcode from supplier")
def multiplex_barcodes(spark, sf_dir):
    """Every supplier's own barcode out of a million."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", B.unique_barcode("s_suppkey", 4**10).alias("barcode"))


@query("select event_id, 'EV:' || event_id || ':' rest, lpad(cast(user_id as varchar), 6, '0') g1, event_type g2 from events")
def regex_strip(spark, sf_dir):
    """Names such as EV:7:000042click lose their captured groups."""
    name = F.concat(F.lit("EV:"), F.col("event_id").cast("string"), F.lit(":"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.col("event_type"))
    rest, (a, b) = FQ.strip_groups(name, r"(?<code>\d{6})(?<kind>[a-z_]+)$", ["code", "kind"])
    return table(spark, sf_dir, "events").select("event_id", rest.alias("rest"), a.alias("g1"), b.alias("g2"))


# --- segments


@query(f"with r as (select event_id, {sql4('event_id', 12)} s from events) select event_id, substr(s, 1, 4) || substr(s, 8, 2) barcode, substr(s, 5, 3) umi, substr(s, 10, 3) target from r")
def segment_split_fixed(spark, sf_dir):
    layout = [M.Element("b1", "barcode", "onlist", "", 4, 4), M.Element("u", "umi", "random", "", 3, 3), M.Element("b2", "barcode", "onlist", "", 2, 2), M.Element("t", "cdna", "random", "", 3, 3)]
    reads = table(spark, sf_dir, "events").select("event_id", S.base4("event_id", 12).alias("seq"), F.repeat(F.lit("F"), 12).alias("qual"))
    return M.annotate(M.split_reads(reads, layout, ["event_id"])).select("event_id", "barcode", "umi", "target")


@query(
    f"""with r as (select event_id, {sql4('event_id * 7919 + 13', 16)} s from events)
    select event_id, case when position('TTA' in substr(s, 5, 6)) > 0 then substr(s, 1, 4) end barcode, case when position('TTA' in substr(s, 5, 6)) > 0 then substr(s, 5, position('TTA' in substr(s, 5, 6)) - 1) end spacer,
    case when position('TTA' in substr(s, 5, 6)) > 0 then substr(s, 7 + position('TTA' in substr(s, 5, 6))) end target, case when position('TTA' in substr(s, 5, 6)) > 0 then 'ok' else 'pattern_mismatch' end status from r"""
)
def segment_split_anchored(spark, sf_dir):
    """A spacer of 0 to 3 bases before an anchor that must match exactly."""
    layout = [M.Element("b", "barcode", "onlist", "", 4, 4), M.Element("v", "linker", "random", "", 0, 3), M.Element("a", "linker", "fixed", "TTA", 3, 3), M.Element("t", "cdna", "random", "", 1, 20)]
    reads = table(spark, sf_dir, "events").select("event_id", S.base4(F.col("event_id") * 7919 + 13, 16).alias("seq"), F.repeat(F.lit("F"), 16).alias("qual"))
    out = M.split_reads(reads, layout, ["event_id"], anchor_tolerance=0.0)
    part = lambda k: F.get(F.filter("segments", lambda x: x["region_id"] == k), F.lit(0))["seq"]
    return out.select("event_id", part("b").alias("barcode"), part("v").alias("spacer"), part("t").alias("target"), F.regexp_replace("status", ":.*", "").alias("status"))


@query(
    f"""with r as (select event_id, {sql4('event_id * 7919 + 13', 16)} s from events),
    m as (select event_id, list_sort(list_transform(range(0, 12), lambda i: {{'m': hamming(substr(s, i + 1, 5), 'ACGTA'), 'p': i}}))[1] b from r)
    select event_id, cast(b.p as int) pos, cast(b.m as int) mismatches from m"""
)
def anchor_search(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", S.best_match(S.base4(F.col("event_id") * 7919 + 13, 16), "ACGTA").alias("b"))
    return x.select("event_id", "b.pos", "b.mismatches")


@query(
    f"""with recursive r as (select event_id, repeat('A', cast(user_id % 5 as int)) || {sql4('event_id', 10)} s from events),
    w as (select event_id, s, 0 as i, 0 as sc, 0 as er, 0 as top, 0 as pl from r
      union all select event_id, s, i + 1, sc + case when substr(s, i + 1, 1) = 'A' then 1 else -2 end, er + case when substr(s, i + 1, 1) = 'A' then 0 else 1 end,
        case when sc + case when substr(s, i + 1, 1) = 'A' then 1 else -2 end > top and 5 * (er + case when substr(s, i + 1, 1) = 'A' then 0 else 1 end) <= i + 1 then sc + case when substr(s, i + 1, 1) = 'A' then 1 else -2 end else top end,
        case when sc + case when substr(s, i + 1, 1) = 'A' then 1 else -2 end > top and 5 * (er + case when substr(s, i + 1, 1) = 'A' then 0 else 1 end) <= i + 1 then i + 1 else pl end
      from w where i < length(s))
    select event_id, nullif(pl, 0) trimmed from w where i = length(s)"""
)
def polya_trim(spark, sf_dir):
    s = F.concat(F.repeat(F.lit("A"), (F.col("user_id") % 5).cast("int")), S.base4("event_id", 10))
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", S.poly_prefix("s", "A").alias("trimmed"))


# --- fragments

_FRAGS = f"""with r as (select {sql4('l_suppkey', 8)} barcode, 'chr' || l_linenumber chrom, l_partkey a, l_partkey + cast(l_quantity as bigint) * 10 b, l_returnflag o,
    l_partkey - l_orderkey % 3 s, l_partkey + cast(l_quantity as bigint) * 10 e, case when l_returnflag = 'N' then null else '+' end strand, l_orderkey * 10 + l_linenumber name from lineitem),
    g as (select *, count(*) over w n, row_number() over (partition by barcode, chrom, a, b, o order by s, e, name) i from r window w as (partition by barcode, chrom, a, b, o)),
    f as (select chrom, case when strand is null then greatest(s + 4, 0) else s end as st, case when strand is null then greatest(e - 5, 0) else e end as en, barcode, n cnt, strand from g where i = 1)"""


def _fragments(spark, sf_dir) -> DataFrame:
    p, q = F.col("l_partkey"), F.col("l_quantity").cast("long") * 10
    reads = table(spark, sf_dir, "lineitem").select(
        S.base4("l_suppkey", 8).alias("barcode"), F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("chrom"), p.alias("left_5p"), (p + q).alias("right_5p"), F.col("l_returnflag").alias("orientation"),
        (p - F.col("l_orderkey") % 3).alias("frag_start"), (p + q).alias("frag_end"), F.when(F.col("l_returnflag") != "N", "+").alias("strand"), read_key().alias("name"),
    )
    return G.unique_fragments(reads, 4, -5)


@query(_FRAGS + ' select chrom, st "start", en "end", barcode, cnt "count", strand from f where en > st')
def fragment_dedup(spark, sf_dir):
    return _fragments(spark, sf_dir)


@query(
    _FRAGS
    + """ select count(*) num_unique_fragments, round(sum(cnt - 1) / nullif(sum(cnt), 0)::double, 9) frac_duplicates,
    round(count(*) filter (where chrom <> 'chr7' and en - st < 147) / count(*)::double, 9) frac_fragment_in_nucleosome_free_region,
    round(count(*) filter (where chrom <> 'chr7' and en - st between 147 and 294) / count(*)::double, 9) frac_fragment_flanking_single_nucleosome from f where en > st"""
)
def fragment_qc(spark, sf_dir):
    q = G.fragment_qc(_fragments(spark, sf_dir), ["chr7"])
    return q.select("num_unique_fragments", *(F.round(c, 9).alias(c) for c in q.columns[1:]))


@query(_FRAGS + """ select chrom || chr(9) || st || chr(9) || en || chr(9) || barcode || chr(9) || cnt || chr(9) || coalesce(strand, '.') line from f where en > st""")
def fragment_lines(spark, sf_dir):
    """Fragments as text, read back and written again."""
    lines = _fragments(spark, sf_dir).select(G.fragment_line().alias("value"))
    return G.parse_fragments(lines).select(G.fragment_line().alias("line"))


@query("select l_orderkey, l_linenumber from lineitem where (l_orderkey % 4096) & 3852 = 0 and (case when l_linenumber = 7 then 255 else cast(l_quantity as int) end) >= 30")
def flag_mapq_filter(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumns({"flags": (F.col("l_orderkey") % 4096).cast("int"), "mapq": F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("int"))})
    return x.where(G.read_passes()).select("l_orderkey", "l_linenumber")


def _pairs(spark, sf_dir) -> DataFrame:
    flags = lambda k: (F.col("l_orderkey") % 2 * 16).bitwiseXOR(F.col("l_partkey") % 2 * 16) if k == 2 else F.col("l_orderkey") % 2 * 16
    read = lambda k, pos: F.struct((flags(k) + 2 + (64 if k == 1 else 128)).cast("int").alias("flags"), (20 + F.col("l_quantity")).cast("int").alias("mapq"), pos.alias("start"), (pos + 49).alias("end"), (pos - F.col("l_linenumber")).alias("unclipped_start"), (pos + 49 + F.col("l_suppkey") % 4).alias("unclipped_end"))
    x = table(spark, sf_dir, "lineitem")
    return x.select(read_key(), read(1, F.col("l_partkey")).alias("r1"), read(2, F.col("l_partkey") + F.col("l_quantity").cast("long") - 25).alias("r2"))


@query(
    """with r as (select l_orderkey * 10 + l_linenumber read_id, l_orderkey % 2 = 1 v1, (l_orderkey % 2 = 1) <> (l_partkey % 2 = 1) v2, l_partkey p1, l_partkey + cast(l_quantity as bigint) - 25 p2, l_linenumber c, l_suppkey % 4 d, l_quantity q from lineitem),
    k as (select *, case when v1 then p1 + 49 + d else p1 - c end f1, case when v2 then p2 + 49 + d else p2 - c end f2, case when v1 then p1 + 49 else p1 end g1, case when v2 then p2 + 49 else p2 end g2 from r where 20 + q >= 30),
    l as (select *, f1 < f2 one, case when f1 < f2 then v1 else v2 end lv, case when f1 < f2 then v2 else v1 end rv from k)
    select read_id, least(f1, f2) left_5p, greatest(f1, f2) right_5p, case when lv and rv then case when one then 'RR' else 'FF' end when not lv and not rv then case when one then 'FF' else 'RR' end when lv then 'RF' else 'FR' end orientation,
    least(g1, g2) - 1 frag_start, greatest(g1, g2) frag_end from l"""
)
def pair_fingerprints(spark, sf_dir):
    x = G.pair_fingerprint(_pairs(spark, sf_dir).where(G.pair_passes()))
    c = G.pair_coordinates()
    return x.select("read_id", "left_5p", "right_5p", "orientation", c["frag_start"].alias("frag_start"), c["frag_end"].alias("frag_end"))


_CIGAR = "(l_linenumber || 'S' || cast(l_quantity as int) || 'M' || case when l_orderkey % 2 = 0 then '100N' else '2D3I' end || '10M' || case when l_orderkey % 3 = 0 then '2S4H' else '' end)"


def _cigar() -> Column:
    return F.concat(F.col("l_linenumber").cast("string"), F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("M"), F.when(F.col("l_orderkey") % 2 == 0, "100N").otherwise("2D3I"), F.lit("10M"), F.when(F.col("l_orderkey") % 3 == 0, "2S4H").otherwise(""))


@query(
    f"""with r as (select l_orderkey * 10 + l_linenumber read_id, l_partkey pos, {_CIGAR} cigar, cast(l_quantity as int) q, l_orderkey k, l_linenumber ln from lineitem)
    select read_id, pos "start", pos + list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: cast(x as bigint)))::bigint - 1 "end", cast(pos - ln as bigint) unclipped_start,
    pos + list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: cast(x as bigint)))::bigint - 1 + case when k % 3 = 0 then 6 else 0 end unclipped_end,
    case when k % 2 = 0 then (pos - 1) || '-' || (pos - 1 + q) || ',' || (pos + 99 + q) || '-' || (pos + 109 + q) else (pos - 1) || '-' || (pos + 11 + q) end segments from r"""
)
def alignment_extents(spark, sf_dir):
    """Extents, clipping and spliced segments of alignments from their CIGAR strings."""
    x = table(spark, sf_dir, "lineitem").select(read_key(), F.col("l_partkey").alias("pos"), _cigar().alias("cigar"))
    text = F.array_join(F.transform(S.spliced_segments("pos", "cigar"), lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return G.with_extents(x).select("read_id", "start", "end", "unclipped_start", "unclipped_end", text.alias("segments"))


@query(
    """with r as (select l_suppkey g, case when l_linenumber % 3 = 0 then null else 'T' || l_linenumber end e from lineitem), c as (select g, coalesce(e, '50') e, count(*) n from r group by all),
    t as (select g, sum(n) a from c group by 1) select g l_suppkey, string_agg(case when n = a then e else e || ':' || n end, ';' order by e) pileup from c join t using (g) group by 1"""
)
def snv_pileup(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("T"), F.col("l_linenumber").cast("string"))).alias("snvs"), F.lit(50).alias("length"))
    return G.snv_pileup(x, ["l_suppkey"])


@query(
    """with r as (select l_orderkey * 10 + l_linenumber read_id, 1 + l_partkey % 20 a, l_quantity >= 30 good, cast(l_suppkey % 40 as int) + 10 b from lineitem)
    select read_id, case when good then a || 'T' || b when true then cast(a + 1 + b as varchar) end as text from r"""
)
def snv_call(spark, sf_dir):
    """One substitution for each read, kept if its quality reaches 30."""
    a, b = (1 + F.col("l_partkey") % 20).cast("int"), (F.col("l_suppkey") % 40 + 10).cast("int")
    low = F.when(F.col("l_quantity") >= 30, "?").otherwise(">")  # 30 or 29
    x = table(spark, sf_dir, "lineitem").select(
        read_key(), F.col("l_partkey").alias("pos"), F.concat((a + 1 + b).cast("string"), F.lit("M")).alias("cigar"), F.concat(a.cast("string"), F.lit("A"), b.cast("string")).alias("md"),
        F.concat(F.repeat(F.lit("C"), a), F.lit("T"), F.repeat(F.lit("G"), b)).alias("seq"), F.concat(F.repeat(F.lit("F"), a), low, F.repeat(F.lit("F"), b)).alias("qual"),
    )
    return V.call_variants(x, "read_id").select("read_id", "text")


# --- intervals


@query(
    """with r as (select l_orderkey * 10 + l_linenumber read_id, l_partkey % 5 chrom, l_partkey * 3 + l_linenumber s, l_partkey * 3 + l_linenumber + cast(l_quantity as bigint) e from lineitem),
    f as (select p_partkey, p_partkey % 5 chrom, p_partkey * 3 s, p_partkey * 3 + p_size e from part)
    select read_id, p_partkey f_p_partkey from r join f on r.chrom = f.chrom and r.s < f.e and f.s < r.e"""
)
def interval_overlap_join(spark, sf_dir):
    p, q = F.col("l_partkey"), F.col("l_quantity").cast("long")
    reads = table(spark, sf_dir, "lineitem").select(read_key(), (p % 5).alias("chrom"), (p * 3 + F.col("l_linenumber")).alias("start"), (p * 3 + F.col("l_linenumber") + q).alias("end"))
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", (k % 5).alias("chrom"), (k * 3).alias("start"), (k * 3 + F.col("p_size")).alias("end"))
    return I.overlap_join(reads, parts, 64).select("read_id", "f_p_partkey")


@query(
    """with r as (select l_suppkey, l_partkey * 10 s, l_partkey * 10 + cast(l_quantity as bigint) * 20 e from lineitem),
    m as (select *, case when s <= max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end nw from r),
    i as (select *, sum(nw) over (partition by l_suppkey order by s, e rows unbounded preceding) isl from m)
    select l_suppkey, min(s) "start", max(e) "end", count(*) n from i group by l_suppkey, isl"""
)
def interval_merge(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long") * 20).alias("end"))
    return I.merge_intervals(x, ["l_suppkey"])


_CHROMS = "chroms as (select n_nationkey ord, n_name name, cast((n_nationkey + 1) * 1000 as bigint) len, cast(coalesce(sum((n_nationkey + 1) * 1000) over (order by n_nationkey rows between unbounded preceding and 1 preceding), 0) as bigint) off from nation)"


def _offsets(spark, sf_dir) -> DataFrame:
    return I.genome_offsets(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), ((F.col("n_nationkey") + 1) * 1000).cast("long").alias("length")))


@query(f"with {_CHROMS} select l_orderkey * 10 + l_linenumber read_id, off + l_partkey % len linear, name chrom, l_partkey % len pos from lineitem join chroms on ord = l_suppkey % 25")
def genome_linear_index(spark, sf_dir):
    """To the genome-wide index and back."""
    o = _offsets(spark, sf_dir)
    place = o.select(F.col("ord").cast("long").alias("ord"), F.col("name").alias("chrom"), "length")
    x = table(spark, sf_dir, "lineitem").select(read_key(), (F.col("l_suppkey") % 25).alias("ord"), "l_partkey").join(F.broadcast(place), "ord")
    x = x.select("read_id", "chrom", (F.col("l_partkey") % F.col("length")).alias("pos"))
    return I.from_linear(I.to_linear(x, o).select("read_id", "linear"), o, bin_size=4096).select("read_id", "linear", "chrom", "pos")


@query(
    f"""with {_CHROMS}, r as (select {sql4('l_suppkey', 8)} barcode, off, l_partkey % 900 s, l_partkey % 900 + cast(l_quantity as bigint) e, l_returnflag = 'R' rev from lineitem join chroms on ord = l_suppkey % 25)
    select barcode, off + case when rev then e - 1 else s end linear, cast(case when rev then s - e else e - s end as int) size from r"""
)
def coverage_signed(spark, sf_dir):
    o = _offsets(spark, sf_dir)
    place = o.select(F.col("ord").cast("long").alias("ord"), F.col("name").alias("chrom"))
    s = F.col("l_partkey") % 900
    x = table(spark, sf_dir, "lineitem").select(S.base4("l_suppkey", 8).alias("barcode"), (F.col("l_suppkey") % 25).alias("ord"), s.alias("start"), (s + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"))
    return I.coverage_values(x.join(F.broadcast(place), "ord"), o)


# --- transcripts, genes and molecules

_TX = """t as (select 'T' || p_partkey tid, 'G' || (p_partkey // 15) gid, 'N' || (p_partkey // 15 % 40) gname, 'chr' || (p_partkey % 5) chrom, p_partkey * 10 s, p_partkey * 10 + 100 e,
    case when p_size % 4 = 0 then '-' else '+' end strand, [{'s': p_partkey * 10, 'e': p_partkey * 10 + 20}, {'s': p_partkey * 10 + 40, 'e': p_partkey * 10 + 60}, {'s': p_partkey * 10 + 80, 'e': p_partkey * 10 + 100}] exons from part),
    r0 as (select l_orderkey * 10 + l_linenumber rid, l_suppkey, l_orderkey, l_linenumber, 'chr' || (l_partkey % 5) chrom, l_partkey * 10 b, l_orderkey % 90 o, cast(l_quantity as bigint) q from lineitem),
    r as (select *, case when l_linenumber % 3 = 0 then [{'s': b + 50, 'e': b + 60}, {'s': b + 80, 'e': b + 81 + q % 20}] else [{'s': b + o, 'e': b + o + 1 + q % 10}] end seg from r0),
    h0 as (select rid, l_suppkey, l_orderkey, tid, gid, strand, seg, list_filter(exons, lambda x: x.e > seg[1].s and x.s < seg[-1].e) ov from r join t on r.chrom = t.chrom and seg[1].s < t.e and t.s < seg[-1].e),
    h as (select rid, l_suppkey, l_orderkey, tid, gid, strand = '-' as an0, case when len(ov) = 0 then 'intronic'
      when len(ov) = len(seg) and (len(ov) = 1 or (ov[1].e = seg[1].e and ov[2].s = seg[2].s)) then case when seg[1].s >= ov[1].s and seg[-1].e <= ov[-1].e then 'exonic' else 'spanning' end
      when len(ov) > len(seg) then case when ov[-1].s >= seg[-1].s and ov[1].e > seg[1].s then 'spanning' else 'discordant' end else 'discordant' end typ from h0)"""
_RES = (
    _TX
    + """, g as (select r.rid, count(h.rid) nh, count(*) filter (where not an0 and typ <> 'discordant') good, bool_or(an0 and typ <> 'discordant') an,
      min(gid) filter (where not an0 and typ <> 'discordant') g0, max(gid) filter (where not an0 and typ <> 'discordant') g1,
      bool_and(typ = 'exonic') filter (where not an0 and typ <> 'discordant') ex, bool_and(typ = 'intronic') filter (where not an0 and typ <> 'discordant') it,
      bool_or(typ = 'spanning') filter (where not an0 and typ <> 'discordant') and not bool_or(typ = 'exonic') filter (where not an0 and typ <> 'discordant') sp
      from r left join h on h.rid = r.rid group by 1),
    res as (select rid, case when nh = 0 then 'intergenic' when good = 0 then case when not an then 'discordant' else 'antisense' end when g0 <> g1 then 'multimapped' else 'aligned' end kind, g0, ex, it, sp from g)"""
)


def _transcripts(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    gene = F.floor(k / 15)
    exon = lambda a: F.struct((k * 10 + a).alias("start"), (k * 10 + a + 20).alias("end"))
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return table(spark, sf_dir, "part").select(
        text("T", k).alias("transcript_id"), text("G", gene).alias("gene_id"), text("N", gene % 40).alias("gene_name"), text("chr", k % 5).alias("chrom"), (k * 10).alias("start"), (k * 10 + 100).alias("end"),
        F.when(F.col("p_size") % 4 == 0, "-").otherwise("+").alias("strand"), F.array(exon(0), exon(40), exon(80)).alias("exons"),
    )


def _reads(spark, sf_dir) -> DataFrame:
    b, o, q = F.col("l_partkey") * 10, F.col("l_orderkey") % 90, F.col("l_quantity").cast("long")
    seg = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    segs = F.when(F.col("l_linenumber") % 3 == 0, F.array(seg(b + 50, b + 60), seg(b + 80, b + 81 + q % 20))).otherwise(F.array(seg(b + o, b + o + 1 + q % 10)))
    return table(spark, sf_dir, "lineitem").select(read_key(), "l_suppkey", "l_orderkey", F.lit(0).alias("aln_idx"), F.lit(1).alias("mate"), F.concat(F.lit("chr"), (F.col("l_partkey") % 5).cast("string")).alias("chrom"), segs.alias("segments"), F.lit("+").alias("strand"))


def _hits(spark, sf_dir) -> DataFrame:
    return T.transcript_hits(_reads(spark, sf_dir), _transcripts(spark, sf_dir), bin_size=256)


@query(f"with {_TX} select rid read_id, tid transcript_id, typ align_type, an0 antisense from h")
def transcript_classify(spark, sf_dir):
    return _hits(spark, sf_dir).select("read_id", "transcript_id", "align_type", "antisense")


def _resolved(spark, sf_dir) -> DataFrame:
    return T.resolve_single(_reads(spark, sf_dir).select("read_id", "aln_idx"), _hits(spark, sf_dir))


@query(f"with {_RES} select rid read_id, kind, case when kind = 'aligned' then g0 end gene_id, kind = 'aligned' and ex exonic_only, kind = 'aligned' and it intronic_only, kind = 'aligned' and sp spanning from res")
def gene_resolution(spark, sf_dir):
    x = _resolved(spark, sf_dir)
    return x.select("read_id", "kind", "gene_id", "exonic_only", "intronic_only", "spanning")


_MATES = (
    _TX
    + """, hm as (select rid // 10 * 10 + (rid % 10 + 1) // 2 pid, (rid + 1) % 2 + 1 mate, tid, gid, an0, typ from h),
    ps as (select rid // 10 * 10 + (rid % 10 + 1) // 2 pid from r group by 1 having count(*) = 2),
    j as (select a.pid, a.tid, a.gid, a.an0, case when a.typ = 'intronic' and b.typ = 'intronic' then 'intronic' when a.typ = 'exonic' and b.typ = 'exonic' then 'exonic' when 'discordant' in (a.typ, b.typ) then 'discordant' else 'spanning' end typ
      from hm a join hm b on a.pid = b.pid and a.tid = b.tid and a.an0 = b.an0 and a.mate = 1 and b.mate = 2),
    s as (select pid, min(gid) filter (where not an0 and typ <> 'discordant') g0, max(gid) filter (where not an0 and typ <> 'discordant') g1, bool_or(an0) an, bool_or(not an0 and typ = 'discordant') di from j group by 1)"""
)


@query(f"with {_MATES} select pid read_id, case when g0 <> g1 then 'multimapped' when g0 is not null then 'aligned' when coalesce(di, false) then 'discordant' when coalesce(an, false) then 'antisense' else 'intergenic' end kind, case when g0 = g1 then g0 end gene_id from ps left join s using (pid)")
def gene_resolution_pairs(spark, sf_dir):
    """Lines 1 and 2, 3 and 4, 5 and 6 of an order as mates; a line without a mate is in no pair."""
    mates = _reads(spark, sf_dir).withColumn("mate", ((F.col("read_id") + 1) % 2 + 1).cast("int"))
    mates = mates.withColumn("read_id", F.floor(F.col("read_id") / 10) * 10 + F.floor((F.col("read_id") % 10 + 1) / 2))
    # Most lines have no mate, so they go before their transcripts are looked for.
    both = F.count("*").over(Window.partitionBy("read_id", "aln_idx"))
    paired = materialized(mates.select("read_id", "aln_idx", "mate", "chrom", "segments", "strand", both.alias("n")).where("n = 2").drop("n"))
    hits = T.transcript_hits(paired, _transcripts(spark, sf_dir), bin_size=256)
    return T.resolve_pairs(paired.select("read_id", "aln_idx").distinct(), hits).select("read_id", "kind", "gene_id")


@query(
    f"""with {_TX}, v as (select rid, bool_or(t.strand = '+') sense from r join t on r.chrom = t.chrom and t.s <= seg[1].s and seg[-1].e <= t.e group by 1)
    select count(*) filter (where sense) n_sense, count(*) filter (where not sense) n_antisense, case when 100e0 * count(*) filter (where sense) / count(*) > 67 then 'forward' when 100e0 * count(*) filter (where not sense) / count(*) > 67 then 'reverse' else 'unstranded' end strandedness from v"""
)
def strandedness_vote(spark, sf_dir):
    return T.strandedness_vote(_reads(spark, sf_dir), _transcripts(spark, sf_dir), bin_size=256)


_UMI = f"""c as (select l_suppkey, l_partkey % 40 gene, {sql4('l_orderkey % 1024', 5)} umi, count(*) n from lineitem where l_orderkey % 11 <> 0 group by all),
    p as (select a.l_suppkey, a.gene, a.umi, max({{'n': b.n, 'u': b.umi}}) m from c a join c b on a.l_suppkey = b.l_suppkey and a.gene = b.gene and hamming(a.umi, b.umi) = 1 and (b.n > a.n or (b.n = a.n and b.umi > a.umi)) group by all),
    k as (select c.*, coalesce(p.m.u, c.umi) target from c left join p on c.l_suppkey = p.l_suppkey and c.gene = p.gene and c.umi = p.umi),
    x as (select l_suppkey, gene, target mol, sum(n) n from k group by all union all select l_suppkey, l_partkey % 40, '#' || (l_orderkey * 10 + l_linenumber), 1 from lineitem where l_orderkey % 11 = 0)"""


def _umi_reads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(read_key(), "l_suppkey", (F.col("l_partkey") % 40).alias("gene"), F.when(F.col("l_orderkey") % 11 != 0, S.base4(F.col("l_orderkey") % 1024, 5)).alias("umi"))


@query(f"with {_UMI} select l_suppkey, gene, count(*) n_molecules, cast(sum(n) as bigint) n_reads from x group by all")
def umi_correct_count(spark, sf_dir):
    """Lines of one number are reads of one name, so that names do not tell the reads without a UMI apart."""
    m = T.molecules(_umi_reads(spark, sf_dir), ["l_suppkey", "gene"])
    n = F.countDistinct(F.when(F.col("umi").isNotNull(), F.col("molecule"))) + F.count_if(F.col("umi").isNull())
    return m.groupBy("l_suppkey", "gene").agg(n.alias("n_molecules"), F.count("*").alias("n_reads"))


_MOL = (
    _RES
    + f""", a as (select res.rid, l_suppkey, g0 gid, {sql4('l_orderkey % 64', 4)} umi, ex, coalesce(sp, false) sp from res join r on r.rid = res.rid where kind = 'aligned'),
    c as (select l_suppkey, gid, umi, count(*) n from a group by all),
    p as (select y.l_suppkey, y.gid, y.umi, max({{'n': b.n, 'u': b.umi}}) m from c y join c b on y.l_suppkey = b.l_suppkey and y.gid = b.gid and hamming(y.umi, b.umi) = 1 and (b.n > y.n or (b.n = y.n and b.umi > y.umi)) group by all),
    w as (select a.*, coalesce(p.m.u, a.umi) mol from a left join p on a.l_suppkey = p.l_suppkey and a.gid = p.gid and a.umi = p.umi),
    tr as (select w.l_suppkey, w.gid, mol, tid, bool_or(typ in ('intronic', 'spanning')) i from w join h on h.rid = w.rid where not an0 and typ <> 'discordant' group by all),
    ev as (select l_suppkey, gid, mol, bool_and(i) e from tr group by all),
    mo as (select w.l_suppkey, w.gid, w.mol, count(*) n_reads, case when bool_or(sp) then 'unspliced' when bool_and(ex) then 'spliced' when any_value(e) then 'unspliced' else 'ambiguous' end ann from w join ev on ev.l_suppkey = w.l_suppkey and ev.gid = w.gid and ev.mol = w.mol group by all),
    gi as (select gid, row_number() over (order by gname, gid) - 1 idx from (select gid, min(gname) gname from t group by 1))"""
)


def _molecules(spark, sf_dir) -> DataFrame:
    """Genes of reads are used several times below, so they are written once."""
    reads = _reads(spark, sf_dir).select("read_id", "aln_idx", "l_suppkey", (F.col("l_orderkey") % 64).alias("code"))
    found = T.resolve_single(reads, _hits(spark, sf_dir), ["l_suppkey", "code"]).where("kind = 'aligned'")
    aligned = materialized(found.select("read_id", "l_suppkey", "gene_id", "hits", "exonic_only", "spanning", S.base4("code", 4).alias("umi")))
    return T.annotate_molecules(T.molecules(aligned, ["l_suppkey", "gene_id"]), ["l_suppkey", "gene_id"])


@query(f"with {_MOL} select l_suppkey, gid gene_id, mol molecule, n_reads, ann annotation from mo")
def spliced_unspliced(spark, sf_dir):
    return _molecules(spark, sf_dir).select("l_suppkey", "gene_id", "molecule", "n_reads", "annotation")


@query(f"with {_MOL} select l_suppkey, idx gene_idx, layer, count(*) as \"value\" from mo join gi using (gid) join (select unnest(['X', 'spliced', 'unspliced']) layer) on layer in ('X', ann) group by all")
def gene_cell_matrix(spark, sf_dir):
    genes = T.gene_index(_transcripts(spark, sf_dir))
    return T.count_layers(_molecules(spark, sf_dir).join(genes.select("gene_id", "gene_idx"), "gene_id"), "l_suppkey")


@query(f"with {_MOL}, v as (select l_suppkey, idx, count(*) n from mo join gi using (gid) group by all) select l_suppkey, string_agg(idx || ':' || n, ' ' order by idx) as \"row\" from v group by 1")
def gene_cell_rows(spark, sf_dir):
    """The matrix as sparse rows."""
    genes = T.gene_index(_transcripts(spark, sf_dir))
    counts = T.count_layers(_molecules(spark, sf_dir).join(genes.select("gene_id", "gene_idx"), "gene_id"), "l_suppkey").where("layer = 'X'")
    rows = T.csr_rows(counts, "l_suppkey")
    return rows.select("l_suppkey", F.array_join(F.zip_with("cols", "vals", lambda a, b: F.concat(a.cast("string"), F.lit(":"), b.cast("string"))), " ").alias("row"))


@query(f"with {_MOL} select count(*) num_unique_umi, round((sum(n_reads) - count(*)) / sum(n_reads)::double, 9) frac_duplicates, round(count(*) filter (where ann = 'spliced') / count(*)::double, 9) frac_spliced, round(count(*) filter (where ann = 'unspliced') / count(*)::double, 9) frac_unspliced from mo")
def quantification_qc(spark, sf_dir):
    q = Q.quantification_qc(_molecules(spark, sf_dir))
    return q.select("num_unique_umi", *(F.round(c, 9).alias(c) for c in q.columns[1:]))


# --- quality metrics

_SHARES = {"spanning": "kind = 'aligned' and sp", "exonic": "kind = 'aligned' and not sp and ex", "intronic": "kind = 'aligned' and not sp and not ex and it", "mixed": "kind = 'aligned' and not sp and not ex and not it"}


@query(
    f"with {_RES} select round(count(*) filter (where kind = 'aligned') / count(*)::double, 9) frac_transcriptomic, "
    + ", ".join(f"round(count(*) filter (where {w}) / count(*)::double, 9) frac_{k}" for k, w in (_SHARES | {k: f"kind = '{k}'" for k in Q.OUTCOMES}).items())
    + " from res"
)
def gene_qc(spark, sf_dir):
    q = Q.gene_qc(_resolved(spark, sf_dir))
    return q.select(*(F.round(c, 9).alias(c) for c in q.columns))


@query(
    """with r as (select 1 + l_linenumber % 2 mate, l_orderkey % 2048 fl, nullif(cast(l_quantity as int), 50) mq, 'chr' || (l_partkey % 5) chrom, l_suppkey % 3 <> 0 bc, l_partkey % 4 = 0 mu from lineitem)
    select count(*) sequenced_reads, count(*) filter (where mate = 1 and fl & 1 <> 0) sequenced_read_pairs, round(count(*) filter (where mate = 1 and fl & 3 = 3) / nullif(count(*) filter (where mate = 1 and fl & 1 <> 0), 0)::double, 9) frac_properly_paired,
    round(count(*) filter (where fl & 4 = 0 and not mu and coalesce(mq, 60) >= 30) / count(*)::double, 9) frac_confidently_mapped, round(count(*) filter (where fl & 4 <> 0) / count(*)::double, 9) frac_unmapped,
    round(count(*) filter (where bc) / count(*)::double, 9) frac_valid_barcode, round(count(*) filter (where bc and chrom = 'chr3' and fl & 4 = 0) / nullif(count(*) filter (where bc and fl & 4 = 0), 0)::double, 9) frac_mitochondrial,
    round(count(*) filter (where fl & 1024 <> 0) / count(*)::double, 9) frac_duplicates, round(count(*) filter (where fl & 4 = 0 and mu) / count(*)::double, 9) frac_multimapped from r"""
)
def align_qc(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(
        (1 + F.col("l_linenumber") % 2).alias("mate"), (F.col("l_orderkey") % 2048).cast("int").alias("flags"), F.nullif(F.col("l_quantity").cast("int"), F.lit(50)).alias("mapq"),
        F.concat(F.lit("chr"), (F.col("l_partkey") % 5).cast("string")).alias("chrom"), F.when(F.col("l_suppkey") % 3 != 0, "x").alias("barcode"), (F.col("l_partkey") % 4 == 0).alias("is_multi"),
    )
    q = Q.align_qc(x, ["chr3"])
    return q.select("sequenced_reads", "sequenced_read_pairs", *(F.round(c, 9).alias(c) for c in q.columns[2:]))


@query(
    """with r as (select unnest([{'p': 'barcode', 'q': repeat(chr(33 + cast(l_quantity as int)), 8)}, {'p': 'umi', 'q': repeat(chr(40 + l_linenumber * 5), l_linenumber)}, {'p': 'read1', 'q': case when l_linenumber = 1 then null else repeat('F', 20) || repeat(',', l_linenumber) end}]) x from lineitem)
    select x.p part, cast(sum(length(x.q)) as bigint) bases, cast(sum(length(regexp_replace(x.q, '[^?-~]', '', 'g'))) as bigint) q30_bases, round(sum(length(regexp_replace(x.q, '[^?-~]', '', 'g'))) / sum(length(x.q))::double, 9) frac_q30_bases from r where x.q is not null group by 1"""
)
def fastq_qc(spark, sf_dir):
    q = lambda c: F.chr(c.cast("long"))
    x = table(spark, sf_dir, "lineitem").select(
        F.repeat(q(33 + F.col("l_quantity").cast("int")), 8).alias("bq"), F.repeat(q(40 + F.col("l_linenumber") * 5), F.col("l_linenumber")).alias("uq"),
        F.when(F.col("l_linenumber") != 1, F.concat(F.repeat(F.lit("F"), 20), F.repeat(F.lit(","), F.col("l_linenumber")))).alias("rq"),
    )
    return Q.fastq_qc(x, {"barcode": "bq", "umi": "uq", "read1": "rq"}).withColumn("frac_q30_bases", F.round("frac_q30_bases", 9))


@query(
    """with r as (select l_orderkey, l_linenumber, l_orderkey // 4 k, l_linenumber % 2 m, l_suppkey % 3 <> 0 p, l_partkey from lineitem), x as (select k, m, l_partkey, l_orderkey, l_linenumber, row_number() over (partition by k, m order by l_partkey, l_orderkey * 10 + l_linenumber) - 1 i, count(*) over (partition by k, m) n from r)
    select k as name, cast(m as int) mate, l_partkey pos, cast(i as int) aln_idx, n > 1 is_multi from x"""
)
def multimap_ranks(spark, sf_dir):
    """Alignments of a read, the primary one first."""
    from pyspark.sql import Window

    x = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("name"), (F.col("l_linenumber") % 2).alias("mate"), F.col("l_partkey").alias("pos"), read_key(), F.lit("chr1").alias("chrom"))
    first = F.row_number().over(Window.partitionBy("name", "mate").orderBy("pos", "read_id"))
    x = x.withColumn("flags", F.when(first == 1, 0).otherwise(256 + 4096 * first))
    return A.multimaps(x).select("name", "mate", "pos", "aln_idx", "is_multi")


# --- further columns and rules, one query each


@query(
    _FRAGS.replace("l_orderkey * 10 + l_linenumber name from", "l_orderkey * 10 + l_linenumber name, l_orderkey % 4 umi from").replace("chrom, a, b, o order", "chrom, a, b, o, umi order").replace("chrom, a, b, o))", "chrom, a, b, o, umi))")
    + ' select chrom, st "start", en "end", barcode, cnt "count", strand from f where en > st'
)
def fragment_dedup_umi(spark, sf_dir):
    """Duplicates agree in the UMI too."""
    p, q = F.col("l_partkey"), F.col("l_quantity").cast("long") * 10
    reads = table(spark, sf_dir, "lineitem").select(
        S.base4("l_suppkey", 8).alias("barcode"), F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("chrom"), p.alias("left_5p"), (p + q).alias("right_5p"), F.col("l_returnflag").alias("orientation"), (F.col("l_orderkey") % 4).alias("umi"),
        (p - F.col("l_orderkey") % 3).alias("frag_start"), (p + q).alias("frag_end"), F.when(F.col("l_returnflag") != "N", "+").alias("strand"), read_key().alias("name"),
    )
    return G.unique_fragments(reads, 4, -5, umi="umi")


@query(
    """with r as (select l_orderkey * 10 + l_linenumber read_id, l_partkey s, l_partkey + 49 e, l_linenumber c, l_suppkey % 4 d, l_orderkey % 2 = 1 rev from lineitem)
    select read_id, case when rev then e + d else s - c end left_5p, case when rev then 'R' else 'F' end orientation, s - 1 frag_start, e frag_end, case when rev then '-' else '+' end strand from r"""
)
def single_fingerprints(spark, sf_dir):
    """Keys of duplicates and fragments of reads without a mate."""
    p = F.col("l_partkey")
    x = table(spark, sf_dir, "lineitem").select(read_key(), (F.col("l_orderkey") % 2 * 16).cast("int").alias("flags"), p.alias("start"), (p + 49).alias("end"), (p - F.col("l_linenumber")).alias("unclipped_start"), (p + 49 + F.col("l_suppkey") % 4).alias("unclipped_end"))
    y = G.single_fingerprint(x)
    return y.select("read_id", "left_5p", "orientation", *(c.alias(n) for n, c in G.single_coordinates().items()))


_SPANS = "l_suppkey, l_orderkey % 64 molecule, l_partkey % 900 s, l_partkey % 900 + cast(l_quantity as bigint) e, l_returnflag = 'R' rev"


@query(
    f"""with {_CHROMS}, r as (select {_SPANS}, off from lineitem join chroms on ord = l_suppkey % 25),
    m as (select *, case when s <= max(e) over (partition by l_suppkey, molecule, rev order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end nw from r),
    i as (select *, sum(nw) over (partition by l_suppkey, molecule, rev order by s, e rows unbounded preceding) isl from m),
    u as (select l_suppkey, molecule, rev, off, min(s) s, max(e) e from i group by l_suppkey, molecule, rev, off, isl)
    select l_suppkey barcode, off + case when rev then e - 1 else s end linear, cast(case when rev then s - e else e - s end as int) size from u"""
)
def molecule_coverage(spark, sf_dir):
    """Spliced segments of molecules, joined strand by strand, as signed coverage."""
    o = _offsets(spark, sf_dir)
    place = o.select(F.col("ord").cast("long").alias("ord"), F.col("name").alias("chrom"))
    s = F.col("l_partkey") % 900
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("barcode"), (F.col("l_orderkey") % 64).alias("molecule"), (F.col("l_suppkey") % 25).alias("ord"), s.alias("start"), (s + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"))
    return I.coverage_values(T.molecule_fragments(x.join(F.broadcast(place), "ord"), ["barcode"]), o)


@query("select l_suppkey, l_linenumber, min(l_partkey) read_start, max(l_partkey + cast(l_quantity as bigint)) read_end from lineitem group by all")
def read_spans(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_partkey").alias("read_start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("read_end"))
    return G.read_extents(x, ["l_suppkey", "l_linenumber"])


@query("select l_orderkey, l_linenumber from lineitem where l_partkey % 4 <> 0 and l_orderkey % 2048 & 4 = 0")
def confident_reads(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumns({"flags": (F.col("l_orderkey") % 2048).cast("int"), "is_multi": F.col("l_partkey") % 4 == 0})
    return x.where(A.confidently_mapped()).select("l_orderkey", "l_linenumber")


@query(
    """with r as (select l_orderkey * 10 + l_linenumber read_id, l_orderkey % 64 f1, l_partkey % 64 f2, l_suppkey % 3 c1, l_linenumber % 3 c2, cast(l_quantity as bigint) * 40 - 900 t from lineitem)
    select read_id, f1 & 4 = 0 and f2 & 4 = 0 and c1 = c2 and f1 & 16 <> f2 & 16 and abs(t) <= 1000 proper from r"""
)
def proper_pairs(spark, sf_dir):
    i = lambda c: c.cast("int")
    p = A.proper_pair(i(F.col("l_orderkey") % 64), F.col("l_suppkey") % 3, F.lit(0), i(F.col("l_partkey") % 64), (F.col("l_linenumber") % 3).cast("long"), F.lit(0), F.col("l_quantity").cast("long") * 40 - 900)
    return table(spark, sf_dir, "lineitem").select(read_key(), p.alias("proper"))


@query(
    """with p as (select p_partkey, p_partkey * 10 s, p_partkey * 10 + p_size * 2 pos from part)
    select p_partkey, case when pos < s + 20 then pos - s when pos >= s + 40 and pos < s + 60 then pos - s - 20 when pos >= s + 80 and pos < s + 100 then pos - s - 40 end "offset", cast(60 as bigint) exonic_length from p"""
)
def transcript_offsets(spark, sf_dir):
    """Places of genome positions within spliced transcripts."""
    x = _transcripts(spark, sf_dir).select(F.substring("transcript_id", 2, 20).cast("long").alias("p_partkey"), "exons").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return x.select("p_partkey", S.transcript_offset("exons", F.col("p_partkey") * 10 + F.col("p_size") * 2).cast("long").alias("offset"), S.exonic_length("exons").alias("exonic_length"))


@query("select p_partkey, p_size % 5 <> 0 and p_size % 3 <> 0 valid from part")
def exon_checks(spark, sf_dir):
    """Exons that overlap, or are empty."""
    k, exon = F.col("p_partkey"), lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    exons = F.array(exon(k, k + 10), exon(F.when(F.col("p_size") % 5 == 0, k + 9).otherwise(k + 10), k + 20), exon(k + 30, F.when(F.col("p_size") % 3 == 0, k + 30).otherwise(k + 40)))
    return table(spark, sf_dir, "part").select("p_partkey", S.exons_valid(exons).alias("valid"))


@query(
    f"""with r as (select event_id, ['sub', 'del', 'ins'][cast(event_id % 3 as int) + 1] k, case when event_id % 3 = 0 then 1 else cast(1 + event_id % 5 as int) end n, {sql4('event_id', 12)} b from events)
    select event_id, case k when 'sub' then substr(b, 1, 1) when 'del' then 'D' || n else 'I' || substr(b, 1, n) end name, case k when 'del' then 0 else n end query_length, case k when 'ins' then 0 else n end reference_length from r"""
)
def mutation_names(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("sub"), F.lit("del"), F.lit("ins")), (F.col("event_id") % 3 + 1).cast("int"))
    n = F.when(F.col("event_id") % 3 == 0, 1).otherwise((1 + F.col("event_id") % 5).cast("int"))
    x = table(spark, sf_dir, "events").select("event_id", kind.alias("k"), n.alias("n"), F.substr(S.base4("event_id", 12), F.lit(1), n).alias("b"))
    return x.select("event_id", S.mutation_name("k", "n", "b").alias("name"), S.mutation_query_length("k", "n").alias("query_length"), S.mutation_reference_length("k", "n").alias("reference_length"))


@query(
    """with r as (select event_id, ['v3LT', 'v4', 'v3'][cast(event_id % 3 as int) + 1] c, nullif(event_id % 4, 0) n from events), t as (select event_id, case when c = 'v3LT' then 9000 when c = 'v4' then coalesce(80000 * n, 160000) else coalesce(45000 * n, 90000) end top from r)
    select event_id, cast(top // 2 as bigint) first_rank, cast(top as bigint) last_rank from t"""
)
def empty_drops_ranks(spark, sf_dir):
    c = F.element_at(F.array(F.lit("v3LT"), F.lit("v4"), F.lit("v3")), (F.col("event_id") % 3 + 1).cast("int"))
    r = S.empty_drops_range(c, F.nullif(F.col("event_id") % 4, F.lit(0)))
    return table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", F.col("r.first").alias("first_rank"), F.col("r.last").alias("last_rank"))


@query("select l_orderkey * 10 + l_linenumber read_id, round(8 * power(10e0, -cast(l_quantity as int) / 10e0) + l_linenumber * power(10e0, -3.7e0), 9) errors from lineitem")
def expected_error_sums(spark, sf_dir):
    q = F.concat(F.repeat(F.chr((33 + F.col("l_quantity").cast("int")).cast("long")), 8), F.repeat(F.lit("F"), F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").select(read_key(), F.round(S.expected_errors(q), 9).alias("errors"))


@query(
    f"""with r as (select event_id, case when event_id % 2 = 0 then lower({sql4('event_id', 10)}) else {sql4('event_id', 10)} end s from events)
    select event_id, reverse(translate(s, 'ACGTacgt', 'TGCATGCA')) upper_rc, reverse(translate(s, 'ACGT', 'TGCA')) proper_rc, translate(s, 'ACGTacgt', 'TGCAtgca') complement, case when event_id % 3 = 0 then 'r' || event_id else 'r' || event_id || '/3' end as name from r"""
)
def case_and_suffix(spark, sf_dir):
    """Complements of both cases, and names with and without a mate's suffix."""
    s = F.when(F.col("event_id") % 2 == 0, F.lower(S.base4("event_id", 10))).otherwise(S.base4("event_id", 10))
    name = F.concat(F.lit("r"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/"), (1 + F.col("event_id") % 2).cast("string"))).otherwise("/3"))
    return table(spark, sf_dir, "events").select("event_id", S.revcomp(s).alias("upper_rc"), S.revcomp(s, any_case=False).alias("proper_rc"), S.complement_keeping_case(s).alias("complement"), S.strip_mate_suffix(name).alias("name"))


@query("select l_orderkey * 10 + l_linenumber read_id, case when l_linenumber = 1 then 'A' when l_linenumber = 2 then '^CTC' else cast(cast(l_quantity as int) as varchar) end token from lineitem")
def md_token_places(spark, sf_dir):
    """The second, third or first token of an MD text."""
    md = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("A0^CTC7"))
    at = F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") == 2, 3).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(read_key(), F.get(S.md_tokens(md), at).alias("token"))


@query(
    f"""with c as (select {sql4('l_suppkey', 8)} barcode, l_partkey % 500 g, count(*) v from lineitem group by all), r as (select barcode, count(*) n, sum(v) total, sum(v * g) weighted from c group by 1)
    select barcode, row_number() over (order by barcode) - 1 as row_idx, cast(sum(n) over (order by barcode) - n as bigint) as ptr, n as entries, cast(total as bigint) total, cast(weighted as bigint) weighted from r"""
)
def matrix_blocks(spark, sf_dir):
    """A sparse matrix of cells by genes in blocks, taken apart again by its pointers."""
    c = table(spark, sf_dir, "lineitem").groupBy(S.base4("l_suppkey", 8).alias("barcode"), (F.col("l_partkey") % 500).alias("gene_idx")).agg(F.count("*").alias("value"))
    b = T.csr_blocks(c, entries=4096).select("first_row", "indptr", "indices", "data", F.posexplode("cells").alias("i", "barcode"))
    ptr, n = F.get("indptr", F.col("i")), F.get("indptr", F.col("i") + 1) - F.get("indptr", F.col("i"))
    own = lambda x: F.slice(x, (ptr - F.get("indptr", F.lit(0)) + 1).cast("int"), n.cast("int"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    return b.select("barcode", (F.col("first_row") + F.col("i")).alias("row_idx"), ptr.alias("ptr"), n.alias("entries"), total(own("data")).alias("total"), total(F.zip_with(own("indices"), own("data"), lambda g, v: g * v)).alias("weighted"))


@query(
    f"""select cast(l_orderkey * 10 + l_linenumber as varchar) as name, cast(l_orderkey % 4096 as int) flags, case when l_suppkey % 5 <> 0 then 'chr' || l_suppkey % 5 end chrom, cast(l_partkey as bigint) pos, nullif(cast(l_quantity as int), 50) mapq,
      case when l_linenumber <> 3 then (8 - l_linenumber) || 'M' || l_linenumber || 'S' end cigar, {sql4('l_orderkey', 8)} seq, case when l_linenumber <> 2 then repeat(chr(cast(40 + l_linenumber as int)), 8) end qual, cast(8 - l_linenumber as varchar) md, case when l_linenumber <> 1 then {sql4('l_suppkey', 8)} end barcode, case when l_orderkey % 3 = 0 then 'chr1' end mate_chrom, case when (l_orderkey % 4096) & 128 <> 0 then 2 else 1 end mate
    from lineitem"""
)
def bam_round_trip(spark, sf_dir):
    """Alignments written as BAM files and read back by ranges of blocks."""
    none = F.lit(None).cast("string")
    n = F.col("l_linenumber").cast("int")
    x = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).cast("string").alias("name"), (F.col("l_orderkey") % 4096).cast("int").alias("flags"), F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string"))).alias("chrom"),
        F.col("l_partkey").cast("long").alias("pos"), F.nullif(F.col("l_quantity").cast("int"), F.lit(50)).alias("mapq"), F.when(n != 3, F.concat((8 - n).cast("string"), F.lit("M"), n.cast("string"), F.lit("S"))).alias("cigar"), S.base4("l_orderkey", 8).alias("seq"),
        F.when(n != 2, F.repeat(F.char(40 + n), F.lit(8))).alias("qual"), (8 - n).cast("string").alias("md"), none.alias("raw_barcode"), F.when(n != 1, S.base4("l_suppkey", 8)).alias("barcode"), none.alias("umi"), F.when(F.col("l_orderkey") % 3 == 0, "chr1").alias("mate_chrom"),
    )
    path = shared_path(spark, "bam")
    A.write_bam(x, path, [(f"chr{i}", 1 << 29) for i in range(1, 5)])
    return A.read_bam(spark, path, 1 << 20).select("name", "flags", "chrom", "pos", "mapq", "cigar", "seq", "qual", "md", "barcode", "mate_chrom", "mate")


@query(f"select row_number() over (order by event_id) - 1 as rec_idx, 'r' || event_id as name, {sql4('user_id', 8)} as seq1, repeat('@', 8) as qual1, {sql4('event_id', 12)} as seq2 from events")
def fastq_lockstep(spark, sf_dir):
    """Two reads of every event written as compressed FASTQ files and read back together, a range of records at a time."""
    x = table(spark, sf_dir, "events").select("event_id", S.base4("user_id", 8).alias("a"), S.base4("event_id", 12).alias("b"))
    paths = {k: shared_path(spark, k) for k in ("R1", "R2")}
    for k, seq in (("R1", "a"), ("R2", "b")):
        named = x.select("event_id", F.concat(F.lit("r"), F.col("event_id").cast("string"), F.lit(f"/{k[1]}")).alias("name"), F.col(seq).alias("seq"), F.repeat(F.lit("@"), F.length(seq)).alias("qual"))
        FQ.write_fastq(named, paths[k], compression="gzip" if k == "R1" else "none", order="event_id")
    both = FQ.read_lockstep(spark, {k: [p] for k, p in paths.items()}, range_bytes=1 << 20)
    return both.select("rec_idx", "name", F.col("R1.seq").alias("seq1"), F.col("R1.qual").alias("qual1"), F.col("R2.seq").alias("seq2"))


@query(
    """with r as (select l_orderkey * 10 + l_linenumber name, l_orderkey % 4096 flags, case when l_suppkey % 5 = 0 then null else 'chr' || l_suppkey % 5 end chrom, l_partkey pos, nullif(cast(l_quantity as int), 50) mapq, case when l_linenumber = 1 then null else 'AC' || l_linenumber end bc from lineitem)
    select name || chr(9) || flags || chr(9) || coalesce(chrom, '*') || chr(9) || pos || chr(9) || coalesce(mapq, 255) || chr(9) || '4M' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || 'ACGT' || chr(9) || 'FFFF' || chr(9) || 'MD:Z:4' || coalesce(chr(9) || 'CB:Z:' || bc, '') as line from r"""
)
def sam_lines(spark, sf_dir):
    """Alignments as lines of text; unknown places and qualities, and tags where there are any."""
    none = F.lit(None).cast("string")
    x = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("name"), (F.col("l_orderkey") % 4096).cast("int").alias("flags"), F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string"))).alias("chrom"),
        F.col("l_partkey").alias("pos"), F.nullif(F.col("l_quantity").cast("int"), F.lit(50)).alias("mapq"), F.lit("4M").alias("cigar"), F.lit("4").alias("md"), F.lit("ACGT").alias("seq"), F.lit("FFFF").alias("qual"),
        none.alias("raw_barcode"), F.when(F.col("l_linenumber") != 1, F.concat(F.lit("AC"), F.col("l_linenumber").cast("string"))).alias("barcode"), none.alias("umi"),
    )
    return x.select(A.sam_line().alias("line"))


@query(
    f"""with r as (select event_id, {sql4('user_id', 6)} bc, case when user_id % 3 <> 0 then {sql4('user_id', 6)} end ok, {sql4('event_id % 256', 4)} umi, {sql4('event_id', 12)} s from events)
    select event_id as name, ok || umi || s seq1, 'IIIIIIFFFF' || repeat(':', 12) qual1, case when event_id % 2 = 0 then substr(s, 1, 5) end seq2 from r where ok is not null"""
)
def consolidated_reads(spark, sf_dir):
    """Corrected barcode, UMI and first read as one record; reads that could not be corrected go."""
    s, b = S.base4("event_id", 12), S.base4("user_id", 6)
    read = lambda x, q: F.struct(x.alias("seq"), F.repeat(F.lit(q), F.length(x)).alias("qual"))
    x = table(spark, sf_dir, "events").select(F.col("event_id").alias("name"), b.alias("barcode"), F.lit("IIIIII").alias("barcode_qual"), F.when(F.col("user_id") % 3 != 0, b).alias("corrected"), S.base4(F.col("event_id") % 256, 4).alias("umi"), F.lit("FFFF").alias("umi_qual"), read(s, ":").alias("r1"), F.when(F.col("event_id") % 2 == 0, read(F.substring(s, 1, 5), ":")).alias("r2"))
    return FQ.consolidated(x, True).select("name", "seq1", "qual1", "seq2")
