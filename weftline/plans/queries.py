"""Queries over the planted fixtures, one or more per operator, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline import fixtures as fx
from weftline.functions import ordering, sequence, stats
from weftline.functions.runs import by_runs
from weftline.operators import assess, cluster, layout, links, longread, merge, regress, superscaffold
from weftline.operators.components import checkpointed, connected_components
from weftline.sources import readers, sinks
from weftline.streaming import link_counts

from . import scaffolding

MIN_LINKS = 12
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Data:
    """The fixture's relations for one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fx.build(self.spark, self.sf_dir, getattr(fx, name.upper()))

    @property
    def obs(self) -> DataFrame:
        return links.link_observations(links.span_filter(self.pairs, self.libraries, self.contigs), self.libraries)

    @property
    def raw_obs(self) -> DataFrame:
        return links.link_observations(self.pairs, self.libraries)

    @property
    def votes(self) -> DataFrame:
        return links.orientation_votes(self.obs)

    def documents(self) -> DataFrame:
        d = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")
        return d.select("doc_id", F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGTN]", "").alias("seq"))

    def clusters(self, obs: DataFrame) -> DataFrame:
        return cluster.jump_clusters(obs, self.libraries)

    def places(self) -> DataFrame:
        return self.layout.select("scaffold_id", "contig_id", F.col("start").alias("pos"))


# ---- shared SQL ---------------------------------------------------------------------------------------------
WITH = f"with contigs as ({fx.oracle(fx.CONTIGS)}), pairs as ({fx.oracle(fx.PAIRS)}), libs as ({fx.LIBRARIES}), layout as ({fx.oracle(fx.LAYOUT)}), align as ({fx.oracle(fx.ALIGNMENTS)})"
JOINED = "select p.*, l.lib_type, l.insert_size, l.sd, a.len len1, b.len len2 from pairs p join libs l using(lib) join contigs a on a.contig_id = p.c1 join contigs b on b.contig_id = p.c2 where c1 <> c2"
FILTERED = f"""
select lib, c1, p1, m1, c2, p2, m2 from ({JOINED}) where p1 = m1 or p2 = m2 or greatest(
  case when lib_type = 'PE' then case when p1 < m1 then len1 - p1 else p1 end when p1 > m1 then len1 - m1 else m1 end,
  case when lib_type = 'PE' then case when p2 > m2 then p2 else len2 - p2 end when p2 < m2 then m2 else len2 - m2 end) <= 3 * sd + insert_size"""
PE_DIFF = "case when p1<m1 and p2>m2 then 800-p2+p1 when p1<m1 and p2<m2 then 800+p2+p1 when p1>m1 and p2>m2 then p1+p2-800 else p1-p2-800 end"
MP_DIFF = "case when p1>m1 and p2<m2 then g-p2+p1 when p1>m1 and p2>m2 then g+p2+p1 when p1<m1 and p2<m2 then p1+p2-g else p1-p2-g end"
OBS_OF = """select lib, lib lib_type, c1, c2, cast(case when (p1<m1)=(p2>m2) then 1 else -1 end as integer) cons,
  cast(case when lib = 'PE' then {pe} else {mp} end as double) diff from (select *, 3000-abs(p1-m1)-abs(p2-m2) g from {t} where p1 <> m1 and p2 <> m2)"""
OBS = OBS_OF.format(pe=PE_DIFF, mp=MP_DIFF, t="filtered")
VOTES = """select c1, c2, cast(sum(n_pos) as bigint) n_pos, cast(sum(n_neg) as bigint) n_neg, cast(sum(sp) as bigint) short_pos, cast(sum(sn) as bigint) short_neg, cast(sum(lp) as bigint) long_pos, cast(sum(ln) as bigint) long_neg from (
  select c1, c2, (cons=1)::int n_pos, (cons=-1)::int n_neg, (cons=1 and lib='PE')::int sp, (cons=-1 and lib='PE')::int sn, (cons=1 and lib<>'PE')::int lp, (cons=-1 and lib<>'PE')::int ln from obs
  union all select c2, c1, (cons=1)::int, (cons=-1)::int, (cons=1 and lib='PE')::int, (cons=-1 and lib='PE')::int, (cons=1 and lib<>'PE')::int, (cons=-1 and lib<>'PE')::int from obs) group by c1, c2"""
COUNTS = "select c1, c2, count(*) n from (select c1, c2 from obs union all select c2, c1 from obs) group by c1, c2"
EDGES = f"select c1, c2, greatest(n_pos, n_neg) weight, n_pos - n_neg direct_sum from votes join contigs a on a.contig_id = c1 join contigs b on b.contig_id = c2 where c1 < c2 and n_pos <> n_neg and greatest(n_pos, n_neg) > {MIN_LINKS} and a.len > 300 and b.len > 300"
CLUSTERS = """select lib, lib_type, c1, c2, cons, diff, sd, cast(sum(cut) over (partition by lib, c1, c2, cons order by diff rows unbounded preceding) as bigint) cluster from (
  select *, case when one or gap is null or gap <= greatest(sd, 10) then 0 else 1 end cut from (
    select o.*, l.sd, diff - lag(diff) over (partition by lib, c1, c2, cons order by diff) gap, sqrt(var_pop(diff) over (partition by lib, c1, c2, cons)) < l.sd one from obs o join libs l using(lib)))"""
ROWS = """select lib, c1, c2, cons, cluster, n, y, case when n >= 6 then greatest(v, 1) else sd*sd end v, 100*n/case when n >= 6 then greatest(v, 1) else sd*sd end w from (
  select lib, c1, c2, cons, cluster, count(*) n, median(diff) y, var_pop(diff) v, max(sd) sd from clusters group by all having count(*) >= 2)"""
CHAIN = f"{WITH}, filtered as ({FILTERED}), obs as ({OBS}), votes as ({VOTES}), counts as ({COUNTS}), edges as ({EDGES}), clusters as ({CLUSTERS}), obs_rows as ({ROWS})"
COMPONENTS = """both_ends as (select c1 a, c2 b from {e} union select c2, c1 from {e}), reach(node, seen) as (select a, a from both_ends union select b, seen from reach join both_ends on a = node),
comp as (select node, min(seen) component from reach group by node)"""


def rec(chain: str) -> str:
    return chain.replace("with contigs", "with recursive contigs", 1)


# ---- filters, projections, links ------------------------------------------------------------------------------
@query(f"{CHAIN} select * from filtered")
def pair_span_filter(spark, sf_dir):
    d = Data(spark, sf_dir)
    return links.span_filter(d.pairs, d.libraries, d.contigs)


@query(f"{WITH} select c1, c2, cast({PE_DIFF} as double) diff, cast(case when (p1<m1)=(p2>m2) then 1 else -1 end as integer) cons from pairs where lib = 'PE' and p1 <> m1 and p2 <> m2")
def pe_link_diff(spark, sf_dir):
    return Data(spark, sf_dir).raw_obs.where("lib = 'PE'").select("c1", "c2", "diff", "cons")


@query(f"{WITH} select c1, c2, cast({MP_DIFF} as double) diff, cast(case when (p1<m1)=(p2>m2) then 1 else -1 end as integer) cons from (select *, 3000-abs(p1-m1)-abs(p2-m2) g from pairs) where lib = 'MP' and p1 <> m1 and p2 <> m2")
def mp_link_diff(spark, sf_dir):
    return Data(spark, sf_dir).raw_obs.where("lib = 'MP'").select("c1", "c2", "diff", "cons")


@query(f"select lib, insert_size + cast(trunc(sd*sd/(1+insert_size)) as bigint) insert_size from ({fx.SUPPLIED.format(supplier='supplier')})")
def gap_corrected_insert(spark, sf_dir):
    return supplied(spark, sf_dir).select("lib", (F.col("insert_size") + links.gap_correction(F.col("insert_size"), F.col("sd"))).alias("insert_size"))


@query(f"{CHAIN} select * from counts")
def link_count_symmetric(spark, sf_dir):
    return links.link_counts(Data(spark, sf_dir).obs)


@query(f"{CHAIN} select * from votes")
def orientation_votes(spark, sf_dir):
    return Data(spark, sf_dir).votes


@query(f"{CHAIN} select * from edges")
def contig_edges(spark, sf_dir):
    d = Data(spark, sf_dir)
    return links.contig_edges(d.votes, d.contigs, MIN_LINKS)


@query(f"{CHAIN} select c1, c2 from votes join contigs a on a.contig_id = c1 join contigs b on b.contig_id = c2 where c1 < c2 and a.len > 300 and b.len > 300")
def loose_edges(spark, sf_dir):
    d = Data(spark, sf_dir)
    return links.loose_edges(d.votes, d.contigs)


@query(f"{CHAIN} select c1, c2, n_pos, n_neg from votes where c1 < c2 and least(n_pos, n_neg) >= 3")
def conflict_links(spark, sf_dir):
    return links.conflict_links(Data(spark, sf_dir).votes, 3)


@query(f"{CHAIN} select cast(trunc(quantile_cont(n, 0.1)) as bigint) min_links from counts where n <> 1")
def auto_link_threshold(spark, sf_dir):
    return links.auto_threshold(links.link_counts(Data(spark, sf_dir).obs))


@query(f"{CHAIN}, p as (select greatest(1 - 2.0 * (select count(*) from contigs) / (select count(*) from counts), 0.7) p), r as (select n, row_number() over (order by n) - 1 i, count(*) over () k from counts) select n + 0.0::double min_links from r, p where i = floor(p * (k - 1))")
def auto_link_threshold_sqrt(spark, sf_dir):
    d = Data(spark, sf_dir)
    t = links.auto_threshold_sqrt(links.link_counts(d.obs), d.contigs)
    return t.select(F.floor("min_links").cast("double").alias("min_links"))


@query(f"""with libs as ({fx.LIBRARIES}), pairs as ({fx.oracle(fx.SELF_PAIRS)}), x as (select lib, lib_type, insert_size, sd, greatest(p1,m1,p2,m2)-least(p1,m1,p2,m2) x from pairs join libs using(lib) where c1 = c2 and 2000 + 250 * (c1 % 40) >= 3 * insert_size)
select lib, lib_type, cast(trunc(median(x)) as bigint) insert_size, round(stddev_samp(x), 6) sd from x where abs(x - insert_size) <= 3*sd group by lib, lib_type having count(*) > 1""")
def insert_size_recalibration(spark, sf_dir):
    d = Data(spark, sf_dir)
    long = d.contigs.withColumn("len", (2000 + 250 * (F.col("contig_id") % 40)).cast("long"))  # only some are three inserts long
    return links.recalibrate(d.self_pairs, d.libraries, long).withColumn("sd", F.round("sd", 6))


def supplied(spark, sf_dir) -> DataFrame:
    """A library for every supplier."""
    return spark.sql(fx.SUPPLIED, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


def _config(spark, sf_dir) -> readers.Config:
    """A configuration with a library for every nation (25 rows), in the format of both templates: a heading may list its fields
    or explain them."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    kinds = [("PE", 300, 10), ("MP", 2000, 100), ("3GS", 0, 0)]
    lines = ["# library_name, type, insert_size, insert_size_deviation, lib_path1, lib_path2"]
    for r in nations:
        kind, insert, sd = kinds[r.n_nationkey % 3]
        lines.append(f"{r.n_name}, {kind},  {insert + (r.n_nationkey * 10 if insert else 0)}, {sd + (r.n_regionkey if sd else 0)}, {r.n_nationkey}a.fq , b.fq")
    lines += ["", "# parameters (thread: the number of threads; reg_m: links that an edge needs)", f"thread, {len(nations)}", f"reg_m, {sum(r.n_nationkey for r in nations) % 50}", f"ScafIter, {1 + len({r.n_regionkey for r in nations})}"]
    return readers.parse_config("\n".join(lines))


NATION_LIBS = """select n_name lib, case n_nationkey % 3 when 0 then 'PE' when 1 then 'MP' else '3GS' end lib_type,
  cast(case n_nationkey % 3 when 0 then 300 + n_nationkey * 10 when 1 then 2000 + n_nationkey * 10 else 0 end as bigint) insert_size, cast(case n_nationkey % 3 when 0 then 10 + n_regionkey when 1 then 100 + n_regionkey else 0 end as double) sd from nation"""


@query(f"select lib_type, count(*) n, max(insert_size) max_insert, max(sd) max_sd, string_agg(lib, ',' order by lib) names from ({NATION_LIBS}) group by lib_type")
def library_classes(spark, sf_dir):
    config = _config(spark, sf_dir)
    rows = [(t, n) for t, names in config.classes().items() for n in names]
    classes = spark.createDataFrame(rows, "lib_type string, lib string")
    found = classes.join(config.frame(spark).drop("lib_type"), "lib").groupBy("lib_type")
    return found.agg(F.count("*").alias("n"), F.max("insert_size").alias("max_insert"), F.max("sd").alias("max_sd"), F.array_join(F.array_sort(F.collect_list("lib")), ",").alias("names"))


@query("select 'min_links' name, cast(sum(n_nationkey) % 50 as bigint) value from nation union all select 'rounds', 1 + count(distinct n_regionkey) from nation")
def config_options(spark, sf_dir):
    o = scaffolding.Options.of(_config(spark, sf_dir))
    return spark.createDataFrame([("min_links", o.min_links), ("rounds", o.rounds)], "name string, value long")


@query(f"select greatest(max(case when lib_type='MP' then insert_size end), 1000) max_in, greatest(max(case when lib_type='MP' then sd end), 10) max_sd, greatest(max(sd), 1) any_sd from ({fx.SUPPLIED.format(supplier='supplier')})")
def library_limits(spark, sf_dir):
    return links.library_limits(supplied(spark, sf_dir))


# ---- clusters and regression rows -----------------------------------------------------------------------------
@query(f"{CHAIN} select lib, c1, c2, cons, diff, cluster from clusters")
def cluster_by_jump(spark, sf_dir):
    d = Data(spark, sf_dir)
    return d.clusters(d.obs).select("lib", "c1", "c2", "cons", "diff", "cluster")


@query(f"{CHAIN} select lib, c1, c2, cons, cluster, n, y, round(v, 6) v, round(w, 6) w from obs_rows")
def edge_observations(spark, sf_dir):
    d = Data(spark, sf_dir)
    return cluster.observation_rows(d.clusters(d.obs)).withColumn("v", F.round("v", 6)).withColumn("w", F.round("w", 6))


@query(f"{CHAIN} select lib, c1, c2, cons, cluster, count(*) n, median(diff) y, round(stddev_pop(diff)+1, 6) v, round(sqrt(count(*))/(stddev_pop(diff)+1), 6) w from clusters group by all having count(*) >= 2")
def edge_observations_sqrt(spark, sf_dir):
    d = Data(spark, sf_dir)
    return cluster.observation_rows(d.clusters(d.obs), weighting="sqrt").withColumn("v", F.round("v", 6)).withColumn("w", F.round("w", 6))


#: Density at each sorted offset, its peaks (middles of plateaus, the higher of two closer than 3), borders, splits.
DENSITY = """sorted_ as (select lib, c1, c2, cons, list(diff order by diff) x, greatest(max(l.sd), 10.0) sd, sqrt(var_pop(diff)) < max(l.sd) one from obs o join libs l using (lib) group by lib, c1, c2, cons),
dense as (select *, case when one then [] else list_transform(x, lambda v: list_sum(list_transform(x, lambda u: exp(-0.5 * ((u - v) / least(sd / 2, 100)) ^ 2)))) end y from sorted_),
tops as (select *, list_filter(list_transform(range(2, len(y)), lambda i: [i - 1, coalesce(list_filter(range(i, len(y) + 1), lambda k: y[k] <> y[i])[1], 0)]), lambda t: y[t[1] + 1] > y[t[1]] and t[2] > 0 and y[t[2]] < y[t[1] + 1]) t from dense),
middle as (select *, list_transform(t, lambda t: ((t[1] + t[2] - 2) // 2)::bigint) p from tops),
high as (select *, list_transform(list_sort(list_transform(p, lambda p: {'h': -y[p + 1], 'p': p})), lambda s: s.p) q from middle),
kept as (select *, list_sort(list_reduce(list_transform(q, lambda v: [v]), lambda a, b: case when len(list_filter(a, lambda k: abs(k - b[1]) < 3)) > 0 then a else list_concat(a, b) end, []::bigint[])) k from high),
borders as (select *, list_concat(list_transform(range(1, len(k)), lambda i: (x[k[i] + 1] + x[k[i + 1] + 1]) / 2), list_transform(list_filter(range(1, len(x)), lambda i: not one and x[i + 1] - x[i] > sd), lambda i: x[i] + sd / 2)) b from kept),
splits as (select *, list_transform(range(1, len(x) + 1), lambda i: case when not one and i > 1 and x[i] - x[i - 1] >= sd / 2 and len(list_filter(b, lambda v: v >= x[i - 1] and v < x[i])) > 0 then 1 else 0 end) s from borders),
numbered_ as (select lib, c1, c2, cons, unnest(x) diff, unnest(list_transform(range(1, len(x) + 1), lambda i: list_sum(s[1:i])::bigint)) cluster from splits)"""


@query(f"{CHAIN}, {DENSITY} select lib, c1, c2, cons, diff, cluster from numbered_")
def cluster_by_density(spark, sf_dir):
    d = Data(spark, sf_dir)
    return cluster.jump_clusters(d.obs, d.libraries, exact_band=True).select("lib", "c1", "c2", "cons", "diff", "cluster")


@query(f"{CHAIN} select c1, c2, round(sum(w*y)/sum(w), 6) x from obs_rows where cons = 1 group by c1, c2")
def two_contig_wls(spark, sf_dir):
    """Every linked pair as a component of two, by the solver; in closed form the weighted mean of its rows."""
    d = Data(spark, sf_dir)
    rows = cluster.observation_rows(d.clusters(d.obs)).where("cons = 1").select("c1", "c2", "y", "w")

    def run(g):
        first, second = np.zeros(len(g["y"]), int), np.ones(len(g["y"]), int)
        x, _ = regress.solve(2, first, second, g["y"], g["w"])
        return {"c1": g["c1"][:1], "c2": g["c2"][:1], "x": x[1:]}

    return by_runs(rows, ["c1", "c2"], ["y", "w"], run, "c1 long, c2 long, x double").withColumn("x", F.round("x", 6))


# ---- graph ----------------------------------------------------------------------------------------------------
def _components(d: Data) -> DataFrame:
    e = links.contig_edges(d.votes, d.contigs, MIN_LINKS)
    return connected_components(e.select(F.col("c1").alias("src"), F.col("c2").alias("dst")))


@query(f"{rec(CHAIN)}, {COMPONENTS.format(e='edges')} select * from comp")
def components(spark, sf_dir):
    return _components(Data(spark, sf_dir))


@query(f"{CHAIN}, varied as (select contig_id, 100 + contig_id % 400 len from contigs) select contig_id, len from varied where contig_id not in (select c1 from edges union select c2 from edges) and len < 300")
def small_contigs(spark, sf_dir):
    d = Data(spark, sf_dir)
    e = links.contig_edges(d.votes, d.contigs, MIN_LINKS)
    placed = e.select(F.explode(F.array("c1", "c2")).alias("contig_id"))
    return layout.unplaced(d.contigs.withColumn("len", 100 + F.col("contig_id") % 400), placed)[1]


@query(f"{CHAIN}, varied as (select contig_id, 100 + contig_id % 400 len from contigs) select contig_id scaffold_id, contig_id, 0.0::double as start, len::double as \"end\", 'F' direct, 0.0::double std, len from varied where contig_id not in (select c1 from edges union select c2 from edges) and len >= 300")
def singleton_layouts(spark, sf_dir):
    d = Data(spark, sf_dir)
    e = links.contig_edges(d.votes, d.contigs, MIN_LINKS)
    placed = e.select(F.explode(F.array("c1", "c2")).alias("contig_id"))
    return layout.unplaced(d.contigs.withColumn("len", 100 + F.col("contig_id") % 400), placed)[0]


#: Planted: every third fragment is turned round, so the votes of a pair of which one is turned change sides.
TURNED = "c1 % 3 = 0 <> (c2 % 3 = 0)"
TURNS = f"{rec(CHAIN)}, {COMPONENTS.format(e='edges')} select component, node, cast(case when (node % 3 = 0) = (component % 3 = 0) then 1 else -1 end as integer) orient from comp"


def _turned_votes(d: Data) -> DataFrame:
    turned = (F.col("c1") % 3 == 0) != (F.col("c2") % 3 == 0)
    return d.votes.select("c1", "c2", F.when(turned, F.col("n_neg")).otherwise(F.col("n_pos")).alias("n_pos"), F.when(turned, F.col("n_pos")).otherwise(F.col("n_neg")).alias("n_neg"))


@query(TURNS)
def orient_components(spark, sf_dir):
    d = Data(spark, sf_dir)
    return regress.orientations(_components(d), _turned_votes(d), MIN_LINKS)


@query(TURNS)
def orient_by_full_field(spark, sf_dir):
    d = Data(spark, sf_dir)
    return regress.orientations(_components(d), _turned_votes(d), MIN_LINKS, full_field=True)


@query(TURNS)
def orient_by_spanning_tree(spark, sf_dir):
    d = Data(spark, sf_dir)
    return regress.orientations(_components(d), _turned_votes(d), MIN_LINKS, tree=True)


#: Votes (i, j, for, against) among five fragments on which the ways of orienting them differ, and what each way gives: the
#: search with flips, flips by the whole field, a spanning tree. Every customer's five fragments have those of one case.
CASES = [
    ([(0, 4, 5, 2), (1, 2, 0, 9), (2, 3, 22, 25), (3, 4, 21, 23)], [1, -1, 1, 1, 1], [1, 1, -1, 1, 1], [1, -1, 1, -1, 1]),
    ([(0, 1, 18, 9), (0, 2, 17, 10), (0, 3, 19, 13), (1, 2, 26, 21), (1, 3, 6, 12), (1, 4, 23, 24), (2, 3, 11, 1), (2, 4, 4, 21), (3, 4, 4, 10)], [-1, -1, -1, -1, 1], [-1, -1, -1, -1, 1], [1, 1, 1, 1, -1]),
    ([(0, 1, 9, 25), (1, 2, 17, 12), (1, 3, 2, 16), (1, 4, 10, 15), (2, 3, 11, 3)], [1, -1, -1, -1, 1], [1, -1, 1, 1, 1], [1, -1, -1, 1, 1]),
    ([(0, 1, 18, 22), (1, 4, 27, 4), (2, 3, 3, 2), (2, 4, 9, 7)], [1, -1, -1, 1, -1], [1, -1, -1, -1, -1], [1, -1, -1, -1, -1]),
]


def case_sql(way: int) -> str:
    given = ", ".join(f"({k}, {i}, {d})" for k, case in enumerate(CASES) for i, d in enumerate(case[1 + way]))
    return f"select c_custkey component, cast(c_custkey * 5 + i as bigint) node, cast(d as integer) orient from customer join (values {given}) t(k, i, d) on c_custkey % {len(CASES)} = k"


def _cases(spark, sf_dir, **how) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    rows = [(k, *v) for k, case in enumerate(CASES) for v in case[0]]
    said = spark.createDataFrame(rows, "k int, i int, j int, n_pos long, n_neg long")
    votes = customers.join(F.broadcast(said), F.col("c_custkey") % len(CASES) == F.col("k")).select((F.col("c_custkey") * 5 + F.col("i")).cast("long").alias("c1"), (F.col("c_custkey") * 5 + F.col("j")).cast("long").alias("c2"), "n_pos", "n_neg")
    comp = customers.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), "c_custkey").select((F.col("c_custkey") * 5 + F.col("i")).cast("long").alias("node"), F.col("c_custkey").cast("long").alias("component"))
    # cut into pieces by all votes, whatever their number: every component is one piece here
    return regress.orientations(comp, votes, 5, cap=5, **how).select((F.floor(F.col("node") / 5)).cast("long").alias("component"), "node", "orient")


@query(case_sql(0))
def orient_cases(spark, sf_dir):
    return _cases(spark, sf_dir)


@query(case_sql(1))
def orient_cases_full_field(spark, sf_dir):
    return _cases(spark, sf_dir, full_field=True)


@query(case_sql(2))
def orient_cases_tree(spark, sf_dir):
    return _cases(spark, sf_dir, tree=True)


#: Chains of forty parts with links to the next two, two in five turned round; the cap is a fifth of that.
TURNED_CHAINS = "select p_partkey, cast(floor(p_partkey / 40) as bigint) * 40 head, case when (p_partkey * 7) % 5 < 2 then -1 else 1 end turn from {part}"


@query(f"with t as ({TURNED_CHAINS.format(part='part')}), h as (select head, min(p_partkey) first_ from t group by head) select first_ component, t.p_partkey node, cast(t.turn * f.turn as integer) orient from t join h using (head) join t f on f.p_partkey = first_")
def orient_in_pieces(spark, sf_dir):
    """Components of more nodes than the cap: pieces agree with each other."""
    t = checkpointed(spark.sql(TURNED_CHAINS, part=spark.read.parquet(f"{sf_dir}/part.parquet")))
    a = t.select("head", F.col("p_partkey").alias("c1"), F.col("turn").alias("t1"))
    b = t.select("head", F.col("p_partkey").alias("c2"), F.col("turn").alias("t2"))
    near = a.withColumn("c2", F.explode(F.array(F.col("c1") + 1, F.col("c1") + 2))).join(b, ["head", "c2"])
    n = 20 + F.col("c1") % 9
    votes = checkpointed(near.select("c1", "c2", F.when(F.col("t1") == F.col("t2"), n).otherwise(2).alias("n_pos"), F.when(F.col("t1") == F.col("t2"), 2).otherwise(n).alias("n_neg")))
    comp = connected_components(votes.select(F.col("c1").alias("src"), F.col("c2").alias("dst")))
    alone = t.join(comp.select(F.col("node").alias("p_partkey")), "p_partkey", "left_anti").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("component"))
    return regress.orientations(checkpointed(comp.unionByName(alone)), votes, MIN_LINKS, cap=8)


def near_truth(laid: DataFrame) -> DataFrame:
    """scaffold_id, contig_id, direct, and whether the start is within 60 of the planted one, seen from the scaffold's smallest
    fragment (tolerance: the noise of 25 at most on two libraries)."""
    first = laid.where("contig_id = scaffold_id").select("scaffold_id", F.col("start").alias("s0"))
    away = F.col("start") - F.col("s0") - 1050 * (F.col("contig_id") - F.col("scaffold_id"))
    return laid.join(first, "scaffold_id").select("scaffold_id", "contig_id", "direct", (F.abs(away) <= 60).alias("near"))


SOLO = "whole as (select contig_id, coalesce(component, contig_id) scaffold_id from contigs left join comp on node = contig_id)"


@query(f"{rec(CHAIN)}, {COMPONENTS.format(e='edges')}, {SOLO} select scaffold_id, contig_id, 'F' direct, true near from whole")
def regress_layout(spark, sf_dir):
    d = Data(spark, sf_dir)
    return near_truth(scaffolding.contig_layout(d.obs, d.libraries, d.contigs, scaffolding.Options())[0])


# ---- regression that trims --------------------------------------------------------------------------------------
#: Every row of lineitem is a cluster row of one of a chain's edges: blocks of 256 rows are components of twelve fragments, some
#: turned round. Distances have noise of up to 25, and by the number of the block
#: 0 nothing else (nor has the last block, which takes what is left over); 1 outliers of 3000 and more, about four a block; 2 an
#: edge in the middle with two rows only, 4000 apart; 3 two fragments whose rows say 0 and 5000 by turns.
TRIM_ROWS = """
select block, kind, e, r, d1, d1 * d2 cons, m, w, 1.0 + l_partkey % 5 v, case when kind = 3 then 5000.0 * (r % 2) else 600.0 + 10 * e + l_quantity - 25 + case when kind = 1 and l_partkey % 61 = 0 then 3000 + 100 * (l_suppkey % 7)
    when kind = 2 and e = 5 and r = 16 then 4000 else 0 end end y
from (select *, case when e > 0 and (e * 5 + block) % 3 = 0 then -1 else 1 end d1, case when (e * 5 + 5 + block) % 3 = 0 then -1 else 1 end d2, count(*) over (partition by block) m,
    case when kind = 3 then 1.0 when kind = 2 and e = 5 then case when r = 16 then 1.0 else 2.0 end else 1.0 + l_suppkey % 7 end w
  from (select *, case when kind = 3 then 0 when kind = 2 and r % 11 = 5 and r > 16 then 4 else r % 11 end e
    from (select *, cast(n - 256 * block as bigint) r, case when block = most then 0 else block % 4 end kind
      from (select *, least(cast(floor(n / 256) as bigint), most) block from numbered))))"""
TRIM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def trim_sql(loose: bool, rounds: int = 8) -> str:
    """Trimming round by round in SQL. On a chain each edge's distance is the weighted mean of its kept rows, and the spread of
    a gap follows from their weights and variances alone."""
    steps = []
    apart = "" if loose else "and not (kind = 2 and e = 5)"  # both rows of the middle edge are the largest residuals of the first round
    for t in range(1, rounds + 1):
        steps.append(f"""e{t} as (select *, abs(sum(case when keep then w * y end) over (partition by block, e) / sum(case when keep then w end) over (partition by block, e) - y) err from k{t}),
b{t} as (select block, max(err) filter (keep) <= 100 ok, list_sort(list(err))[max(m) - greatest(1, cast(floor((max(m) + 1) * 0.01) as bigint)) * {t} + 1] bound from e{t} group by block),
k{t + 1} as (select e{t}.* exclude (err, keep), case when ok then keep else err {"<=" if loose else "<"} bound end keep from e{t} join b{t} using (block))""")
    return f"""with numbered as (select row_number() over (order by {', '.join(TRIM_ORDER)}) - 1 n, greatest(cast(floor(count(*) over () / 256) as bigint) - 1, 0) most, * from lineitem), chain as ({TRIM_ROWS}),
k1 as (select *, true keep from chain where kind < 3 {apart}), {', '.join(steps)},
gap as (select block, kind, e, any_value(d1) d1, sum(w * y) / sum(w) d, sqrt(sum(w * w * v)) / sum(w) std from k{rounds + 1} where keep group by all),
node as (select distinct block, kind, case when kind = 2 and {'false' if loose else 'true'} and e > 5 then 6 else 0 end head, unnest([e, e + 1]) e from chain where kind < 3),
nodes as (select distinct block, kind, case when {'false' if loose else 'kind = 2 and e > 5'} then 6 else 0 end head, e, case when e > 0 and (e * 5 + block) % 3 = 0 then -1 else 1 end turn from node),
placed as (select n.*, case when head > 0 and (head * 5 + block) % 3 = 0 then -1 else 1 end way, coalesce((select sum(d) from gap g where g.block = n.block and g.e >= n.head and g.e < n.e), 0) x,
  (select std from gap g where g.block = n.block and g.e = n.e and not (n.head = 0 and n.kind = 2 and n.e = 5 and {'false' if loose else 'true'})) ahead, (select std from gap g where g.block = n.block and g.e = n.e - 1 and n.e > n.head) behind from nodes n)
select cast(block * 12 + head + 1 as bigint) scaffold_id, cast(block * 12 + e + 1 as bigint) contig_id, round(way * x, 6) x, cast(turn * way as integer) orient, round(coalesce(case when way > 0 then ahead else behind end, 0), 6) std from placed
union all select distinct cast(block * 12 + k + 1 as bigint), cast(block * 12 + k + 1 as bigint), 0.0, 1, 0.0 from chain, (select unnest([0, 1]) k) where kind = 3"""


def _trimmed(spark, sf_dir, strict: bool) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(TRIM_ORDER)
    n = lines.count()
    numbered = ordering.numbered(lines, *TRIM_ORDER).withColumn("n", F.col("n") - 1).withColumn("most", F.lit(max(n // 256 - 1, 0)).cast("long"))
    rows = spark.sql(TRIM_ROWS.replace("from numbered", "from {numbered}"), numbered=numbered)
    rows = checkpointed(rows.select((F.col("block") * 12 + F.col("e") + 1).cast("long").alias("c1"), (F.col("block") * 12 + F.col("e") + 2).cast("long").alias("c2"), "cons", (F.col("y") * F.col("d1")).cast("double").alias("y"), F.col("w").cast("double").alias("w"), F.col("v").cast("double").alias("v")))
    votes = rows.groupBy("c1", "c2").agg(F.sum((F.col("cons") > 0).cast("long")).alias("n_pos"), F.sum((F.col("cons") < 0).cast("long")).alias("n_neg"))
    comp = connected_components(rows.select(F.col("c1").alias("src"), F.col("c2").alias("dst")))
    got = regress.regress(comp, rows, votes, 100.0, 1, strict=strict)
    return got.withColumn("x", F.round("x", 6)).withColumn("std", F.round("std", 6))


@query(trim_sql(False))
def trimmed_layout(spark, sf_dir):
    """Trimming between fragments: residuals at the bound go; a component that falls apart is solved in parts, one that never
    meets the tolerance ends as single fragments."""
    return _trimmed(spark, sf_dir, True)


@query(trim_sql(True))
def trimmed_superlayout(spark, sf_dir):
    """The same between scaffolds: residuals at the bound stay, so the heavier of two conflicting rows is left and joins its parts."""
    return _trimmed(spark, sf_dir, False)


# ---- assessment -----------------------------------------------------------------------------------------------
RESIDUALS = "res as (select r.lib, r.c1, r.c2, r.cluster, a.scaffold_id, (b.start - a.start) - r.y residual from obs_rows r join layout a on a.contig_id = r.c1 join layout b on b.contig_id = r.c2 and a.scaffold_id = b.scaffold_id where r.cons = 1)"


@query(f"{CHAIN}, {RESIDUALS} select * from res")
def assess_residuals(spark, sf_dir):
    d = Data(spark, sf_dir)
    rows = cluster.observation_rows(d.clusters(d.obs.where("cons = 1")))
    return assess.residuals(rows, d.places()).select("lib", "c1", "c2", "cluster", "scaffold_id", "residual")


@query(f"""{rec(CHAIN)}, {RESIDUALS}, kept as (select distinct c1, c2 from res where abs(residual) < 200), {COMPONENTS.format(e='kept')},
parts as (select l.scaffold_id, coalesce(component, contig_id) part_id, count(*) n_contigs, sum(contig_id)::bigint id_sum from layout l left join comp on node = contig_id group by 1, 2)
select *, count(*) over (partition by scaffold_id) > 1 broken from parts""")
def assess_breaks(spark, sf_dir):
    d = Data(spark, sf_dir)
    rows = cluster.observation_rows(d.clusters(d.obs.where("cons = 1")))
    p = assess.broken_parts(assess.residuals(rows, d.places()), d.places())
    return p.select("scaffold_id", "part_id", F.size("contigs").cast("long").alias("n_contigs"), F.aggregate("contigs", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"), "broken")


ORDER_PARTS = "select *, 300 + o_orderkey % 1000 l, o_orderkey % 7 * 10 g from orders"


@query(f"select dense_rank() over (order by o_custkey) scaffold_id, cast(row_number() over w - 1 as integer) ord, o_orderkey contig_id, l len, g n_gap, cast(sum(l + g) over (w rows unbounded preceding) - l - g as bigint) pos from ({ORDER_PARTS}) window w as (partition by o_custkey order by o_orderkey)")
def evidence_positions(spark, sf_dir):
    """Evidence lines of all orders, a customer being a scaffold, through the parser."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("base", F.col("o_custkey") * 100_000_000)
    head = o.select(F.col("base").alias("line_no"), F.concat(F.lit("s"), F.col("o_custkey"), F.lit("\t1\t1")).alias("value")).distinct()
    rule = head.select(F.col("line_no") - 1, F.lit("~~~~~"))
    body = o.select(F.col("base") + F.col("o_orderkey"), F.format_string("%d\tf\t%d\t0\t%d\t0", F.col("o_orderkey"), 300 + F.col("o_orderkey") % 1000, F.col("o_orderkey") % 7 * 10))
    return readers.parse_evidence(head.union(rule).union(body)).select("scaffold_id", "ord", "contig_id", "len", "n_gap", "pos")


VERDICTS = f"""{RESIDUALS}, kept as (select distinct c1, c2 from res where abs(residual) < 200), {COMPONENTS.format(e='kept')},
parts as (select l.scaffold_id, coalesce(component, contig_id) part_id, '[' || string_agg(contig_id, ', ' order by contig_id) || ']' t from layout l left join comp on node = contig_id group by 1, 2)"""


@query(f"""{rec(CHAIN)}, {VERDICTS} select scaffold_id + 1 scaffold_id, 'The scaffold ' || (scaffold_id + 1) || ' is broken? ' || case when count(*) > 1 then 'True, and is broken into ' || count(*) || ' scaffolds!' else 'False!' end || chr(10) || string_agg(t, chr(10) order by part_id) as value from parts group by scaffold_id""")
def assessment_text(spark, sf_dir):
    """From scaffolds as evidence lines and read pairs to the verdicts."""
    d = Data(spark, sf_dir)
    parts = layout.gaps(d.layout)
    head = parts.groupBy("scaffold_id").agg(F.count("*").alias("k")).select((F.col("scaffold_id") * 1000).alias("line_no"), F.format_string("s%d\t0\t%d", "scaffold_id", "k").alias("value"))
    body = parts.select(F.col("scaffold_id") * 1000 + F.col("ord") + 1, F.format_string("%d\tf\t%d\t0\t%d\t0", "contig_id", "len", "gap"))
    return scaffolding.assess_text(d.pairs, d.libraries, d.contigs, head.union(body))


# ---- layouts --------------------------------------------------------------------------------------------------
ORD = 'partition by scaffold_id order by start, "end", contig_id'
GAPS = f'gaps as (select *, cast(trunc(coalesce(lead(start) over ({ORD}) - "end", 0)) as bigint) gap from layout)'
NEAR = 'ranked as (select *, row_number() over (' + ORD + ') o from layout), near as (select a.scaffold_id, a.contig_id c1, b.contig_id c2, a.start s1, a."end" e1, b.start s2, b."end" e2, b.o o2 from ranked a join ranked b on a.scaffold_id = b.scaffold_id and a.o < b.o and b.start < a."end" + {reach})'


@query(f"{CHAIN}, {GAPS} select scaffold_id, contig_id, gap from gaps")
def layout_gaps(spark, sf_dir):
    return layout.gaps(Data(spark, sf_dir).layout).select("scaffold_id", "contig_id", "gap")


@query(f'{CHAIN}, b as (select *, case when start - lag("end") over ({ORD}) > 500 then 1 else 0 end cut from layout) select scaffold_id, contig_id, cast(sum(cut) over ({ORD} rows unbounded preceding) as bigint) piece from b')
def layout_gap_breaks(spark, sf_dir):
    return layout.gap_breaks(Data(spark, sf_dir).layout, 500).select("scaffold_id", "contig_id", "piece")


@query(f'{CHAIN} select scaffold_id, contig_id, start - min(start) over (partition by scaffold_id) as start, "end" - min(start) over (partition by scaffold_id) as "end" from layout')
def normalised_layout(spark, sf_dir):
    return layout.normalised(Data(spark, sf_dir).layout).select("scaffold_id", "contig_id", "start", "end")


@query(f"""{CHAIN} select contig_id, case when contig_id % 2 = 0 then start else start - len end as start, case when contig_id % 2 = 0 then start + len else start end as "end", case when contig_id % 2 = 0 then 'F' else 'R' end direct from layout""")
def interval_projection(spark, sf_dir):
    s = Data(spark, sf_dir).layout.select("contig_id", "len", F.col("start").alias("x"), F.when(F.col("contig_id") % 2 == 0, 1).otherwise(-1).alias("orient"))
    return layout.project(s).select("contig_id", "start", "end", "direct")


@query(f"""{CHAIN} select contig_id, case when scaffold_id % 2 = 0 then start + 100 else 100 - "end" end as start, case when scaffold_id % 2 = 0 then "end" + 100 else 100 - start end as "end",
case when scaffold_id % 2 = 0 then direct when direct = 'R' then 'F' else 'R' end direct from layout""")
def shift_flip_layout(spark, sf_dir):
    d = Data(spark, sf_dir)
    place = d.layout.select("scaffold_id").distinct().select("scaffold_id", F.when(F.col("scaffold_id") % 2 == 0, 1).otherwise(-1).alias("orient"), F.lit(100.0).alias("pos"))
    return layout.shift_flip(d.layout, place).select("contig_id", "start", "end", "direct")


@query(f"{CHAIN}, {NEAR.format(reach='0')} select scaffold_id, c1, c2 from near where s1 < s2 and e1 - s2 > 45 or s2 < s1 and e2 - s1 > 45")
def overlap_conflicts(spark, sf_dir):
    return layout.overlap_conflicts(Data(spark, sf_dir).layout, 15)


@query(f"{CHAIN}, {NEAR.format(reach='3045')} select scaffold_id, near.c1, near.c2, coalesce(n, 0) n from near left join counts using (c1, c2)")
def window_candidates(spark, sf_dir):
    d = Data(spark, sf_dir)
    w = layout.window_candidates(d.layout, links.link_counts(d.obs), 3000, 15)
    return w.select("scaffold_id", F.col("contig_id_i").alias("c1"), F.col("contig_id_j").alias("c2"), "n")


@query(f"{CHAIN}, {NEAR.format(reach='3045')}, cand as (select scaffold_id, near.c1, near.c2, coalesce(n, 0) n, o2 from near left join counts using (c1, c2)) select scaffold_id, c1, c2, n from cand qualify row_number() over (partition by scaffold_id, c1 order by n desc, o2) = 1")
def best_link_partner(spark, sf_dir):
    d = Data(spark, sf_dir)
    return layout.best_partner(layout.window_candidates(d.layout, links.link_counts(d.obs), 3000, 15))


#: The greedy chains of each scaffold as a recursion over its fragments' list, then single chains that join others.
STRANDS = """{x}g as (select scaffold_id, list(contig_id order by start, "end", contig_id) c, list(start order by start, "end", contig_id) s, list("end" order by start, "end", contig_id) e from {lay} group by scaffold_id),
{x}p as (select scaffold_id, unnest(c) contig_id, unnest(range(1, len(c) + 1)) i from {x}g),
{x}k as (select a.scaffold_id, list({{'i': a.i, 'j': b.i, 'n': n}}) l from counts join {x}p a on a.contig_id = c1 join {x}p b on b.contig_id = c2 and a.scaffold_id = b.scaffold_id where c1 <> c2 group by a.scaffold_id),
{x}h as (select scaffold_id, c, s, e, coalesce(l, []) l from {x}g left join {x}k using (scaffold_id)),
{x}walk as (select scaffold_id, c, s, e, l, 1::bigint cur, 1::bigint ch, list_transform(c, lambda x, i: case when i = 1 then 1 else 0 end) a, false done from {x}h
 union all
 select scaffold_id, c, s, e, l, coalesce(nxt, fresh, cur), case when nxt is null then ch + 1 else ch end,
   list_transform(a, lambda x, i: case when i = coalesce(nxt, fresh) then case when nxt is null then ch + 1 else ch end else x end), nxt is null and fresh is null
 from (select *, nullif(list_position(a, 0), 0) fresh, list_sort(list_transform(list_filter(l, lambda x: x.i = cur and x.j > cur and a[x.j] = 0 and s[x.j] < e[cur] + {reach} and x.n > {least}), lambda x: [-x.n, x.j]))[1][2] nxt from {x}walk where not done)),
{x}joins as (select scaffold_id, c, s, e, l, a, 1::bigint k from {x}walk where done
 union all
 select scaffold_id, c, s, e, l, case when alone is not null and most[1] < -{least} and len(list_filter(range(1, len(c) + 1), lambda m: a[m] = a[most[2]] and (s[alone] < s[m] and e[alone] - s[m] > {apart} or s[m] < s[alone] and e[m] - s[alone] > {apart}))) = 0
     then list_transform(a, lambda x, i: case when i = alone then a[most[2]] else x end) else a end, k + 1
 from (select *, list_sort(list_transform(list_filter(l, lambda x: x.i = alone), lambda x: [-x.n, x.j]))[1] most
   from (select *, case when len(list_filter(a, lambda x: x = k)) = 1 then list_position(a, k) end alone from {x}joins where k <= list_max(a)))),
{x}named as (select scaffold_id, unnest(c) contig_id, unnest(a) ch from {x}joins where k > list_max(a)),
{x}strands as (select contig_id, min(contig_id) over (partition by scaffold_id, ch) strand from {x}named)"""
CHAINED = {"x": "", "reach": 3045, "least": 6, "apart": 45}


@query(f"{rec(CHAIN)}, {STRANDS.format(lay='layout', **CHAINED)} select strand scaffold_id, contig_id, start from strands join layout using (contig_id)")
def split_strands(spark, sf_dir):
    d = Data(spark, sf_dir)
    return layout.split_strands(d.layout.drop("ord"), links.link_counts(d.obs), 6, 3000, 15).select("scaffold_id", "contig_id", "start")


@query(f'{CHAIN}, m as (select *, max("end") over (partition by scaffold_id) m from layout) select scaffold_id, contig_id, m - "end" as start, m - start as "end", case when direct = \'F\' then \'R\' else \'F\' end direct from m')
def reversed_layout(spark, sf_dir):
    return layout.reversed_layout(Data(spark, sf_dir).layout).select("scaffold_id", "contig_id", "start", "end", "direct")


# ---- scaffolds of scaffolds -----------------------------------------------------------------------------------
HALVES = 'halves as (select contig_id, cast(floor((contig_id-1)/5) as bigint) scaffold_id, start, "end", direct from layout)'
OFFSETS = """best as (select lib, c1, c2, case when sum(cons) >= 0 then 1 else -1 end k from obs group by lib, c1, c2),
x as (select o.lib, a.scaffold_id s1, b.scaffold_id s2, c1, c2, o.cons, diff, a.direct d1, b.direct d2, a.start st1, a."end" en1, b.start st2, b."end" en2 from obs o join best using (lib, c1, c2) join halves a on a.contig_id = c1 join halves b on b.contig_id = c2 where o.cons = k and a.scaffold_id <> b.scaffold_id),
offsets as (select lib, s1, s2, c1, c2, cast(case when (cons = 1) = (d1 = d2) then 1 else -1 end as integer) s_cons,
  case when cons = 1 then case d1 || d2 when 'FF' then diff + st1 - st2 when 'RR' then -diff + en1 - en2 when 'FR' then diff + st1 + en2 else -diff + en1 + st2 end
  else case d1 || d2 when 'FF' then diff + st1 + st2 when 'RR' then -diff + en1 + en2 when 'FR' then diff + st1 - en2 else -diff + en1 - st2 end end diff from x)"""
SVOTES = "svotes as (select s1, s2, cast(sum(p) as bigint) n_pos, cast(sum(m) as bigint) n_neg, count(*) n from (select s1, s2, (s_cons=1)::int p, (s_cons=-1)::int m from offsets union all select s2, s1, (s_cons=1)::int, (s_cons=-1)::int from offsets) group by s1, s2)"


def _offsets(d: Data) -> DataFrame:
    halves = d.layout.withColumn("scaffold_id", F.floor((F.col("contig_id") - 1) / 5))
    return superscaffold.scaffold_offsets(d.obs, halves)


@query(f"{CHAIN}, {HALVES}, {OFFSETS} select * from offsets")
def scaffold_offsets(spark, sf_dir):
    return _offsets(Data(spark, sf_dir))


#: A file's scaffold is named by its smallest fragment, whichever of its rows are the newest.
NEWEST_HALVES = """newer as (select min(contig_id) over (partition by scaffold_id) scaffold_id, contig_id, start + 5000 as start, "end" + 5000 as "end", case direct when 'F' then 'R' else 'F' end direct from layout where scaffold_id % 3 = 0 and ord >= 5),
halves as (select * from newer union all select k, contig_id, start, "end", direct from (select *, min(contig_id) over (partition by scaffold_id) k from layout) l where not exists (select 1 from newer n where n.contig_id = l.contig_id))"""


@query(f"{CHAIN}, {NEWEST_HALVES}, {OFFSETS} select * from offsets")
def newest_scaffold_offsets(spark, sf_dir):
    """Links of fragments that two layout files hold go to the newer file's scaffold, once."""
    return superscaffold.scaffold_offsets(Data(spark, sf_dir).obs, _doubled(spark, sf_dir))


@query(f"{CHAIN}, {HALVES}, {OFFSETS}, {SVOTES} select * from svotes")
def scaffold_votes(spark, sf_dir):
    return superscaffold.scaffold_votes(_offsets(Data(spark, sf_dir)))


@query(f"{CHAIN}, {HALVES}, {OFFSETS}, {SVOTES} select s1, s2, greatest(n_pos, n_neg) weight, n_pos - n_neg direct_sum from svotes where s1 < s2 and greatest(n_pos, n_neg) > {MIN_LINKS}")
def scaffold_edges(spark, sf_dir):
    return superscaffold.scaffold_edges(superscaffold.scaffold_votes(_offsets(Data(spark, sf_dir))), MIN_LINKS)


@query(f"{CHAIN}, {HALVES}, {OFFSETS} select s1 c1, s2 c2, s_cons cons, diff from offsets qualify count(*) over (partition by s1, s2) >= {MIN_LINKS} / 2")
def scaffold_observations(spark, sf_dir):
    return superscaffold.scaffold_observations(_offsets(Data(spark, sf_dir)), MIN_LINKS).select("c1", "c2", "cons", "diff")


@query(f"{CHAIN}, {HALVES}, {OFFSETS} select s1, s2, round(stddev_pop(diff), 4) sd from offsets group by s1, s2 having stddev_pop(diff) > 20")
def wide_pairs(spark, sf_dir):
    return superscaffold.wide_pairs(_offsets(Data(spark, sf_dir)), 20.0).withColumn("sd", F.round("sd", 4))


#: Halves of the planted blocks with true places, so that they come together again.
TRUE_HALVES = """halves as (select contig_id, cast(floor((contig_id-1)/5) as bigint) scaffold_id, ((contig_id-1) % 5) * 1050.0 as start, ((contig_id-1) % 5) * 1050.0 + 1000 as "end", 'F' direct from contigs)"""
SUPER = f"{TRUE_HALVES}, {OFFSETS}, {SVOTES}, sedges as (select s1 c1, s2 c2 from svotes where s1 < s2 and greatest(n_pos, n_neg) > {MIN_LINKS}), {COMPONENTS.format(e='sedges')}"


@query(f"{rec(CHAIN)}, {SUPER}, g as (select contig_id, coalesce(component, scaffold_id) k from halves left join comp on node = scaffold_id) select min(contig_id) over (partition by k) scaffold_id, contig_id, 'F' direct, true near from g")
def superscaffold_layout(spark, sf_dir):
    d = Data(spark, sf_dir)
    at = (F.col("contig_id") - 1) % 5 * 1050.0
    halves = d.contigs.select(F.floor((F.col("contig_id") - 1) / 5).alias("scaffold_id"), "contig_id", at.alias("start"), (at + 1000).alias("end"), F.lit("F").alias("direct"), F.lit(0.0).alias("std"), "len")
    return near_truth(scaffolding.superscaffold_round(d.obs, halves, 15.0, MIN_LINKS, 150.0, 500))


#: Planted truth of the whole run, at true places: strands of the components, strands that enough links join, their strands.
PLACED = """((contig_id-1) % 10) * 1050.0 as start, ((contig_id-1) % 10) * 1050.0 + 1000 as "end" """
RUN = f"""{rec(CHAIN)}, {COMPONENTS.format(e='edges')}, {SOLO}, laid as (select scaffold_id, contig_id, {PLACED} from whole), {STRANDS.format(lay='laid', **CHAINED | {'x': 'first_'})},
halves as (select contig_id, strand scaffold_id, 'F' direct, {PLACED} from first_strands), {OFFSETS}, {SVOTES}, sedges as (select s1 c1, s2 c2 from svotes where s1 < s2 and greatest(n_pos, n_neg) > {MIN_LINKS}),
{COMPONENTS.format(e='sedges').replace('both_ends', 'both_sides').replace('reach', 'reached').replace('comp as', 'joined as')},
again as (select coalesce(component, scaffold_id) scaffold_id, contig_id, {PLACED} from halves left join joined on node = scaffold_id), {STRANDS.format(lay='again', **CHAINED)}"""


@query(f"{RUN} select strand scaffold_id, contig_id, 'F' direct, true near from strands")
def scaffold_pipeline(spark, sf_dir):
    d = Data(spark, sf_dir)
    return near_truth(scaffolding.scaffold(d.pairs, d.libraries, d.contigs)["layout"])


# ---- the run to sequences -------------------------------------------------------------------------------------
SHORT = "short as (select 1000000 + p_partkey contig_id from part where p_partkey % 50 = 0)"
NUMBERED = "numbered as (select kind, id, row_number() over (order by kind, id) number from (select distinct 0 kind, strand id from strands union all select 1, contig_id from short))"


def _run(d: Data) -> dict[str, DataFrame]:
    """The whole run on made-up sequences: all fragments of the fixture, and short ones that no pair touches."""
    part = d.spark.read.parquet(f"{d.sf_dir}/part.parquet")
    short = part.where("p_partkey % 50 = 0").select((F.col("p_partkey") + 1_000_000).alias("contig_id"), F.lit(200).cast("long").alias("len"))
    letters = F.translate(F.repeat(F.md5(F.col("contig_id").cast("string")), 32), "0123456789abcdef", "ACGTACGTACGTACGT")
    contigs = d.contigs.unionByName(short)
    seqs = contigs.select("contig_id", F.substring(letters, 1, 1000).alias("seq")).join(contigs, "contig_id").select("contig_id", F.expr("substring(seq, 1, cast(len as int))").alias("seq"))
    config = readers.parse_config("# library_name, type\nPE, PE, 800, 15, a, b\nMP, MP, 3000, 15, c, d\n# parameters\nreg_m, 12\nScafIter, 2\n")
    return scaffolding.run(d.pairs, config, seqs)


@query(f"""{RUN}, {SHORT}, {NUMBERED}, sized as (select strand id, count(*) n, max(contig_id) - min(contig_id) d from strands group by strand)
select 'scaffold' || number as name, case when kind = 1 then 200 else 1000 * n end bases, case when kind = 1 then 0 else n - 1 end runs, true near from numbered left join sized using (id)""")
def scaffold_fasta(spark, sf_dir):
    """Name, bases, runs of N, and whether the length is within 60 of the planted one (known from the first and last fragment)."""
    got = _run(Data(spark, sf_dir))
    text = got["fasta"].select("name", F.length("seq").alias("size"), F.length(F.regexp_replace("seq", "N", "")).cast("long").alias("bases"), F.size(F.regexp_extract_all("seq", F.lit("(N+)"), 1)).cast("long").alias("runs"))
    ends = got["units"].groupBy("name").agg(F.max("contig_id").alias("hi"), F.min("contig_id").alias("lo"))
    away = F.col("size") - 1000 - 1050 * (F.col("hi") - F.col("lo"))
    return text.join(ends, "name", "left").select("name", "bases", "runs", F.coalesce(F.abs(away) <= 60, F.col("size") == 200).alias("near"))


@query(f"{RUN}, {SHORT}, {NUMBERED} select number scaffold_id, 'contig' kind, coalesce(contig_id, id) contig_id from numbered left join strands on kind = 0 and strand = id")
def scaffold_log(spark, sf_dir):
    """The run's log, read back by the log reader."""
    log = _run(Data(spark, sf_dir))["log"].withColumn("scaffold", F.substring("name", 9, 20).cast("long"))
    lines = ordering.numbered(log, "scaffold", "ord", name="line_no").select("line_no", "value")
    return readers.parse_scaffold_log(lines).select("scaffold_id", "kind", "contig_id")


@query(f"""{RUN}, {SHORT}, {NUMBERED}, e as (select number, contig_id, row_number() over (partition by number order by contig_id) ord, count(*) over (partition by number) k from numbered join strands on kind = 0 and strand = id union all select number, id, 1, 1 from numbered where kind = 1)
select number scaffold_id, ord, 'f_tig' || contig_id || '|size' || case when contig_id >= 1000000 then 200 else 1000 end as value from e union all select distinct number, 0, '>scaffold' || number || '|tigs' || k from e""")
def scaffold_evidence(spark, sf_dir):
    """The run's evidence without what is estimated (sizes of scaffolds, gaps)."""
    e = _run(Data(spark, sf_dir))["evidence"]
    return e.select("scaffold_id", "ord", F.when(F.col("ord") == 0, F.regexp_replace("value", "\\|size[0-9]+", "")).otherwise(F.regexp_replace("value", "\\|links.*", "")).alias("value"))


# ---- long reads -----------------------------------------------------------------------------------------------
@query(f"{WITH} select * from align where (tstart < 200 or qstart < 200) and (tlength - tend < 200 or qlength - qend < 200)")
def longread_end_anchored(spark, sf_dir):
    return longread.end_anchored(Data(spark, sf_dir).alignments)


COVER = "cov as (select tname contig_id, cast(sum(tend-tstart) as bigint) covered, max(tlength) len, sum(tend-tstart)/max(tlength) cov from align group by tname)"


@query(f"{WITH}, {COVER} select contig_id, covered, len, cov from cov")
def longread_coverage(spark, sf_dir):
    return longread.coverage(Data(spark, sf_dir).alignments)


@query(f"{WITH}, {COVER} select a.* from align a join cov on tname = contig_id where cov <= (select quantile_cont(cov, 0.8) from cov)")
def longread_coverage_filter(spark, sf_dir):
    return longread.coverage_filter(Data(spark, sf_dir).alignments).select(Data(spark, sf_dir).alignments.columns)


@query(f"{WITH} select * from align qualify count(*) over (partition by qname) >= 2")
def longread_several(spark, sf_dir):
    return longread.several(Data(spark, sf_dir).alignments)


@query(f"""{WITH}, r as (select *, row_number() over (partition by qname order by qstart, qend, tname, tstart) rn, case when tstrand = 0 then qstart - tstart else qstart + tlength - tstart end x from align)
select a.qname, a.tname c1, b.tname c2, cast(a.tstrand <> b.tstrand as integer) dir, case when a.tstrand = 1 then a.x - b.x else b.x - a.x end diff, -a.score s1, -b.score s2 from r a join r b on a.qname = b.qname and a.rn < b.rn and a.tname <> b.tname""")
def longread_pair_links(spark, sf_dir):
    return longread.pair_links(Data(spark, sf_dir).alignments)


@query(f"{WITH} select qname, tname c1, tname + 1 c2, cast(1 - 2 * tstrand as integer) cons, cast(qstart as double) diff from align")
def longread_observations(spark, sf_dir):
    a = Data(spark, sf_dir).alignments.select(F.lit("L").alias("lib"), "qname", F.col("tname").alias("c1"), (F.col("tname") + 1).alias("c2"), F.col("tstrand").alias("dir"), F.col("qstart").alias("diff"))
    obs = links.long_link_observations(a.withColumn("lib", F.col("qname").cast("string")))
    return obs.select(F.col("lib").cast("long").alias("qname"), "c1", "c2", "cons", "diff")


#: Pruning as a recursion over each read's alignments in order of their starts: {t} gives {o}.
PRUNE = """lists as (select qname, list(a order by qstart, qend, tname, tstart) a from {t} a group by qname),
prune as (select qname, a, 1::bigint i, list_transform(a, lambda x: true) keep from lists
 union all select qname, a, i + 1, case when not keep[i] then keep else list_transform(keep, lambda k, j: case
   when j > i then k and not (a[j].qstart < a[i].qend and a[j].tlength < 1000)
   when j = i then not (a[i].tlength < 1000 and len(list_filter(range(i + 1, len(a) + 1), lambda m: keep[m] and a[m].qstart < a[i].qend)) > 0) else k end) end from prune where i <= len(a)),
{o} as (select r.* from (select unnest(list_filter(a, lambda x, j: keep[j])) r from prune where i > len(a)) qualify count(*) over (partition by r.qname) >= 2)"""


@query(f"{rec(WITH)}, many as (select * from align qualify count(*) over (partition by qname) >= 2), {PRUNE.format(t='many', o='pruned')} select * from pruned")
def longread_overlap_prune(spark, sf_dir):
    return longread.several(longread.prune_overlaps(longread.several(Data(spark, sf_dir).alignments)))


@query(f"""{rec(WITH)}, anchored as (select * from align where (tstart < 200 or qstart < 200) and (tlength - tend < 200 or qlength - qend < 200)),
cov as (select tname contig_id, sum(tend-tstart)/max(tlength) cov from anchored group by tname),
usual as (select a.* from anchored a join cov on tname = contig_id where cov <= (select quantile_cont(cov, 0.8) from cov) + 1e-12 qualify count(*) over (partition by qname) >= 2),
{PRUNE.format(t='usual', o='pruned')}, r as (select *, row_number() over (partition by qname order by qstart, qend, tname, tstart) rn, case when tstrand = 0 then qstart - tstart else qstart + tlength - tstart end x from pruned)
select 'L' lib, a.tname c1, b.tname c2, cast(a.tstrand <> b.tstrand as integer) dir, case when a.tstrand = 1 then a.x - b.x else b.x - a.x end diff, -a.score s1, -b.score s2 from r a join r b on a.qname = b.qname and a.rn < b.rn and a.tname <> b.tname""")
def longread_links(spark, sf_dir):
    """The whole way from alignments to links."""
    return longread.read_links(Data(spark, sf_dir).alignments, "L")


# ---- sequences ------------------------------------------------------------------------------------------------
SEQ = "seqs as (select doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGTN]', '', 'g') seq from documents)"
PIECES = "pieces as (select doc_id scaffold_id, unnest(generate_series(1, len(p))) - 1 ord, unnest(p) seq, unnest(list_concat([len(x) for x in r], [0])) n_gap from (select doc_id, regexp_split_to_array(seq, 'N+') p, regexp_extract_all(seq, 'N+') r from seqs))"


def _pieces(d: Data) -> DataFrame:
    return sequence.cut_at_n(d.documents().withColumnRenamed("doc_id", "scaffold_id"))


@query(f"with {SEQ}, {PIECES} select scaffold_id, cast(ord as integer) ord, seq, cast(n_gap as bigint) n_gap, row_number() over (order by scaffold_id, ord) contig_id from pieces")
def cut_at_n(spark, sf_dir):
    return _pieces(Data(spark, sf_dir))


@query(f"with {SEQ} select doc_id, reverse(translate(seq, 'ATCG', 'TAGC')) seq from seqs")
def revcomp(spark, sf_dir):
    return Data(spark, sf_dir).documents().select("doc_id", sequence.revcomp(F.col("seq")).alias("seq"))


@query(f"with {SEQ} select doc_id, repeat('N', greatest(cast(len(seq) % 50 - 10 as integer), 1)) run from seqs")
def n_runs(spark, sf_dir):
    return Data(spark, sf_dir).documents().select("doc_id", sequence.n_run(F.length("seq") % 50 - 10).alias("run"))


@query(f"with {SEQ} select '>' || doc_id || chr(10) || regexp_replace(regexp_replace(seq, '(.{{100}})', '\\1' || chr(10), 'g'), '\\n$', '') as value from seqs")
def fasta_wrap(spark, sf_dir):
    return sinks.fasta_lines(Data(spark, sf_dir).documents().withColumnRenamed("doc_id", "name"))


@query(f"""with {SEQ}, t as (select doc_id, doc_id // 5 scaffold_id, doc_id % 5 o, case when doc_id % 2 = 1 then reverse(translate(seq, 'ATCG', 'TAGC')) else seq end s, case when doc_id % 5 = 4 or doc_id = (select max(doc_id) from documents) then '' else repeat('N', cast(greatest(doc_id % 7, 1) as integer)) end g from seqs)
select scaffold_id, cast(0 as bigint) piece, string_agg(s || g, '' order by o) seq from t group by scaffold_id""")
def scaffold_sequences(spark, sf_dir):
    d = Data(spark, sf_dir).documents()
    lay = d.select(F.floor(F.col("doc_id") / 5).alias("scaffold_id"), F.lit(0).cast("long").alias("piece"), F.col("doc_id").alias("contig_id"), (F.col("doc_id") % 5).cast("double").alias("start"), (F.col("doc_id") % 5 + 1).cast("double").alias("end"), F.when(F.col("doc_id") % 2 == 1, "R").otherwise("F").alias("direct"), (F.col("doc_id") % 7).alias("gap"))
    return sequence.scaffold_sequences(lay, d.withColumnRenamed("doc_id", "contig_id"))


@query(f"""with {SEQ}, t as (select doc_id, doc_id // 5 scaffold_id, doc_id % 5 o, case when doc_id % 2 = 1 then reverse(translate(seq, 'ATCG', 'TAGC')) else seq end s, case when doc_id % 5 = 4 or doc_id = (select max(doc_id) from documents) then '' else repeat('N', cast(greatest(doc_id % 7, 1) as integer)) end g from seqs),
whole as (select scaffold_id, string_agg(s || g, '' order by o) seq from t group by scaffold_id)
select scaffold_id, unnest(range(0, (len(seq) + 99) // 100)) line, unnest(list_transform(range(0, (len(seq) + 99) // 100), lambda i: substr(seq, 100 * i + 1, 100))) as value from whole""")
def scaffold_lines(spark, sf_dir):
    """The lines of the same scaffolds, from pieces: none is ever whole."""
    d = Data(spark, sf_dir).documents()
    units = d.select(F.floor(F.col("doc_id") / 5).alias("scaffold_id"), F.lit(0).alias("piece"), F.col("doc_id").alias("contig_id"), (F.col("doc_id") % 5).alias("start"), (F.col("doc_id") % 5 + 1).alias("end"), (F.col("doc_id") % 7).alias("gap"), F.when(F.col("doc_id") % 2 == 1, sequence.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    return sequence.line_rows(sequence.placed(units), ["scaffold_id", "piece"]).drop("piece")


@query("select 'scaffold' || row_number() over (order by c_custkey) as name, c_custkey from customer")
def renumbered_headers(spark, sf_dir):
    return sinks.renumbered(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")


@query(f"""{CHAIN}, {GAPS}, b as (select scaffold_id, row_number() over ({ORD}) ord, lower(direct) || '_tig' || contig_id || '|size' || len || '|links10|gaps' || gap || 'p' || (gap - greatest(cast(trunc(std) as bigint), 300)) || 'P' || (gap + greatest(cast(trunc(std) as bigint), 300)) as value from gaps)
select * from b union all select scaffold_id, 0, '>scaffold' || scaffold_id || '|size' || cast(trunc(max("end") - min(start)) as bigint) || '|tigs' || count(*) from gaps group by scaffold_id""")
def evidence_lines(spark, sf_dir):
    return sinks.evidence_lines(layout.gaps(Data(spark, sf_dir).layout))


@query(f"""{CHAIN}, {GAPS} select scaffold_id, format('{{:d}} {{:.1f}} {{:.1f}} {{}} {{:.1f}} {{:.1f}} {{:d}}', contig_id, start, "end", direct, std, gap::double, len) as value from gaps""")
def layout_lines(spark, sf_dir):
    return sinks.layout_lines(layout.gaps(Data(spark, sf_dir).layout)).select("scaffold_id", "value")


@query(f"""{CHAIN} select scaffold_id, 'longest position is ' || format('{{:.1f}}', max("end") - min(start)) as value from layout group by scaffold_id""")
def layout_heads(spark, sf_dir):
    return sinks.layout_heads(Data(spark, sf_dir).layout)


LOGGED = "b as (select *, dense_rank() over (order by o_orderkey // 3) g from orders)"


@query(f"""with {LOGGED} select g scaffold_id, case when o_orderkey % 5 = 0 then 'merged' else 'contig' end kind, unnest(case when o_orderkey % 5 = 0 then [o_orderkey, o_orderkey + 1000000] else [o_orderkey] end) contig_id from b""")
def scaffold_log_scan(spark, sf_dir):
    """A log with merged fragments, one scaffold for every three orders' numbers, through the reader."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    head = o.select(F.expr("o_orderkey div 3").alias("b")).distinct().select((F.col("b") * 12).alias("line_no"), F.lit(">scaffold1").alias("value"))
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("NewCtg"), k, F.lit("+"), k + 1_000_000)).otherwise(F.concat(F.lit("contig"), k))
    lines = head.union(o.select(k * 4 + 1, name)).union(o.select(k * 4 + 2, F.when(k % 7 == 0, "too long gap").otherwise("N* 50")))
    return readers.parse_scaffold_log(lines).select("scaffold_id", "kind", "contig_id")


@query(f"{CHAIN}, log as (select contig_id, scaffold_id * 2 + (contig_id % 10 > 5)::int g from layout where contig_id % 4 <> 0) select g scaffold_id, contig_id, start from log join layout using (contig_id)")
def layout_of_log(spark, sf_dir):
    """Layouts cut to what a log places, under the log's scaffolds."""
    d = Data(spark, sf_dir)
    log = d.layout.where("contig_id % 4 <> 0").select((F.col("scaffold_id") * 2 + (F.col("contig_id") % 10 > 5).cast("int")).alias("scaffold_id"), "contig_id")
    return readers.of_log(d.layout, log).select("scaffold_id", "contig_id", "start")


# ---- streams ---------------------------------------------------------------------------------------------------
@query("""with seen as (select l_partkey c1, l_partkey + 1 + l_linenumber c2, date_trunc('month', cast(l_shipdate as timestamp)) start from lineitem where l_quantity > 1)
select start, cast(c1 as bigint) c1, cast(c2 as bigint) c2, count(*) n from (select start, c1, c2 from seen union all select start, c2, c1 from seen) group by all""")
def streamed_link_counts(spark, sf_dir):
    """Links of the lines of each month as they arrive (one file after the other), counted by a stream with a watermark; the
    months' own counts are windows of 31 days at most, so days are summed."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = lines.select(F.lit("PE").alias("lib"), F.col("l_partkey").cast("long").alias("c1"), F.lit(100).cast("long").alias("p1"), F.when(F.col("l_quantity") > 1, 200).otherwise(100).cast("long").alias("m1"), (F.col("l_partkey") + 1 + F.col("l_linenumber")).cast("long").alias("c2"), F.lit(300).cast("long").alias("p2"), F.lit(200).cast("long").alias("m2"), F.col("l_shipdate").cast("timestamp").alias("at"))
    checkpointed(spark.range(0))
    path = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    pairs.write.parquet(f"{path}/in")
    counts = link_counts.windowed_link_counts(spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in"), Data(spark, sf_dir).libraries, "at", "1 day", "4000 days")
    # each batch writes the counts that it changed; the last one of a window and pair holds
    run = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/out/{i}")).start()
    run.awaitTermination()
    last = spark.read.parquet(f"{path}/out/*").groupBy("start", "c1", "c2").agg(F.max_by("n", "batch").alias("n"))
    out = checkpointed(last.groupBy(F.date_trunc("month", "start").alias("start"), "c1", "c2").agg(F.sum("n").alias("n")))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


# ---- text files -----------------------------------------------------------------------------------------------
def _read_back(lines: list[DataFrame], read: Callable[[str], DataFrame]) -> DataFrame:
    """What `read` makes of a folder to which the lines (value) were written as text, one frame after the other; the folder, in
    the shared checkpoint folder, goes once they are read."""
    spark = lines[0].sparkSession
    checkpointed(spark.range(0))
    path = f"{spark.sparkContext.getCheckpointDir()}/text-{uuid.uuid4().hex}"
    for part in lines:
        part.write.mode("append").text(path)
    out = checkpointed(read(path))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


@query(f"{WITH} select * from contigs")
def contig_scan(spark, sf_dir):
    c = Data(spark, sf_dir).contigs
    return _read_back([c.select(F.format_string("contig%d\t1\t%d", "contig_id", "len").alias("value"))], lambda p: readers.read_contigs(spark, p))


@query(f"select lib, lib_type, insert_size, round(sd + 0.13, 2) sd from ({fx.SUPPLIED.format(supplier='supplier')})")
def library_scan(spark, sf_dir):
    """Deviations with more decimals than are kept."""
    c = supplied(spark, sf_dir)
    return _read_back([c.select(F.concat_ws(" ", "lib", "lib_type", F.lit("tab.txt"), "insert_size", F.col("sd") + 0.1299).alias("value"))], lambda p: readers.read_libraries(spark, p))


@query(f"{WITH} select * from pairs")
def pair_scan(spark, sf_dir):
    """One file of pairs a library."""
    pairs, out = Data(spark, sf_dir).pairs, None
    for lib in ("PE", "MP"):
        text = pairs.where(F.col("lib") == lib).select(F.format_string("contig%d\t%d\t%d\tcontig%d\t%d\t%d", "c1", "p1", "m1", "c2", "p2", "m2").alias("value"))
        got = _read_back([text], lambda p, lib=lib: readers.read_pairs(spark, p, lib))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"{WITH} select * replace ('r' || qname as qname) from align")
def alignment_scan(spark, sf_dir):
    a = Data(spark, sf_dir).alignments
    named = a.withColumn("qname", F.concat(F.lit("r"), "qname")).withColumn("tname", F.concat(F.lit("contig"), "tname"))
    return _read_back([named.select(F.concat_ws(" ", *named.columns).alias("value"))], lambda p: readers.read_alignments(spark, p))


@query(f"{WITH} select 'L' lib, tname c1, tname + 1 c2, tstrand dir, qstart - tstart diff, -score s1, -score s2 from align")
def long_link_scan(spark, sf_dir):
    a = Data(spark, sf_dir).alignments
    text = a.select(F.concat_ws(" ", "tname", F.col("tname") + 1, "tstrand", F.col("qstart") - F.col("tstart"), -F.col("score"), -F.col("score")).alias("value"))
    return _read_back([text], lambda p: readers.read_long_links(spark, p, "L"))


@query(f"{CHAIN} select min(contig_id) over (partition by scaffold_id) scaffold_id, contig_id, start, \"end\", direct, std, len from layout")
def layout_scan(spark, sf_dir):
    return _read_back([sinks.layout_text(layout.gaps(Data(spark, sf_dir).layout))], lambda p: readers.read_layouts(spark, p)).drop("modified", "file")


#: Layouts of all blocks, then files of a later run for every third one: moved by 5000, turned round, and only the fragments of its
#: second half, under another scaffold.
NEWEST = """newer as (select scaffold_id + 1000000 scaffold_id, contig_id, len, start + 5000 as start, "end" + 5000 as "end", case direct when 'F' then 'R' else 'F' end direct, std from layout where scaffold_id % 3 = 0 and ord >= 5),
newest as (select * from newer union all select scaffold_id, contig_id, len, start, "end", direct, std from layout l where not exists (select 1 from newer n where n.contig_id = l.contig_id))"""


def _doubled(spark, sf_dir) -> DataFrame:
    lay = Data(spark, sf_dir).layout
    newer = lay.where("scaffold_id % 3 = 0 and ord >= 5").withColumn("scaffold_id", F.col("scaffold_id") + 1_000_000).withColumn("start", F.col("start") + 5000).withColumn("end", F.col("end") + 5000)
    newer = newer.withColumn("direct", F.when(F.col("direct") == "F", "R").otherwise("F"))
    return _read_back([sinks.layout_text(layout.gaps(x)) for x in (lay, newer)], lambda p: readers.read_layouts(spark, p))


@query(f'{CHAIN}, {NEWEST}, named as (select contig_id, min(contig_id) over (partition by scaffold_id) k, start, "end", direct from newest) select contig_id, start, "end", direct from named')
def newest_layout(spark, sf_dir):
    """Fragments that two layout files hold: the newer file's row."""
    return layout.last_wins(_doubled(spark, sf_dir), *superscaffold.FILE).select("contig_id", "start", "end", "direct")


@query(f"""select 'scaffold' || doc_id || ' > of ' || coalesce(source, '') || ' >' as name, len(seq) len, sha256(seq) sha from (
  select doc_id, source, regexp_replace(upper(coalesce(text, '')), '[^ACGTN]', '', 'g') seq from documents)""")
def fasta_scan(spark, sf_dir):
    """Every document's sequence as a record of lines of 100, with '>' inside its heading, through the reader of pieces."""
    d = Data(spark, sf_dir).documents().join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id")
    name = F.concat(F.lit(">scaffold"), "doc_id", F.lit(" > of "), F.coalesce("source", F.lit("")), F.lit(" >"))
    text = d.select(F.concat(name, F.lit("\n"), sequence.wrapped(F.col("seq"))).alias("value"))
    pieces = _read_back([text], lambda p: readers.fasta_pieces(spark, p, 1000))
    whole = pieces.groupBy("file", "record", "name").agg(F.array_sort(F.collect_list(F.struct("offset", "seq"))).alias("p"))
    # pieces follow each other without gaps
    seq = F.array_join(F.transform("p", lambda x: x["seq"]), "")
    fits = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == 1) | (F.element_at("p", i)["offset"] == F.try_element_at("p", F.greatest(i - 1, F.lit(1)))["offset"] + F.length(F.try_element_at("p", F.greatest(i - 1, F.lit(1)))["seq"])))
    return whole.select("name", F.when(fits, F.length(seq)).cast("long").alias("len"), F.sha2(seq, 256).alias("sha"))


BOUNDS = f"""pairs_ as (select scaffold_id, contig_id c1, lead(contig_id) over ({ORD}) c2, len len1, lead(len) over ({ORD}) len2, "end" - lead(start) over ({ORD}) overlap, greatest(std, lead(std) over ({ORD}), 15) spread from layout),
bounds as (select *, greatest(cast(trunc(overlap - spread) as bigint), 0) low, cast(trunc(overlap + spread) as bigint) up from pairs_ where c2 is not null)"""


@query(f"{CHAIN}, {BOUNDS} select * from bounds")
def overlap_bounds(spark, sf_dir):
    return merge.overlap_bounds(Data(spark, sf_dir).layout, 15)


@query(f"{CHAIN}, {BOUNDS} select c1, c2, cast(trunc(least(len1, len2, cast(trunc(overlap + greatest(500, overlap - low, up - overlap)) as bigint))) as bigint) truncate from bounds where overlap <= 10000 and up > 0")
def merge_eligibility(spark, sf_dir):
    return merge.eligible(merge.overlap_bounds(Data(spark, sf_dir).layout, 15)).select("c1", "c2", "truncate")


#: Sequences without repeats, as long as a document, made from its text's hash; cut every 200 bases into fragments of 300 (the
#: last takes the rest). Between neighbours something is planted, by a hash of the place:
#: 0 nothing; 1 three mismatches; 2 one to three bases lost; 3 one to three added; 4 the left one's last 12 bases lost to N;
#: 5 the same with 30 (refused); 6 the right one's first 12 lost; 7 the same with 30 (refused); 8 no base in common (refused);
#: 9 places 40 bases off, beyond the band (refused). All other places are off by up to 10 bases, within the band of 15.
MERGE_SQL = """
with hashed as (select doc_id, strlen(coalesce(text, '')) size, sha256(coalesce(text, '')) h from documents where strlen(coalesce(text, '')) > 0),
texts as (select doc_id, size, left(translate(array_to_string(list_transform(range(0, (size + 63) // 64), lambda i: sha256(h || ':' || i)), ''), '0123456789abcdef', 'ACGTACGTACGTACGT'), size) seq from hashed),
cuts as (select *, unnest(range(0, greatest((size - 100) // 200, 1))) i, greatest((size - 100) // 200, 1) n from texts),
kinds as (select *, case when i < n - 1 then ('0x' || left(sha256(doc_id || ':' || i), 6))::bigint % 10 else -1 end kind from cuts),
placed as (select *, case when i < n - 1 then 300 else size - 200 * i end len, coalesce(lag(kind) over (partition by doc_id order by i), -1) before from kinds),
units as (select *, sum(case when before in (0, 1, 2, 3, 4, 6) then 0 else 1 end) over (partition by doc_id order by i) unit from placed),
given as (select *, case before when 6 then repeat('W', 12) || substr(seq, 200 * i + 13, 88) when 7 then repeat('W', 30) || substr(seq, 200 * i + 31, 70) else substr(seq, 200 * i + 1, 100) end first100,
  case kind when 5 then substr(seq, 200 * i + 201, 70) || repeat('N', 30) when 8 then repeat('N', 100) else substr(seq, 200 * i + len - 99, 100) end last100 from units)
select doc_id scaffold_id, cast(doc_id * 1000000 + min(i) as bigint) contig_id, count(*) fragments, cast(200 * (max(i) - min(i)) + arg_max(len, i) as bigint) len,
  sha256(case when max(n) = 1 then any_value(seq) else arg_min(first100, i) || substr(any_value(seq), 200 * min(i) + 101, 200 * (max(i) - min(i)) + arg_max(len, i) - 200) || arg_max(last100, i) end) sha
from given group by doc_id, unit"""


@query(MERGE_SQL)
def overlap_merge(spark, sf_dir):
    """Fragments of every document's sequence with planted edits, merged; every second one is turned round."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("octet_length(text) > 0")
    d = d.select("doc_id", F.expr("octet_length(text) size"), F.sha2("text", 256).alias("h"))  # whole texts are not dealt out
    d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    blocks = "array_join(transform(sequence(0, div(size + 63, 64) - 1), i -> sha2(concat(h, ':', i), 256)), '')"
    d = d.select("doc_id", "size", F.expr(f"left(translate({blocks}, '0123456789abcdef', 'ACGTACGTACGTACGT'), size)").alias("seq"), F.expr("greatest(div(size - 100, 200), 1)").alias("n"))
    kind = lambda i: f"case when {i} between 0 and n - 2 then cast(conv(left(sha2(concat(doc_id, ':', {i}), 256), 6), 16, 10) as bigint) % 10 else -1 end"
    jitter = lambda i: f"cast(conv(substring(sha2(concat(doc_id, ':', {i}), 256), 7, 6), 16, 10) as bigint) % 11 - 5"
    cut = d.select("*", F.expr("explode(sequence(0, cast(n as int) - 1)) i")).withColumn("kind", F.expr(kind("i"))).withColumn("prior", F.expr(kind("(i - 1)")))
    cut = cut.withColumn("part", F.expr("substring(seq, 200 * i + 1, cast(if(i < n - 1, 300, size - 200 * i) as int))")).withColumn("k", F.expr("cast(1 + i % 3 as int)"))
    first = "case prior when 6 then concat(repeat('W', 12), substring(part, 13)) when 7 then concat(repeat('W', 30), substring(part, 31)) else part end"
    last = """case kind when 1 then concat(left(part, 235), 'N', substring(part, 237, 9), 'N', substring(part, 247, 9), 'N', substring(part, 257))
      when 2 then concat(left(part, 250), substring(part, 251 + k)) when 3 then concat(left(part, 250), repeat('N', k), substring(part, 251))
      when 4 then concat(left(part, 288), repeat('N', 12)) when 5 then concat(left(part, 270), repeat('N', 30)) when 8 then concat(left(part, 200), repeat('N', 100)) else part end"""
    cut = cut.withColumn("part", F.expr(first)).withColumn("part", F.expr(last))
    # fragments lie where they are, off by some bases, and by 40 more from one that its left neighbour must not reach
    moved = F.sum(F.when(F.col("prior") == 9, 40).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("i"))
    cut = cut.select(F.col("doc_id").alias("scaffold_id"), F.expr("doc_id * 1000000 + i").alias("contig_id"), (F.col("i") * 200.0 + F.expr(jitter("i")) + moved).alias("start"), F.when(F.col("i") % 2 == 1, "R").otherwise("F").alias("direct"), F.lit(0.0).alias("std"), "part")
    cut = checkpointed(cut)
    seqs = cut.select("contig_id", F.when(F.col("direct") == "R", sequence.revcomp(F.col("part"))).otherwise(F.col("part")).alias("seq"))
    lay = cut.select("scaffold_id", "contig_id", "start", (F.col("start") + F.length("part")).alias("end"), "direct", "std")
    units = merge.merged_units(lay, seqs, 15.0)
    return units.select("scaffold_id", "contig_id", F.size(F.split("ids", "\\+")).cast("long").alias("fragments"), F.length("seq").cast("long").alias("len"), F.sha2("seq", 256).alias("sha"))


# ---- robust statistics ----------------------------------------------------------------------------------------
PRICE = "select l_suppkey k, l_extendedprice x from lineitem"


def _price(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("x"))


@query(f"with d as ({PRICE}), m as (select *, median(x) over (partition by k) m from d) select k, round(median(abs(x - m)) / 0.675, 4) madn from m group by k")
def madn(spark, sf_dir):
    return stats.madn(_price(spark, sf_dir), "k", "x").withColumn("madn", F.round("madn", 4))


@query(f"with d as ({PRICE}), q as (select k, quantile_cont(x, 0.05) l, quantile_cont(x, 0.95) h from d group by k) select k, round(median(x), 4) trim_median from d join q using (k) where x between l and h group by k")
def trim_median(spark, sf_dir):
    return stats.trim_median(_price(spark, sf_dir), "k", "x").withColumn("trim_median", F.round("trim_median", 4))


@query(f"with d as ({PRICE}), m as (select *, median(x) over (partition by k) m from d) select k, round(sqrt(avg((x - m) * (x - m)) / 2), 4) median_std from m group by k")
def median_std(spark, sf_dir):
    return stats.median_std(_price(spark, sf_dir), "k", "x").withColumn("median_std", F.round("median_std", 4))


@query(f"""with d as ({PRICE}), q as (select k, quantile_cont(x, 0.75) q, quantile_cont(x, 0.98) f from d group by k), n as (select *, lead(x) over (partition by k order by x) nx from d)
select k, round(coalesce(min(case when x >= q and nx - x > 1000 and nx > 3 * x then x end), max(f)), 4) demarcation from n join q using (k) group by k""")
def demarcation(spark, sf_dir):
    return stats.demarcation(_price(spark, sf_dir), "k", "x").withColumn("demarcation", F.round("demarcation", 4))
