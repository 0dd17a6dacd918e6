"""Planted inputs derived from the part, lineitem and orders tables by SQL that Spark and DuckDB both run.

Fragments are 1000 long in blocks of ten, 1050 apart; short-insert pairs (800 +- 15) join neighbours, mate
pairs (3000 +- 15) join fragments two apart, and some short pairs are flipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTIGS = "select cast(p_partkey+1 as bigint) contig_id, cast(1000 as bigint) len from {part}"

PAIRS = """
select 'PE' lib, c1, 250+q+noise p1, 350+q+noise m1, c2, case when ln=7 then q-100 else q end p2, case when ln=7 then q else q-100 end m2
from (select cast(l_partkey+1 as bigint) c1, cast(l_partkey+2 as bigint) c2, 100+(l_orderkey % 200) q, cast(l_quantity as bigint)-25 noise, l_linenumber ln
      from {lineitem} where l_suppkey % 2 = 0 and l_partkey % 10 < 9) a
union all
select 'MP' lib, c1, q-700+noise p1, q-800+noise m1, c2, q p2, q+100 m2
from (select cast(l_partkey+1 as bigint) c1, cast(l_partkey+3 as bigint) c2, 850+(l_orderkey % 40) q, cast(l_quantity as bigint)-25 noise
      from {lineitem} where l_suppkey % 2 = 1 and l_partkey % 10 < 8) b
"""

LIBRARIES = "select * from (values ('PE','PE',cast(800 as bigint),cast(15 as double)),('MP','MP',cast(3000 as bigint),cast(15 as double))) t(lib,lib_type,insert_size,sd)"

#: A library for every supplier.
SUPPLIED = """select concat('lib', s_suppkey) lib, case s_nationkey % 3 when 0 then 'PE' when 1 then 'MP' else '3GS' end lib_type,
  cast(500 + 100 * s_nationkey + s_suppkey % 7 as bigint) insert_size, cast(10 + (s_suppkey % 400) / 4.0 as double) sd from {supplier}"""

SELF_PAIRS = """
select case when o_orderkey % 2 = 0 then 'PE' else 'MP' end lib, c c1, 100+o_orderkey % 4000 p1, 200+o_orderkey % 4000 m1, c c2,
       100+o_orderkey % 4000+x p2, o_orderkey % 4000+x m2
from (select o_orderkey, cast(o_custkey % 50 + 1 as bigint) c, case when o_orderkey % 2 = 0 then 800 else 3000 end + (o_orderkey*7+o_custkey) % 121 - 60 x from {orders}) a
"""

LAYOUT = """
select scaffold_id, ord, contig_id, len, cast(pos as double) as start, cast(pos+len as double) as "end", case when contig_id % 3 = 0 then 'R' else 'F' end direct,
       cast(10 + contig_id % 7 as double) std
from (select cast(floor((contig_id-1)/10) as bigint) scaffold_id, (contig_id-1) % 10 ord, contig_id, len,
        ((contig_id-1) % 10)*1050 + case when cast(floor((contig_id-1)/10) as bigint) % 7 = 3 and (contig_id-1) % 10 >= 5 then 700 else 0 end
        - case when contig_id % 11 = 0 then 400 else 0 end pos
      from ({contigs}) c) l
"""

ALIGNMENTS = """
select q qname, t tname, cast(0 as int) qstrand, cast((q+rn) % 2 as int) tstrand, -700-(s % 100) score, 85.0+(s % 15) pct_sim,
       s % 300 tstart, 500+(t % 50)*20-(s % 7)*50 tend, 500+(t % 50)*20 tlength, (rn-1)*900+(s % 50) qstart, (rn-1)*900+600+(t % 50)*10 qend, cast(7000 as bigint) qlength
from (select l_orderkey q, l_partkey+1 t,
        row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate) rn, l_suppkey s from {lineitem}) r
"""


def oracle(text: str) -> str:
    """The fixture's SQL over the registered table names (DuckDB)."""
    return text.replace("{contigs}", CONTIGS).format(part="part", lineitem="lineitem", orders="orders")


def build(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The fixture as a DataFrame over the Parquet tables."""
    text = text.replace("{contigs}", CONTIGS).replace('"end"', "`end`")
    names = [n for n in ("part", "lineitem", "orders") if "{" + n + "}" in text]
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
