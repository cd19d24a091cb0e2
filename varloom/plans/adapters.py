"""Domain tables made from the star-schema test tables (synthetic, without genetic meaning).

The text is plain SQL with a placeholder for each input table, so that the
same table feeds the operators and the SQL they are held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ADAPTERS = {
    "ref_variant": """
select concat('rs',cast(p_partkey as varchar(20))) snp, p_partkey%22+1 chr, ((p_partkey*7919)%60000)*1000 bp,
 substr('ACGT',cast(p_size%4+1 as int),1) a1, substr('ACGT',cast((p_size+1+p_partkey%3)%4+1 as int),1) a2,
 (p_retailprice-900)/200 maf, p_brand from {part}""",
    "sumstats": """
select case when p_partkey%5=0 then concat('x',cast(p_partkey as varchar(20))) else concat('rs',cast(p_partkey as varchar(20))) end snp,
 p_partkey%22+1 chr, ((p_partkey*7919)%60000)*1000 bp, case when p_partkey%97=0 then 'X' else cast(p_partkey%22+1 as varchar(2)) end chr_label,
 case when p_partkey%7 in (1,3) then substr('ACGT',cast((p_size+1+p_partkey%3)%4+1 as int),1) else substr('ACGT',cast(p_size%4+1 as int),1) end a1,
 case when p_partkey%7 in (1,3) then substr('ACGT',cast(p_size%4+1 as int),1) else substr('ACGT',cast((p_size+1+p_partkey%3)%4+1 as int),1) end a2,
 l_returnflag trait, sum(l_quantity)*100 n, round((avg(l_discount)-0.05)/0.0316*sqrt(count(*)),6)+0.0 z
 from {part} join {lineitem} on p_partkey=l_partkey group by p_partkey,p_size,l_returnflag""",
    "go_enrich": """
with a as (select p_brand b,p_size%10 g,l_extendedprice e,l_discount d,l_quantity q from {lineitem} join {part} on l_partkey=p_partkey),
 s as (select b,count(distinct g) ng,sum(e*d) h2,sum(e) h2b,count(*) snps,avg(d) m from a group by b),
 l as (select b,g,sum(e*d) h2,sum(e) h2b,count(*) snps,avg(d) m from a group by b,g),
 t as (select sum(h2) h2,sum(h2b) h2b,sum(snps) snps,sum(ng) ng from s)
 select 'coding_genes' go,cast(1.0 as double) enrich,h2,h2b h2_base,snps,ng ngenes,cast(null as double) loglike_aic from t
 union all select concat('GOBP_',b),(s.h2/s.h2b)/(t.h2/t.h2b),s.h2,s.h2b,s.snps,s.ng,round((m-0.05)*1e5,3)+0.0 from s cross join t
 union all select concat('GOBP_',l.b,'_excl_GENE',cast(l.g as varchar(20))),((s.h2-l.h2)/(s.h2b-l.h2b))/(t.h2/t.h2b),s.h2-l.h2,s.h2b-l.h2b,s.snps-l.snps,s.ng-1,cast(null as double) from l join s on l.b=s.b cross join t
 union all select concat('GENE',cast(g as varchar(20))),(sum(l.h2)/sum(l.h2b))/max(t.h2/t.h2b),sum(l.h2),sum(l.h2b),sum(l.snps),1,round((avg(l.m)-0.05)*1e5,3)+0.0 from l cross join t group by g""",
    "replicate_run": """
select p_brand trait,l_linenumber rep,avg(l_discount) pi,avg(l_tax) sig2_beta,sum(l_extendedprice*l_discount) h2,
 avg(l_discount*l_tax) pi12, corr(l_discount,l_tax) rho_beta, avg(l_discount)*1.5 pi2u, count(*) num_snp
 from {lineitem} join {part} on l_partkey=p_partkey group by p_brand,l_linenumber""",
    "magma_gsa": """
select distinct concat('GOBP_',p_brand) full_name, pow(10.0e0, -((cast(substr(p_brand,7) as int)*7)%25)/5.0e0) p from {part} where p_brand<>'Brand#1'""",
    "magma_genes": """
select distinct concat('GENE',cast(p_size%10 as varchar(20))) gene, pow(10.0e0, -((p_size%10)*3)%10) p from {part}""",
    "gene_loc": """
select concat('G',cast(p_partkey as varchar(20))) gene, p_partkey%22+1 chr, ((p_partkey*104729)%60000)*1000 gstart, ((p_partkey*104729)%60000)*1000+500000 gend from {part}""",
    "p_or": """
select l_orderkey,l_partkey,l_linenumber,(round(l_discount*100,0)+1)/12.0e0 p, round(1+l_tax-0.04e0,4) odds_ratio from {lineitem}""",
}
TABLES = ("part", "lineitem", "embeddings")


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(ADAPTERS[name].format(**files))


def ctes(*names: str) -> str:
    """A WITH clause that names the adapters over plain table names."""
    return "with " + ", ".join(f"{n} as ({ADAPTERS[n].format(**{t: t for t in TABLES})})" for n in names)
