"""A wordlist derived from the trade tables, so that every operator has input that grows with them.

A part is a cognate set, a customer's nation modulo 8 a doculect, and the first word of the part's name the form, with
regular sound changes per doculect, an irregular first sound in one of eleven words, and a gap at the end of one in five.
A doculect has the word if its customers ordered the part ATTESTED times or more, in whatever lines of their orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGS = [f"L{i}" for i in range(8)]
#: Letters of each doculect and what they become.
CHANGES = [("", ""), ("ae", "ea"), ("bdg", "ptk"), ("st", "zd"), ("aou", "oua"), ("lr", "rl"), ("mn", "nm"), ("ei", "ie")]
CONCEPTS, FAMILIES, ATTESTED = 97, 2, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _changed(word: Column, lang: Column) -> Column:
    out = word
    for i, (a, b) in enumerate(CHANGES):
        if a:
            out = F.when(lang == i, F.translate(word, a, b)).otherwise(out)
    return out


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doculect, lang, concept, family, cogid, word, tokens, alignment, structure), one row per (cogid, doculect)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 8).cast("int").alias("lang"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("word"))
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "lang")  # so that the lines move once
    rows = lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.groupBy(F.col("l_partkey").alias("cogid"), "lang").agg(F.count("*").alias("lines")).where(F.col("lines") >= ATTESTED)
    rows = rows.join(parts, F.col("cogid") == F.col("p_partkey"))
    form = _changed(F.col("word"), F.col("lang"))
    rows = rows.withColumn("form", form)
    rows = rows.withColumn("form", F.when((F.col("cogid") * 7 + F.col("lang") * 3) % 11 == 0, F.concat(F.lit("x"), F.expr("substring(form, 2)"))).otherwise(F.col("form")))
    rows = rows.withColumn("form", F.when((F.col("cogid") + F.col("lang")) % 5 == 0, F.concat(F.expr("substring(form, 1, length(form) - 1)"), F.lit("-"))).otherwise(F.col("form")))
    rows = rows.withColumn("alignment", F.filter(F.split("form", ""), lambda x: x != ""))
    kind = lambda x: F.when(x.isin(*"aeiou"), "v").otherwise("c")
    base = F.filter(F.split("word", ""), lambda x: x != "")
    spread = F.filter(F.arrays_zip(F.col("alignment").alias("a"), base.alias("b")), lambda z: z["a"] != "-")
    return rows.select(
        (F.col("cogid") * 8 + F.col("lang")).alias("id"),
        F.concat(F.lit("L"), F.col("lang").cast("string")).alias("doculect"),
        "lang",
        F.concat(F.lit("C"), (F.col("cogid") % CONCEPTS).cast("string")).alias("concept"),
        F.concat(F.lit("F"), (F.col("lang") % FAMILIES).cast("string")).alias("family"),
        "cogid",
        "word",
        F.filter("alignment", lambda x: x != "-").alias("tokens"),
        "alignment",
        F.transform(spread, lambda z: kind(z["b"])).alias("structure"),
    )


def morphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived words in the long form that the operators take."""
    return words(spark, sf_dir).select("id", F.lit(0).alias("m_idx"), "doculect", "concept", "cogid", "tokens", "alignment", "structure")


def partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived words with two cogids each (a stem of its own, and one of seven endings) and glosses."""
    rows = words(spark, sf_dir)
    ending = (F.lit(10_000_000) + F.col("cogid") % 7).cast("long")
    gloss = F.when(F.col("cogid") % 3 == 0, "_suf").otherwise("end")
    stem = (F.col("cogid") % 1009).cast("long")
    return rows.withColumn("cogids", F.array(stem, ending)).withColumn("morphemes", F.array(F.concat(F.lit("stem"), (F.col("cogid") % 5).cast("string")), gloss))


def _sql_form() -> str:
    cases = " ".join(f"when {i} then translate(word, '{a}', '{b}')" for i, (a, b) in enumerate(CHANGES) if a)
    return f"case lang {cases} else word end"


#: The same words in DuckDB SQL: CTEs words (id, doculect, lang, concept, family, cogid, word, form) and cells (one row per sound).
SQL = f"""
raw as (
    select l_partkey as cogid, (c_nationkey % 8)::int as lang, split_part(any_value(p_name), ' ', 1) as word
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey
    group by all having count(*) >= {ATTESTED}
), formed as (select *, {_sql_form()} as f0 from raw),
broken as (select *, case when (cogid * 7 + lang * 3) % 11 = 0 then 'x' || substr(f0, 2) else f0 end as f1 from formed),
words as (
    select cogid * 8 + lang as id, 'L' || lang as doculect, lang, 'C' || (cogid % {CONCEPTS}) as concept, 'F' || (lang % {FAMILIES}) as family, cogid, word,
        case when (cogid + lang) % 5 = 0 then substr(f1, 1, length(f1) - 1) || '-' else f1 end as form
    from broken
), cells as (
    select cogid, lang, id, doculect, concept, i - 1 as pos, substr(form, i, 1) as sound,
        case when substr(word, i, 1) in ('a', 'e', 'i', 'o', 'u') then 'v' else 'c' end as class,
        count(*) over (partition by cogid, i) as refs
    from words, unnest(range(1, length(form) + 1)) as t(i)
), site_cells as (
    select g.cogid, g.pos, l.lang, coalesce(c.sound, 'Ø') as sound
    from (select distinct cogid, pos from cells where refs >= 2) g cross join (select unnest(range(8)) as lang) l
    left join cells c on c.cogid = g.cogid and c.pos = g.pos and c.lang = l.lang
), site_rows as (
    select s.cogid, s.pos, list(s.sound order by s.lang) as pattern,
        coalesce((select arg_min(class, lang) from cells c where c.cogid = s.cogid and c.pos = s.pos and c.sound <> '-'), '+') as struct,
        count(*) filter (where s.sound <> 'Ø') as refs
    from site_cells s group by s.cogid, s.pos
), sites as (select cogid, pos, struct, pattern from site_rows where refs >= 3)
"""

_FITS = """len(list_filter(range(1, 9), lambda j: {a}[j] <> {b}[j] and {a}[j] <> 'Ø' and {b}[j] <> 'Ø')) = 0
    and len(list_filter(range(1, 9), lambda j: {a}[j] = {b}[j] and {a}[j] <> 'Ø' and {a}[j] <> '-')) > 0"""


def fits(a: str, b: str) -> str:
    """SQL: two patterns have a sound in common and conflict nowhere."""
    return _FITS.format(a=a, b=b)


#: The clusters of sites in DuckDB SQL: CTE clustered (cogid, pos, struct, pattern, consensus). A pass goes through the clusters
#: in their order, each to the first one before it that it fits; passes repeat while any two come together.
CLUSTERS = f"""
, one_each as (select struct, pattern, count(*) as n, min((cogid, pos)) as first, len(list_filter(pattern, lambda x: x <> 'Ø')) as fill from sites group by all),
pass_start as (
    select struct, list({{'cons': pattern, 'members': [pattern], 'n': n, 'rp': n * fill * (fill - 1) / 2.0::double,
        'cols': list_transform(pattern, lambda x: case when x = 'Ø' then 0::bigint else n end)}} order by first) as cl
    from one_each group by struct
), passes as (
    with recursive r(k, struct, cl, stable) as (
        select 0, struct, cl, false from pass_start
        union all
        select k + 1, struct, new, len(new) = len(cl) from (
            select k, struct, cl, list_reduce(list_transform(list_sort(list_transform(cl, lambda c, i: {{
                    'a': case when c.n <= 1 then 1.0::double
                        else -((c.rp + list_sum(list_transform(c.cols, lambda v: v * (v - 1) / 2.0::double))) / c.n / greatest(1, len(list_filter(c.cols, lambda v: v > 0))) / 8) end,
                    'b': -c.n, 'i': i, 'c': c}})), lambda z: {{'cl': [z.c]}}),
                lambda x, y: {{'cl': list_transform([coalesce(list_position(list_transform(x.cl, lambda c: {fits('c.cons', 'y.cl[1].cons')}), true), 0)],
                    lambda p: case when p = 0 then list_append(x.cl, y.cl[1]) else list_transform(x.cl, lambda c, i: case when i = p then {{
                        'cons': list_transform(range(1, 9), lambda j: case when c.cons[j] = 'Ø' then y.cl[1].cons[j] else c.cons[j] end),
                        'members': list_concat(c.members, y.cl[1].members), 'n': c.n + y.cl[1].n, 'rp': c.rp + y.cl[1].rp,
                        'cols': list_transform(range(1, 9), lambda j: c.cols[j] + y.cl[1].cols[j])}} else c end) end)[1]}}).cl as new
            from r where not stable
        )
    ) select struct, cl from r where stable
), heads as (
    select struct, c.cons as consensus, unnest(c.members) as pattern from (select struct, unnest(cl) as c from passes)
), clustered as (select s.cogid, s.pos, s.struct, s.pattern, h.consensus from sites s join heads h using (struct, pattern)),
sizes as (select struct, consensus, count(*) as size, min((cogid, pos)) as first from clustered group by all)
"""
