"""Registered queries over the derived wordlist, one per operator or group of operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.sequences import alignment_to_tokens, bleu, clean_sound, gap_count, is_subsequence, matches, mismatches, unjoin
from lexispark.functions.storage import materialise, stored
from lexispark.operators import borrowing, clusters, cognates, metrics, prepare, reconstruct, sites, trimming
from lexispark.operators.fits import fitting
from lexispark.plans.derived import CLUSTERS, LANGS, SQL, fits, morphemes, partial, words
from lexispark.plans.experiments import correspondence_patterns, leave_out, leave_out_summary, prediction_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prefix: str = SQL) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {prefix}{sql}" if prefix else sql
        return f

    return add


def text(array: str) -> Column:
    return F.array_join(array, " ")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.get_sites(morphemes(spark, sf_dir), LANGS)


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correspondence_patterns(morphemes(spark, sf_dir), LANGS)


# Sequence functions


@query("select id, array_to_string(list_filter(string_split(form, ''), lambda x: x <> '-'), ' ') as tokens, len(form)::bigint as width from words")
def tokens_of_alignments(spark, sf_dir):
    return words(spark, sf_dir).select("id", F.array_join(alignment_to_tokens(F.col("alignment")), " ").alias("tokens"), F.size("alignment").cast("long").alias("width"))


@query("select id, form || '/' || word as raw, word as clean, word || ' ' || form as parts from words")
def slashes_and_dots(spark, sf_dir):
    form = F.array_join("alignment", "")
    raw = F.concat(form, F.lit("/"), F.col("word"))
    parts = unjoin(F.array(F.concat_ws(".", "word", form)))
    return words(spark, sf_dir).select("id", raw.alias("raw"), clean_sound(raw).alias("clean"), F.array_join(parts, " ").alias("parts"))


@query(
    """
select a.id as id_a, b.id as id_b,
    len(list_filter(range(1, len(a.form) + 1), lambda i: a.form[i] = b.form[i] and a.form[i] <> '-'))::bigint as same,
    len(list_filter(range(1, len(a.form) + 1), lambda i: a.form[i] <> b.form[i]))::bigint as different
from words a join words b on a.cogid = b.cogid and a.lang < b.lang
"""
)
def compatible_words(spark, sf_dir):
    w = words(spark, sf_dir)
    a, b = w.select("cogid", F.col("lang").alias("la"), F.col("id").alias("id_a"), F.col("alignment").alias("a")), w.select("cogid", F.col("lang").alias("lb"), F.col("id").alias("id_b"), F.col("alignment").alias("b"))
    both = a.join(b, "cogid").where("la < lb")
    return both.select("id_a", "id_b", matches(F.col("a"), F.col("b")).cast("long").alias("same"), mismatches(F.col("a"), F.col("b")).cast("long").alias("different"))


@query("select id, regexp_matches(regexp_replace(regexp_replace(word, '[aeiou]', 'V', 'g'), '[^V]', 'C', 'g'), 'C.*V.*C') as holds from words")
def skeleton_in_word(spark, sf_dir):
    kinds = F.transform(F.filter(F.split("word", ""), lambda x: x != ""), lambda x: F.when(x.isin(*"aeiou"), "V").otherwise("C"))
    return words(spark, sf_dir).select("id", is_subsequence(F.array(F.lit("C"), F.lit("V"), F.lit("C")), kinds).alias("holds"))


_TOKENS = "string_split(replace(form, '-', ''), '')"
_PAIRED = "from words a join words b on a.cogid = b.cogid and a.id < b.id"


@query(
    f""", t as (select id, cogid, {_TOKENS} as w from words), p as (
    select a.id as id_a, b.id as id_b, a.w as w, b.w as r,
        list_transform(range(1, len(a.w)), lambda i: a.w[i] || a.w[i + 1]) as w2, list_transform(range(1, len(b.w)), lambda i: b.w[i] || b.w[i + 1]) as r2
    from t a join t b on a.cogid = b.cogid and a.id < b.id
)
select id_a, id_b, round(case when len(w) > len(r) then 1.0 else exp(1 - len(r)::double / len(w)) end
    * sqrt(len(list_filter(r, lambda x: list_contains(w, x)))::double / len(w)) * sqrt(len(list_filter(r2, lambda x: list_contains(w2, x)))::double / len(w2)), 9) as bleu
from p
"""
)
def bleu_scores(spark, sf_dir):
    w = words(spark, sf_dir)
    a, b = w.select("cogid", F.col("id").alias("id_a"), F.col("tokens").alias("a")), w.select("cogid", F.col("id").alias("id_b"), F.col("tokens").alias("b"))
    return a.join(b, "cogid").where("id_a < id_b").select("id_a", "id_b", F.round(bleu(F.col("a"), F.col("b"), n=2), 9).alias("bleu"))


@query("select id, (length(form) - length(replace(form, '-', '')))::bigint as gaps from words")
def gaps_of_words(spark, sf_dir):
    return words(spark, sf_dir).select("id", gap_count(F.col("alignment")).cast("long").alias("gaps"))


# Sites


@query("select cogid, pos, struct, array_to_string(pattern, ' ') as pattern from sites")
def alignment_sites(spark, sf_dir):
    return _sites(spark, sf_dir).select("cogid", F.col("pos").cast("long").alias("pos"), "struct", text("pattern").alias("pattern"))


@query(
    """, alone as (
    select c.cogid, row_number() over (partition by c.cogid order by c.pos) - 1 as pos, c.lang, c.sound from cells c where refs = 1 and sound <> '-'
)
select cogid, pos, array_to_string(pattern, ' ') as pattern from site_rows
union all
select cogid, pos, array_to_string(list_transform(range(8), lambda l: case when l = lang then sound else 'Ø' end), ' ') from alone
"""
)
def every_site(spark, sf_dir):
    found = sites.all_sites(morphemes(spark, sf_dir), LANGS)
    return found.select("cogid", F.col("pos").cast("long").alias("pos"), text("pattern").alias("pattern"))


_PAIRS = """, kinds as (select struct, pattern, count(*) as n from sites group by all),
kind_cells as (select struct, pattern, i, pattern[i] as s from kinds, unnest(range(1, 9)) as t(i) where pattern[i] not in ('Ø', '-')),
near as (
    select a.struct, a.pattern as p, b.pattern as q, count(*) as matched
    from kind_cells a join kind_cells b on a.struct = b.struct and a.i = b.i and a.s = b.s group by all
), pairs as (
    select * from near where len(list_filter(range(1, 9), lambda i: p[i] <> q[i] and p[i] <> 'Ø' and q[i] <> 'Ø')) = 0
)
"""


@query(_PAIRS + "select struct, array_to_string(p, ' ') as pattern, count(*)::bigint as partners, sum(matched)::bigint as matched from pairs group by all")
def compatible_patterns(spark, sf_dir):
    kinds = materialise(_sites(spark, sf_dir).select("struct", "pattern").distinct())
    return fitting(kinds, kinds, {"partners": None}).select("struct", text("pattern").alias("pattern"), "partners", "matched")


@query(_PAIRS + "select s.cogid, s.pos, (sum(k.n) - 1)::bigint as neighbours from sites s join pairs p on p.struct = s.struct and p.p = s.pattern join kinds k on k.struct = p.struct and k.pattern = p.q group by all having sum(k.n) > 1")
def site_neighbours(spark, sf_dir):
    return sites.site_degrees(_sites(spark, sf_dir)).select("cogid", F.col("pos").cast("long").alias("pos"), "neighbours")


@query(
    """, kinds as (select struct, pattern, count(*) as n from sites group by all), per as (select struct, sum(n) as held from kinds group by struct),
clash as (
    select a.struct, a.pattern, sum(case when len(list_filter(range(1, 9), lambda i: a.pattern[i] <> b.pattern[i] and a.pattern[i] <> 'Ø' and b.pattern[i] <> 'Ø')) > 0 then b.n else 0 end) as bad, sum(b.n) as total
    from kinds a join kinds b using (struct) group by a.struct, a.pattern
)
select max(bad + (select sum(n) from kinds) - held)::bigint as upper_bound from clash join per using (struct) where total - bad > 1
"""
)
def upper_bound(spark, sf_dir):
    return sites.upper_bound(_sites(spark, sf_dir))


_FILL = """, filled as (
    select cogid, count(*) as n, max(len(list_filter(pattern, lambda x: x <> 'Ø'))) as m,
        avg(pow(len(list_filter(pattern, lambda x: x <> 'Ø')) / 8.0, 2)) as sq,
        sum(len(list_filter(pattern, lambda x: x <> 'Ø'))) as cells,
        bool_or(false) as none from sites group by cogid
), conflicts as (
    select cogid, max(k) as kinds from (select cogid, i, count(distinct nullif(pattern[i], 'Ø')) as k from sites, unnest(range(1, 9)) as t(i) group by all) group by cogid
)
"""


@query(_FILL + "select cogid, round(case when kinds > 1 or n <= 1 then -1.0 else cells / 8.0 / n end, 9) as score from filled join conflicts using (cogid)")
def pattern_score_coverage(spark, sf_dir):
    return sites.score_patterns(_sites(spark, sf_dir), ["cogid"], "coverage").select("cogid", F.round("score", 9).alias("score"))


@query(_FILL + "select cogid, round(case when kinds > 1 or n <= 1 then -1.0 else sq end, 9) as score from filled join conflicts using (cogid)")
def pattern_score_squared(spark, sf_dir):
    return sites.score_patterns(_sites(spark, sf_dir), ["cogid"], "squared").select("cogid", F.round("score", 9).alias("score"))


_GROUPED = """, members as (select struct, array_to_string(pattern[1:4], ' ') as g, pattern from sites),
mrows as (select g, struct, pattern, len(list_filter(pattern, lambda x: x <> 'Ø')) as fill from members),
mcols as (select g, struct, i, count(*) filter (where pattern[i] <> 'Ø') as fill, count(distinct nullif(pattern[i], 'Ø')) as kinds from members, unnest(range(1, 9)) as t(i) group by all),
ranked as (select *, 9 - row_number() over (partition by g, struct order by fill desc, i) as rank from mcols),
scores as (
    select r.g, r.struct, case when r.n <= 1 or c.kinds > 1 then -1.0 else (r.rp + c.cp) / r.n / c.covered / 8 end as pairs, case when r.n <= 1 or c.kinds > 1 then -1.0 else c.ranked / r.n end as ranked
    from (select g, struct, count(*) as n, sum(fill * (fill - 1) / 2.0) as rp from mrows group by all) r
    join (select g, struct, max(kinds) as kinds, sum(fill * (fill - 1) / 2.0) as cp, count(*) filter (where fill > 0) as covered, sum(rank * fill) / sum(rank)::double as ranked from ranked group by all) c using (g, struct)
)
"""


def _like_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites in groups that agree in the first four doculects; some groups conflict in the others, some don't."""
    return _sites(spark, sf_dir).select("struct", text(F.slice("pattern", 1, 4)).alias("g"), "pattern")


@query(_GROUPED + "select g, struct, round(pairs, 9) as score from scores")
def pattern_score_pairs(spark, sf_dir):
    return sites.score_patterns(_like_groups(spark, sf_dir), ["g", "struct"], "pairs").select("g", "struct", F.round("score", 9).alias("score"))


@query(_GROUPED + "select g, struct, round(ranked, 9) as score from scores")
def pattern_score_ranked(spark, sf_dir):
    return sites.score_patterns(_like_groups(spark, sf_dir), ["g", "struct"], "ranked").select("g", "struct", F.round("score", 9).alias("score"))


@query(
    """, cols as (select cogid, i, max(nullif(pattern[i], 'Ø')) as s, count(distinct nullif(pattern[i], 'Ø')) as k from sites, unnest(range(1, 9)) as t(i) group by all)
select cogid, case when max(k) > 1 then null else string_agg(coalesce(s, 'Ø'), ' ' order by i) end as consensus, string_agg(case when k > 1 then '*' else '.' end, '' order by i) as conflicts from cols group by cogid
"""
)
def consensus_patterns(spark, sf_dir):
    found = sites.consensus(_sites(spark, sf_dir), ["cogid"])
    return found.select("cogid", text("consensus").alias("consensus"), F.array_join(F.transform("conflicts", lambda c: F.when(c == "", ".").otherwise(c)), "").alias("conflicts"))


@query("select round(1 - avg(share), 12) as density from (select concept, count(distinct cogid)::double / count(*) as share from words group by concept)")
def density(spark, sf_dir):
    return sites.density(words(spark, sf_dir)).select(F.round("density", 12).alias("density"))


@query("select id from words where form like '%-'")
def badly_structured_words(spark, sf_dir):
    """Words whose classes are those of the part's name, which has a sound more where the last one is a gap."""
    kinds = F.transform(F.filter(F.split("word", ""), lambda x: x != ""), lambda x: F.when(x.isin(*"aeiou"), "v").otherwise("c"))
    return sites.bad_structures(words(spark, sf_dir).withColumn("structure", kinds).withColumn("m_idx", F.lit(0))).select("id")


# Clusters

_FITTING = CLUSTERS + f""", heads_of as (
    select k.struct, k.pattern, z.consensus, z.size, len(list_filter(range(1, 9), lambda j: k.pattern[j] = z.consensus[j] and k.pattern[j] <> 'Ø' and k.pattern[j] <> '-')) as matches
    from one_each k join sizes z on k.struct = z.struct and {fits('k.pattern', 'z.consensus')}
)
"""


@query(CLUSTERS + "select cogid, pos, struct, array_to_string(pattern, ' ') as pattern, array_to_string(consensus, ' ') as consensus from clustered")
def clustered_sites(spark, sf_dir):
    return _clustered(spark, sf_dir).select("cogid", F.col("pos").cast("long").alias("pos"), "struct", text("pattern").alias("pattern"), text("consensus").alias("consensus"))


@query(_FITTING + "select s.cogid, s.pos, s.struct, array_to_string(h.consensus, ' ') as consensus, h.matches::bigint as matches from sites s join heads_of h using (struct, pattern)")
def sites_to_patterns(spark, sf_dir):
    found = clusters.sites_to_patterns(_clustered(spark, sf_dir))
    return found.select("cogid", F.col("pos").cast("long").alias("pos"), "struct", text("consensus").alias("consensus"), F.col("matches").cast("long").alias("matches"))


@query(_FITTING + "select round(count(*)::double / count(distinct (s.cogid, s.pos)), 9) as fuzziness from sites s join heads_of h using (struct, pattern)")
def fuzziness(spark, sf_dir):
    return clusters.fuzziness(_clustered(spark, sf_dir)).select(F.round("fuzziness", 9).alias("fuzziness"))


@query(
    CLUSTERS + _PAIRS + """, of as (select distinct struct, pattern, consensus from clustered),
beside as (
    select p.struct, p.p as pattern, o.consensus, sum(k.n - (p.p = p.q)::int) as n
    from pairs p join of o on o.struct = p.struct and o.pattern = p.q join kinds k on k.struct = p.struct and k.pattern = p.q where k.n > (p.p = p.q)::int group by all
), counts as (select struct, pattern, i, consensus[i] as sound, sum(n) as n from beside, unnest(range(1, 9)) as t(i) group by all),
cols as (select struct, pattern, i, sqrt(sum(case when sound <> 'Ø' then n * n else 0 end)) / sum(n) as p from counts group by all),
per as (select struct, pattern, avg(p) as p from cols group by all)
select round(sum(coalesce(p.p, 0) * k.n) / sum(k.n), 9) as purity from kinds k left join per p using (struct, pattern)
"""
)
def cluster_purity(spark, sf_dir):
    return clusters.purity(_clustered(spark, sf_dir)).select(F.round("purity", 9).alias("purity"))


_IRREGULAR = CLUSTERS + """, lone as (select c.* from clustered c join sizes z using (struct, consensus) where z.size = 1),
closest as (
    select l.pattern, arg_min(g.consensus, (-g.size, g.first, g.struct)) as consensus
    from (select distinct pattern from lone) l join (select * from sizes where size >= 2) g
        on len(list_filter(range(1, 9), lambda j: l.pattern[j] = g.consensus[j] and l.pattern[j] <> 'Ø' and l.pattern[j] <> '-')) > 1
        and len(list_filter(range(1, 9), lambda j: l.pattern[j] <> g.consensus[j] and l.pattern[j] <> 'Ø' and g.consensus[j] <> 'Ø')) <= 1
    group by l.pattern
), irregular as (select l.cogid, l.pos, l.struct, l.pattern, c.consensus from lone l left join closest c using (pattern))
"""


@query(_IRREGULAR + "select cogid, pos, struct, array_to_string(pattern, ' ') as pattern, array_to_string(consensus, ' ') as consensus from irregular")
def irregular_sites(spark, sf_dir):
    found = clusters.irregular_patterns(_clustered(spark, sf_dir))
    return found.select("cogid", F.col("pos").cast("long").alias("pos"), "struct", text("pattern").alias("pattern"), text("consensus").alias("consensus"))


@query(
    _IRREGULAR + """, marked as (
    select c.id, c.pos, case when r.cogid is null then c.sound when r.consensus is null then '!' || c.sound
        when r.consensus[c.lang + 1] <> c.sound and r.consensus[c.lang + 1] <> 'Ø' then '!' || c.sound || '/' || r.consensus[c.lang + 1] else c.sound end as sound
    from cells c left join irregular r on r.cogid = c.cogid and r.pos = c.pos
)
select id, string_agg(sound, ' ' order by pos) as alignment from marked group by id
"""
)
def marked_irregular_words(spark, sf_dir):
    found = clusters.irregular_patterns(_clustered(spark, sf_dir))
    return clusters.mark_irregular(morphemes(spark, sf_dir), found, LANGS, mark_rest=True).select("id", text("alignment").alias("alignment"))


_NAMED = CLUSTERS + """, ranked as (select *, row_number() over (order by -size, first, struct) as rank from sizes),
names as (select struct, consensus, size, rank, rank || '-' || size || '/' || consensus[1] as pattern_id from ranked),
labelled as (
    select c.id, c.cogid, c.lang, c.pos, c.sound, coalesce(n.pattern_id, '0/n') as pattern_id
    from cells c left join clustered s on s.cogid = c.cogid and s.pos = c.pos left join names n on n.struct = s.struct and n.consensus = s.consensus
)
"""


@query(_NAMED + "select id, string_agg(pattern_id, ' ' order by pos) as patterns from labelled group by id")
def words_with_patterns(spark, sf_dir):
    return clusters.add_patterns(morphemes(spark, sf_dir), _clustered(spark, sf_dir), LANGS).select("id", text("patterns").alias("patterns"))


@query(
    _NAMED + """, firsts as (select pattern_id, lang, arg_min(sound, (id, pos)) as sound from labelled where pattern_id <> '0/n' and sound <> 'Ø' group by all)
select pattern_id, string_agg(coalesce(f.sound, 'Ø'), ' ' order by l.lang) as pattern, any_value(n.sites)::bigint as sites
from (select pattern_id, count(distinct (cogid, pos)) as sites from labelled where pattern_id <> '0/n' group by all) n
cross join (select unnest(range(8)) as lang) l left join firsts f using (pattern_id, lang) group by pattern_id
"""
)
def loaded_patterns(spark, sf_dir):
    rows = clusters.add_patterns(morphemes(spark, sf_dir), _clustered(spark, sf_dir), LANGS)
    return clusters.load_patterns(rows, LANGS).select("pattern_id", text("pattern").alias("pattern"), "sites")


_SHOWN = ", ".join(f"shown[{i + 1}] as {t}" for i, t in enumerate(LANGS))


@query(
    _IRREGULAR + _NAMED.removeprefix(CLUSTERS) + f""", of as (
    select c.cogid, c.pos, c.struct, coalesce(r.consensus, c.consensus) as consensus, case when r.consensus is null then c.consensus
        else list_transform(range(1, 9), lambda j: case when r.consensus[j] <> c.consensus[j] and c.consensus[j] <> 'Ø' then r.consensus[j] || '/' || c.consensus[j] else c.consensus[j] end) end as shown
    from clustered c left join irregular r on r.cogid = c.cogid and r.pos = c.pos
), owners as (select consensus, arg_min(pattern_id, rank) as pattern_id from names group by consensus),
shown_rows as (select o.*, w.pattern_id from of o join owners w using (consensus)),
meanings as (
    select pattern_id, struct, shown, string_agg(distinct concept, ' / ' order by concept) as concepts
    from shown_rows r join (select distinct cogid, concept from words) m using (cogid) group by all
)
select split_part(pattern_id, '/', 1) as id, struct as structure, count(*)::bigint as frequency, {_SHOWN}, string_agg(cogid || ':' || pos, ', ' order by cogid, pos) as cognatesets, any_value(concepts) as concepts
from shown_rows join meanings using (pattern_id, struct, shown) group by pattern_id, struct, shown
"""
)
def table_of_patterns(spark, sf_dir):
    found = _clustered(spark, sf_dir)
    return clusters.pattern_table(morphemes(spark, sf_dir), found, LANGS, irregular=clusters.irregular_patterns(found))


_PREDICTED = _FITTING + """, votes as (
    select struct, pattern, j - 1 as lang, consensus[j] as sound, sum(size) as weight from heads_of, unnest(range(1, 9)) as t(j) where pattern[j] = 'Ø' and consensus[j] <> 'Ø' group by all
), shares as (
    select *, weight / sum(weight) over (partition by struct, pattern, lang) as share, row_number() over (partition by struct, pattern, lang order by weight desc, sound) as rank from votes
), best as (
    select struct, pattern, lang, sqrt(sum(share * share)) as purity, max(sound) filter (where rank = 1) as one,
        string_agg(sound, '|' order by rank) filter (where rank <= 2) as two, string_agg(sound, '|' order by rank) filter (where rank <= 3) as three
    from shares group by all
), absent as (select cogid, l.lang from clustered c cross join (select unnest(range(8)) as lang) l group by all having bool_and(c.pattern[l.lang + 1] = 'Ø')),
predicted as (
    select c.cogid, a.lang, 'L' || a.lang as doculect, string_agg(coalesce(b.one, 'Ø'), ' ' order by c.pos) as one, string_agg(coalesce(b.two, 'Ø'), ' ' order by c.pos) as two,
        string_agg(coalesce(b.three, 'Ø'), ' ' order by c.pos) as three, avg(coalesce(b.purity, 0.0)) as purity, bool_or(b.one is null) as unsure
    from clustered c join absent a using (cogid) left join best b on b.struct = c.struct and b.pattern = c.pattern and b.lang = a.lang group by all
)
"""


@query(_PREDICTED + "select cogid, doculect, three as word, round(purity, 9) as purity from predicted")
def predicted_words(spark, sf_dir):
    return clusters.predict_words(_clustered(spark, sf_dir), LANGS).select("cogid", "doculect", text("word").alias("word"), F.round("purity", 9).alias("purity"))


# The leave-out experiment as it was published: three quarters of the words go, two runs.


@query()
def leave_out_accuracy(spark, sf_dir):
    return leave_out(morphemes(spark, sf_dir), LANGS, 0.75, 2)


@query()
def leave_out_statistics(spark, sf_dir):
    return leave_out_summary(morphemes(spark, sf_dir), LANGS, 0.75, 2)


@query(
    _PREDICTED + """, about as (
    select cogid, string_agg(distinct concept, ' / ' order by concept) as concepts,
        array_to_string(list_sort(list(distinct doculect || ' ' || array_to_string(list_filter(string_split(form, ''), lambda x: x <> '-'), ' '))), ', ') as cognates
    from words group by cogid
)
select cogid, doculect, concepts, cognates, one as one_best, two as two_best, three as three_best, round(purity, 9) as purity, case when unsure then '?' else '' end as flag from predicted join about using (cogid)
"""
)
def reported_predictions(spark, sf_dir):
    return prediction_report(morphemes(spark, sf_dir), LANGS).withColumn("purity", F.round("purity", 9))


@query(CLUSTERS + "select struct, count(*) filter (where size > 1)::bigint as regular, count(*) filter (where size = 1)::bigint as singletons from sizes group by struct")
def patterns_by_structure(spark, sf_dir):
    return metrics.structure_summary(_clustered(spark, sf_dir))


@query(
    CLUSTERS + "select sum(size)::bigint as sites, count(*)::bigint as patterns, count(*) filter (where size = 1)::bigint as singletons, "
    "round((sum(size) - count(*) filter (where size = 1)) / sum(size)::double, 9) as coverage from sizes"
)
def dataset_summary(spark, sf_dir):
    return metrics.dataset_summary(_clustered(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


_REGULAR = """, best as (select s.cogid, s.pos, max(h.size) as n from sites s join heads_of h using (struct, pattern) group by all),
sets as (select cogid, avg((n >= 3)::int) as share from best group by cogid),
refs as (select cogid, max(refs) as refs from site_rows group by cogid)
select (select count(*) from sizes where size >= 3)::bigint as regular_patterns, (select count(*) from sizes)::bigint as patterns,
    (select sum(size) from sizes where size >= 3)::bigint as regular_sites, (select sum(size) from sizes)::bigint as sites,
    coalesce(sum(refs) filter (where share >= 0.75), 0)::bigint as regular_words, sum(refs)::bigint as words
from sets join refs using (cogid)
"""


@query(_FITTING + _REGULAR)
def regularity(spark, sf_dir):
    return metrics.regularity(_clustered(spark, sf_dir)).select("regular_patterns", "patterns", "regular_sites", "sites", "regular_words", "words")


@query(
    _PAIRS + ", sizes as (select struct, pattern as consensus, n as size from kinds), heads_of as (select p.struct, p.p as pattern, z.size from pairs p join sizes z on z.struct = p.struct and z.consensus = p.q)" + _REGULAR
)
def regularity_of_unclustered_sites(spark, sf_dir):
    """Each different pattern as a cluster of its own: many more heads than clustering leaves."""
    found = materialise(_sites(spark, sf_dir)).withColumn("consensus", F.col("pattern"))
    return metrics.regularity(found).select("regular_patterns", "patterns", "regular_sites", "sites", "regular_words", "words")


@query(
    CLUSTERS + """, filled as (select struct, consensus, count(*) as n, sum(f * (f - 1) / 2.0) as rp from (select *, len(list_filter(pattern, lambda x: x <> 'Ø')) as f from clustered) group by all),
cols as (select struct, consensus, i, count(*) filter (where pattern[i] <> 'Ø') as fill from clustered, unnest(range(1, 9)) as t(i) group by all),
scores as (
    select f.struct, f.consensus, max(f.n) as n, case when max(f.n) <= 1 then 0.0 else (max(f.rp) + sum(c.fill * (c.fill - 1) / 2.0)) / max(f.n) / count(*) filter (where c.fill > 0) / 8 end as score
    from filled f join cols c using (struct, consensus) group by f.struct, f.consensus
) select round(sum(n * score) / sum(n), 9) as score from scores
"""
)
def mean_site_score(spark, sf_dir):
    found = _clustered(spark, sf_dir)
    return clusters.mean_site_score(found, found).select(F.round("score", 9).alias("score"))


# Preparation, templates, trimming


@query("select id, replace(form, '-', '') as word from words where cogid in (select cogid from words group by cogid having count(*) >= 3)")
def prepared_words(spark, sf_dir):
    return prepare.prep_wordlist(words(spark, sf_dir), 3).select("id", F.array_join("tokens", "").alias("word"))


def _structures(model: str) -> Query:
    return lambda spark, sf_dir: prepare.add_structure(morphemes(spark, sf_dir).drop("structure"), model).select("id", F.array_join("structure", "").alias("structure"))


for _model in ("cv", "c", "CcV", "ps", "nogap"):
    QUERIES[f"structure_{_model.lower()}"] = _structures(_model)
ORACLES["structure_cv"] = f"with {SQL} select id, regexp_replace(regexp_replace(replace(form, '-', ''), '[^aeiouy]', 'c', 'g'), '[aeiouy]', 'v', 'g') as structure from words"
_SONORITY = "list_transform(string_split(replace(form, '-', ''), ''), lambda x: case when x in ('a','e','i','o','u','y') then 7 when x in ('j','w') then 5 when x in ('l','r') then 4 when x in ('m','n') then 3 when x in ('s','z','f','v','x','h') then 2 else 1 end)"
_SOUNDED = f"""with {SQL}, s as (select id, {_SONORITY} as s from words), around as (
    select id, list_transform(range(1, len(s) + 1), lambda i: {{'here': s[i], 'rising': coalesce(s[i + 1] >= s[i], false), 'first': i = 1, 'last': i = len(s)}}) as z from s
) select id, array_to_string(list_transform(z, lambda c: """
ORACLES["structure_ccv"] = _SOUNDED + "case when c.here = 7 then 'V' when c.rising or (c.first and not c.last) then 'C' else 'c' end), '') as structure from around"
ORACLES["structure_ps"] = (
    _SOUNDED + "case when c.here = 7 then case when c.first then 'X' when c.last then 'Z' else 'Y' end "
    "when c.rising and c.first then 'A' when c.rising then 'B' when c.last then 'N' when c.first then 'L' else 'M' end), '') as structure from around"
)
ORACLES["structure_nogap"] = f"""with {SQL}, n as (select cogid, pos, sound, count(*) as n from cells group by all),
modes as (select cogid, pos, arg_max(sound, (n, sound <> '-', sound)) as mode from n group by all), many as (select cogid from words group by cogid having count(*) >= 2)
select c.id, string_agg(case when m.cogid is null or o.mode <> '-' then 'c' else '-' end, '' order by c.pos) as structure
from cells c join modes o using (cogid, pos) left join many m using (cogid) where c.sound <> '-' group by c.id
"""
ORACLES["structure_c"] = f"with {SQL} select id, regexp_replace(replace(form, '-', ''), '.', 'c', 'g') as structure from words"


_KINDS = "list_transform(string_split(substr(word, 1, len(replace(form, '-', ''))), ''), lambda x: case when x in ('a','e','i','o','u') then 'v' else 'c' end)"


@query(
    f""", t as (select id, cogid, {_TOKENS} as w, {_KINDS} as k from words),
placed as (
    select id, cogid, i, w[i] as token, sum(case when i = 1 then case when k[1] = 'c' then 1 else 2 end when k[i] = k[i - 1] then 2 else 1 end) over (partition by id order by i) as place
    from t, unnest(range(1, len(w) + 1)) as u(i)
), used as (select distinct cogid, place from placed), ids as (select distinct id, cogid from placed)
select d.id, string_agg(coalesce(p.token, '-'), ' ' order by u.place) as alignment from ids d join used u using (cogid) left join placed p on p.id = d.id and p.place = u.place group by d.id
"""
)
def aligned_to_template(spark, sf_dir):
    return prepare.template_alignment(morphemes(spark, sf_dir).drop("alignment"), "cv" * 10 + "c").select("id", text("alignment").alias("alignment"))


@query(
    f""", t as (select id, {_TOKENS} as w, {_KINDS} as k from words), pairs as (select id, w, k, list_transform(range(1, len(w) + 1), lambda i: i < len(w) and k[i] = 'c' and k[i + 1] = 'v') as m from t),
steps as (select id, i, m[i] as merged, w[i] || case when m[i] then w[i + 1] else '' end as token, case when m[i] then 'S' when k[i] = 'c' then 'K' else k[i] end as kind from pairs, unnest(range(1, len(w) + 1)) as u(i) where m[i] or i = 1 or not m[i - 1])
select id, string_agg(token, ' ' order by i) as tokens, string_agg(kind, ' ' order by i) as structure from steps group by id
"""
)
def shrunk_words(spark, sf_dir):
    made = prepare.shrink_template(words(spark, sf_dir), {"c v": "S", "c": "K"})
    return made.select("id", text("tokens2").alias("tokens"), text("structure2").alias("structure"))


@query("select id, case when bool_and(form like '%-') over (partition by cogid) then substr(form, 1, length(form) - 1) else form end as alignment from words")
def shrunk_alignments(spark, sf_dir):
    return prepare.shrink_alignments(words(spark, sf_dir), ["cogid"]).select("id", F.array_join("alignment", "").alias("alignment"))


_SPACED = "array_to_string(string_split({}, ''), ' ')"


@query(
    f""", empty as (select cogid from words where lang <> 0 group by cogid having bool_and(form like '%-'))
select id, case when e.cogid is null then {_SPACED.format('form')} when form like '%-' then {_SPACED.format('substr(form, 1, len(form) - 1)')}
    else {_SPACED.format('substr(form, 1, len(form) - 1)')} || '.' || right(form, 1) end as alignment
from words left join empty e using (cogid)
"""
)
def ungapped(spark, sf_dir):
    return prepare.ungap(morphemes(spark, sf_dir), "L0").select("id", text("alignment").alias("alignment"))


@query(
    f"""select a.id as id_a, b.id as id_b, case when b.form like '%-' then {_SPACED.format('substr(a.form, 1, len(a.form) - 1)')} || '<' || right(a.form, 1) else {_SPACED.format('a.form')} end as a,
    {_SPACED.format("replace(b.form, '-', '')")} as b {_PAIRED}
"""
)
def gap_free_pairs(spark, sf_dir):
    w = words(spark, sf_dir)
    a, b = w.select("cogid", F.col("id").alias("id_a"), F.col("alignment").alias("a")), w.select("cogid", F.col("id").alias("id_b"), F.col("alignment").alias("b"))
    both = a.join(b, "cogid").where("id_a < id_b").withColumn("z", prepare.gap_free_pairwise(F.col("a"), F.col("b")))
    return both.select("id_a", "id_b", text("z.a").alias("a"), text("z.b").alias("b"))


@query("select cogid, pos, round(avg((sound = '-')::int), 9) as ratio from cells group by cogid, pos")
def gap_ratios(spark, sf_dir):
    return trimming.site_table(morphemes(spark, sf_dir)).select("cogid", F.col("pos").cast("long").alias("pos"), F.round("ratio", 9).alias("ratio"))


#: Only last columns have gaps here. One goes if a quarter of it are gaps and the classes before it still hold CV or VC, or if
#: it holds nothing else.
_LETTERS = "case when arg_min(sound, id) filter (where sound <> '-') is null then '+' when arg_min(sound, id) filter (where sound <> '-') in ('a','e','i','o','u','y') then 'V' else 'C' end"
_TRIMMED = f""", columns as (select cogid, pos, avg((sound = '-')::int) as ratio, {_LETTERS} as class from cells group by all),
whole as (
    select cogid, max(pos) as last, arg_max(ratio, pos) as ratio, arg_max(class, pos) as class, string_agg(class, '' order by pos) as skeleton from columns group by cogid
), cut as (
    select cogid, class = '+' or (ratio >= 0.25 and (regexp_matches(left(skeleton, last::int), 'C.*V') or regexp_matches(left(skeleton, last::int), 'V.*C'))) as gone from whole
)
select id, {_SPACED.format('case when gone then substr(form, 1, len(form) - 1) else form end')} as alignment from words join cut using (cogid)
"""


@query(_TRIMMED)
def trimmed_gaps(spark, sf_dir):
    return trimming.trim(morphemes(spark, sf_dir), threshold=0.25).select("id", text("alignment").alias("alignment"))


@query(_TRIMMED)
def trimmed_core(spark, sf_dir):
    return trimming.trim(morphemes(spark, sf_dir), "core-oriented", 0.25).select("id", text("alignment").alias("alignment"))


_LAID = "array_to_string(list_transform(kept, lambda p: form[p + 1]), ' ')"


@query(
    _TRIMMED[: _TRIMMED.index("select id, array_to_string")] + f""", left_over as (select c.cogid, c.pos, c.class from columns c join whole w using (cogid) join cut using (cogid) where not (gone and c.pos = w.last)),
quota as (select cogid, class, count(*) as quota from left_over group by all),
drawn as (select *, row_number() over (partition by cogid, class order by md5('0 ' || cogid || ' ' || pos), pos) as rank from columns),
chosen as (select d.cogid, list(d.pos order by d.pos) as kept from drawn d join quota q using (cogid, class) where d.rank <= q.quota group by d.cogid)
select id, {_LAID} as alignment from words join chosen using (cogid)
"""
)
def trimmed_at_random(spark, sf_dir):
    return trimming.trim_random(morphemes(spark, sf_dir), threshold=0.25).select("id", text("alignment").alias("alignment"))


@query(
    f""", columns as (select cogid, pos, {_LETTERS} as class from cells group by all), whole as (select cogid, string_agg(class, '' order by pos) as skeleton from columns group by cogid),
many as (select cogid from words group by cogid having count(*) > 1)
select id, regexp_replace(regexp_replace(replace(form, '-', ''), '[^aeiouy]', 'C', 'g'), '[aeiouy]', 'V', 'g') as structure
from words join many using (cogid) join whole using (cogid) where regexp_matches(skeleton, 'C.*V') or regexp_matches(skeleton, 'V.*C')
"""
)
def aligned_with_syllables(spark, sf_dir):
    return prepare.prep_alignments(morphemes(spark, sf_dir)).select("id", F.array_join("structure", "").alias("structure"))


# Cognates and borrowings


@query(
    """, long as (select id, concept, m, case m when 0 then cogid % 1009 else 10000000 + cogid % 7 end as cogid from words, unnest(range(2)) as t(m)),
counts as (select concept, cogid, count(*) as n, min((id, m)) as first from long group by all),
ranked as (select *, row_number() over (partition by concept order by n desc, first) as rank from counts),
before as (select concept, coalesce(sum(count(*)) over (order by concept rows between unbounded preceding and 1 preceding), 0) as b from counts group by concept)
select id, (min(rank) + max(b))::bigint as autoid from long join ranked using (concept, cogid) join before using (concept) group by id
"""
)
def common_morphemes(spark, sf_dir):
    return cognates.common_morpheme_cognates(partial(spark, sf_dir)).select("id", F.col("autoid").cast("long").alias("autoid"))


@query(
    """, keyed as (select id, case when cogid % 3 = 0 then (cogid % 1009)::varchar else (cogid % 1009) || ' ' || (10000000 + cogid % 7) end as k from words),
firsts as (select k, row_number() over (order by min(id)) as n from keyed group by k)
select id, n::bigint as newcogid from keyed join firsts using (k)
"""
)
def salient_cognates(spark, sf_dir):
    return cognates.salient_cognates(partial(spark, sf_dir)).select("id", F.col("newcogid").cast("long").alias("newcogid"))


def _merged_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived words in fewer cognate sets, so that a doculect has several words in one."""
    return morphemes(spark, sf_dir).withColumn("cogid", F.col("cogid") % 211)


@query(
    """, m as (select id, doculect, cogid % 211 as cogid, form from words),
kinds as (select cogid, doculect, form, count(*) as n, min(id) as first from m group by all),
best as (select cogid, doculect, arg_max(form, (n, -first)) as form, count(*) as k from kinds group by all),
wrong as (select m.cogid, m.id, row_number() over (order by m.cogid, m.id) as step from m join best b using (cogid, doculect) where b.k > 1 and m.form <> b.form)
select m.id, coalesce((select max(cogid) from m) + w.step, m.cogid)::bigint as cogid from m left join wrong w using (id)
"""
)
def inconsistent_words(spark, sf_dir):
    return cognates.bad_internal_alignments(_merged_sets(spark, sf_dir)).select("id", F.col("cogid").cast("long").alias("cogid"))


@query()
def colexified_sets(spark, sf_dir):
    return cognates.colexified(morphemes(spark, sf_dir), LANGS).select("id", "crossid")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cognates are found from, written down once: the derived words without alignments and structures."""
    return stored(words(spark, sf_dir).select("id", "doculect", "concept", "family", "tokens"), "words")


@query()
def internal_cognates(spark, sf_dir):
    return borrowing.internal_cognates(_written(spark, sf_dir), "lexstat").select("id", "autocogid")


@query()
def borrowed_sets(spark, sf_dir):
    return borrowing.external_cognates(stored(borrowing.internal_cognates(_written(spark, sf_dir), "sca"), "cognates")).select("id", "autocogid", "autoborid")


_BCUBED = """, x as (select concept, cogid as a, word as b from words), ab as (select concept, a, b, count(*) as n from x group by all),
na as (select concept, a, sum(n) as na from ab group by all), nb as (select concept, b, sum(n) as nb from ab group by all)
select concept, round(sum(n * n / na::double) / sum(n), 9) as precision, round(sum(n * n / nb::double) / sum(n), 9) as recall
from ab join na using (concept, a) join nb using (concept, b) group by concept
"""


@query(_BCUBED)
def compared_cognates(spark, sf_dir):
    found = metrics.compare_cognate_sets(words(spark, sf_dir), "cogid", "word")
    return found.select("concept", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(
    """, long as (
    select id, doculect, concept, cogid % 1009 as cogid from words union all
    select id, doculect, concept, 10000000 + cogid % 7 from words where cogid % 3 <> 0
), spread as (select doculect, cogid, count(distinct concept) - 1 as others from long group by all),
per as (select concept, id, avg(others) as score from long join spread using (doculect, cogid) group by all)
select concept, round(avg(score), 9) as score from per group by concept
"""
)
def cross_semantic_statistics(spark, sf_dir):
    return metrics.cross_semantic_statistics(partial(spark, sf_dir)).select("concept", F.round("score", 9).alias("score"))


@query("select doculect, count(distinct concept)::bigint as concepts from words group by doculect")
def coverage(spark, sf_dir):
    return metrics.coverage(words(spark, sf_dir))


@query("select doculect, count(distinct sound)::bigint as sounds from cells where sound <> '-' group by doculect")
def alphabets(spark, sf_dir):
    return metrics.alphabet(words(spark, sf_dir))


# Reconstruction


@query()
def reconstructed_words(spark, sf_dir):
    return reconstruct.reconstruct(morphemes(spark, sf_dir), LANGS[1:], "L0").select("cogid", text("word").alias("word"))


@query()
def fuzzy_reconstructions(spark, sf_dir):
    return reconstruct.fuzzy_reconstruct(morphemes(spark, sf_dir), LANGS[1:], "L0")


@query()
def reconstructions_by_split(spark, sf_dir):
    return reconstruct.fuzzy_reconstruct(morphemes(spark, sf_dir), LANGS[1:], "L0", output="words").select("cogid", "split", text("word").alias("word"))


@query()
def feature_matrix(spark, sf_dir):
    rows = reconstruct.training_rows(morphemes(spark, sf_dir), LANGS[1:], "L0", position=True, startend=True, prosodic=True, firstlast=True)
    return rows.select("cogid", "pos", text("row").alias("row"), "target")


@query(
    """, seen as (select i, list(distinct pattern[i] order by pattern[i]) as held from sites, unnest(range(1, 9)) as t(i) group by i)
select cogid, pos, string_agg(array_to_string(list_transform(held, lambda v: case when v = pattern[i] then '1' else '0' end), '') || '0', '' order by i) as onehot from sites join seen on true group by cogid, pos
"""
)
def one_hot_rows(spark, sf_dir):
    rows = _sites(spark, sf_dir).withColumnRenamed("pattern", "row")
    return reconstruct.one_hot(rows, 8).select("cogid", F.col("pos").cast("long").alias("pos"), F.array_join(F.col("onehot").cast("array<string>"), "").alias("onehot"))


@query(
    """, counted as (select cogid, pos, sound as x, count(*) as c, sum(count(*)) over (partition by cogid, pos) as m from cells group by cogid, pos, sound),
slots as (select *, floor(c / (m / 5.0::double) + 0.5)::bigint as s from counted),
filled as (select cogid, pos, flatten(list(list_transform(range(s), lambda k: x) order by -s, x) filter (where s > 0)) as f from slots group by all),
five as (select cogid, pos, case when len(coalesce(f, [])) = 0 then ['Ø', 'Ø', 'Ø', 'Ø', 'Ø'] else list_slice(flatten([f, f, f, f, f]), 1, 5) end as f from filled),
tiles as (
    select cogid, pos, array_to_string(list_transform(list_sort(list_transform(f, lambda y, i: {'c': -len(list_filter(f, lambda z: z = y)), 'i': i, 's': y})), lambda q: q.s), '|') as t
    from five where len(list_filter(f, lambda z: z = '-')) <> 4
), joined as (select cogid, string_agg(t, ' ' order by pos) as t from tiles group by cogid), sets as (select cogid, count(*) as n, any_value(form) as form from words group by cogid)
select cogid, case when n = 1 then array_to_string(string_split(replace(form, '-', ''), ''), ' ') else coalesce(t, '') end as ntile from sets left join joined using (cogid)
"""
)
def ntiles(spark, sf_dir):
    return reconstruct.ntile(words(spark, sf_dir), ["cogid"], 5)


def _word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    return w.where("lang = 0").select("cogid", F.col("tokens").alias("attested")).join(w.where("lang = 1").select("cogid", F.col("tokens").alias("predicted")), "cogid")


@query("select round(avg(levenshtein(replace(a.form, '-', ''), replace(b.form, '-', ''))), 9) as distance from words a join words b on a.cogid = b.cogid and a.lang = 0 and b.lang = 1")
def mean_edit_distance(spark, sf_dir):
    return reconstruct.mean_distance(_word_pairs(spark, sf_dir)).select(F.round("distance", 9).alias("distance"))


@query()
def bcubed_of_sounds(spark, sf_dir):
    return reconstruct.bcubed_f(_word_pairs(spark, sf_dir))
