"""Registered queries of the prose engine and their form in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import engine_queries
from .operators import native as N
from .plans import engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TERMS = [("the of", "W#a"), ("of the", "W#b"), ("and the", "W#c"), ("the", "W#d"), ("in", "W#e"), ("de la", "W#f")]
PATTERNS = [("[0-9]{3}-[0-9]{4}", "P1#tail", 2), ("[0-9]{3}-[0-9]{4}", "P2#tail", 3), ("@[a-z]+", "P3#at", 1)]
CLUSTER = [("the", 0), ("of", 1), ("and", 2), ("that", 3), ("with", 4), ("from", 5)]
METRICS = [("M1", "dash_rate", "gt", 0.5), ("M2", "bold", "gt", 3.0), ("M3", "words", "lt", 40.0), ("M4", "exclaims", "gt", 1.0)]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def values(rows: list[tuple]) -> str:
    quoted = [", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) for r in rows]
    return "(values " + ", ".join(f"({r})" for r in quoted) + ")"


#: Pieces of SQL that several oracles share.
W_SQL = r"len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]')))"
RUNS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
UNITS_SQL = r"select doc_id, idx, trim(unit) as unit from (select doc_id, unnest(u) as unit, unnest(range(0, len(u))) as idx from (select doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*') as u from documents)) where regexp_matches(unit, '[\p{L}\p{N}]')"
DASH_SQL = "(length(text) - length(replace(text, '—', '')))"
BOLD_SQL = r"len(regexp_extract_all(text, '(?s)\*\*.*?\*\*'))"
HITS_SQL = f"""
    with t(term, entry_id) as {values(TERMS)},
    w as (select doc_id, {RUNS_SQL} as w from documents),
    g as (select doc_id, i as idx, n, array_to_string(list_slice(w, i + 1, i + n), ' ') as term
          from (select doc_id, w, unnest(range(0, len(w))) as i from w), (values (1), (2)) k(n) where i + n <= len(w)),
    h as (select g.*, entry_id from g join t using (term)),
    b as (select *, max(n) over (partition by doc_id, idx) as most from h)
    select doc_id, idx, cast(n as bigint) as n, term, entry_id from b where n = most"""


@query(f"select doc_id, cast({W_SQL} as bigint) as words from documents")
def doc_word_count(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", N.word_count(F.col("text")).cast("long").alias("words"))


@query(f"select doc_id, case when {W_SQL} >= 250 then round({DASH_SQL} * 1000.0 / greatest({W_SQL}, 1), 6) end as rate from documents")
def doc_em_dash_rate(spark, sf_dir):
    t = F.col("text")
    return docs_of(spark, sf_dir).select("doc_id", N.floored(F.round(N.em_dash_rate(t), 6), N.word_count(t), 250).alias("rate"))


@query("""with c as (select doc_id, length(text) - length(replace(replace(text, '“', ''), '”', '')) as curly, length(text) - length(replace(text, '"', '')) as straight from documents)
select doc_id, case when curly + straight >= 20 then round(curly * 1.0 / (curly + straight), 6) else 0.0 end as ratio from c""")
def doc_curly_ratio(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.round(N.curly_ratio(F.col("text")), 6).alias("ratio"))


@query(f"select doc_id, round({BOLD_SQL} * 100.0 / greatest({W_SQL}, 1), 6) as density from documents")
def doc_bold_density(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.round(N.bold_density(F.col("text")), 6).alias("density"))


def wide(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.select("doc_id", N.word_count(t).cast("double").alias("words"), F.round(N.em_dash_rate(t), 6).alias("dash_rate"), F.round(N.bold_density(t), 6).alias("bold"), F.round(N.count_of(t, "!") * 1000.0 / F.greatest(F.size(F.split(F.trim(t), N.SPACES)), F.lit(1)), 6).alias("exclaims"))


WIDE_SQL = rf"select doc_id, cast({W_SQL} as double) as words, round({DASH_SQL} * 1000.0 / greatest({W_SQL}, 1), 6) as dash_rate, round({BOLD_SQL} * 100.0 / greatest({W_SQL}, 1), 6) as bold, round((length(text) - length(replace(text, '!', ''))) * 1000.0 / greatest(len(string_split_regex(trim(text), '[ \t\n\r]+')), 1), 6) as exclaims from documents"


@query(WIDE_SQL)
def doc_stats_wide(spark, sf_dir):
    return wide(docs_of(spark, sf_dir))


def fired(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    """Statistics by rules: the rules are few and broadcast."""
    long = wide(docs_of(spark, sf_dir)).unpivot("doc_id", ["words", "dash_rate", "bold", "exclaims"], "stat", "value")
    rules = N.small(spark, METRICS, "rule_id string, stat string, direction string, cutoff double")
    hit = F.when(F.col("direction") == "gt", F.col("value") > F.col("cutoff")).otherwise(F.col("value") < F.col("cutoff"))
    return long.join(F.broadcast(rules), "stat").where(hit & (F.col("direction") == direction)).select("doc_id", "rule_id", "stat", "value")


def fired_sql(direction: str) -> str:
    hit = "value > cutoff" if direction == "gt" else "value < cutoff"
    return f"with w as ({WIDE_SQL}), l as (unpivot w on words, dash_rate, bold, exclaims into name stat value value), r(rule_id, stat, direction, cutoff) as {values(METRICS)} select doc_id, rule_id, l.stat, value from l join r on l.stat = r.stat where direction = '{direction}' and {hit}"


@query(fired_sql("gt"))
def metric_findings_gt(spark, sf_dir):
    return fired(spark, sf_dir, "gt")


@query(fired_sql("lt"))
def metric_findings_lt(spark, sf_dir):
    return fired(spark, sf_dir, "lt")


@query(f"select {W_SQL} >= 250 as judged, count(*) as docs from documents group by 1")
def metric_floor_nulls(spark, sf_dir):
    return docs_of(spark, sf_dir).select((N.word_count(F.col("text")) >= 250).alias("judged")).groupBy("judged").agg(F.count("*").alias("docs"))


@query(f"select doc_id, cast(len(w) as bigint) as tokens, cast(len(list_distinct(w)) as bigint) as kinds from (select doc_id, {RUNS_SQL} as w from documents)")
def token_explode(spark, sf_dir):
    w = N.runs(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("tokens"), F.size(F.array_distinct(w)).cast("long").alias("kinds"))


@query(rf"select doc_id, cast(i - 1 as bigint) as idx, w[i] as token from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from (select doc_id, {RUNS_SQL} as w from documents))")
def token_positions(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select("doc_id", F.posexplode(N.runs(F.col("text"))).alias("idx", "token"))
    return rows.withColumn("idx", F.col("idx").cast("long"))


def word_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.vocab_hits(docs_of(spark, sf_dir), N.small(spark, TERMS, "term string, entry_id string"), 2)


@query(f"with t(term) as {values([('that',), ('with',), ('from',)])} select doc_id, term, count(*) as hits from (select doc_id, unnest({RUNS_SQL}) as term from documents) join t using (term) group by all")
def vocab_single(spark, sf_dir):
    terms = N.small(spark, [("that",), ("with",), ("from",)], "term string")
    return N.token_rows(docs_of(spark, sf_dir)).withColumnRenamed("token", "term").join(F.broadcast(terms), "term").groupBy("doc_id", "term").agg(F.count("*").alias("hits"))


@query(HITS_SQL)
def vocab_phrase_longest(spark, sf_dir):
    return word_hits(spark, sf_dir)


@query(r"select doc_id, cast(len(m) as bigint) as hits, m[1] as first from (select doc_id, regexp_extract_all(text, '(?i)cc by-nc [0-9]+') as m from documents) where len(m) > 0")
def literal_digits(spark, sf_dir):
    m = F.regexp_extract_all("text", F.lit("(?i)cc by-nc [0-9]+"), F.lit(0))
    return docs_of(spark, sf_dir).select("doc_id", m.alias("m")).where(F.size("m") > 0).select("doc_id", F.size("m").cast("long").alias("hits"), F.element_at("m", 1).alias("first"))


@query(r"""with m as (select doc_id, text, regexp_extract_all(text, '[0-9]{3}-[0-9]{4}') as m, string_split_regex(text, '[0-9]{3}-[0-9]{4}') as g from documents)
select doc_id, cast(k - 1 as bigint) as k, cast(list_sum(list_transform(list_slice(g, 1, k), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, k - 1), lambda x: length(x))), 0) as bigint) as start, m[k] as matched from (select *, unnest(range(1, len(m) + 1)) as k from m)""")
def pattern_spans(spark, sf_dir):
    return N.spans(docs_of(spark, sf_dir), "[0-9]{3}-[0-9]{4}")


@query(r"select doc_id, regexp_extract(text, '\(([0-9]{3})\) [0-9]{3}-[0-9]{4}', 1) as area from documents where regexp_matches(text, '\([0-9]{3}\) [0-9]{3}-[0-9]{4}')")
def pattern_named_capture(spark, sf_dir):
    p = "\\((?<area>[0-9]{3})\\) [0-9]{3}-[0-9]{4}"
    return docs_of(spark, sf_dir).where(F.col("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 1).alias("area"))


@query(f"with o(regex, entry_id, tier) as {values(PATTERNS)} select doc_id, entry_id, tier, count(*) as hits from (select doc_id, regex, unnest(regexp_extract_all(text, regex)) as m from documents, (select distinct regex from o)) join o using (regex) group by all")
def pattern_owner_fanout(spark, sf_dir):
    """Each distinct pattern runs once over the documents; its owners join its hits."""
    owners = N.small(spark, PATTERNS, "regex string, entry_id string, tier int")
    found = F.array(*[F.struct(F.lit(p).alias("regex"), F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long").alias("hits")) for p in dict.fromkeys(p for p, _, _ in PATTERNS)])
    rows = docs_of(spark, sf_dir).select("doc_id", F.inline(found)).where("hits > 0")
    return rows.join(F.broadcast(owners), "regex").select("doc_id", "entry_id", "tier", "hits")


def clustered(docs: DataFrame, spark: SparkSession, keys: list[str]) -> DataFrame:
    lemmas = N.small(spark, CLUSTER, "token string, lemma int")
    return docs.join(F.broadcast(lemmas), "token").groupBy(*keys).agg(F.countDistinct("lemma").alias("distinct_terms")).where("distinct_terms > 3")


CLUSTER_SQL = f"with t(token, lemma) as {values(CLUSTER)}"


@query(f"{CLUSTER_SQL} select doc_id, count(distinct lemma) as distinct_terms from (select doc_id, unnest({RUNS_SQL}) as token from documents) join t using (token) group by all having count(distinct lemma) > 3")
def cluster_document(spark, sf_dir):
    return clustered(N.token_rows(docs_of(spark, sf_dir)), spark, ["doc_id"])


@query(rf"""with u as ({UNITS_SQL}), f as (select doc_id, idx, regexp_matches(unit, '\b[a-z]+, [a-z]+, and [a-z]+\b') as f, row_number() over (partition by doc_id order by idx) as r from u),
i as (select doc_id, r - row_number() over (partition by doc_id order by idx) as i from f where f) select doc_id, max(n) as streak from (select doc_id, i, count(*) as n from i group by all) group by doc_id""")
def tricolon_streak(spark, sf_dir):
    return N.streak(N.units(docs_of(spark, sf_dir)), "doc_id", "idx", F.col("unit").rlike(N.TRICOLON))


@query(rf"""with u as ({UNITS_SQL}), o as (select doc_id, idx, case when len(w) >= 2 then w[1] || ' ' || w[2] end as o from (select doc_id, idx, string_split_regex(lower(unit), '[ \t\n\r]+') as w from u)),
l as (select *, row_number() over (partition by doc_id order by idx) as r, coalesce(o = lag(o) over (partition by doc_id order by idx), false) as same from o),
g as (select *, sum(case when same then 0 else 1 end) over (partition by doc_id order by idx rows unbounded preceding) as g from l)
select doc_id, max(n) as streak from (select doc_id, g, count(o) as n from g group by all) group by doc_id""")
def opener_streak(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("idx")
    head = F.split(F.lower("unit"), N.SPACES)
    rows = N.units(docs_of(spark, sf_dir)).select("doc_id", "idx", F.when(F.size(head) >= 2, F.concat_ws(" ", head[0], head[1])).alias("o"))
    rows = rows.withColumn("same", F.coalesce(F.col("o") == F.lag("o").over(w), F.lit(False)))
    rows = rows.withColumn("g", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "g").agg(F.count("o").alias("n")).groupBy("doc_id").agg(F.max("n").alias("streak"))


@query(rf"with u as ({UNITS_SQL}) select doc_id, round(stddev_pop(n) / avg(n), 6) as cv, count(*) as sentences from (select doc_id, cast(len(list_filter(string_split_regex(unit, '[ \t\n\r]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))) as double) as n from u) group by doc_id having count(*) >= 6")
def sent_len_cv(spark, sf_dir):
    rows = N.units(docs_of(spark, sf_dir)).select("doc_id", N.word_count(F.col("unit")).cast("double").alias("n"))
    return rows.groupBy("doc_id").agg(F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("cv"), F.count("*").alias("sentences")).where("sentences >= 6")


SHINGLES_SQL = rf"select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - (case when len(w) >= 8 then 8 else 4 end) + 2), lambda i: array_to_string(list_slice(w, i, i + (case when len(w) >= 8 then 8 else 4 end) - 1), ' '))) else [] end as s from (select doc_id, {RUNS_SQL} as w from documents)"


@query(f"select doc_id, cast(len(s) as bigint) as shingles from ({SHINGLES_SQL})")
def shingles(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", N.runs(F.col("text")).alias("w")).select("doc_id", F.size(N.shingles(F.col("w"))).cast("long").alias("shingles"))


LEVELS = {"W": "note", "W#a": "error", "W#f": "allow"}


@query(f"with h as ({HITS_SQL}), l(id, level) as {values(list(LEVELS.items()))} select entry_id, coalesce(a.level, b.level) as level, count(*) as hits from h left join l a on a.id = entry_id left join l b on b.id = split_part(entry_id, '#', 1) where coalesce(a.level, b.level) <> 'allow' group by all")
def level_resolution(spark, sf_dir):
    levels = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    level = F.coalesce(levels[F.col("entry_id")], levels[F.split("entry_id", "#")[0]])
    return word_hits(spark, sf_dir).select("entry_id", level.alias("level")).where("level <> 'allow'").groupBy("entry_id", "level").agg(F.count("*").alias("hits"))


@query(f"with h as ({HITS_SQL}) select doc_id, idx, entry_id, row_number() over (partition by doc_id order by idx, n, entry_id) as place from h")
def findings_sorted(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("idx", "n", "entry_id")
    return word_hits(spark, sf_dir).select("doc_id", "idx", "entry_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"with h as ({HITS_SQL}) select case entry_id when 'W#a' then 1 when 'W#d' then 3 else 2 end as tier, count(*) as n from h group by all")
def tier_tally(spark, sf_dir):
    tier = F.when(F.col("entry_id") == "W#a", 1).when(F.col("entry_id") == "W#d", 3).otherwise(2)
    return engine.tier_tally(word_hits(spark, sf_dir).withColumn("tier", tier))


@query(f"""with h as ({HITS_SQL}), f as (select doc_id, idx, idx as start, idx + n as e, entry_id from h)
select doc_id, start, entry_id from f where not exists (select 1 from f o where o.doc_id = f.doc_id and o.idx <> f.idx and o.start < f.e and f.start < o.e)""")
def fix_overlap_antijoin(spark, sf_dir):
    found = word_hits(spark, sf_dir).select("doc_id", F.col("idx").alias("fid"), F.col("idx").alias("start"), (F.col("idx") + F.col("n")).alias("end"), "entry_id")
    return N.without_overlaps(found).select("doc_id", "start", "entry_id")


@query(f"""with h as ({HITS_SQL}) select '{{"doc_id":' || doc_id || ',"idx":' || idx || ',"entry_id":"' || entry_id || '","replacement":null}}' as json from h""")
def json_lines(spark, sf_dir):
    return word_hits(spark, sf_dir).select(F.to_json(F.struct("doc_id", "idx", "entry_id", F.lit(None).cast("string").alias("replacement")), {"ignoreNullFields": "false"}).alias("json"))


@query(f"with h as ({HITS_SQL}) select '::warning file=' || doc_id || ',title=' || replace(entry_id, '#', '%23') || '::' || replace(term, ' ', '%20') as line from h")
def github_lines(spark, sf_dir):
    return word_hits(spark, sf_dir).select(F.concat(F.lit("::warning file="), "doc_id", F.lit(",title="), F.replace("entry_id", F.lit("#"), F.lit("%23")), F.lit("::"), F.replace("term", F.lit(" "), F.lit("%20"))).alias("line"))


@query(f"with h as ({HITS_SQL}) select count(*) > 0 as blocking from h where entry_id <> 'W#d'")
def blocking_exit(spark, sf_dir):
    return word_hits(spark, sf_dir).where("entry_id <> 'W#d'").agg((F.count("*") > 0).alias("blocking"))


@query(r"select doc_id, case when length(t) > 80 then left(t, 80) || '…' else t end as excerpt from (select doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) as t from documents)")
def member_excerpt(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", N.member_excerpt(F.col("text")).alias("excerpt"))




QUERIES |= engine_queries.QUERIES
ORACLE_SQL |= engine_queries.ORACLE_SQL
