"""Demand mining over the event log as question log and the conversations as question texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import demand as D
from plumbline.queries.base import query
from plumbline.queries.semantic import RETRIEVAL, part_elements, part_questions
from plumbline.session import settle
from plumbline.sources.testtables import questions, spoken, table, users

# Glossary over the conversations' vocabulary: (phrase, concept). Phrases overlap on purpose.
GLOSSARY = [
    ("of the", "relation"), ("in the", "place"), ("the", "article"), ("of", "link"), ("that", "pointer"), ("this", "pointer"),
    ("de la", "relation"), ("dans", "place"), ("la", "article"), ("le", "article"), ("que", "pointer"),
    ("von der", "relation"), ("im", "place"), ("der", "article"), ("die", "article"), ("mit", "link"),
]
ENTITIES = {"colon": ["es", "las"], "conjunction": ["und", "et", "and"]}

PENDING = (
    "outcome in ('missing_data', 'low_confidence', 'abandoned') and intent_id is null and resolved_by_product is null"
)


@query("dem_pending", f"select question_id, asked_by, asked_at, outcome, topic from questions where {PENDING}")
def _(spark, d):
    return D.pending(questions(spark, d)).select("question_id", "asked_by", "asked_at", "outcome", "topic")


def _concept_frames():
    """One blanking step per phrase, longest first, in DuckDB."""
    frames = {"s0": "select question_id, lower(text) as rest from spoken"}
    ordered = sorted(GLOSSARY, key=lambda g: (-len(g[0]), g[0]))
    names = []
    for i, (p, _) in enumerate(ordered, 1):
        hit = f"(^|[^a-z0-9]){p}([^a-z0-9]|$)"
        once = f"regexp_replace(rest, '{hit}', '\\1#\\2', 'g')"
        names.append(f"f{i}")
        keep = "".join(f", {n}" for n in names[:-1])
        frames[f"s{i}"] = (
            f"select question_id, regexp_replace({once}, '{hit}', '\\1#\\2', 'g') as rest{keep}, regexp_matches(rest, '{hit}') as f{i}"
            f" from s{i - 1}"
        )
    last = f"s{len(ordered)}"
    frames["found"] = " union ".join(f"select question_id, '{c}' as concept from {last} where f{i}" for i, (_, c) in enumerate(ordered, 1))
    return frames


CONCEPTS = _concept_frames()


def asked_terms(spark, d):
    return spoken(spark, d).select("question_id", D.intent_terms(F.col("text"), GLOSSARY, ENTITIES).alias("terms"))


@query("dem_concepts", "select question_id, concept from found", extra=CONCEPTS)
def _(spark, d):
    from plumbline.functions.text import find_concepts

    return spoken(spark, d).select("question_id", F.explode(find_concepts(F.col("text"), GLOSSARY)).alias("concept"))


TERMS = {
    **CONCEPTS,
    "named": " union all ".join(
        f"select question_id, 'entity_{n}' as term from spoken where "
        + " or ".join(f"contains(' ' || lower(text) || ' ', ' {p} ')" for p in phrases)
        for n, phrases in ENTITIES.items()
    ),
    "qterms": "select question_id, 'concept_' || concept as term from found union all select question_id, term from named where question_id"
    " not in (select question_id from found) union all select distinct question_id, term from (select question_id,"
    " unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) as term from spoken where question_id not in"
    " (select question_id from found) and question_id not in (select question_id from named)) where term <> ''",
}


@query(
    "dem_intent_terms",
    "select question_id, string_agg(term, ' ' order by encode(term)) as terms from qterms group by 1",
    extra=TERMS,
)
def _(spark, d):
    return asked_terms(spark, d).select("question_id", F.concat_ws(" ", "terms").alias("terms"))


@query("dem_cluster")
def _(spark, d):
    """Average-linkage clusters of all spoken questions; checked against a direct computation in the tests."""
    return D.cluster(settle(asked_terms(spark, d), "terms"))


ATTACH = {
    **TERMS,
    "itf": "select 'i' || (question_id // 1000 % 10) as doc, term, count(*)::double as tf from qterms where question_id % 1000 <= 1 group by 1, 2",
    "qtf": "select 'q' || question_id as doc, term, 1.0::double as tf from qterms where question_id % 1000 > 1",
    "tf": "select * from itf union all select * from qtf",
    "ndocs": "select count(distinct doc)::double as n from tf",
    "dft": "select term, count(*)::double as df from tf group by 1",
    "wt": "select doc, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join dft on dft.term = tf.term cross join ndocs",
    "unit": "select wt.doc, term, w / len as w from wt join (select doc, sqrt(sum(w * w)) as len from wt group by 1) l on l.doc = wt.doc",
    "nearest": "select *, row_number() over (partition by q order by round(s, 12) desc, i) as rn from (select substr(a.doc, 2)::bigint as q,"
    " substr(b.doc, 2)::bigint as i, sum(a.w * b.w) as s from unit a join unit b on b.term = a.term where a.doc like 'q%' and b.doc like 'i%'"
    " group by 1, 2)",
}


@query(
    "dem_attach",
    "select q as question_id, i as intent_id, round(s, 4) as similarity from nearest where rn = 1 and 1 - s <= 0.45 + 1e-12",
    extra=ATTACH,
)
def _(spark, d):
    """Opening questions form ten intents; later questions join the nearest close one."""
    terms = settle(asked_terms(spark, d), "terms")
    turn = F.col("question_id") % 1000
    conv = F.expr("question_id div 1000")
    opening = terms.where(turn <= 1).select((conv % 10).alias("intent_id"), "question_id", "terms")
    return D.attach(terms.where(turn > 1), opening)


# Coverage of the event kinds by products, and what they derive from.
COVERAGE = [("view", "p1"), ("click", "p1"), ("click", "p2"), ("purchase", "p2")]
DERIVED = [("error", "view")]
COLUMNS = [("signup",)]


def _pairs_sql(rows):
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


GAP = {
    "ic": "select distinct user_id || '/' || ts::date as intent_id, case when value > 300 then 'large' else event_type end as concept from events",
    "cov": f"select * from (values {_pairs_sql(COVERAGE)}) v(concept, product)",
    "reached": "select concept from cov union select 'error'",
    "sizes": "select intent_id, count(*) as n from ic group by 1",
    "shared": "select distinct p.intent_id from (select intent_id, product, count(*) as n from ic join cov on cov.concept = ic.concept"
    " group by 1, 2) p join sizes s on s.intent_id = p.intent_id and s.n = p.n",
}


@query(
    "dem_gap",
    "select intent_id, case when intent_id in (select intent_id from shared) then 'missing_grain' when bool_and(concept in"
    " (select concept from reached)) then 'missing_join_path' when bool_or(concept = 'signup') then 'missing_attribute' else"
    " 'missing_domain' end as gap from ic group by 1",
    extra=GAP,
)
def _(spark, d):
    concept = F.when(F.col("value") > 300, "large").otherwise(F.col("event_type"))
    day = F.to_date("ts").cast("string")
    intents = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), day).alias("intent_id"), concept.alias("concept"))
    return D.classify_gap(
        intents,
        spark.createDataFrame(COVERAGE, "concept string, product string"),
        spark.createDataFrame(DERIVED, "concept string, base string"),
        spark.createDataFrame(COLUMNS, "concept string"),
    )


SOURCES = {**RETRIEVAL, "el": f"select * from ({RETRIEVAL['el']}) where product <> 'anvil'"}


@query(
    "dem_sources",
    'select question_id as concept, element_id as "column", round(similarity, 4) as score from (select *, row_number() over (partition by'
    " question_id order by round(similarity, 12) desc, element_id) as rn from cosines) where rn <= 3 and similarity > 0",
    extra=SOURCES,
)
def _(spark, d):
    """Parts looked up in the part catalogue; anvils are classified as personal and never offered."""
    catalog = part_elements(spark, d).select(
        F.col("element_id").alias("column"),
        F.lower(F.concat_ws(" ", "phrases", "description")).alias("text"),
        F.when(F.col("product") == "anvil", "PII").alias("classification"),
        F.lit(True).alias("searchable"),
    )
    asked = part_questions(spark, d).select(F.col("question_id").alias("concept"), F.lower("text").alias("text"))
    return D.sources(asked, catalog)


FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
HOPS = {"lineitem": 0, "orders": 1, "part": 1, "supplier": 1, "customer": 2, "nation": 2, "region": 3}


@query(
    "dem_join_path",
    " union all ".join(
        f"select '{t}' as \"table\", {h} as hops, round(1 / power({max(1, h)}, 0.25), 4) as confidence, count(*) as n_rows from {t}"
        for t, h in HOPS.items()
    ),
)
def _(spark, d):
    """Paths from the order lines over the tables' keys, with the size of each table they lead to."""
    keys = spark.createDataFrame(FOREIGN_KEYS, "child string, child_column string, parent string, parent_column string")
    paths = D.join_paths(keys, "lineitem").select("table", "hops", D.path_confidence(F.col("hops")).alias("confidence"))
    sizes = None
    for t in HOPS:
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit(t))
        sizes = one if sizes is None else sizes.unionByName(one)
    return paths.join(sizes, "table")


@query(
    "dem_score",
    "select intent_id, count(*) as distinct_askers, sum(n)::bigint as question_count, sum(w)::bigint as role_weight_sum,"
    " (2 * count(*) + sum(n) + sum(w))::double as demand_score from (select topic as intent_id, asked_by, count(*) as n, max(case role when"
    " 'ops_manager' then 3 when 'ops_director' then 3 when 'admin' then 0 else 1 end) as w from questions join users on"
    " user_id = asked_by group by 1, 2) group by 1",
)
def _(spark, d):
    return D.score(questions(spark, d).withColumn("intent_id", F.col("topic")), users(spark, d))


@query(
    "dem_closure",
    "select asked_by as intent_id, count(resolved_by_product) as resolved, count(*) as total, round(count(resolved_by_product) / count(*), 4)"
    " as closure_rate, round((floor(epoch(max(resolved_at))) - floor(epoch(min(asked_at)))) / 3600, 2) as hours_to_resolution, case when"
    " count(resolved_by_product) = count(*) then 'closed' else 'partially_closed' end as status from questions group by 1",
)
def _(spark, d):
    return D.closure(questions(spark, d).withColumn("intent_id", F.col("asked_by")))
