"""Vectors of terms and documents, topics and their choice, and maps of groups."""

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import evaluation as E
from plumbline.operators import iterative as IT
from plumbline.operators import retrieval as IR
from plumbline.operators import semantics as S
from plumbline.operators import tiles as TL
from plumbline.operators import topic_models as TM
from plumbline.plans.measures import COS, WORDS, conversation_pairs, vector_task
from plumbline.plans.registry import query
from plumbline.plans.relational import MONEY, long
from plumbline.plans.structures import weighted_terms

AXES = 16
STOP = ["the", "and", "of", "to", "de", "la", "le", "und", "der", "die", "que", "el", "en", "et"]


def turn_terms(t):
    return IR.postings(t("conversations").withColumn("doc", F.concat_ws("/", "conv_id", "turn")), "doc", T.words(F.col("text")))


@query("R07_document_vectors")
def _(t):
    vectors = S.term_vectors(IR.sppmi(conversation_pairs(t)), AXES).checkpoint()
    return S.document_vectors(turn_terms(t), vectors, AXES).select("doc", F.transform("vector", lambda v: F.round(v, 5)).alias("vector"))


@query("R08_nearest_terms")
def _(t):
    vectors = S.term_vectors(IR.sppmi(conversation_pairs(t)), AXES).checkpoint()
    most = turn_terms(t).groupBy("term").agg(F.sum("tf").alias("n")).join(vectors, "term", "left_semi").orderBy(F.col("n").desc(), "term").first()  # one term
    return S.nearest_terms(vectors, most.term if most else "", 10).select("term", F.round("cosine", 5).alias("cosine"))


@query("R11_stacked", "SELECT vec_id, md5(array_to_string(list_transform(list_transform(embedding, lambda x: x::DOUBLE * sqrt(2.0::DOUBLE)) || list_transform(embedding[1:8], lambda x: x::DOUBLE * sqrt(0.75::DOUBLE)), lambda x: (round(x * 1e6))::BIGINT::VARCHAR), ',')) AS vector FROM embeddings")
def _(t):
    e = t("embeddings")
    full = e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    both = S.stacked([(full, 2.0), (full.select("vec_id", F.slice("vector", 1, 8).alias("vector")), 0.75)], "vec_id")
    return both.select("vec_id", F.md5(F.array_join(F.transform("vector", lambda v: F.round(v * 1e6).cast("long").cast("string")), ",").cast("binary")).alias("vector"))


@query("R12_joint_axes")
def _(t):
    e = t("embeddings")
    full = e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    both = S.stacked([(full, 2.0), (full.select("vec_id", F.slice("vector", 1, 8).alias("vector")), 0.75)], "vec_id").checkpoint()
    width = both.select(F.size("vector").alias("n")).first()
    return S.projected(both, "vec_id", width.n if width else 0, 8).select("vec_id", F.transform("vector", lambda v: F.round(v, 5)).alias("vector"))


def stories(t, vocabulary: int = 2000) -> TM.Corpus:
    """Documents over their most frequent words of two languages or one."""
    return TM.corpus(t("documents"), "doc_id", F.filter(T.words(F.col("text")), lambda w: ~w.isin(STOP)), vocabulary)


@query("M04_resampled_stability")
def _(t):
    c = stories(t)
    found, _ = TM.stability(c, [4, 6])
    return c.rows.sparkSession.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "k long, stability double")


@query("M05_fitted_number")
def _(t):
    return TM.choose_number(stories(t))[0]


@query("M06_two_levels")
def _(t):
    c = stories(t)
    h = TM.fit(c.rows, len(c.terms), [TM.Model(4)])[0]
    return TM.two_levels(c, h)[0].select(F.col("doc").alias("doc_id"), "topic")


@query("M07_placed")
def _(t):
    x = weighted_terms(t).checkpoint()
    c = TM.gathered(x, None)  # all words, as topics and places need them
    h = TM.fit(c.rows, len(c.terms), [TM.Model(4)])[0]
    return S.placed_on_topics(x, TM.as_rows(c, h), 4).select(F.col("doc").alias("id"), F.transform("f", lambda v: F.round(v, 5)).alias("shares"))


TERMS = "SELECT p_type AS topic, p_brand AS term, l_linestatus AS part, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


@query(
    "M04_stability",
    f"""WITH t AS ({TERMS}), a AS (SELECT * FROM t WHERE part = 'O'), b AS (SELECT * FROM t WHERE part = 'F'), n AS (SELECT topic, part, sqrt(sum(weight * weight)) AS n FROM t GROUP BY ALL),
    c AS (SELECT a.topic AS x, b.topic AS y, sum(a.weight * b.weight) AS dot FROM a JOIN b USING (term) GROUP BY ALL), m AS (SELECT x, max(dot / (p.n * q.n)) AS best FROM c JOIN n p ON p.topic = x AND p.part = 'O' JOIN n q ON q.topic = y AND q.part = 'F' GROUP BY x) SELECT round(avg(best), 8) AS stability FROM m""",
)
def _(t):
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    w = lines.groupBy(F.col("p_type").alias("topic"), F.col("p_brand").alias("term"), "l_linestatus").agg(F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("weight")).checkpoint()
    half = lambda s: w.where(F.col("l_linestatus") == s).select("topic", "term", "weight")
    return S.stability(half("O"), half("F")).select(F.round("stability", 8).alias("stability"))


@query(
    "M05_chosen_number",
    """WITH c AS (SELECT p_size AS k, round(avg(CASE WHEN p_type = 'PROMO' THEN 0.5 ELSE -0.1 END)::DOUBLE, 9) AS coherence, round(avg(p_retailprice % 1000)::DOUBLE / 1000, 9) AS stability, round(count(DISTINCT p_brand) / 25.0::DOUBLE, 9) AS support, round(count(DISTINCT p_name)::DOUBLE / count(*), 9) AS exclusivity FROM part GROUP BY p_size),
    q AS (SELECT *, round(0.35::DOUBLE * ((coherence + 1) / 2) + 0.25::DOUBLE * stability + 0.2::DOUBLE * support + 0.2::DOUBLE * exclusivity, 9) AS quality FROM c) SELECT k::BIGINT AS k, quality, k = (SELECT min(k) FROM q WHERE quality >= (SELECT max(quality) FROM q) - 0.02) AS chosen FROM q""",
)
def _(t):
    c = t("part").groupBy(long("p_size").alias("k")).agg(
        F.round(F.avg(F.when(F.col("p_type") == "PROMO", 0.5).otherwise(-0.1)), 9).alias("coherence"), F.round(F.avg(F.col("p_retailprice") % 1000) / 1000, 9).alias("stability"),
        F.round(F.countDistinct("p_brand") / 25.0, 9).alias("support"), F.round(F.countDistinct("p_name") / F.count("*"), 9).alias("exclusivity"),
    )
    return S.chosen_number(c).select("k", "quality", "chosen")


@query(
    "M06_subtopics",
    """WITH m AS (SELECT c_custkey AS id, c_mktsegment AS topic, c_nationkey % 5 AS part, c_acctbal FROM customer), s AS (SELECT topic, count(*) AS size FROM m GROUP BY topic), g AS (SELECT topic, part, avg(c_acctbal) - 4500 AS npmi FROM m GROUP BY ALL)
    SELECT id, CASE WHEN size >= 10 AND npmi >= 0 THEN topic || '.' || part ELSE topic END AS topic FROM m JOIN s USING (topic) JOIN g USING (topic, part)""",
)
def _(t):
    m = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("topic"), (F.col("c_nationkey") % 5).alias("part"), "c_acctbal")
    coherence = m.groupBy("topic", "part").agg((F.avg("c_acctbal") - 4500).alias("npmi"))
    return S.split_topics(m.select("id", "topic", "part"), coherence)


@query("M08_memberships", "WITH w AS (SELECT l_suppkey, p_type, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT l_suppkey, p_type, round(w / sum(w) OVER (PARTITION BY l_suppkey), 8) AS share FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY share DESC, p_type)::BIGINT AS rank FROM s) SELECT *, rank = 1 AS dominant FROM r")
def _(t):
    w = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_type").agg(F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("w"))
    total = w.groupBy("l_suppkey").agg(F.sum("w").alias("total"))
    shares = w.join(total, "l_suppkey").select("l_suppkey", "p_type", F.round(F.col("w") / F.col("total"), 8).alias("share"))
    return S.memberships(shares, "l_suppkey", "p_type").withColumn("rank", long("rank"))


@query("G02_coordinates")
def _(t):
    return S.group_map(E.group_distances(t("embeddings"), "label", "embedding"), smooth=False)


@query("G03_smoothed_map")
def _(t):
    return S.group_map(E.group_distances(t("embeddings"), "label", "embedding"))


@query("R20_skill_match", "WITH w AS (SELECT DISTINCT l_suppkey AS e, p_brand || '/' || p_size AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#1'), o AS (SELECT s FROM w WHERE e = 1) SELECT e, round(count(*)::DOUBLE / (SELECT count(*) FROM o), 8) AS match, string_agg(s, ';' ORDER BY s) AS shared FROM w WHERE s IN (SELECT s FROM o) AND e <> 1 GROUP BY e")
def _(t):
    w = t("lineitem").join(t("part").where("p_brand <> 'Brand#1'"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("e"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("s")).distinct()
    wanted = w.where("e = 1").select("s")
    n = wanted.agg(F.count("*").alias("n"))  # one row
    have = w.where("e <> 1").join(wanted, "s", "left_semi").groupBy("e").agg(F.count("*").alias("c"), F.array_join(F.array_sort(F.collect_set("s")), ";").alias("shared"))
    return have.join(F.broadcast(n)).select("e", F.round(F.col("c") / F.col("n"), 8).alias("match"), "shared")


@query("J20_query_items", f"SELECT q.vec_id AS query_id, count(*)::BIGINT AS n, round(max({COS}), 6) AS most FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id GROUP BY q.vec_id")
def _(t):
    items, queries = vector_task(t)
    found = TL.top_items(items, TL.vector_queries(queries, scale=1e6), 1)
    most = F.col("found")[0]["under"]
    return found.select(F.col("query").alias("query_id"), F.col("scored").alias("n"), F.when(most != -TL.NULL, -most / 1e6).alias("most"))


KEPT = f"list_filter({WORDS}, lambda x: x NOT IN ({', '.join(repr(w) for w in STOP)}))"


@query(
    "R01_one_and_two_words",
    f"""WITH w AS (SELECT doc_id, {KEPT} AS w FROM documents), p AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w), t AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
    d AS (SELECT term, df FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM t GROUP BY term) WHERE df >= 2 ORDER BY total DESC, term LIMIT 60000), x AS (SELECT doc_id, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM t JOIN d USING (term), n), s AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id)
    SELECT doc_id, round(max(w / norm), 7) AS top_weight, count(*)::BIGINT AS terms, round(sum(w / norm), 5) AS total FROM x JOIN s USING (doc_id) GROUP BY doc_id""",
)
def _(t):
    docs = t("documents")
    kept = F.filter(T.words(F.col("text")), lambda w: ~w.isin(STOP))
    terms = IR.postings(docs.select("doc_id", kept.alias("w")), "doc_id", F.concat("w", T.ngrams(F.col("w"))))
    known = IR.vocabulary(terms, least=2, most=60_000)
    weights = IR.tfidf(terms.join(known, "term", "left_semi"), "doc_id", docs.count())
    return weights.groupBy("doc_id").agg(F.round(F.max("weight"), 7).alias("top_weight"), F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("total"))
