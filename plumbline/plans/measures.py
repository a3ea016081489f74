"""Rankings, retrieval, graphs and text queries of the catalogue."""

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import graph as G
from plumbline.operators import ranking as R
from plumbline.operators import retrieval as IR
from plumbline.operators import tiles as TL
from plumbline.plans.registry import query
from plumbline.plans.relational import MONEY, shared_orders

TERMS = ["license", "the", "public", "version"]
FOLD = r"trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))"
WORDS = "regexp_extract_all(lower(strip_accents(text)), '[a-z][a-z0-9]+')"


def titled(t):
    """documents as fields: the first line, and the rest."""
    first = F.substring_index("text", "\n", 1)
    d = t("documents").select("doc_id", F.stack(F.lit(2), F.lit("title"), first, F.lit("body"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)")).alias("field", "text"))
    return d


@query(
    "R14_bm25f",
    f"""WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text FROM documents), f AS (
      SELECT doc_id, 'title' AS field, title AS text FROM d UNION ALL SELECT doc_id, 'body', substr(text, length(title) + 1) FROM d
    ), k AS (SELECT doc_id, field, {WORDS} AS w FROM f), a AS (SELECT field, avg(len(w)) AS mean FROM k GROUP BY field),
    p AS (SELECT doc_id, field, len(w) AS size, unnest(w) AS term FROM k), h AS (SELECT doc_id, field, size, term, count(*) AS tf FROM p WHERE term IN ('license', 'the', 'public', 'version') GROUP BY ALL),
    q AS (SELECT doc_id, term, sum(CASE WHEN field = 'title' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END * tf / (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) AS pseudo FROM h JOIN a USING (field) GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM documents), i AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM q, n GROUP BY term, n),
    s AS (SELECT doc_id, round(sum(idf * pseudo / (1.5::DOUBLE + pseudo)), 8) AS score FROM q JOIN i USING (term) GROUP BY doc_id)
    SELECT doc_id, score, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100, 6) AS percentile FROM s ORDER BY score DESC, doc_id LIMIT 50""",
)
def _(t):
    return IR.bm25f_search(titled(t), "doc_id", TERMS, {"title": 3.0, "body": 1.0}, 50)


@query(
    "R01_tfidf",
    f"""WITH p AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    w AS (SELECT doc_id, term, df, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM t JOIN d USING (term), n), s AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
    SELECT doc_id, round(max(w / norm), 7) AS top_weight, count(*)::BIGINT AS terms, round(sum(w / norm), 5) AS total FROM w JOIN s USING (doc_id) GROUP BY doc_id""",
)
def _(t):
    docs = t("documents")
    weights = IR.tfidf(IR.postings(docs, "doc_id", T.words(F.col("text"))), "doc_id", docs.count())
    return weights.groupBy("doc_id").agg(F.round(F.max("weight"), 7).alias("top_weight"), F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("total"))


#: Occurrences that a word of a pair has at least.
MIN_COUNT = 4
CONVERSATION_WORDS = f"SELECT {{'conv_id': conv_id, 'turn': turn}} AS id, {WORDS} AS w FROM conversations"
PAIRS = f"""WITH x AS ({CONVERSATION_WORDS}), v AS (SELECT term FROM (SELECT unnest(w) AS term FROM x) GROUP BY term HAVING count(*) >= {MIN_COUNT}),
    o AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS ix FROM x), k AS (SELECT id, o.term, row_number() OVER (PARTITION BY id ORDER BY ix) AS pos FROM o JOIN v USING (term)),
    h AS (SELECT a.term AS a, b.term AS b, sum(1.0::DOUBLE / (b.pos - a.pos)) AS weight FROM k a JOIN k b ON a.id = b.id AND b.pos - a.pos BETWEEN 1 AND 4 GROUP BY ALL),
    c AS (SELECT a, b, sum(weight) AS weight FROM (SELECT * FROM h UNION ALL SELECT b, a, weight FROM h) GROUP BY a, b)"""


def conversation_pairs(t, min_count: int = MIN_COUNT):
    """Pairs of words at most four places apart in a turn, of words seen min_count times or more."""
    x = t("conversations").select(F.struct("conv_id", "turn").alias("id"), F.posexplode(T.words(F.col("text"))).alias("at", "term"))
    vocabulary = x.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("term")
    kept = x.join(vocabulary, "term", "left_semi").withColumn("pos", F.row_number().over(R.Window.partitionBy("id").orderBy("at")))
    return IR.cooccurrence(kept.select("id", "pos", "term"), "id", 4)


@query("J16_window_pairs", f"{PAIRS} SELECT a, b, round(weight, 6) AS weight FROM c")
def _(t):
    return conversation_pairs(t).select("a", "b", F.round("weight", 6).alias("weight"))


@query(
    "R06_sppmi",
    f"""{PAIRS}, l AS (SELECT a, sum(weight) AS wa FROM c GROUP BY a), r AS (SELECT b, pow(sum(weight), 0.75) AS wb FROM c GROUP BY b), z AS (SELECT (SELECT sum(wa) FROM l) AS total, (SELECT sum(wb) FROM r) AS smooth)
    SELECT a, b, round(ln(weight / total / (wa / total * (wb / smooth))), 6) AS pmi FROM c JOIN l USING (a) JOIN r USING (b), z WHERE round(ln(weight / total / (wa / total * (wb / smooth))), 6) > 0""",
)
def _(t):
    return IR.sppmi(conversation_pairs(t)).select("a", "b", F.round("pmi", 6).alias("pmi")).where("pmi > 0")


@query(
    "R22_rarity",
    f"""WITH p AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
    SELECT doc_id, round(least(1, greatest(0.05::DOUBLE, avg(ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) / ln(n + 1.0::DOUBLE)))), 6) AS rarity FROM p JOIN d USING (term), n GROUP BY doc_id""",
)
def _(t):
    docs = t("documents")
    terms = IR.postings(docs, "doc_id", T.words(F.col("text")))
    return IR.rarity_weights(terms, "doc_id", docs.count()).select("doc_id", F.round("rarity", 6).alias("rarity"))


COS = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(
    "R13_cosine_queries",
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({COS}, 7) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
    SELECT query_id, vec_id, cosine, k::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM s) WHERE k <= 10""",
)
def _(t):
    items, queries = vector_task(t)
    found = TL.top_items(items, TL.vector_queries(queries), 10).select(F.col("query").alias("query_id"), F.posexplode("found").alias("at", "f"))
    return found.select("query_id", F.col("f.item").alias("vec_id"), F.when(F.col("f.under") != -TL.NULL, -F.col("f.under") / TL.SCALE).alias("cosine"), (F.col("at") + 1).cast("long").alias("place"))


def vector_task(t):
    """All vectors, and the stated query set: those whose id is divisible by 100."""
    e = t("embeddings")
    return e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"), F.col("label").alias("has")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), F.col("label").alias("want"))


@query(
    "W16_retrieval_quality",
    f"""WITH s AS (SELECT q.vec_id AS query_id, q.label AS want, e.label, e.vec_id, round({COS}, 7) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place, count(*) FILTER (label = want) OVER (PARTITION BY query_id) AS relevant FROM s),
    p AS (SELECT query_id, min(place) AS first, sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1.0::DOUBLE) ELSE 0 END) / max(list_sum(list_transform(range(1, least(10, relevant) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE)))) AS ndcg FROM r WHERE label = want GROUP BY query_id)
    SELECT round(avg(1.0::DOUBLE / first), 6) AS mrr, round(avg((first <= 1)::INT), 6) AS recall_1, round(avg((first <= 5)::INT), 6) AS recall_5, round(avg((first <= 10)::INT), 6) AS recall_10, round(avg(ndcg), 6) AS ndcg_10, count(*)::BIGINT AS cases FROM p""",
)
def _(t):
    items, queries = vector_task(t)
    out = TL.quality(items, TL.vector_queries(queries))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mrr", "recall_1", "recall_5", "recall_10")], F.round("ndcg", 6).alias("ndcg_10"), "cases")


@query(
    "W03_rrf",
    """WITH c AS (SELECT doc_id, lang, 'size' AS channel, n_chars::DOUBLE AS score FROM documents UNION ALL SELECT doc_id, lang, 'id', doc_id::DOUBLE FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, channel ORDER BY score DESC NULLS LAST, doc_id) AS place FROM c)
    SELECT lang, doc_id, round(sum(CASE WHEN channel = 'size' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + place)) / (3.0::DOUBLE / 61), 8) AS rrf FROM r GROUP BY lang, doc_id""",
)
def _(t):
    d = t("documents").select("doc_id", "lang", F.stack(F.lit(2), F.lit("size"), F.col("n_chars").cast("double"), F.lit("id"), F.col("doc_id").cast("double")).alias("channel", "score"))
    return R.reciprocal_rank_fusion(d, ["lang"], "doc_id", "channel", {"size": 2.0, "id": 1.0}).select("lang", "doc_id", F.round("rrf", 8).alias("rrf"))


@query("W02_percentile", "SELECT doc_id, round((rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY lang) * 100, 6) AS percentile FROM documents")
def _(t):
    return R.with_percentile(t("documents").select("doc_id", "lang", "n_chars"), ["lang"], "n_chars", "p").select("doc_id", F.round("p", 6).alias("percentile"))


@query("W01_ordinal", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey)::BIGINT AS place, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST)::BIGINT AS shared FROM supplier")
def _(t):
    return t("supplier").select("s_suppkey", R.ordinal_rank(["s_nationkey"], "s_acctbal", "s_suppkey").cast("long").alias("place"), R.competition_rank(["s_nationkey"], "s_acctbal").cast("long").alias("shared"))


@query("W05_top_evidence", "SELECT l_suppkey, l_orderkey, l_partkey, k::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity * (1 - l_discount) DESC, l_orderkey, l_partkey, l_linenumber, l_shipdate, l_extendedprice) AS k FROM lineitem) WHERE k <= 6")
def _(t):
    order = [(F.col("l_quantity") * (1 - F.col("l_discount"))).desc(), *map(F.col, ("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice"))]
    return R.top_per_group(t("lineitem"), ["l_suppkey"], order, 6).select("l_suppkey", "l_orderkey", "l_partkey", F.col("place").cast("long").alias("place"))


@query("W08_dedupe_first", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, substr(lower(text), 1, 400) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def _(t):
    return R.latest(t("documents").withColumn("key", F.substring(F.lower("text"), 1, 400)), ["source", "key"], [F.col("doc_id")]).select("doc_id", "source")


@query("W12_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _(t):
    return R.latest(t("events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query(
    "W13_rank_blend",
    """WITH f AS (SELECT s_suppkey, s_acctbal AS a, n AS b FROM supplier JOIN (SELECT l_suppkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey), p AS (SELECT s_suppkey, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100 AS pa,
    (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100 AS pb FROM f), m AS (SELECT s_suppkey, round((2 * pa + pb) / 300, 9) AS blend FROM p)
    SELECT s_suppkey, blend, round((rank() OVER (ORDER BY blend) + (count(*) OVER (PARTITION BY blend) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100, 6) AS overall FROM m""",
)
def _(t):
    n = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").cast("double").alias("b"))
    f = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("a")).join(n, "s_suppkey")
    p = R.with_percentile(R.with_percentile(f, [], "a", "pa"), [], "b", "pb")
    m = p.select("s_suppkey", F.round((2 * F.col("pa") + F.col("pb")) / 300, 9).alias("blend"))
    return R.with_percentile(m, [], "blend", "p").select("s_suppkey", "blend", F.round("p", 6).alias("overall"))


REVENUE = "SELECT s_nationkey, s_suppkey, sum((l_extendedprice::DECIMAL(18,2)))::DOUBLE AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"


def revenue(t):
    per = t("lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("revenue"))
    return per.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "s_suppkey", "revenue")


@query(
    "A05_concentration",
    f"""WITH v AS ({REVENUE}), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY revenue) AS i, row_number() OVER (PARTITION BY s_nationkey ORDER BY revenue DESC) AS d FROM v)
    SELECT s_nationkey, round(greatest(0, (2 * sum(i * revenue) - (count(*) + 1) * sum(revenue)) / (count(*) * sum(revenue))), 6) AS gini, round(sum(revenue * revenue) / (sum(revenue) * sum(revenue)), 6) AS hhi,
    round(sum(CASE WHEN d <= 2 THEN revenue ELSE 0 END) / sum(revenue), 6) AS top_share FROM r GROUP BY s_nationkey""",
)
def _(t):
    return R.concentration(revenue(t), ["s_nationkey"], "revenue", 2).select("s_nationkey", *[F.round(c, 6).alias(c) for c in ("gini", "hhi", "top_share")])


@query(
    "A08_lorenz",
    f"""WITH v AS ({REVENUE}) SELECT s_suppkey, round(row_number() OVER (PARTITION BY s_nationkey ORDER BY revenue, s_suppkey)::DOUBLE / count(*) OVER (PARTITION BY s_nationkey), 6) AS population,
    round(sum(revenue) OVER (PARTITION BY s_nationkey ORDER BY revenue, s_suppkey ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER (PARTITION BY s_nationkey), 6) AS share FROM v""",
)
def _(t):
    return R.lorenz(revenue(t), ["s_nationkey"], "revenue", "s_suppkey").select("s_suppkey", F.round("population", 6).alias("population"), F.round("share", 6).alias("share"))


@query(
    "A27_weighted_best",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value * (event_id % 7 + 1) DESC, event_id) AS k FROM events WHERE value IS NOT NULL)
    SELECT user_id, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) AS mean FROM r WHERE k <= 3 GROUP BY user_id""",
)
def _(t):
    e = t("events").where("value IS NOT NULL").withColumn("w", (F.col("event_id") % 7 + 1).cast("double"))
    return R.weighted_mean_of_best(e, ["user_id"], "value", "w", "event_id", 3).select("user_id", F.round("mean", 6).alias("mean"))


@query(
    "U04_jaccard",
    """WITH f AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS f FROM lineitem), n AS (SELECT e, count(*) AS n FROM f GROUP BY e),
    s AS (SELECT x.e AS a, y.e AS b, count(*) AS s FROM f x JOIN f y ON x.f = y.f AND x.e < y.e GROUP BY ALL) SELECT a, b, round(s::DOUBLE / (p.n + q.n - s), 6) AS similarity FROM s JOIN n p ON a = p.e JOIN n q ON b = q.e""",
)
def _(t):
    return IR.shared_feature_pairs(parts_of(t), "e", "f").select("a", "b", F.round("similarity", 6).alias("similarity"))


def parts_of(t):
    """The parts of each supplier: a part is supplied by few."""
    return t("lineitem").select(F.col("l_suppkey").alias("e"), F.col("l_partkey").alias("f")).distinct()


@query(
    "N23_pruned_similarity",
    """WITH w AS (SELECT l_suppkey AS e, l_partkey AS f, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS w FROM lineitem GROUP BY ALL), n AS (SELECT e, sum(w * w) AS n FROM w GROUP BY e),
    s AS (SELECT x.e AS a, y.e AS b, sum(x.w * y.w) AS s FROM w x JOIN w y ON x.f = y.f AND x.e < y.e GROUP BY ALL), c AS (SELECT a, b, round(s / sqrt(p.n * q.n), 6) AS similarity FROM s JOIN n p ON a = p.e JOIN n q ON b = q.e),
    k AS (SELECT * FROM c WHERE similarity >= 0.18), e AS (SELECT a AS e, * FROM k UNION ALL SELECT b, * FROM k)
    SELECT DISTINCT a, b, similarity FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY similarity DESC, a, b) AS place FROM e) WHERE place <= 6""",
)
def _(t):
    w = t("lineitem").groupBy(F.col("l_suppkey").alias("e"), F.col("l_partkey").alias("f")).agg(F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("w"))
    pairs = IR.shared_feature_pairs(w, "e", "f", "w").withColumn("similarity", F.round("similarity", 6))
    return IR.prune_edges(pairs, 0.18, 6)


EDGES = """e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), g AS (SELECT a.s AS src, b.s AS dst, count(*)::DOUBLE AS weight FROM e a JOIN e b ON a.o = b.o AND a.s < b.s GROUP BY ALL),
    u AS (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g)"""


def edges(t):
    """Suppliers that share orders, by how many; all line items."""
    return shared_orders(t).withColumn("weight", F.col("weight").cast("double"))


@query("N13_degree", f"WITH {EDGES} SELECT src AS node, count(*)::BIGINT AS degree, sum(weight) AS strength FROM u GROUP BY src")
def _(t):
    return G.degrees(edges(t))


@query("N12_neighbours", f"WITH {EDGES} SELECT src, dst, weight, k::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM u) WHERE k <= 5")
def _(t):
    return G.strongest_neighbours(edges(t), 5).select("src", "dst", "weight", F.col("place").cast("long").alias("place"))


@query("N16_bridging", f"WITH {EDGES} SELECT src AS node, round(sum(CASE WHEN a.s_nationkey <> b.s_nationkey THEN weight ELSE 0 END) / sum(weight), 8) AS bridging FROM u JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst GROUP BY src")
def _(t):
    labels = t("supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))
    return G.bridging(edges(t), labels).select("node", F.round("bridging", 8).alias("bridging"))


@query("N17_reach", f"WITH {EDGES} SELECT src AS node, round(sum(CASE WHEN dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000) THEN 0 ELSE weight END) / sum(weight), 8) AS reach FROM u GROUP BY src")
def _(t):
    return G.external_reach(edges(t), t("supplier").where("s_acctbal > 4000").select(F.col("s_suppkey").alias("node"))).select("node", F.round("reach", 8).alias("reach"))


@query(
    "N21_neighbourhood",
    f"""WITH RECURSIVE {EDGES}, h(node, hops) AS (SELECT 1::BIGINT, 0 UNION SELECT u.dst, h.hops + 1 FROM h JOIN u ON u.src = h.node WHERE h.hops < 2) SELECT node, min(hops)::BIGINT AS hops FROM h GROUP BY node""",
)
def _(t):
    seeds = t("supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("node"))
    return G.neighbourhood(edges(t), seeds, 2).select("node", F.col("hops").cast("long").alias("hops"))


@query(
    "N19_paths",
    f"""WITH RECURSIVE {EDGES}, h(node, cost, hops) AS (SELECT 1::BIGINT, 0::DOUBLE, 0 UNION ALL SELECT node, min(cost), min(hops) FROM (SELECT u.dst AS node, h.cost + 1.0::DOUBLE / u.weight AS cost, h.hops + 1 AS hops FROM h JOIN u ON u.src = h.node WHERE h.hops < 3) GROUP BY node)
    SELECT node, round(min(cost), 8) AS cost FROM h GROUP BY node""",
)
def _(t):
    return G.cheapest_paths(edges(t), 1, 3).select("node", F.round("cost", 8).alias("cost"))


@query("N22_second_wave", f"WITH {EDGES} SELECT dst AS node, count(DISTINCT src)::BIGINT AS via FROM u WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000) AND dst NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000) GROUP BY dst")
def _(t):
    known = t("supplier").where("s_acctbal > 4000")
    met = G.both_ways(edges(t)).join(known.select(F.col("s_suppkey").alias("src")), "src", "left_semi").join(known.select(F.col("s_suppkey").alias("dst")), "dst", "left_anti")
    return met.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("via"))


@query(
    "N18_components",
    """WITH RECURSIVE e AS (SELECT c_nationkey AS a, 1000 + c_custkey AS b FROM customer), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a)
    SELECT node::BIGINT AS node, min(seen)::BIGINT AS component FROM r GROUP BY node""",
)
def _(t):
    c = t("customer")
    e = c.select(F.col("c_nationkey").cast("long").alias("src"), (F.lit(1000) + F.col("c_custkey")).cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    return G.min_labels(e)


@query("N10_canonical", "SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS weight FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL")
def _(t):
    e = t("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").cast(MONEY).alias("weight"))
    return G.canonical(e).withColumn("weight", F.col("weight").cast("double"))


@query("T04_fold", f"SELECT doc_id, sha256({FOLD}) AS folded FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(T.fold(F.col("text")).cast("binary"), 256).alias("folded"))


@query("T11_slug", r"SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(split_part(text, chr(10), 1))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def _(t):
    return t("documents").select("doc_id", T.slug(F.substring_index("text", "\n", 1)).alias("slug"))


@query("T06_person_name", "SELECT c_custkey, trim(regexp_replace(upper(strip_accents(c_name)), '[^A-Z0-9]+', ' ', 'g')) AS name FROM customer")
def _(t):
    return t("customer").select("c_custkey", T.normalize_person_name(F.col("c_name")).alias("name"))


@query("T28_bigrams", f"WITH x AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT w[i] || ' ' || w[i + 1] AS gram, count(*)::BIGINT AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM x) GROUP BY 1")
def _(t):
    return t("documents").select(F.explode(T.ngrams(T.words(F.col("text")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("T31_recency", "SELECT o_orderkey, round(pow(2.0::DOUBLE, -greatest(0, 2002 - year(o_orderdate)) / 6.0::DOUBLE), 8) AS weight FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.round(T.recency_weight(F.year("o_orderdate"), 2002), 8).alias("weight"))


@query("S22_url_parts", r"SELECT page_id, lower(regexp_extract(url, '^(\w+)://', 1)) AS scheme, lower(regexp_extract(url, '^\w+://([^/?#]+)', 1)) AS host, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') AS args FROM pages")
def _(t):
    args = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda x: x != "")), "&")
    return t("pages").select("page_id", F.lower(F.regexp_extract("url", r"^(\w+)://", 1)).alias("scheme"), F.lower(F.regexp_extract("url", r"^\w+://([^/?#]+)", 1)).alias("host"), args.alias("args"))


@query("S08_json_leaf", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))
