"""Text rules, records from leaves, representations, coherence, distances and the battery of retrieval tasks."""

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import evaluation as E
from plumbline.operators import ranking as R
from plumbline.operators import records as RC
from plumbline.operators import retrieval as IR
from plumbline.operators import tiles as TL
from plumbline.plans.measures import COS, WORDS, vector_task
from plumbline.plans.registry import query
from plumbline.plans.relational import MONEY, long
from plumbline.sources import pages as P

#: The particles as SQL text.
PARTICLES = ", ".join(f"'{p}'" for p in T.PARTICLES)
SHOWN = ", ".join(f"'{p}'" for p in T.SHOWN_PARTICLES)
#: The words of each line of a document, as names.
BYLINE = f"SELECT doc_id, nth, ({WORDS}) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents)"
TITLE = f"SELECT doc_id, {WORDS.replace('(text)', '(split_part(text, chr(10), 1))')} AS w FROM documents"


def bylines(t):
    """The words of each line of a document, as names."""
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("nth"), T.words(F.col("line")).alias("w"))


@query(
    "T02_scrubbed",
    r"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[•·▪●◦‣]', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM documents), u AS (SELECT doc_id, regexp_replace(x, '(?i)(?:https?://|www\.)\S+', ' ', 'g') AS x FROM c),
    d AS (SELECT doc_id, regexp_replace(x, '(?i)(?:\bdoi:?\s*)?\b10\.[0-9]{4,9}/\S+', ' ', 'g') AS x FROM u), p AS (SELECT doc_id, regexp_replace(x, '\([^()]{0,140}\b(?:19|20)[0-9]{2}[a-zA-Z]?\b[^()]{0,140}\)', ' ', 'g') AS x FROM d),
    e AS (SELECT doc_id, regexp_replace(x, '(?i)\b\pL[\pL''’-]+(?:\s+\pL[\pL''’-]+){0,3}?\s+et\s+al\b\.?\s*,?\s*\(?\s*(?:19|20)[0-9]{2}[a-zA-Z]?\b\s*\)?', ' ', 'g') AS x FROM p),
    b AS (SELECT doc_id, regexp_replace(x, '\[\s*[0-9]+(?:[\s,;-]+[0-9]+)*[\s,;]*\]', ' ', 'g') AS x FROM e), n AS (SELECT doc_id, regexp_replace(x, '\b\p{Lu}\p{Lu}+(?:\s+\p{Lu}\p{Lu}+){0,3}\s*,?\s*(?:19|20)[0-9]{2}[a-zA-Z]?\b', ' ', 'g') AS x FROM b)
    SELECT doc_id, sha256(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS text FROM n""",
)
def _(t):
    return t("documents").select("doc_id", F.sha2(T.scrub_citations(F.col("text")).cast("binary"), 256).alias("text"))


@query("T03_join_unique", "SELECT o_orderkey, o_orderpriority || '; ' || o_orderstatus AS joined FROM orders")
def _(t):
    parts = F.array("o_orderpriority", F.lit(" "), F.lower("o_orderpriority"), F.lit(None).cast("string"), "o_orderstatus", F.lower("o_orderstatus"))
    return t("orders").select("o_orderkey", T.join_unique(parts, "; ").alias("joined"))


@query("T07_display_name", f"SELECT doc_id, nth, md5(array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND x IN ({SHOWN}) THEN x ELSE upper(x[1]) || x[2:] END), ' ')) AS name FROM ({BYLINE})")
def _(t):
    return bylines(t).select("doc_id", "nth", F.md5(T.display_person_name(F.array_join("w", " ")).cast("binary")).alias("name"))


@query("T09_name_key", f"SELECT doc_id, nth, k[1][1] AS initial, k[-1] AS family FROM (SELECT doc_id, nth, list_filter(w, lambda x: x NOT IN ({PARTICLES})) AS k FROM ({BYLINE})) WHERE len(k) > 0")
def _(t):
    kept = F.filter("w", lambda x: ~x.isin(T.PARTICLES))
    return bylines(t).withColumn("k", kept).where(F.size("k") > 0).select("doc_id", "nth", F.substring(F.element_at("k", 1), 1, 1).alias("initial"), F.element_at("k", -1).alias("family"))


@query(
    "T25_sentences",
    r"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.;:!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 25))::BIGINT AS sentences FROM documents""",
)
def _(t):
    return t("documents").select("doc_id", long(F.size(T.sentences(F.col("text")))).alias("sentences"))


@query(
    "T26_masked_title",
    f"""WITH x AS ({TITLE}), o AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM x), d AS (SELECT term, count(*) AS df FROM o GROUP BY term), k AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS place FROM o JOIN d USING (term)),
    m AS (SELECT doc_id, list(term) AS masked FROM k WHERE place <= 2 GROUP BY doc_id) SELECT doc_id, array_to_string(list_filter(w, lambda a: NOT list_contains(masked, a)), ' ') AS title FROM x JOIN m USING (doc_id)""",
)
def _(t):
    x = t("documents").select("doc_id", T.words(F.substring_index("text", "\n", 1)).alias("w"))
    o = x.select("doc_id", F.explode(F.array_distinct("w")).alias("term"))
    rare = R.top_per_group(o.join(o.groupBy("term").agg(F.count("*").alias("df")), "term"), ["doc_id"], [F.col("df"), F.col("term")], 2)
    return x.join(rare.groupBy("doc_id").agg(F.collect_list("term").alias("masked")), "doc_id").select("doc_id", F.array_join(F.filter("w", lambda a: ~F.array_contains("masked", a)), " ").alias("title"))


GRAMS = """w AS (SELECT p_partkey, ' ' || unnest(regexp_extract_all(lower(strip_accents(p_name)), '[a-z][a-z0-9]+')) || ' ' AS p FROM part), s AS (SELECT p_partkey, p, unnest([3, 4, 5]) AS n FROM w),
    g AS (SELECT p_partkey, substr(p, i, n) AS term FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM s))"""


def part_grams(t):
    return IR.postings(t("part"), "p_partkey", T.char_ngrams(T.words(F.col("p_name")), 3, 5))


@query("T29_char_ngrams", f"WITH {GRAMS} SELECT term, count(*)::BIGINT AS n, count(DISTINCT p_partkey)::BIGINT AS parts FROM g GROUP BY term")
def _(t):
    return part_grams(t).groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("parts"))


@query(
    "R02_char_tfidf",
    f"""WITH {GRAMS}, t AS (SELECT p_partkey, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM part), d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    v AS (SELECT p_partkey, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS v FROM t JOIN d USING (term), n) SELECT p_partkey, round(max(v) / sqrt(sum(v * v)), 7) AS top_weight, round(sum(v) / sqrt(sum(v * v)), 6) AS total FROM v GROUP BY p_partkey""",
)
def _(t):
    w = IR.tfidf(part_grams(t), "p_partkey", t("part").count())
    return w.groupBy("p_partkey").agg(F.round(F.max("weight"), 7).alias("top_weight"), F.round(F.sum("weight"), 6).alias("total"))


@query(
    "R04_vocabulary",
    f"""WITH p AS (SELECT unnest({WORDS}) AS term FROM documents), c AS (SELECT term, count(*)::BIGINT AS n FROM p WHERE length(term) > 2 GROUP BY term HAVING count(*) >= 4)
    SELECT term, n, round(0.001::DOUBLE / (0.001::DOUBLE + n / (SELECT sum(n) FROM c)::DOUBLE), 8) AS weight FROM c""",
)
def _(t):
    c = t("documents").select(F.explode(T.words(F.col("text"))).alias("term")).where("length(term) > 2").groupBy("term").agg(F.count("*").alias("n")).where("n >= 4")
    share = F.col("n") / F.col("total").cast("double")
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total")))).select("term", "n", F.round(0.001 / (0.001 + share), 8).alias("weight"))


@query(
    "R09_truncated_view",
    "WITH s AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, unnest(range(1, 17))::BIGINT AS at, round(unnest(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 7) AS x FROM s",
)
def _(t):
    v = t("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double")).alias("v"))
    unit = v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).select("vec_id", "norm", F.posexplode("v").alias("at", "x"))
    return unit.select("vec_id", long(F.col("at") + 1).alias("at"), F.round(F.col("x") / F.col("norm"), 7).alias("x"))


CUT = COS.replace("len(e.embedding)", "16").replace("list_transform(e.embedding", "list_transform(e.embedding[1:16]").replace("list_transform(q.embedding", "list_transform(q.embedding[1:16]")
CHANNELS = f"""c AS (SELECT 'full' AS channel, q.vec_id AS query, e.vec_id AS item, round({COS}, 7) AS score, e.label = q.label AS relevant FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id
    UNION ALL SELECT 'short', q.vec_id, e.vec_id, round({CUT}, 7), e.label = q.label FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)"""


def channels(t):
    """All vectors, and the stated query set in two views: whole, and the first 16 numbers."""
    items, queries = vector_task(t)
    return items, {"full": TL.vector_queries(queries), "short": TL.vector_queries(queries, 16)}


@query("R10_fused_views", f"WITH {CHANNELS} SELECT query, item, round(sum(CASE channel WHEN 'full' THEN 2 ELSE 1 END * score) / 3, 9) AS score FROM c GROUP BY query, item")
def _(t):
    items, views = channels(t)

    def fused(keys):
        whole, short = keys
        total = 2.0 * np.nan_to_num(whole) / TL.SCALE + np.nan_to_num(short) / TL.SCALE
        return np.where(np.isnan(whole) & np.isnan(short), np.nan, total / 3 if repeated else TL.rounded(total / 3, 1e9) / 1e9)

    repeated = not items.groupBy("item").count().where("count > 1").isEmpty()
    found = TL.all_pairs(items, list(views.values()), "score", fused)
    # ids that come twice add up
    return found.groupBy("query", "item").agg(F.round(F.sum("score"), 9).alias("score")) if repeated else found


@query(
    "R18_battery",
    f"""WITH {CHANNELS}, r AS (SELECT *, row_number() OVER (PARTITION BY channel, query ORDER BY score DESC, item) AS place, count(*) FILTER (relevant) OVER (PARTITION BY channel, query) AS n FROM c),
    p AS (SELECT channel, query, min(place) AS first, sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1.0::DOUBLE) ELSE 0 END) / max(list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE)))) AS ndcg FROM r WHERE relevant GROUP BY channel, query)
    SELECT channel, count(*)::BIGINT AS cases, round(avg(1.0::DOUBLE / first), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM p GROUP BY channel""",
)
def _(t):
    items, views = channels(t)
    found = [TL.quality(items, q).where("cases > 0").select(F.lit(name).alias("channel"), "cases", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg")) for name, q in views.items()]
    return reduce(DataFrame.union, found)


SEARCH = f"""k AS (SELECT doc_id, source, {WORDS} AS w FROM documents), a AS (SELECT avg(len(w)) AS mean, count(*) AS n FROM k), h AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM k) WHERE term IN ('license', 'public') GROUP BY ALL),
    q AS (SELECT doc_id, term, tf / (0.25::DOUBLE + 0.75::DOUBLE * size / mean) AS pseudo FROM h, a), i AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM q, a GROUP BY term, n),
    s AS (SELECT doc_id, round(sum(idf * pseudo / (1.5::DOUBLE + pseudo)), 8) AS score FROM q JOIN i USING (term) GROUP BY doc_id)"""


def searched(t):
    fields = t("documents").select("doc_id", F.lit("text").alias("field"), "text")
    return IR.bm25f(fields, "doc_id", ["license", "public"], {"text": 1.0}).withColumn("score", F.round("score", 8))


@query("R15_bm25", f"WITH {SEARCH} SELECT doc_id, score FROM s")
def _(t):
    return searched(t)


@query("R16_best_per_source", f"WITH {SEARCH} SELECT source, doc_id, score FROM (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place FROM s JOIN k USING (doc_id)) WHERE place = 1")
def _(t):
    found = searched(t).join(t("documents").select("doc_id", "source"), "doc_id")
    return R.latest(found, ["source"], [F.col("score").desc(), F.col("doc_id")]).select("source", "doc_id", "score")


@query(
    "M02_npmi",
    f"""WITH o AS (SELECT doc_id, lang, unnest({WORDS}) AS term FROM documents), c AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS k FROM o WHERE length(term) > 3 GROUP BY lang, term),
    t AS (SELECT lang, term FROM c WHERE k <= 8), p AS (SELECT DISTINCT doc_id, term FROM o WHERE term IN (SELECT term FROM t)), d AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
    j AS (SELECT x.term AS a, y.term AS b, count(*) AS ab FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL), q AS (SELECT x.lang, x.term AS a, y.term AS b FROM t x JOIN t y ON x.lang = y.lang AND x.term < y.term)
    SELECT q.lang, round(avg(CASE WHEN ab IS NULL THEN -1 WHEN ab = n THEN 1 ELSE ln(ab * n::DOUBLE / (da.df * db.df)) / -ln(ab / n::DOUBLE) END), 6) AS npmi FROM q LEFT JOIN j ON q.a = j.a AND q.b = j.b JOIN d da ON q.a = da.term JOIN d db ON q.b = db.term, n GROUP BY q.lang""",
)
def _(t):
    docs = t("documents")
    terms = docs.select("doc_id", "lang", F.explode(T.words(F.col("text"))).alias("term"))
    counts = terms.where("length(term) > 3").groupBy("lang", "term").agg(F.count("*").alias("n"))
    topics = R.top_per_group(counts, ["lang"], [F.col("n").desc(), F.col("term")], 8).select("lang", "term")
    return E.npmi_coherence(terms.select("doc_id", "term").distinct(), "doc_id", topics, "lang", docs.count()).select("lang", F.round("npmi", 6).alias("npmi"))


MEANS = """x AS (SELECT label AS g, unnest(range(1, len(embedding) + 1)) AS ix, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT g, ix, avg(x) AS x FROM x GROUP BY g, ix)"""
FAR = "SELECT p.g AS a, q.g AS b, 1 - sum(p.x * q.x) / sqrt(sum(p.x * p.x) * sum(q.x * q.x)) AS distance FROM m p JOIN m q ON p.ix = q.ix AND p.g < q.g{} GROUP BY p.g, q.g"


@query("G01_distances", f"WITH {MEANS} SELECT a, b, round(distance, 6) AS distance FROM ({FAR.format('')})")
def _(t):
    return E.group_distances(t("embeddings"), "label", "embedding").select("a", "b", F.round("distance", 6).alias("distance"))


@query(
    "G04_stress",
    f"""WITH {MEANS}, w AS ({FAR.format('')}), s AS ({FAR.format(' AND p.ix <= 8')}), j AS (SELECT w.distance AS w, s.distance AS s FROM w JOIN s USING (a, b))
    SELECT round(sqrt(1 - sum(w * s) * sum(w * s) / (sum(w * w) * sum(s * s))), 6) AS stress, round(corr(w, s), 6) AS pearson FROM j""",
)
def _(t):
    e = t("embeddings").select("label", "embedding", F.slice("embedding", 1, 8).alias("cut"))
    both = E.group_distances(e, "label", "embedding").join(E.group_distances(e, "label", "cut").withColumnRenamed("distance", "shown"), ["a", "b"])
    return E.stress(both, "distance", "shown").select(F.round("stress", 6).alias("stress"), F.round("pearson", 6).alias("pearson"))


def order_leaves(t):
    """One JSON text per order, as leaves: {"head": {"key": k}, "lines": [{"line": {"part": p, "Qty": q, "note": ""}}]}."""
    line = F.struct(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("Qty"), F.lit("").alias("note")).alias("line"))
    docs = t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(F.col("l_orderkey").alias("key")).alias("head"), F.collect_list(line).alias("lines"))).alias("json"))
    return P.json_leaves(docs, "l_orderkey", "json")


@query("T21_path_segments", "SELECT 'lines' AS family, 'part' AS leaf, count(*)::BIGINT AS n FROM lineitem UNION ALL SELECT 'lines', 'Qty', count(*) FROM lineitem UNION ALL SELECT 'lines', 'note', count(*) FROM lineitem UNION ALL SELECT 'head', 'key', count(DISTINCT l_orderkey) FROM lineitem")
def _(t):
    s = order_leaves(t).select(RC.path_segments(F.col("path")).alias("s"))
    return s.groupBy(F.element_at("s", 1).alias("family"), F.element_at("s", -1).alias("leaf")).agg(F.count("*").alias("n"))


@query("X02_records", "SELECT l_orderkey, 'line' AS kind, l_partkey::VARCHAR AS part, l_quantity::INT::VARCHAR AS quantity FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 'head', l_orderkey::VARCHAR, NULL FROM lineitem")
def _(t):
    specs = {"line": "lines.line", "head": "head"}
    return RC.gather(order_leaves(t), "l_orderkey", specs, {"part": ["part", "key"], "quantity": ["note", "QTY"]}).drop("prefix")


@query(
    "P05_fingerprint",
    "SELECT source, count(*)::BIGINT AS n, max(doc_id) AS newest, sum(n_chars)::BIGINT AS chars, bit_xor(('0x' || substr(sha256(text), 1, 12))::BIGINT) AS mark FROM documents GROUP BY source",
)
def _(t):
    mark = F.bit_xor(F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12), 16, 10).cast("long"))
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("newest"), long(F.sum("n_chars")).alias("chars"), mark.alias("mark"))


@query(
    "C06_profile",
    """WITH p AS (SELECT s_suppkey, l_returnflag, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), r AS (SELECT *, (rank() OVER (PARTITION BY l_returnflag ORDER BY v) + (count(*) OVER (PARTITION BY l_returnflag, v) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY l_returnflag) * 100 AS pct FROM p)
    SELECT s_suppkey, round(sum(CASE l_returnflag WHEN 'N' THEN 0.5::DOUBLE WHEN 'A' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END * pct), 6) AS score, round(max(pct), 6) AS best FROM r GROUP BY s_suppkey""",
)
def _(t):
    per = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag").agg(F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("v"))
    w = F.when(F.col("l_returnflag") == "N", 0.5).when(F.col("l_returnflag") == "A", 0.3).otherwise(0.2)
    ranked = R.with_percentile(per, ["l_returnflag"], "v", "pct")
    return ranked.groupBy("s_suppkey").agg(F.round(F.sum(w * F.col("pct")), 6).alias("score"), F.round(F.max("pct"), 6).alias("best"))
