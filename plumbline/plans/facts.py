"""Filters, joins, tallies, orders, sets and text rules of the catalogue that the first two modules lack."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import graph as G
from plumbline.operators import ranking as R
from plumbline.operators import retrieval as IR
from plumbline.plans.measures import EDGES, FOLD, WORDS, edges, parts_of
from plumbline.plans.registry import query
from plumbline.plans.relational import MONEY, long

PLAIN = "lower(strip_accents(text))"


def money(c):
    return F.sum(F.col(c).cast(MONEY)).cast("double")


@query("F04_fold_contains", f"SELECT doc_id FROM documents WHERE contains({PLAIN}, 'informacion') OR contains({PLAIN}, 'tres')")
def _(t):
    folded = T.fold(F.col("text"))
    return t("documents").where(F.contains(folded, F.lit("informacion")) | F.contains(folded, F.lit("tres"))).select("doc_id")


@query("F05_alnum_contains", rf"SELECT doc_id FROM documents WHERE contains(regexp_replace({PLAIN}, '[^\p{{L}}\p{{N}}]', '', 'g'), 'thethe')")
def _(t):
    return t("documents").where(F.contains(T.identity_fold(F.col("text")), F.lit("thethe"))).select("doc_id")


@query("F09_threshold_after_scoring", "SELECT * FROM (SELECT s_suppkey, round((rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100, 6) AS percentile FROM supplier) WHERE percentile >= 80")
def _(t):
    scored = R.with_percentile(t("supplier").select("s_suppkey", "s_acctbal"), [], "s_acctbal", "p")
    return scored.select("s_suppkey", F.round("p", 6).alias("percentile")).where("percentile >= 80")


@query(
    "F10_direction_label",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 'out' ELSE 'in' END AS direction, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'returned, closed' WHEN 'NF' THEN 'kept, closed'
    WHEN 'NO' THEN 'kept, open' ELSE 'other' END AS label FROM lineitem""",
)
def _(t):
    state = F.concat("l_returnflag", "l_linestatus")
    label = F.when(state == "AF", "returned, closed").when(state == "NF", "kept, closed").when(state == "NO", "kept, open").otherwise("other")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 2 == 0, "out").otherwise("in").alias("direction"), label.alias("label"))


@query("F12_finite", "SELECT event_id, CASE WHEN isfinite(value) THEN value + 0.0 END AS value FROM events")
def _(t):
    value = F.col("value")
    return t("events").select("event_id", F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value + 0.0).alias("value"))


@query("F13_rounded", "SELECT o_orderkey, round(o_totalprice::DECIMAL(18,2), 1)::DOUBLE AS price FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.round(F.col("o_totalprice").cast(MONEY), 1).cast("double").alias("price"))


@query("F15_haystack", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size >= 10 AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'bolt')")
def _(t):
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return t("part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3") & (F.col("p_size") >= 10) & F.contains(hay, F.lit("bolt"))).select("p_partkey")


@query("F16_people", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0 AND contains(lower(c_name), '1')")
def _(t):
    return t("customer").where((F.col("c_nationkey") == 3) & (F.col("c_acctbal") > 0) & F.contains(F.lower("c_name"), F.lit("1"))).select("c_custkey", "c_name")


@query("F17_cross_unit", f"WITH {EDGES} SELECT src, dst, weight FROM g JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst WHERE a.s_nationkey <> b.s_nationkey")
def _(t):
    unit = t("supplier").select("s_suppkey", "s_nationkey")
    return edges(t).join(unit.toDF("src", "ua"), "src").join(unit.toDF("dst", "ub"), "dst").where("ua <> ub").select("src", "dst", "weight")


@query("F19_node_text", "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(s_name || ' ' || n_name || ' ' || r_name), 'nation_1')")
def _(t):
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.where(F.contains(F.lower(F.concat_ws(" ", "s_name", "n_name", "r_name")), F.lit("nation_1"))).select("s_suppkey")


@query("J10_metric_floor", f"WITH {EDGES}, d AS (SELECT src, count(*)::BIGINT AS degree FROM u GROUP BY src) SELECT s_suppkey, s_acctbal + 0.0 AS s_acctbal, degree FROM supplier JOIN d ON src = s_suppkey WHERE degree >= 5")
def _(t):
    d = G.degrees(edges(t)).where("degree >= 5")
    return t("supplier").join(d, F.col("s_suppkey") == F.col("node")).select("s_suppkey", (F.col("s_acctbal") + 0.0).alias("s_acctbal"), "degree")


@query("J11_kinds_of_ends", f"WITH {EDGES} SELECT a.s_nationkey % 3 AS ka, b.s_nationkey % 3 AS kb, count(*)::BIGINT AS n, sum(weight) AS weight FROM g JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst WHERE a.s_nationkey % 3 IN (0, 1) AND b.s_nationkey % 3 IN (1, 2) GROUP BY ALL")
def _(t):
    kind = t("supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("k"))
    e = edges(t).join(kind.where("k IN (0, 1)").toDF("src", "ka"), "src").join(kind.where("k IN (1, 2)").toDF("dst", "kb"), "dst")
    return e.groupBy("ka", "kb").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(
    "J13_similar_pairs",
    """WITH w AS (SELECT l_suppkey AS e, l_partkey AS f, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS w FROM lineitem GROUP BY ALL), n AS (SELECT e, sum(w * w) AS n FROM w GROUP BY e),
    s AS (SELECT x.e AS a, y.e AS b, sum(x.w * y.w) AS s FROM w x JOIN w y ON x.f = y.f AND x.e < y.e GROUP BY ALL) SELECT * FROM (SELECT a, b, round(s / sqrt(p.n * q.n), 6) AS similarity FROM s JOIN n p ON a = p.e JOIN n q ON b = q.e) WHERE similarity >= 0.02""",
)
def _(t):
    w = t("lineitem").groupBy(F.col("l_suppkey").alias("e"), F.col("l_partkey").alias("f")).agg(money("l_quantity").alias("w"))
    return IR.shared_feature_pairs(w, "e", "f", "w").select("a", "b", F.round("similarity", 6).alias("similarity")).where("similarity >= 0.02")


@query(
    "J21_topic_shares",
    """WITH w AS (SELECT l_suppkey, p_type, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT l_suppkey, p_type, round(w / sum(w) OVER (PARTITION BY l_suppkey), 8) AS share FROM w""",
)
def _(t):
    w = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_type").agg(money("l_quantity").alias("w"))
    return w.select("l_suppkey", "p_type", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("l_suppkey")), 8).alias("share"))


@query("J24_inherit_position", "SELECT o_orderkey, c_acctbal + 0.0 AS x, coalesce(c_mktsegment, '') AS cluster FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(t):
    at = t("customer").where("c_acctbal > 0")
    return t("orders").join(at, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", (F.col("c_acctbal") + 0.0).alias("x"), F.coalesce("c_mktsegment", F.lit("")).alias("cluster"))


SPENT = "SELECT c_mktsegment AS s, c_custkey AS c, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def spent(t):
    per = t("orders").groupBy("o_custkey").agg(money("o_totalprice").alias("v"))
    return per.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("s"), F.col("c_custkey").alias("c"), "v")


@query("A06_hhi", f"WITH v AS ({SPENT}) SELECT s, round(sum(v * v) / (sum(v) * sum(v)), 8) AS hhi FROM v GROUP BY s")
def _(t):
    return spent(t).groupBy("s").agg(F.round(F.sum(F.col("v") * F.col("v")) / (F.sum("v") * F.sum("v")), 8).alias("hhi"))


@query("A07_top_share", f"WITH v AS ({SPENT}), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY v DESC, c) AS k FROM v) SELECT s, round(sum(CASE WHEN k <= 10 THEN v ELSE 0 END) / sum(v), 8) AS share FROM r GROUP BY s")
def _(t):
    # the largest ten come from a limited window, the total from a partial aggregation: no group is sorted whole
    v = spent(t)
    top = R.top_per_group(v, ["s"], [F.col("v").desc(), F.col("c")], 10).groupBy("s").agg(F.sum("v").alias("top"))
    return v.groupBy("s").agg(F.sum("v").alias("total")).join(top, "s").select("s", F.round(F.col("top") / F.col("total"), 8).alias("share"))


@query("A10_collaborations", f"WITH {EDGES} SELECT src AS person, s_name AS name, count(*)::BIGINT AS n, sum(weight) AS weight FROM u JOIN supplier ON s_suppkey = dst GROUP BY ALL")
def _(t):
    e = G.both_ways(edges(t)).join(t("supplier"), F.col("s_suppkey") == F.col("dst"))
    return e.groupBy(F.col("src").alias("person"), F.col("s_name").alias("name")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(
    "A13_first_titles",
    """WITH l AS (SELECT source, doc_id, trim(split_part(text, chr(10), 1)) AS title FROM documents), o AS (SELECT source, lower(title) AS k, min(doc_id) AS doc_id, arg_min(title, doc_id) AS title FROM l WHERE title <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM o) SELECT source, string_agg(title, ' | ' ORDER BY doc_id) AS titles FROM r WHERE n <= 5 GROUP BY source""",
)
def _(t):
    titles = t("documents").select("source", "doc_id", F.trim(F.substring_index("text", "\n", 1)).alias("title")).where("title <> ''")
    once = titles.groupBy("source", F.lower("title").alias("k")).agg(F.min(F.struct("doc_id", "title")).alias("f")).select("source", "f.*")
    first = R.top_per_group(once, ["source"], [F.col("doc_id")], 5)
    return first.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.struct("doc_id", "title")))["title"], " | ").alias("titles"))


@query("A15_landscape", "SELECT p_brand, p_type, count(DISTINCT l_suppkey)::BIGINT AS entities, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS mentions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(t):
    # one row per supplier first, so that the distinct count needs no second expansion
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    per = lines.groupBy("p_brand", "p_type", "l_suppkey").agg(F.sum(F.col("l_quantity").cast(MONEY)).alias("q"))
    return per.groupBy("p_brand", "p_type").agg(F.count("l_suppkey").alias("entities"), F.sum("q").cast("double").alias("mentions"))


@query(
    "A19_pair_ties",
    """WITH e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT a.s AS src, b.s AS dst, count(*)::BIGINT AS weight, max(year(o_orderdate))::BIGINT AS last_year, min(o_orderkey) AS first_order
    FROM e a JOIN e b ON a.o = b.o AND a.s < b.s JOIN orders ON o_orderkey = a.o GROUP BY ALL HAVING count(*) >= 4""",
)
def _(t):
    e = t("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    dated = t("orders").select(F.col("o_orderkey").alias("o"), long(F.year("o_orderdate")).alias("y"))
    pairs = e.toDF("o", "src").join(e.toDF("o", "dst"), "o").where("src < dst").join(dated, "o")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.max("y").alias("last_year"), F.min("o").alias("first_order")).where("weight >= 4")


@query("A20_entity_merge", "SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> '') AS first_type, arg_max(props, event_id) FILTER (props <> '{}') AS last_props, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM events GROUP BY user_id")
def _(t):
    # event types are a closed vocabulary, so the set of a user is small
    return t("events").groupBy("user_id").agg(
        F.min_by(F.when(F.col("event_type") != "", F.col("event_type")), F.when(F.col("event_type") != "", F.col("event_id"))).alias("first_type"),
        F.max_by(F.when(F.col("props") != "{}", F.col("props")), F.when(F.col("props") != "{}", F.col("event_id"))).alias("last_props"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("sources"),
    )


@query("A21_tally", "SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type")
def _(t):
    return t("part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_type")


@query("A22_graph_summary", f"WITH {EDGES} SELECT 'nodes' AS kind, count(DISTINCT src)::BIGINT AS n, NULL::DOUBLE AS weight FROM u UNION ALL SELECT 'edges ' || CASE WHEN a.s_nationkey = b.s_nationkey THEN 'within' ELSE 'across' END, count(*)::BIGINT, sum(weight) FROM g JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst GROUP BY 1")
def _(t):
    e, unit = edges(t).checkpoint(), t("supplier").select("s_suppkey", "s_nationkey")
    nodes = G.both_ways(e).select("src").distinct().agg(F.lit("nodes").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("double").alias("weight"))
    relation = F.concat(F.lit("edges "), F.when(F.col("ua") == F.col("ub"), "within").otherwise("across"))
    return nodes.unionByName(e.join(unit.toDF("src", "ua"), "src").join(unit.toDF("dst", "ub"), "dst").groupBy(relation.alias("kind")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight")))


@query("A24_campaign_counts", "SELECT o_orderstatus AS status, count(*)::BIGINT AS n, count(*) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS selected, count(DISTINCT o_custkey)::BIGINT AS recipients FROM orders GROUP BY o_orderstatus")
def _(t):
    return t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("selected"), F.countDistinct("o_custkey").alias("recipients"))


@query("A25_corpus_stats", "SELECT count(*)::BIGINT AS documents, count(DISTINCT coalesce(nullif(source, ''), lang))::BIGINT AS projects, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars = 0)::BIGINT AS empty FROM documents")
def _(t):
    return t("documents").agg(F.count("*").alias("documents"), F.countDistinct(F.coalesce(F.nullif("source", F.lit("")), "lang")).alias("projects"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") == 0).alias("empty"))


@query(
    "A26_benchmark_summary",
    """WITH d AS (SELECT lang AS task, source AS channel, rank() OVER (PARTITION BY lang, source ORDER BY n_chars DESC) AS place, quality FROM documents JOIN labels USING (doc_id)),
    q AS (SELECT task, channel, min(place) FILTER (quality = 1) AS first FROM d GROUP BY ALL), m AS (SELECT task, channel, round(coalesce(1.0::DOUBLE / first, 0), 8) AS mrr FROM q)
    SELECT task, channel, mrr, rank() OVER (PARTITION BY task ORDER BY mrr DESC)::BIGINT AS place FROM m""",
)
def _(t):
    d = t("documents").join(t("labels"), "doc_id").select(F.col("lang").alias("task"), F.col("source").alias("channel"), "n_chars", "quality")
    best = d.groupBy(F.col("task").alias("_t"), F.col("channel").alias("_c")).agg(F.max(F.when(F.col("quality") == 1, F.col("n_chars"))).alias("best"))
    ahead = d.join(best, F.col("task").eqNullSafe(F.col("_t")) & F.col("channel").eqNullSafe(F.col("_c")))
    m = ahead.groupBy("task", "channel").agg(F.max("best").alias("best"), F.count_if(F.col("n_chars") > F.col("best")).alias("ahead"))
    m = m.select("task", "channel", F.round(F.when(F.col("best").isNull(), 0.0).otherwise(1.0 / (F.col("ahead") + 1)), 8).alias("mrr"))
    return m.withColumn("place", R.competition_rank(["task"], "mrr").cast("long"))


@query("A28_best_mean", "WITH r AS (SELECT o_custkey, o_totalprice::DECIMAL(18,2) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT c_custkey, coalesce(round(sum(v)::DOUBLE / count(v), 4), 0.0) AS mean FROM customer LEFT JOIN r ON o_custkey = c_custkey AND k <= 3 GROUP BY c_custkey")
def _(t):
    best = R.top_per_group(t("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).groupBy("o_custkey").agg((money("o_totalprice") / F.count("*")).alias("m"))
    return t("customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.round("m", 4), F.lit(0.0)).alias("mean"))


@query("A30_external_degree", f"WITH {EDGES} SELECT src AS node, count(*)::BIGINT AS outside FROM u WHERE dst NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000) GROUP BY src")
def _(t):
    inside = t("supplier").where("s_acctbal > 4000").select(F.col("s_suppkey").alias("dst"))
    return G.both_ways(edges(t)).join(inside, "dst", "left_anti").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outside"))


@query("A31_drawn_degrees", f"WITH {EDGES}, d AS (SELECT src, count(*) AS n FROM u GROUP BY src) SELECT s_nationkey, count(*)::BIGINT AS nodes, count(*) FILTER (n IS NULL)::BIGINT AS isolated, coalesce(max(n), 0)::BIGINT AS most FROM supplier LEFT JOIN d ON src = s_suppkey GROUP BY s_nationkey")
def _(t):
    drawn = t("supplier").join(G.degrees(edges(t)), F.col("s_suppkey") == F.col("node"), "left")
    return drawn.groupBy("s_nationkey").agg(F.count("*").alias("nodes"), F.count_if(F.col("degree").isNull()).alias("isolated"), F.coalesce(F.max("degree"), F.lit(0)).alias("most"))


@query(
    "A32_spellings_folded",
    """SELECT lower(strip_accents(p_name)) AS name, count(*)::BIGINT AS n, min(p_size)::BIGINT AS smallest, max(p_size)::BIGINT AS largest, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1""",
)
def _(t):
    return t("part").groupBy(T.fold(F.col("p_name")).alias("name")).agg(F.count("*").alias("n"), long(F.min("p_size")).alias("smallest"), long(F.max("p_size")).alias("largest"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("A36_finite_total", "SELECT event_type, round(sum(CASE WHEN isfinite(value) THEN value ELSE 0 END), 3) AS total FROM events GROUP BY event_type")
def _(t):
    v = F.col("value")
    return t("events").groupBy("event_type").agg(F.round(F.sum(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(0.0)), 3).alias("total"))


@query("W04_competition", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST)::BIGINT AS place FROM part")
def _(t):
    return t("part").select("p_partkey", R.competition_rank(["p_brand"], "p_size").cast("long").alias("place"))


@query(
    "W06_either_top",
    f"""WITH {EDGES}, r AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM u) SELECT DISTINCT a AS src, b AS dst, weight FROM r WHERE k <= 3""",
)
def _(t):
    return G.strongest_neighbours(edges(t), 3).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").distinct()


@query(
    "W07_keywords",
    f"""WITH c AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest({WORDS}) AS term FROM documents) WHERE len(term) > 4 AND term NOT IN ('there', 'their', 'which') GROUP BY ALL)
    SELECT source, term, n::BIGINT AS n, k::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS k FROM c) WHERE k <= 3""",
)
def _(t):
    words = t("documents").select("source", F.explode(T.words(F.col("text"))).alias("term")).where("length(term) > 4 AND term NOT IN ('there', 'their', 'which')")
    counts = words.groupBy("source", "term").agg(F.count("*").alias("n"))
    return R.top_per_group(counts, ["source"], [F.col("n").desc(), F.col("term")], 3).withColumn("place", long("place"))


@query("W10_current_term", "SELECT o_orderkey, year(o_orderdate) = max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS is_current FROM orders")
def _(t):
    # the newest year of a customer by aggregation and join, so that a hot customer is not sorted
    o = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    newest = o.groupBy("o_custkey").agg(F.max("y").alias("last"))
    return o.join(newest, "o_custkey").select("o_orderkey", (F.col("y") == F.col("last")).alias("is_current"))


@query("W11_best_evidence", "SELECT user_id, event_id, value + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1")
def _(t):
    best = F.max_by(F.struct("event_id", (F.col("value") + 0.0).alias("value")), F.struct("value", (-F.col("event_id")).alias("tie")))
    return t("events").where("value IS NOT NULL").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.*")


@query(
    "W14_rank_with_exclusions",
    """WITH r AS (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE NOT contains(text, 'License')) SELECT lang, min(place)::BIGINT AS place FROM r WHERE source = 'src1' GROUP BY lang""",
)
def _(t):
    # the best relevant document's place is one more than the number before it: counts, no global sort
    d = t("documents").where("NOT contains(text, 'License')")
    best = d.where("source = 'src1'").groupBy("lang").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("id"))).alias("best"))
    before = F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("id")) > F.col("best")
    return d.join(best, "lang").groupBy("lang").agg((F.count_if(before) + 1).alias("place"))


@query("W18_compact_labels", "WITH s AS (SELECT c_nationkey AS label, count(*) AS n FROM customer GROUP BY ALL) SELECT label, n::BIGINT AS n, 'c' || (row_number() OVER (ORDER BY n DESC, label) - 1)::VARCHAR AS name FROM s")
def _(t):
    return G.compact_labels(t("customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("label")))


@query("O02_by_year", "SELECT o_orderpriority, year(o_orderdate)::BIGINT AS y, o_orderkey FROM orders ORDER BY o_orderpriority, y DESC NULLS LAST, o_orderkey")
def _(t):
    return t("orders").select("o_orderpriority", long(F.year("o_orderdate")).alias("y"), "o_orderkey").orderBy("o_orderpriority", F.col("y").desc_nulls_last(), "o_orderkey")


@query("O03_top_by_metric", f"WITH {EDGES}, d AS (SELECT src AS node, count(*)::BIGINT AS degree, sum(weight) AS strength FROM u GROUP BY src) SELECT * FROM d WHERE degree >= 2 ORDER BY strength DESC, node LIMIT 20")
def _(t):
    return G.degrees(edges(t)).where("degree >= 2").orderBy(F.col("strength").desc(), "node").limit(20)


@query("O04_nearest", f"WITH {EDGES} SELECT dst AS node, weight FROM u WHERE src = 7 ORDER BY weight DESC, dst LIMIT 10")
def _(t):
    return G.both_ways(edges(t).where("src = 7 OR dst = 7")).where("src = 7").select(F.col("dst").alias("node"), "weight").orderBy(F.col("weight").desc(), "node").limit(10)


@query("O06_shortest_name", "SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '1') ORDER BY length(c_name), c_name, c_custkey LIMIT 10")
def _(t):
    return t("customer").where(F.contains("c_name", F.lit("1"))).select("c_custkey", "c_name").orderBy(F.length("c_name"), "c_name", "c_custkey").limit(10)


@query("O07_audience_order", "SELECT s_suppkey, s_name, s_acctbal + 0.0 AS score FROM supplier ORDER BY score DESC, s_name LIMIT 25")
def _(t):
    return t("supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") + 0.0).alias("score")).orderBy(F.col("score").desc(), "s_name").limit(25)


@query("O08_nulls_last_both", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS v FROM supplier ORDER BY v ASC NULLS LAST, s_suppkey")
def _(t):
    return t("supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("v")).orderBy(F.col("v").asc_nulls_last(), "s_suppkey")


@query("U02_atoms", "SELECT 'order' AS kind, o_orderkey::VARCHAR AS id, o_orderpriority AS text FROM orders UNION ALL SELECT 'part', p_partkey::VARCHAR, p_name FROM part UNION ALL SELECT 'turn', conv_id || '/' || turn, text FROM conversations UNION ALL SELECT 'item', item_id::VARCHAR, text FROM benchmark")
def _(t):
    parts = [("order", "orders", "o_orderkey", "o_orderpriority"), ("part", "part", "p_partkey", "p_name"), ("turn", "conversations", "concat_ws('/', conv_id, turn)", "text"), ("item", "benchmark", "item_id", "text")]
    return reduce(lambda a, b: a.unionByName(b), [t(n).selectExpr(f"'{k}' AS kind", f"CAST({i} AS string) AS id", f"{x} AS text") for k, n, i, x in parts])


@query("U03_training_texts", "SELECT 'd' AS kind, doc_id AS id FROM documents WHERE length(trim(text)) >= 20 UNION ALL SELECT 'b', item_id FROM benchmark WHERE length(trim(text)) >= 20")
def _(t):
    long_enough = "length(trim(text)) >= 20"
    return t("documents").where(long_enough).selectExpr("'d' AS kind", "doc_id AS id").unionByName(t("benchmark").where(long_enough).selectExpr("'b' AS kind", "item_id AS id"))


PARTS = "f AS (SELECT l_suppkey AS e, l_partkey AS f, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS w FROM lineitem GROUP BY ALL)"


@query(
    "U05_shared_keys",
    f"WITH {PARTS} SELECT f AS part, x.e AS other, least(x.w, y.w) AS weight FROM f x JOIN f y USING (f) WHERE y.e = 1 AND x.e <> 1",
)
def _(t):
    w = t("lineitem").groupBy(F.col("l_suppkey").alias("e"), F.col("l_partkey").alias("f")).agg(money("l_quantity").alias("w"))
    mine = w.where("e = 1").select("f", F.col("w").alias("mine"))
    return w.where("e <> 1").join(mine, "f").select(F.col("f").alias("part"), F.col("e").alias("other"), F.least("w", "mine").alias("weight"))


@query("U06_wanted_and_had", f"WITH {PARTS}, want AS (SELECT f FROM f WHERE e = 1) SELECT e, count(*)::BIGINT AS shared, round(count(*) / (SELECT count(*) FROM want)::DOUBLE, 8) AS fit FROM f SEMI JOIN want USING (f) GROUP BY e")
def _(t):
    had = parts_of(t)
    want = had.where("e = 1").select("f")
    n = want.agg(F.count("*").alias("n"))  # one row
    return had.join(want, "f", "left_semi").groupBy("e").agg(F.count("*").alias("shared")).join(F.broadcast(n)).select("e", "shared", F.round(F.col("shared") / F.col("n"), 8).alias("fit"))


@query(
    "U07_unshared_lines",
    """WITH l AS (SELECT DISTINCT source, doc_id, trim(x, ' ') AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length(trim(x, ' ')) > 25),
    c AS (SELECT source, line, count(*) AS n FROM l GROUP BY ALL) SELECT doc_id, count(*) FILTER (n = 1)::BIGINT AS own, count(*) FILTER (n > 1)::BIGINT AS shared FROM l JOIN c USING (source, line) GROUP BY doc_id""",
)
def _(t):
    # lines meet by digest; counts are partial before the shuffle, so a line that many share is one row a partition
    lines = t("documents").select("source", "doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).where("length(line) > 25")
    keyed = lines.select("source", "doc_id", F.sha2(F.col("line").cast("binary"), 256).alias("line"))
    counts = keyed.groupBy("source", "line").agg(F.count("*").alias("n"))
    return keyed.join(counts, ["source", "line"]).groupBy("doc_id").agg(F.count_if(F.col("n") == 1).alias("own"), F.count_if(F.col("n") > 1).alias("shared"))


@query("U09_closure", "WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, b AS needs FROM r")
def _(t):
    e = t("supplier").selectExpr("concat('s', s_suppkey) AS node", "concat('n', s_nationkey) AS needs").union(t("nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)"))
    return G.transitive_closure(e)


@query("T01_clean_text", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[•·▪●◦‣]', ' ', 'g'), '\s+', ' ', 'g'))) AS cleaned FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(T.clean_text(F.col("text")).cast("binary"), 256).alias("cleaned"))


@query("T05_identity_fold", rf"SELECT doc_id, sha256(regexp_replace({FOLD}, '[^\p{{L}}\p{{N}}]', '', 'g')) AS folded FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(T.identity_fold(F.col("text")).cast("binary"), 256).alias("folded"))


@query("T08_given_first", "SELECT s_suppkey, n_name || ' ' || s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    named = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("s_suppkey", T.given_first(F.concat_ws(", ", "s_name", "n_name")).alias("name"))


@query("T12_entity_ids", r"SELECT p_partkey, CASE WHEN s <> '' THEN 'part:' || s END AS id FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)")
def _(t):
    return t("part").select("p_partkey", T.entity_id("part", F.col("p_name")).alias("id"))


@query("T13_underscore_slug", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(strip_accents(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def _(t):
    return t("part").select("p_partkey", T.slug(F.col("p_type"), "_").alias("slug"))


@query("T14_first_year", r"SELECT doc_id, try_cast(regexp_extract(text, '(?:19|20)\d{2}', 0) AS BIGINT) AS year FROM documents")
def _(t):
    return t("documents").select("doc_id", T.first_year(F.col("text")).alias("year"))


@query("T14_bounded_year", r"SELECT doc_id, CASE WHEN y BETWEEN 1950 AND 2029 THEN y END AS year FROM (SELECT doc_id, try_cast(regexp_extract(text, '\b((?:19|20)[0-9]{2})\b', 1) AS BIGINT) AS y FROM documents)")
def _(t):
    return t("documents").select("doc_id", T.bounded_year(F.col("text"), 1950, 2029).alias("year"))


@query("T14_leading_year", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate)::BIGINT END AS year FROM orders")
def _(t):
    said = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("in "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", T.leading_year(said).alias("year"))


@query("T28_marked_words", f"SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all({PLAIN}, '[a-z][a-z0-9_+.#/-]*[a-z0-9_]')) AS term FROM documents) GROUP BY term")
def _(t):
    return t("documents").select(F.explode(T.marked_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("T27_code_tokens", f"SELECT doc_id, len(list_filter(list_transform(regexp_extract_all({PLAIN}, '[a-z0-9][a-z0-9_+.#/-]*'), lambda x: rtrim(x, '._-/')), lambda x: len(x) > 1))::BIGINT AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", long(F.size(T.code_tokens(F.col("text")))).alias("tokens"))


@query("T30_rare_tokens", f"SELECT doc_id, len(regexp_extract_all({PLAIN}, '[a-z][a-z0-9+./-]{{2,}}'))::BIGINT AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", long(F.size(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z][a-z0-9+./-]{2,}"), F.lit(0)))).alias("tokens"))


@query(
    "T33_is_current",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN true WHEN NOT (o_orderpriority IN ('2-HIGH', '3-MEDIUM') OR o_orderstatus = 'O') THEN false WHEN o_orderstatus = 'F' THEN year(o_orderdate) + 1 >= 2000 WHEN o_orderstatus = 'O' OR o_orderpriority <> '2-HIGH' THEN year(o_orderdate) >= 1998
    ELSE o_orderstatus = 'O' AND o_orderpriority IN ('2-HIGH', '3-MEDIUM') END AS is_current FROM orders""",
)
def _(t):
    kind, state, year = F.col("o_orderpriority"), F.col("o_orderstatus"), F.year("o_orderdate")
    o = t("orders").withColumn("start", F.when((state == "O") | (kind != "2-HIGH"), year)).withColumn("end", F.when(state == "F", year + 1))
    return o.select("o_orderkey", T.is_current(kind == "1-URGENT", kind.isin("2-HIGH", "3-MEDIUM"), state == "O", F.col("start"), F.col("end"), 2000).alias("is_current"))


SKILLS = ["license", "software", "version", "data"]


@query("R19_gazetteer", " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, '{s}' AS skill, len(regexp_extract_all({PLAIN}, '\\b{s}\\b'))::BIGINT AS mentions FROM documents) WHERE mentions > 0" for s in SKILLS))
def _(t):
    return IR.gazetteer(t("documents"), "doc_id", T.fold(F.col("text")), {s: rf"\b{s}\b" for s in SKILLS})


@query(
    "R21_discovered_terms",
    f"""WITH p AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS term FROM documents), d AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), c AS (SELECT DISTINCT unnest({WORDS}) AS term FROM benchmark)
    SELECT term, df FROM d WHERE df >= 3 AND df <= 0.25 * (SELECT count(*) FROM documents) AND len(term) > 3 AND term NOT IN (SELECT term FROM c) AND NOT regexp_matches(term, '^(license|software|version)') ORDER BY df DESC, term LIMIT 60""",
)
def _(t):
    docs = t("documents")
    terms = docs.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("term")).where("length(term) > 3")
    n = docs.agg(F.count("*").alias("n"))  # one row
    covered = t("benchmark").select(F.explode(T.words(F.col("text"))).alias("term")).distinct()
    df = terms.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).where("df >= 3 AND df <= 0.25 * n AND NOT term RLIKE '^(license|software|version)'").join(covered, "term", "left_anti")
    return df.select("term", "df").orderBy(F.col("df").desc(), "term").limit(60)


@query(
    "R23_portfolio_scores",
    """WITH d AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY l_partkey), n AS (SELECT count(*)::DOUBLE AS n FROM orders), y AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity AS score, year(l_shipdate) AS y, p_type, least(1, greatest(0.05::DOUBLE, ln((n + 1) / (df + 1.0::DOUBLE)) / ln(n + 1))) AS rarity, l_partkey
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN d USING (l_partkey), n), x AS (SELECT *, CASE p_type WHEN 'PROMO' THEN 1.0::DOUBLE WHEN 'STANDARD' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END * pow(2.0::DOUBLE, -greatest(0, 2002 - y) / 6.0::DOUBLE) * rarity AS weight FROM y),
    s AS (SELECT l_suppkey, 'trajectory' AS scope, weight, score FROM x WHERE p_type <> 'PROMO' UNION ALL SELECT l_suppkey, 'current', weight, score FROM x WHERE y >= 2000) SELECT l_suppkey, scope, round(sum(weight * score) / sum(weight), 6) AS score, count(*)::BIGINT AS atoms FROM s GROUP BY ALL""",
)
def _(t):
    n = t("orders").agg(F.count("*").cast("double").alias("n"))  # one row
    df = t("lineitem").select("l_partkey", "l_orderkey").distinct().groupBy(F.col("l_partkey").alias("p")).agg(F.count("*").alias("df"))
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(df, F.col("p") == F.col("l_partkey")).join(F.broadcast(n))
    rarity = F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.log((F.col("n") + 1) / (F.col("df") + 1.0)) / F.log(F.col("n") + 1)))
    specificity = F.when(F.col("p_type") == "PROMO", 1.0).when(F.col("p_type") == "STANDARD", 0.8).otherwise(0.5)
    x = lines.select("l_suppkey", "p_type", F.year("l_shipdate").alias("y"), (specificity * T.recency_weight(F.year("l_shipdate"), 2002) * rarity).alias("weight"), F.col("l_quantity").alias("score"))
    scope = F.filter(F.array(F.when(F.col("p_type") != "PROMO", "trajectory"), F.when(F.col("y") >= 2000, "current")), lambda v: v.isNotNull())
    s = x.withColumn("scope", F.explode(scope))
    return s.groupBy("l_suppkey", "scope").agg(F.round(F.sum(F.col("weight") * F.col("score")) / F.sum("weight"), 6).alias("score"), F.count("*").alias("atoms"))


@query(
    "N01_affiliations",
    """SELECT 'person:' || s_suppkey::VARCHAR AS src, 'org:nation-' || n_nationkey::VARCHAR AS dst, 'affiliated_with' AS relation FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'org:nation-' || n_nationkey::VARCHAR, 'org:region-' || r_regionkey::VARCHAR, 'part_of' FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def _(t):
    people = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("'person:' || s_suppkey AS src", "'org:nation-' || n_nationkey AS dst", "'affiliated_with' AS relation")
    return people.unionByName(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("'org:nation-' || n_nationkey AS src", "'org:region-' || r_regionkey AS dst", "'part_of' AS relation"))


@query("N11_adjacency", f"WITH {EDGES} SELECT src, dst, weight FROM u")
def _(t):
    return G.both_ways(edges(t))


@query(
    "N20_structure",
    f"""WITH {EDGES} SELECT src AS node, count(*)::BIGINT AS degree, sum(weight) AS strength, round(sum(CASE WHEN a.s_nationkey <> b.s_nationkey THEN weight ELSE 0 END) / sum(weight), 8) AS bridging
    FROM u JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst GROUP BY src""",
)
def _(t):
    e = edges(t)
    labels = t("supplier").select("s_suppkey", "s_nationkey").toDF("node", "community")
    return G.degrees(e).join(G.bridging(e, labels), "node").select("node", "degree", "strength", F.round("bridging", 8).alias("bridging"))


@query("N24_indexed_edges", f"WITH {EDGES} SELECT src, dst, weight FROM g WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000) AND dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000)")
def _(t):
    known = t("supplier").where("s_acctbal > 4000").select("s_suppkey")
    return edges(t).join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").select("src", "dst", "weight")


@query(
    "Q01_open_orders",
    """WITH p AS (SELECT o_orderkey, o_custkey, round((rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY o_orderstatus) * 100, 6) AS percentile FROM orders)
    SELECT o_orderkey, c_name, n_name, percentile FROM p JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE percentile >= 90""",
)
def _(t):
    ranked = R.with_percentile(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], "o_totalprice", "p")
    best = ranked.select("o_orderkey", "o_custkey", F.round("p", 6).alias("percentile")).where("percentile >= 90")
    return best.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "percentile")


@query(
    "Q02_people",
    """SELECT s_suppkey, s_name, n_name, count(DISTINCT l_orderkey)::BIGINT AS orders, coalesce(sum(l_extendedprice::DECIMAL(18,2)), 0)::DOUBLE AS revenue FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""",
)
def _(t):
    per = t("lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("r")).groupBy("l_suppkey").agg(F.count("*").alias("orders"), F.sum("r").cast("double").alias("revenue"))
    people = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(per, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return people.select("s_suppkey", "s_name", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"))


@query(
    "Q07_portfolio",
    """SELECT l_suppkey, year(l_shipdate)::BIGINT AS y, p_type, count(*)::BIGINT AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def _(t):
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("l_suppkey", long(F.year("l_shipdate")).alias("y"), "p_type").agg(F.count("*").alias("n"), money("l_quantity").alias("quantity"))


@query(
    "Q08_grouped_neighbours",
    f"""WITH {EDGES}, r AS (SELECT src, s_nationkey AS grp, dst, weight, row_number() OVER (PARTITION BY src, s_nationkey ORDER BY weight DESC, dst) AS k, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS j FROM u JOIN supplier ON s_suppkey = dst) SELECT src, grp, dst, weight FROM r WHERE k <= 120 AND j <= 400""",
)
def _(t):
    e = G.both_ways(edges(t)).join(t("supplier"), F.col("s_suppkey") == F.col("dst")).select("src", F.col("s_nationkey").alias("grp"), "dst", "weight")
    shown = R.top_per_group(e, ["src"], [F.col("weight").desc(), F.col("dst")], 400).drop("place")
    return R.top_per_group(shown, ["src", "grp"], [F.col("weight").desc(), F.col("dst")], 120).drop("place")


@query(
    "Q09_search",
    """WITH h AS (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey::VARCHAR, p_name FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY length(name), name, id) AS k FROM h WHERE contains(lower(strip_accents(name)), 'er')) SELECT kind, id, name FROM r WHERE k <= 8""",
)
def _(t):
    kinds = [("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name")]
    found = reduce(lambda a, b: a.unionByName(b), [t(n).selectExpr(f"'{k}' AS kind", f"CAST({i} AS string) AS id", f"{x} AS name") for k, n, i, x in kinds])
    found = found.where(F.contains(T.fold(F.col("name")), F.lit("er")))
    return R.top_per_group(found, ["kind"], [F.length("name"), F.col("name"), F.col("id")], 8).drop("place")
