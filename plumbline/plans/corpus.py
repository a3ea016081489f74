"""Views and atoms of a corpus, rules on their texts and states, the audience of a campaign, and files that are exchanged."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import matching as MT
from plumbline.operators import ranking as R
from plumbline.operators import records as RC
from plumbline.plans.measures import FOLD
from plumbline.plans.recording import DEAL, WORK, leaves, table_rows
from plumbline.plans.registry import query
from plumbline.plans.relational import MONEY, long
from plumbline.sources import files as FS

TITLE, LINES = "split_part(x, chr(10), 1)", "string_split(x, chr(10))"
VIEWS_SQL = {
    "title": TITLE,
    "body": f"substr(x, length({TITLE}) + 2)",
    "closing": f"{LINES}[-1]",
    "second": f"coalesce({LINES}[2], '')",
    "title_folded": FOLD.replace("(text)", f"({TITLE})"),
    "title_key": rf"regexp_replace(lower(strip_accents({TITLE})), '[^\p{{L}}\p{{N}}]', '', 'g')",
    "ends": f"{TITLE} || ' / ' || {LINES}[-1]",
    "one_line": "replace(x, chr(10), ' ')",
    "sourced": "coalesce(source, '') || ': ' || x",
    "whole": "x",
}


@query("C01_views", "WITH d AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{v}' AS view, md5({e}) AS text FROM d" for v, e in VIEWS_SQL.items()))
def _(t):
    d = t("documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("x"))
    title, lines = F.substring_index("x", "\n", 1), F.split("x", "\n")
    views = {
        "title": title, "body": F.substring(F.col("x"), F.length(title) + 2, F.length("x")), "closing": F.element_at(lines, -1), "second": F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")),
        "title_folded": T.fold(title), "title_key": T.identity_fold(title), "ends": F.concat(title, F.lit(" / "), F.element_at(lines, -1)), "one_line": F.replace("x", F.lit("\n"), F.lit(" ")),
        "sourced": F.concat(F.coalesce("source", F.lit("")), F.lit(": "), "x"), "whole": F.col("x"),
    }
    return d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.md5(e.cast("binary")).alias("text")) for v, e in views.items()])).alias("v")).select("doc_id", "v.*")


@query(
    "C02_atoms",
    """WITH w AS (SELECT l_orderkey, 'work' AS family, 'Part ' || l_partkey AS title, min(year(l_shipdate)) AS year FROM lineitem WHERE l_tax > 0 GROUP BY ALL), a AS (SELECT * FROM w WHERE length(title) >= 7 UNION ALL SELECT o_orderkey, 'deal', 'Order ' || o_orderkey, NULL FROM orders)
    SELECT l_orderkey, family, title, year::BIGINT AS year, family = 'work' AND year >= 2000 AS is_active FROM a""",
)
def _(t):
    r = RC.shape(leaves(t), "l_orderkey", [WORK, DEAL], "given").withColumn("year", T.first_year(F.col("year")))
    least = F.when(F.col("family") == "work", 7).otherwise(3)
    a = r.where(F.length("title") >= least).groupBy("l_orderkey", "family", T.identity_fold(F.col("title")).alias("key")).agg(F.min("title").alias("title"), F.min("year").alias("year"))
    return a.select("l_orderkey", "family", "title", "year", ((F.col("family") == "work") & (F.col("year") >= 2000)).alias("is_active")).withColumn("is_active", F.when(F.col("family") == "deal", F.lit(False)).otherwise(F.col("is_active")))


@query("C03_table_atoms", "SELECT 'PRJ' || o_orderkey AS code, o_custkey, o_orderpriority AS title, year(o_orderdate)::BIGINT AS year FROM orders WHERE o_orderkey >= 100")
def _(t):
    p = RC.project_rows(table_rows(t), ["o_custkey"], "nth")
    return p.where(F.col("code").rlike(r"^[A-Z]{2,}\d{3,}$")).groupBy("code", "o_custkey").agg(F.min("title").alias("title"), long(F.min("year")).alias("year"))


@query("C04_short_atoms", "SELECT 'profile_summary' AS kind, doc_id AS id, md5(trim(regexp_replace(regexp_replace(text, '[•·▪●◦‣]', ' ', 'g'), '\\s+', ' ', 'g'))) AS text FROM documents WHERE length(trim(regexp_replace(regexp_replace(text, '[•·▪●◦‣]', ' ', 'g'), '\\s+', ' ', 'g'))) >= 40 UNION ALL SELECT 'opportunity', item_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM benchmark")
def _(t):
    d = t("documents").select(F.lit("profile_summary").alias("kind"), F.col("doc_id").alias("id"), T.clean_text(F.col("text")).alias("text")).where("length(text) >= 40")
    b = t("benchmark").select(F.lit("opportunity").alias("kind"), F.col("item_id").alias("id"), T.clean_text(F.col("text")).alias("text"))
    return d.unionByName(b).select("kind", "id", F.md5(F.col("text").cast("binary")).alias("text"))


def facet_queries(profile, facets: dict[str, list[str]], fallback: str):
    """One text per facet: the fields that are filled, joined, else the fallback's text."""
    said = lambda names: F.array_join(F.filter(F.array(*map(F.col, names)), lambda v: v.isNotNull() & (F.trim(v) != "")), "; ")
    return [F.coalesce(F.nullif(T.clean_text(said(names)), F.lit("")), F.col(fallback)).alias(facet) for facet, names in facets.items()]


@query("C05_facet_queries", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_name ELSE c_mktsegment END AS methods, c_mktsegment || '; ' || n_name AS domain, n_name AS skills, c_name AS overall FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    p = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("method", F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).otherwise(" "))
    return p.select("c_custkey", *facet_queries(p, {"methods": ["method"], "domain": ["c_mktsegment", "n_name"], "skills": ["n_name"], "overall": []}, "c_name"))


def rank_sql(by, v):
    part = f"PARTITION BY {by} " if by else ""
    both = f"PARTITION BY {by}, {v}" if by else f"PARTITION BY {v}"
    return f"(rank() OVER ({part}ORDER BY {v}) + (count(*) OVER ({both}) - 1) / 2.0::DOUBLE) / count(*) OVER ({part}) * 100"


AUDIENCE = f"""l AS (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_returnflag, {rank_sql('', 'l_extendedprice')} AS p FROM lineitem), s AS (SELECT l_suppkey, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS every, coalesce(sum(l_quantity::DECIMAL(18,2)) FILTER (year(l_shipdate) >= 2000), 0)::DOUBLE AS recent FROM lineitem GROUP BY l_suppkey),
    c AS (SELECT l_suppkey, {rank_sql('', 'recent')} AS cur, {rank_sql('', 'every')} AS tra FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY p DESC, l_orderkey, l_partkey, l_linenumber) AS k FROM l WHERE p >= 50 AND l_returnflag <> 'N'),
    a AS (SELECT q.l_suppkey, round(0.5::DOUBLE * max(p) + 0.3::DOUBLE * max(cur) + 0.2::DOUBLE * max(tra), 3) AS score, count(*)::BIGINT AS qualifying, string_agg(l_orderkey || '-' || l_partkey, '; ' ORDER BY k) FILTER (k <= 3) AS evidence FROM q JOIN c USING (l_suppkey) JOIN supplier ON s_suppkey = q.l_suppkey WHERE s_acctbal > 0 GROUP BY q.l_suppkey)"""


def audience(t):
    """Suppliers in reach of a campaign: lines above the middle qualify, and a supplier's score blends its best line with its recent and all-time places."""
    lines = R.with_percentile(t("lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_extendedprice"), [], "l_extendedprice", "p")
    q = F.col("l_quantity").cast(MONEY)
    s = t("lineitem").groupBy("l_suppkey").agg(F.sum(q).cast("double").alias("every"), F.coalesce(F.sum(F.when(F.year("l_shipdate") >= 2000, q)), F.lit(0)).cast("double").alias("recent")).checkpoint()
    placed = R.with_percentile(R.with_percentile(s, [], "recent", "cur"), [], "every", "tra").select("l_suppkey", "cur", "tra")
    wanted = lines.where("p >= 50 AND l_returnflag <> 'N'")
    order = [F.col("p").desc(), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")]
    top = R.top_per_group(wanted, ["l_suppkey"], order, 3).groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws("-", "l_orderkey", "l_partkey").alias("id")))), lambda x: x["id"]), "; ").alias("evidence"))
    best = wanted.groupBy("l_suppkey").agg(F.max("p").alias("best"), F.count("*").alias("qualifying"))
    reach = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    joined = best.join(reach, "l_suppkey").join(placed, "l_suppkey").join(top, "l_suppkey")
    return joined.select("l_suppkey", F.round(0.5 * F.col("best") + 0.3 * F.col("cur") + 0.2 * F.col("tra"), 3).alias("score"), "qualifying", "evidence")


@query("C07_audience", f"WITH {AUDIENCE} SELECT * FROM a")
def _(t):
    return audience(t)


@query("Q12_audience_preview", f"WITH {AUDIENCE} SELECT l_suppkey, s_name, score FROM a JOIN supplier ON s_suppkey = l_suppkey ORDER BY score DESC, s_name LIMIT 20")
def _(t):
    return audience(t).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("l_suppkey", "s_name", "score").orderBy(F.col("score").desc(), "s_name").limit(20)


@query("C08_evidence_lists", "WITH r AS (SELECT l_suppkey, CASE WHEN year(l_shipdate) >= 2000 THEN 'current' ELSE 'past' END AS scope, l_orderkey || '-' || l_partkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY year(l_shipdate) >= 2000 DESC, l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS k FROM lineitem) SELECT l_suppkey, string_agg(scope || ' ' || id, '; ' ORDER BY k) AS evidence FROM r WHERE k <= 5 GROUP BY l_suppkey")
def _(t):
    e = t("lineitem").withColumn("now", F.year("l_shipdate") >= 2000)
    top = R.top_per_group(e, ["l_suppkey"], [F.col("now").desc(), F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")], 5)
    said = F.concat(F.when(F.col("now"), "current").otherwise("past"), F.lit(" "), F.concat_ws("-", "l_orderkey", "l_partkey"))
    return top.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("e")))), lambda x: x["e"]), "; ").alias("evidence"))


@query("C09_readings", "SELECT l_orderkey, string_agg(l_returnflag || '=' || n, ';' ORDER BY l_returnflag) AS reading FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def _(t):
    n = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    read = F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_returnflag", "n"))))
    return n.groupBy("l_orderkey").agg(read.alias("m")).select("l_orderkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("reading"))


STATE = "CASE event_type WHEN 'signup' THEN 'sent' WHEN 'click' THEN 'replied' WHEN 'purchase' THEN 'indicated' WHEN 'error' THEN 'declined' END"


@query(
    "C11_outcomes",
    f"""WITH s AS (SELECT user_id, event_id, ts, {STATE} AS state FROM events WHERE event_type <> 'view'), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM s),
    h AS (SELECT max(struct_pack(ts := ts, event_id := event_id)).event_id AS holder FROM s WHERE state = 'indicated'), r AS (SELECT user_id, min(ts) AS replied_at FROM s WHERE state <> 'sent' GROUP BY user_id)
    SELECT l.user_id, CASE WHEN state = 'indicated' AND event_id <> (SELECT holder FROM h) THEN 'open' ELSE state END AS state, ts AS updated_at, replied_at FROM l LEFT JOIN r ON l.user_id = r.user_id WHERE k = 1""",
)
def _(t):
    return outcomes(t("events").where("event_type <> 'view'"))


def outcomes(events):
    """Where each conversation stands: its last state, when it was first answered; only the last one indicated is, those before are open again."""
    state = F.create_map(*[F.lit(x) for e in {"signup": "sent", "click": "replied", "purchase": "indicated", "error": "declined"}.items() for x in e])[F.col("event_type")]
    s = events.select("user_id", "event_id", "ts", state.alias("state"))
    last = s.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "state")).alias("l"), F.min(F.when(F.col("state") != "sent", F.col("ts"))).alias("replied_at"))
    holder = s.where("state = 'indicated'").agg(F.max(F.struct("ts", "event_id")).alias("h")).select(F.col("h.event_id").alias("holder"))  # one row
    kept = F.when((F.col("l.state") == "indicated") & (F.col("l.event_id") != F.coalesce("holder", F.lit(-1))), "open").otherwise(F.col("l.state"))
    return last.join(F.broadcast(holder)).select("user_id", kept.alias("state"), F.col("l.ts").alias("updated_at"), "replied_at")


@query("T15_project_code", "SELECT o_orderkey, year(o_orderdate)::BIGINT AS year FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey >= 100")
def _(t):
    code = F.concat(F.when(F.col("o_orderstatus") == "F", "P").otherwise("PRJ"), F.col("o_orderkey").cast("string"), F.lit("-"), F.year("o_orderdate").cast("string"))
    return t("orders").select("o_orderkey", T.project_year(code).alias("year")).where("year IS NOT NULL")


@query("T17_match_key", "SELECT p_partkey, trim(regexp_replace(upper(p_name || ' & ' || p_brand), '[^A-Z0-9]+', ' ', 'g')) AS key FROM part")
def _(t):
    return t("part").select("p_partkey", MT.match_key(F.concat("p_name", F.lit(" &amp; "), "p_brand")).alias("key"))


def known_parts(t):
    """Distinct names of parts with the smallest key, as a list to match against."""
    return t("part").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("unit")).agg(F.min("p_partkey").alias("known_id"))


@query("T18_scores")
def _(t):
    return MT.candidates(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("unit")), known_parts(t), "name", "unit").withColumn("score", F.round("score", 6))


@query("T19_decided", "WITH k AS (SELECT p_name, p_brand, min(p_partkey) AS id FROM part GROUP BY ALL), x AS (SELECT p.p_partkey, count(*) AS n, min(k.id) AS id FROM part p JOIN k ON k.p_name = p.p_name AND (contains(k.p_brand, p.p_brand) OR contains(p.p_brand, k.p_brand)) GROUP BY p.p_partkey) SELECT p_partkey AS id, CASE WHEN n = 1 THEN id END AS known_id, CASE WHEN n = 1 THEN 'exact' ELSE 'ambiguous_exact' END AS verdict, 1.0::DOUBLE AS score FROM x")
def _(t):
    scored = MT.candidates(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("unit")), known_parts(t), "name", "unit")
    return MT.decided(scored)


@query("T20_options", "SELECT DISTINCT n_name AS asked, n_name AS option FROM nation WHERE n_name NOT IN (SELECT a.n_name FROM nation a JOIN nation b ON b.n_name LIKE a.n_name || '%' AND a.n_name <> b.n_name) UNION ALL SELECT DISTINCT a.n_name, a.n_name FROM nation a JOIN nation b ON b.n_name LIKE a.n_name || '%' AND a.n_name <> b.n_name")
def _(t):
    names = t("nation").select("n_name")
    return MT.best_option(names.toDF("asked"), names.toDF("option"))


@query("T22_first_leaf", "SELECT l_orderkey, l_linestatus AS venue, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def _(t):
    bare = RC.Family("work", "works.*", {"title": ["venue", "year"], "venue": ["journal", "VENUE"]}, untitled=True)
    return RC.shape(leaves(t), "l_orderkey", [bare], "given").groupBy("l_orderkey", "venue").agg(F.count("*").alias("n"))


@query("T23_matching_leaves", "SELECT l_orderkey, string_agg(CASE WHEN l_discount > 0.05 THEN 'special ' || l_linenumber || '; ' ELSE '' END || 'general ' || l_linenumber || '; general 1', ' | ' ORDER BY l_partkey * 1000000000 + l_suppkey * 1000 + l_linenumber * 100 + l_quantity::INT) AS found FROM lineitem GROUP BY l_orderkey")
def _(t):
    found = RC.matching_leaves(leaves(t), "l_orderkey", [WORK], "^(special|general)$")
    place = F.regexp_extract("prefix", r"\[(\d+)\]$", 1).cast("long")
    lists = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.array_join("texts", "; ").alias("x")))), lambda x: x["x"])
    return found.groupBy("l_orderkey").agg(F.array_join(lists, " | ").alias("found"))


KINDS = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'article' WHEN 'AO' THEN 'technical' WHEN 'NF' THEN 'sigaa_project' WHEN 'NO' THEN 'opportunity' WHEN 'RF' THEN 'orientation' ELSE 'other' END"


@query("T32_specificity", f"SELECT l_suppkey, round(avg(CASE {KINDS} WHEN 'article' THEN 0.78 WHEN 'technical' THEN 0.55 WHEN 'sigaa_project' THEN 0.92 WHEN 'opportunity' THEN 1 WHEN 'orientation' THEN 0.7 ELSE 0.5 END::DOUBLE), 8) AS specificity FROM lineitem GROUP BY l_suppkey")
def _(t):
    said = F.concat("l_returnflag", "l_linestatus")
    kind = F.when(said == "AF", "article").when(said == "AO", "technical").when(said == "NF", "sigaa_project").when(said == "NO", "opportunity").when(said == "RF", "orientation").otherwise("other")
    return t("lineitem").groupBy("l_suppkey").agg(F.round(F.avg(T.specificity(kind)), 8).alias("specificity"))


@query("T34_states", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'concluded' WHEN 'O' THEN 'ongoing' WHEN 'P' THEN 'inactive' END AS state FROM orders")
def _(t):
    said = F.when(F.col("o_orderstatus") == "F", "Concluido").when(F.col("o_orderstatus") == "O", "EM_ANDAMENTO").otherwise("desativado")
    return t("orders").select("o_orderkey", T.project_state(said).alias("state"))


@query("T35_json_round_trip", "SELECT l_suppkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS skills FROM lineitem GROUP BY l_suppkey")
def _(t):
    stored = t("lineitem").groupBy("l_suppkey").agg(F.to_json(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus")))).alias("json"))
    return stored.select("l_suppkey", F.array_join(F.from_json("json", "array<string>"), ",").alias("skills"))


@query("F06_path_families", "SELECT l_orderkey, 2 * count(*)::BIGINT AS names FROM lineitem GROUP BY l_orderkey")
def _(t):
    low = F.lower("path")
    return leaves(t).where(low.like("%authors%") & (low.like("%fullname%") | low.like("%citation%"))).groupBy("l_orderkey").agg(F.count("*").alias("names"))


@query("F07_leaf_prefilter", "SELECT 'year' AS leaf, count(*)::BIGINT AS n FROM lineitem UNION ALL SELECT 'venue', count(*) FROM lineitem UNION ALL SELECT 'name', count(*) FROM orders")
def _(t):
    leaf = F.lower(F.element_at(RC.path_segments(F.col("path")), -1))
    return leaves(t).withColumn("leaf", leaf).where(F.col("leaf").isin("year", "venue", "name")).groupBy("leaf").agg(F.count("*").alias("n"))


@query("J23_display_names", "SELECT s_suppkey, s_name AS display FROM supplier")
def _(t):
    s = t("supplier")
    leaf = s.select("s_suppkey", "s_name").unionByName(s.select((F.col("s_suppkey") + 1).alias("s_suppkey"), "s_name"))  # a namesake's leaf too
    held = s.select("s_suppkey", F.upper("s_name").alias("stored"))
    return held.join(leaf, "s_suppkey").where(T.fold(F.col("stored")) == T.fold(F.col("s_name"))).select("s_suppkey", F.col("s_name").alias("display"))


@query("O09_rank_list", f"WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN round({rank_sql('o_orderstatus', 'o_totalprice')}, 6) END AS percentile FROM orders), p AS (SELECT o_orderkey, percentile, n FROM r JOIN (SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey) SELECT * FROM p ORDER BY percentile DESC NULLS LAST, n DESC, o_orderkey LIMIT 200")
def _(t):
    ranked = R.with_percentile(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], "o_totalprice", "p")
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    listed = ranked.join(n, "o_orderkey").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.round("p", 6)).alias("percentile"), "n")
    return listed.orderBy(F.col("percentile").desc_nulls_last(), F.col("n").desc(), "o_orderkey").limit(200)  # the page shown


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("Q13_state", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::BIGINT AS n FROM {n}" for n in TABLES))
def _(t):
    out = [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in TABLES]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


@query(
    "Q14_report",
    """SELECT 'orders' AS section, o_orderstatus AS item, count(*)::DOUBLE AS value FROM orders GROUP BY ALL UNION ALL SELECT 'revenue', n_name, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL
    UNION ALL SELECT 'segment', c_mktsegment, count(DISTINCT o_custkey)::DOUBLE FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
)
def _(t):
    orders = t("orders").groupBy(F.col("o_orderstatus").alias("item")).agg(F.count("*").cast("double").alias("value"))
    places = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.col("n_name").alias("item"))
    per = t("lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("r"))
    revenue = per.join(places, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("item").agg(F.sum("r").cast("double").alias("value"))
    buyers = t("orders").select(F.col("o_custkey").alias("c_custkey")).distinct().join(t("customer"), "c_custkey").groupBy(F.col("c_mktsegment").alias("item")).agg(F.count("*").cast("double").alias("value"))
    tag = lambda n, df: df.select(F.lit(n).alias("section"), "item", "value")
    return tag("orders", orders).unionByName(tag("revenue", revenue)).unionByName(tag("segment", buyers))


@query("S07_json_lines", "SELECT event_id, user_id, event_type, value, props FROM events")
def _(t):
    e = t("events").select("event_id", "user_id", "event_type", "value", "props")
    return FS.json_lines(e, FS.exchange_dir(e.sparkSession))


@query("S10_json_path", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def _(t):
    return t("events").select("event_id", F.coalesce(F.expr("try_variant_get(try_parse_json(props), '$.k', 'string')"), F.lit("")).alias("k"))


@query("S11_robust_csv", "SELECT c_custkey::VARCHAR AS c_custkey, c_name || ' é;' AS c_name, c_mktsegment, NULL::VARCHAR AS missing FROM customer")
def _(t):
    c = t("customer").select("c_custkey", F.concat("c_name", F.lit(" é;")).alias("c_name"), F.col("c_mktsegment").alias(" C_MktSegment "))
    path = FS.exchange_dir(c.sparkSession)
    c.write.option("header", True).option("sep", ";").option("encoding", "iso-8859-1").csv(path)
    return FS.robust_csv(c.sparkSession, f"{path}/*.csv", ["c_custkey", "c_name", "c_mktsegment", "missing"])


@query("S12_keyed_ledger", "SELECT l_orderkey, l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_quantity::INT AS name, l_returnflag AS state, l_quantity::INT::BIGINT AS slots FROM lineitem")
def _(t):
    name = F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int"))
    entry = F.struct(name.alias("key"), F.struct(F.col("l_returnflag").alias("state"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" slots")).alias("vacancies")).alias("value"))
    ledger = t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))
    return FS.keyed_objects(ledger, "l_orderkey", "json", "state string, vacancies string").select("l_orderkey", "name", "state", T.first_int(F.col("vacancies")).alias("slots"))


@query("S14_upsert", "SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderstatus = 'F' THEN 'seen before' ELSE 'new' END AS discovered FROM orders")
def _(t):
    now = t("orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit("new").alias("discovered"))
    before = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", F.lit("seen before").alias("first_seen"))
    return now.join(before, "o_orderkey", "left").select("o_orderkey", "price", F.coalesce(F.nullif("first_seen", F.lit("")), F.col("discovered")).alias("discovered"))


@query("S16_name_export", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities, string_agg(DISTINCT o_orderstatus, '; ' ORDER BY o_orderstatus) AS states, count(*)::BIGINT AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY o_custkey")
def _(t):
    each = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    return t("orders").groupBy("o_custkey").agg(each("o_orderpriority").alias("priorities"), each("o_orderstatus").alias("states"), F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("total"))


@query("S17_decoded", "SELECT page_id, md5(html) AS text FROM pages")
def _(t):
    return t("pages").select("page_id", F.md5(FS.decoded_page(F.encode("html", "UTF-8")).cast("binary")).alias("text"))


@query("S20_script_objects", "SELECT event_id, props AS object, NULL::VARCHAR AS error FROM events")
def _(t):
    e = t("events").select("event_id", F.concat(F.lit("<script>var other = {}; var curriculo = "), "props", F.lit('; x = "}";</script>')).alias("html"))
    return FS.script_objects(e, "event_id", "html", "curriculo")


@query("S27_repaired", "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS html FROM pages")
def _(t):
    return t("pages").select("page_id", F.md5(FS.repaired(F.col("html")).cast("binary")).alias("html"))


@query(
    "S09_imported",
    r"""SELECT c_custkey, lower(regexp_extract('Contato: ' || replace(c_name, '#', '.') || '@Example.COM; tel', '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', 0)) AS email, coalesce(n_name, '') AS unit, c_name || '; ' || upper(c_name) AS aliases FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def _(t):
    c = t("customer").withColumn("eletronico_endereco", F.concat(F.lit("Contato: "), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.COM; tel")))
    unit = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.nullif("n_name", F.lit("")).alias("unit"))
    email = F.lower(F.regexp_extract("eletronico_endereco", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", 0))
    return c.join(unit, "c_nationkey", "left").select("c_custkey", email.alias("email"), F.coalesce("unit", F.lit("")).alias("unit"), F.array_join(F.array_distinct(F.array("c_name", F.upper("c_name"))), "; ").alias("aliases"))


@query("S15_ledger_files", "SELECT o_orderkey AS order_id, o_orderstatus AS state, o_orderpriority AS priority FROM orders")
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"))
    path = FS.exchange_dir(o.sparkSession)
    o.write.option("header", True).csv(path)
    return o.sparkSession.read.option("header", True).schema(o.schema).csv(path)


@query("S34_campaign_export", """SELECT l_orderkey, '{"parts":[' || string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) || ']}' AS details FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey""")
def _(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.array_sort(F.collect_set("l_partkey")).alias("parts"))).alias("details"))
    path = FS.exchange_dir(lines.sparkSession)
    lines.write.option("header", True).option("escape", '"').csv(path)
    return lines.sparkSession.read.option("header", True).option("escape", '"').schema(lines.schema).csv(path)


@query("T10_compatible", "SELECT s_suppkey, true AS same FROM supplier")
def _(t):
    key = lambda c: F.split(T.normalize_person_name(F.col(c)), " ")
    s = t("supplier").select("s_suppkey", key("s_name").alias("long")).withColumn("short", F.transform("long", lambda w, i: F.when(i == 0, F.substring(w, 1, 1)).otherwise(w)))
    return s.select("s_suppkey", T.ordered_subset(F.col("short"), F.col("long")).alias("same"))


@query("A09_report_gini", "WITH r AS (SELECT s_nationkey, l_suppkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY v) AS i FROM r) SELECT s_nationkey, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*)::DOUBLE, 8) AS gini FROM k GROUP BY s_nationkey")
def _(t):
    r = t("lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("v")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    k = r.withColumn("i", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("v")))
    n = F.count("*")
    return k.groupBy("s_nationkey").agg(F.round(2 * F.sum(F.col("i") * F.col("v")) / (n * F.sum("v")) - (n + 1) / n, 8).alias("gini"))
