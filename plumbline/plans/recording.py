"""Typed records: shaped from leaves and from the rows of tables, with people, areas, careers and what is asked of them."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import records as RC
from plumbline.plans.registry import query
from plumbline.plans.relational import long

#: Shipped parts as works: the form is the return flag, under which they stand.
WORK = RC.Family("work", "works.*", {"title": ["title"], "year": ["year"], "venue": ["journal", "venue"]}, aliases={"A": "article", "N": "chapter"})
DEAL = RC.Family("deal", "deal", {"title": ["title", "name"], "status": ["status"]}, form="order")


def leaves(t):
    """An order as JSON leaves (l_orderkey, ordinal, path, text): a deal, and a work for each line item with people and areas."""
    at = F.col("l_partkey") * 1_000_000_000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")
    base = F.concat(F.lit("$['works']['"), "l_returnflag", F.lit("']["), at.cast("string"), F.lit("]"))
    no = F.col("l_linenumber").cast("string")
    found = [
        ("['details']['Title']", F.when(F.col("l_tax") > 0, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).otherwise("")),
        ("['year']", F.year("l_shipdate").cast("string")),
        ("['venue']", F.col("l_linestatus")),
        ("['Authors'][0]['fullname']", F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))),
        ("['Authors'][0]['order']", no),
        ("['Authors'][0]['lead']", F.when(F.col("l_linestatus") == "O", "sim").otherwise("nao")),
        ("['Authors'][1]['citation']", F.concat(F.lit("Clerk "), no)),
        ("['area1']['special']", F.when(F.col("l_discount") > 0.05, F.concat(F.lit("special "), no)).otherwise("")),
        ("['area1']['general']", F.concat(F.lit("general "), no)),
        ("['area2']['general']", F.lit("general 1")),
    ]
    # a place in the list is exploded, not ten structs: the JVM never compiles a method as large as theirs
    nth = F.explode(F.array(*map(F.lit, range(len(found))))).alias("i")
    text = reduce(lambda c, i: c.when(F.col("i") == i, found[i][1]), range(1, len(found)), F.when(F.col("i") == 0, found[0][1]))
    based = t("lineitem").select("*", at.alias("at"), base.alias("base")).select("*", nth)
    lines = based.select("l_orderkey", (F.col("at") * 100 + F.col("i")).alias("ordinal"), F.concat("base", F.get(F.array(*[F.lit(p) for p, _ in found]), F.col("i"))).alias("path"), text.alias("text"))
    deal = [("['deal']['name']", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))), ("['deal']['status']", F.col("o_orderstatus")), ("['DEAL']['status']", F.lit("x")), ("[0]['deal']", F.lit("x"))]
    heads = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit("$" + p).alias("path"), v.alias("text")) for i, (p, v) in enumerate(deal)])).alias("x")).select("l_orderkey", "x.*")
    return lines.unionByName(heads)


BASE = "'$[''works''][''' || l_returnflag || '''][' || (l_partkey * 1000000000 + l_suppkey * 1000 + l_linenumber * 100 + l_quantity::INT)::VARCHAR || ']'"
ID = "substr(sha1(l_orderkey::VARCHAR || '|work|given|' || {}), 1, 16)".format(BASE)
FORM = "CASE l_returnflag WHEN 'A' THEN 'article' WHEN 'N' THEN 'chapter' ELSE lower(l_returnflag) END"
PEOPLE = "SELECT *, 'Supplier ' || l_suppkey AS name, l_linenumber AS ordinal, CASE WHEN l_linestatus = 'O' THEN 'responsible' ELSE 'author' END AS role FROM lineitem UNION ALL SELECT *, 'Clerk ' || l_linenumber, 2, 'author' FROM lineitem"


@query("X01_spec_match", "SELECT 'work' AS family, l_returnflag AS wildcard, (sum(8 + CASE WHEN l_tax > 0 THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END))::BIGINT AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'deal', '', 3 * count(*) FROM orders")
def _(t):
    return RC.under(leaves(t), "l_orderkey", [WORK, DEAL]).groupBy("family", "wildcard").agg(F.count("*").alias("n"))


@query("X03_forms", f"SELECT 'work' AS family, {FORM} AS form, count(*)::BIGINT AS n FROM lineitem WHERE l_tax > 0 GROUP BY ALL UNION ALL SELECT 'deal', 'order', count(*) FROM orders")
def _(t):
    return RC.shape(leaves(t), "l_orderkey", [WORK, DEAL], "given").groupBy("family", "form").agg(F.count("*").alias("n"))


@query("X04_shaped", f"SELECT {ID} AS record_id, l_orderkey, 'work' AS family, {FORM} AS form, 'Part ' || l_partkey AS title, year(l_shipdate)::BIGINT AS year, l_linestatus AS venue, NULL AS status FROM lineitem WHERE l_tax > 0 UNION ALL SELECT substr(sha1(o_orderkey::VARCHAR || '|deal|given|$[''deal'']'), 1, 16), o_orderkey, 'deal', 'order', 'Order ' || o_orderkey, NULL, NULL, o_orderstatus FROM orders")
def _(t):
    return RC.shape(leaves(t), "l_orderkey", [WORK, DEAL], "given").withColumn("year", long(T.first_year(F.col("year")))).drop("prefix")


def people(t):
    return RC.people(leaves(t), "l_orderkey", [WORK], {"authors": "author", "team": "member"}, ["fullname", "citation"], ["order"], "lead")


@query("X05_people", f"SELECT l_orderkey, md5({BASE}) AS place, ordinal::BIGINT AS ordinal, name, role FROM ({PEOPLE})")
def _(t):
    return people(t).select("l_orderkey", F.md5(F.col("prefix").cast("binary")).alias("place"), long("ordinal").alias("ordinal"), "name", "role")


AREAS = "CASE WHEN l_discount > 0.05 THEN 'special ' || l_linenumber || '; general 1' WHEN l_linenumber = 1 THEN 'general 1' ELSE 'general ' || l_linenumber || '; general 1' END"


@query("X06_areas", f"SELECT l_orderkey, md5({BASE}) AS place, {AREAS} AS areas FROM lineitem")
def _(t):
    found = RC.areas(leaves(t), "l_orderkey", [WORK], "area", ["special", "sub", "area", "general"])
    return found.select("l_orderkey", F.md5(F.col("prefix").cast("binary")).alias("place"), F.array_join("areas", "; ").alias("areas"))


TIES = "SELECT l_suppkey, l_returnflag AS kind, l_linestatus AS role, year(l_shipdate) AS start, CASE WHEN l_linestatus = 'F' OR year(l_shipdate) < 1998 THEN year(l_shipdate) + 1 END AS stop, l_orderkey * 1000000 + l_partkey AS ordinal FROM lineitem"


@query(
    "X07_career",
    f"""WITH x AS ({TIES}), c AS (SELECT *, stop IS NULL AS is_open, row_number() OVER (PARTITION BY l_suppkey ORDER BY stop IS NULL DESC, start DESC, coalesce(stop, 9999) DESC, ordinal DESC) AS k FROM x)
    SELECT l_suppkey, min(start)::BIGINT AS year, (CASE WHEN NOT bool_or(is_open) THEN max(stop) END)::BIGINT AS year_end, CASE WHEN bool_or(is_open) THEN 'current' ELSE 'past' END AS status, max(kind) FILTER (k = 1) AS form, max(role) FILTER (k = 1) AS nature FROM c GROUP BY l_suppkey""",
)
def _(t):
    start = F.year("l_shipdate")
    end = F.when((F.col("l_linestatus") == "F") | (start < 1998), start + 1)
    ties = t("lineitem").select("l_suppkey", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("role"), start.alias("start"), end.alias("end"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("ordinal"))
    return RC.career(ties, ["l_suppkey"]).withColumn("year", long("year")).withColumn("year_end", long("year_end"))


def table_rows(t):
    """Orders as a customer's page of rows: a row for each year, then its orders."""
    o = t("orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("at"), F.array(F.concat(F.lit("PRJ"), F.col("o_orderkey").cast("string")), "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "60 h").otherwise("detalhes"), "o_orderstatus").alias("cells"))
    terms = o.select("o_custkey", "y").distinct().select("o_custkey", "y", F.lit(-1).cast("long").alias("at"), F.array(F.concat(F.col("y").cast("string"), F.lit(".1"))).alias("cells"))
    heads = o.select("o_custkey").distinct().select("o_custkey", F.lit(0).alias("y"), F.lit(-2).cast("long").alias("at"), F.array(F.lit("Código"), F.lit("Título"), F.lit("Área")).alias("cells"))
    every = o.unionByName(terms).unionByName(heads)
    return every.select("o_custkey", (F.col("y") * 100_000_000_000 + F.col("at")).alias("nth"), "cells")


@query("X08_table_courses", "SELECT o_custkey, 'PRJ' || o_orderkey AS code, o_orderpriority AS title, year(o_orderdate)::BIGINT AS year, CASE WHEN year(o_orderdate) = max(year(o_orderdate)) OVER (PARTITION BY o_custkey) THEN 'current' ELSE 'past' END AS status, CASE WHEN o_orderstatus = 'F' THEN '60 h' ELSE '' END AS hours FROM orders")
def _(t):
    return RC.course_rows(table_rows(t).where("cells[0] <> 'Código'"), ["o_custkey"], "nth").withColumn("year", long("year"))


@query("X08_table_projects", "SELECT o_custkey, 'PRJ' || o_orderkey AS code, o_orderpriority AS title, year(o_orderdate)::BIGINT AS year, CASE WHEN o_orderstatus = 'F' THEN '60 h' END AS area FROM orders")
def _(t):
    return RC.project_rows(table_rows(t), ["o_custkey"], "nth").withColumn("year", long("year"))


@query("X08_table_mentoring", "SELECT p_partkey, p_name AS title, p_size::BIGINT + 2000 AS year, p_type AS org, p_brand AS coordinator FROM part")
def _(t):
    p = t("part")
    titled = p.select("p_partkey", F.lit(1).alias("nth"), F.array(F.concat("p_name", F.lit(" (Coordenador(a): "), "p_brand", F.lit(")")), "p_type").alias("cells"))
    terms = p.select("p_partkey", F.lit(0).alias("nth"), F.array(F.concat((F.col("p_size") + 2000).cast("string"), F.lit(".2"))).alias("cells"))
    return RC.mentoring_rows(titled.unionByName(terms), ["p_partkey"], "nth").withColumn("year", long("year"))


def records(t):
    """Works with people, areas and the text to search."""
    shaped = RC.shape(leaves(t), "l_orderkey", [WORK], "given")
    by = ["l_orderkey", "family", "prefix"]
    names = people(t).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "role"))).alias("people"))
    found = RC.areas(leaves(t), "l_orderkey", [WORK], "area", ["special", "sub", "area", "general"])
    r = shaped.join(names, by, "left").join(found, by, "left")
    text = RC.search_text([F.col("title"), F.col("venue"), F.col("form"), F.array_join("areas", " "), F.array_join(F.transform("people", lambda p: p["name"]), " ")])
    return r.withColumn("search_text", text).withColumn("year", T.first_year(F.col("year")))


NAMES = "CASE WHEN l_linenumber < 2 OR (l_linenumber = 2 AND false) THEN 'Supplier ' || l_suppkey || ' Clerk ' || l_linenumber WHEN l_linenumber = 2 THEN 'Clerk 2 Supplier ' || l_suppkey ELSE 'Clerk ' || l_linenumber || ' Supplier ' || l_suppkey END"
TEXT = f"lower('Part ' || l_partkey || ' ' || l_linestatus || ' ' || {FORM} || ' ' || replace({AREAS}, ';', '') || ' ' || {NAMES})"


@query("X09_search_text", f"SELECT {ID} AS record_id, {TEXT} AS search_text FROM lineitem WHERE l_tax > 0")
def _(t):
    return records(t).select("record_id", "search_text")


@query("X10_stored_people", f"SELECT {ID} AS record_id, l_orderkey, ordinal::BIGINT AS ordinal, name, trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')) AS normalized_name, role, year(l_shipdate)::BIGINT AS year FROM ({PEOPLE}) WHERE l_tax > 0")
def _(t):
    p = records(t).select("record_id", "l_orderkey", "year", F.explode("people").alias("p"))
    return p.select("record_id", "l_orderkey", long("p.ordinal").alias("ordinal"), "p.name", T.normalize_person_name(F.col("p.name")).alias("normalized_name"), "p.role", long("year").alias("year"))


@query(
    "Q06_records",
    f"""WITH r AS (SELECT {ID} AS record_id, l_orderkey, {FORM} AS form, 'Part ' || l_partkey AS title, year(l_shipdate)::BIGINT AS year, {TEXT} AS x FROM lineitem WHERE l_tax > 0)
    SELECT record_id, l_orderkey, form, title, year, count(*) OVER ()::BIGINT AS total FROM r WHERE contains(x, 'special') AND year BETWEEN 1997 AND 1999 AND form = 'article' ORDER BY year DESC, title, record_id LIMIT 200""",
)
def _(t):
    hits = records(t).where(F.contains("search_text", F.lit("special")) & F.col("year").between(1997, 1999) & (F.col("form") == "article")).select("record_id", "l_orderkey", "form", "title", long("year").alias("year")).checkpoint()
    return hits.withColumn("total", F.lit(hits.count()).cast("long")).orderBy(F.col("year").desc(), "title", "record_id").limit(200)  # a page of 200


@query(
    "Q06_facets",
    f"""WITH r AS (SELECT {FORM} AS form, year(l_shipdate) AS year, l_linestatus AS venue FROM lineitem WHERE l_tax > 0) SELECT 'form' AS facet, form AS value, count(*)::BIGINT AS n FROM r GROUP BY ALL
    UNION ALL SELECT 'venue', venue, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'span', min(year) || '-' || max(year), count(*) FROM r""",
)
def _(t):
    r = RC.shape(leaves(t), "l_orderkey", [WORK], "given").select("form", "year", "venue")
    tall = r.select(F.stack(F.lit(3), F.lit("form"), F.col("form"), F.lit("venue"), F.col("venue"), F.lit("year"), F.col("year")).alias("facet", "value")).groupBy("facet", "value").agg(F.count("*").alias("n"))
    span = tall.where("facet = 'year'").agg(F.concat_ws("-", F.min("value"), F.max("value")).alias("value"), F.sum("n").alias("n")).select(F.lit("span").alias("facet"), "value", "n")
    return tall.unionByName(span)
