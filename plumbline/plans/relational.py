"""Joins, filters, aggregations, sorts and set operations of the catalogue, on the given tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.text import digest_id, first_int
from plumbline.operators.ranking import latest
from plumbline.plans.registry import query

MONEY = "decimal(18,2)"


def long(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


@query("J01_left_using", "SELECT o_orderkey, o_orderstatus, count(l_orderkey)::BIGINT AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def _(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t("orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"))


@query(
    "J02_left_constant_keys",
    "SELECT o_orderkey, min(l_linenumber)::BIGINT AS first_returned FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY o_orderkey",
)
def _(t):
    right = t("lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F'").groupBy("l_orderkey").agg(F.min("l_linenumber").cast("long").alias("first_returned"))
    return t("orders").select("o_orderkey").join(right, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query(
    "J03_wide_pivot",
    """SELECT s_suppkey, s_name, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS returned_a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS returned_n,
    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned_r FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL""",
)
def _(t):
    wide = t("lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count()
    return t("supplier").join(wide, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "s_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"returned_{c.lower()}") for c in "ANR"])


@query(
    "J04_inner_three_keys",
    "SELECT a.user_id, a.event_type, a.props, count(*)::BIGINT AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.props = b.props AND a.event_id < b.event_id GROUP BY ALL",
)
def _(t):
    # pairs of equal keys are n (n - 1) / 2: counted, never joined
    return t("events").where("event_id IS NOT NULL").groupBy("user_id", "event_type", "props").agg(F.count("*").alias("n")).where("n > 1").select("user_id", "event_type", "props", F.expr("n * (n - 1) div 2").alias("pairs"))


@query(
    "J05_other_end",
    """WITH e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), p AS (SELECT a.s AS x, b.s AS y, count(*)::BIGINT AS w FROM e a JOIN e b ON a.o = b.o AND a.s < b.s GROUP BY ALL)
    SELECT CASE WHEN x = 1 THEN y ELSE x END AS s_suppkey, s_name, CASE WHEN x = 1 THEN 'out' ELSE 'in' END AS direction, w AS weight FROM p JOIN supplier ON s_suppkey = CASE WHEN x = 1 THEN y ELSE x END WHERE x = 1 OR y = 1""",
)
def _(t):
    pairs = t("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    ties = pairs.where("s = 1").select("o").join(pairs.where("s <> 1"), "o").groupBy("s").agg(F.count("*").alias("weight"))
    return ties.join(t("supplier"), F.col("s") == F.col("s_suppkey")).select("s_suppkey", "s_name", F.when(F.col("s") > 1, "out").otherwise("in").alias("direction"), "weight")


@query("J06_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("J07_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "J08_scalar_counts",
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')::BIGINT AS n_final,
    (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')::BIGINT AS n_urgent FROM customer""",
)
def _(t):
    counts = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))
    return t("customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_orders", "n_final", "n_urgent")])


@query("J09_first_related", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS top_order FROM customer")
def _(t):
    top = latest(t("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return t("customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("top_order"))


@query(
    "J12_top_lookup",
    """WITH b AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC NULLS LAST, l_suppkey, l_orderkey) AS k FROM lineitem)
    SELECT p_partkey, coalesce(l_suppkey, -1) AS best_supplier FROM part LEFT JOIN b ON p_partkey = l_partkey AND k = 1""",
)
def _(t):
    best = latest(t("lineitem"), ["l_partkey"], [F.col("l_quantity").desc_nulls_last(), F.col("l_suppkey"), F.col("l_orderkey")])
    return t("part").join(best, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("l_suppkey", F.lit(-1)).alias("best_supplier"))


@query(
    "J14_pairs_in_group",
    "WITH e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT a.s AS src, b.s AS dst, count(*)::BIGINT AS weight FROM e a JOIN e b ON a.o = b.o AND a.s < b.s GROUP BY ALL HAVING count(*) >= 3",
)
def _(t):
    return shared_orders(t).where("weight >= 3")


def shared_orders(t):
    """Suppliers that share orders: an order has few lines, so its pairs are few."""
    e = t("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    return e.toDF("o", "src").join(e.toDF("o", "dst"), "o").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query(
    "J15_star_pairs",
    "SELECT n_nationkey AS hub, c_mktsegment AS spoke, count(*)::BIGINT AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
)
def _(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("hub"), F.col("c_mktsegment").alias("spoke")).agg(F.count("*").alias("weight"))


@query(
    "J17_first_pattern",
    """SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 1 WHEN p_type LIKE '%BRASS%' THEN 2 WHEN p_type LIKE 'S%' THEN 3 WHEN p_type LIKE '%' THEN 4 END::BIGINT AS spec FROM part""",
)
def _(t):
    spec = F.when(F.col("p_type").startswith("PROMO"), 1).when(F.col("p_type").contains("BRASS"), 2).when(F.col("p_type").startswith("S"), 3).when(F.col("p_type").isNotNull(), 4)
    return t("part").select("p_partkey", spec.cast("long").alias("spec"))


@query(
    "J18_inherit",
    "SELECT s_suppkey, coalesce(nullif(CASE WHEN s_acctbal > 5000 THEN s_name ELSE '' END, ''), n_name) AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
)
def _(t):
    own = F.when(F.col("s_acctbal") > 5000, F.col("s_name")).otherwise("")
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce(F.nullif(own, F.lit("")), F.col("n_name")).alias("label"))


@query("J22_dangling", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return lines.join(t("part").where("p_size < 10"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(t("supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")


@query(
    "F01_all_terms",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')",
)
def _(t):
    text = F.lower("text")
    return t("documents").where(text.contains("the") & text.contains("license")).select("doc_id")


@query("F02_record_filters", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND n_chars BETWEEN 500 AND 4000")
def _(t):
    return t("documents").where(F.col("lang").eqNullSafe("en") & F.col("source").isin("src1", "src2") & F.col("n_chars").between(500, 4000)).select("doc_id", "source", "n_chars")


@query(
    "F03_year_range",
    """WITH s AS (SELECT o_orderkey, year(o_orderdate)::BIGINT AS y0, max(year(l_shipdate))::BIGINT AS y1 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT o_orderkey, y0, y1 FROM s WHERE coalesce(y1, y0) >= 1997 AND y0 <= 1998""",
)
def _(t):
    last = t("lineitem").groupBy("l_orderkey").agg(F.max(F.year("l_shipdate")).cast("long").alias("y1"))
    spans = t("orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y0")).join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return spans.where((F.coalesce("y1", "y0") >= 1997) & (F.col("y0") <= 1998))


@query(
    "F08_audience_builder",
    """WITH n AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders GROUP BY o_custkey) SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN n ON o_custkey = c_custkey
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND n_regionkey IN (0, 1, 2, 3) AND c_acctbal > 1000 AND coalesce(c_name, '') <> '' AND coalesce(n, 0) >= 2 AND coalesce(v, 0) >= 100000 AND lower(c_name || ' ' || c_mktsegment || ' ' || n_name) LIKE '%customer%' AND lower(c_name || ' ' || c_mktsegment || ' ' || n_name) LIKE '%nation%'
    AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 450000)""",
)
def _(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast(MONEY)).alias("v"))
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(n, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey")
    return audience(people, t("orders"), segments=["BUILDING", "MACHINERY"], regions=[0, 1, 2, 3], balance=1000, named=True, least_orders=2, least_value=100_000, keywords=["customer", "nation"], has=["o_totalprice > 100000", "o_orderpriority LIKE '1%'"], lacks=["o_orderstatus = 'P' AND o_totalprice > 450000"]).select("c_custkey")


def audience(people, orders, segments=None, regions=None, balance=None, named=False, least_orders=None, least_value=None, keywords=(), has=(), lacks=()):
    """People who meet every clause given; a clause that is not given asks nothing."""
    text = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment", "n_name"))
    clauses = [
        F.col("c_mktsegment").isin(segments) if segments else None,
        F.col("n_regionkey").isin(regions) if regions else None,
        F.col("c_acctbal") > balance if balance is not None else None,
        F.coalesce("c_name", F.lit("")) != "" if named else None,
        F.coalesce("n", F.lit(0)) >= least_orders if least_orders is not None else None,
        F.coalesce("v", F.lit(0)) >= least_value if least_value is not None else None,
        *[F.contains(text, F.lit(k.lower())) for k in keywords],
    ]
    for clause in clauses:
        people = people if clause is None else people.where(clause)
    for how, tests in (("left_semi", has), ("left_anti", lacks)):
        for test in tests:
            people = people.join(orders.where(test).select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), how)
    return people


@query("F11_defaults", "SELECT event_type, coalesce(nullif(props, '{}'), 'none') AS props, coalesce(value, 0) + 0.0 AS value, event_id FROM events")
def _(t):
    return t("events").select("event_type", F.coalesce(F.nullif(F.col("props"), F.lit("{}")), F.lit("none")).alias("props"), (F.coalesce("value", F.lit(0.0)) + F.lit(0.0)).alias("value"), "event_id")


@query("F14_pending", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND c_name <> '' ORDER BY o_totalprice DESC, c_name")
def _(t):
    return t("orders").where("o_orderstatus <> 'F'").join(t("customer").where("c_name <> ''"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "c_name")


@query("F18_group_lens", "SELECT user_id, max(value) AS best FROM events GROUP BY user_id HAVING max(value) >= 90 OR max(value) < 50")
def _(t):
    return t("events").groupBy("user_id").agg(F.max("value").alias("best")).where("best >= 90 OR best < 50")


@query("F20_next_moves", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    done = t("orders").where("o_orderstatus = 'P'").select("o_custkey")
    return t("orders").where("o_orderstatus = 'O'").join(done, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query(
    "A01_facets",
    """WITH l AS (SELECT l_returnflag AS family, l_linestatus AS form, year(l_shipdate) AS y, l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT 'family' AS facet, family AS a, '' AS b, count(*)::BIGINT AS n, min(y)::BIGINT AS first_year, max(y)::BIGINT AS last_year FROM l GROUP BY family UNION ALL SELECT 'form', family, form, count(*), NULL, NULL FROM l GROUP BY ALL
    UNION ALL SELECT 'year', y::VARCHAR, family, count(*), NULL, NULL FROM l GROUP BY ALL UNION ALL SELECT * FROM (SELECT 'org', l_suppkey::VARCHAR, '', count(*) AS n, NULL, NULL FROM l GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 40)
    UNION ALL SELECT * FROM (SELECT 'venue', p_brand, '', count(*) AS n, NULL, NULL FROM l WHERE family = 'A' GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 40)""",
)
def _(t):
    lines = t("lineitem").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    x = lines.select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("form"), F.year("l_shipdate").alias("y"), "l_suppkey", "p_brand")
    # one aggregation for the closed facets; the open ones keep their 40 most frequent values
    sets = x.groupingSets([["family"], ["family", "form"], ["family", "y"]], "family", "form", "y").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.min(x["y"]).alias("lo"), F.max(x["y"]).alias("hi"))
    facet = F.when(F.col("g") == 3, "family").when(F.col("g") == 1, "form").otherwise("year")
    closed = sets.select(
        facet.alias("facet"), F.when(F.col("g") == 2, F.col("y").cast("string")).otherwise(F.col("family")).alias("a"), F.when(F.col("g") == 1, F.col("form")).when(F.col("g") == 2, F.col("family")).otherwise("").alias("b"),
        "n", F.when(F.col("g") == 3, long("lo")).alias("first_year"), F.when(F.col("g") == 3, long("hi")).alias("last_year"),
    )
    none = F.lit(None).cast("long")
    top = lambda df, facet, c: df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), c).limit(40).select(F.lit(facet).alias("facet"), F.col(c).cast("string").alias("a"), F.lit("").alias("b"), "n", none.alias("first_year"), none.alias("last_year"))
    return closed.unionByName(top(x, "org", "l_suppkey")).unionByName(top(x.where("family = 'A'"), "venue", "p_brand"))


@query(
    "A02_people_around",
    """SELECT l_suppkey AS person, count(*)::BIGINT AS n, min(year(l_shipdate))::BIGINT AS first_year, max(year(l_shipdate))::BIGINT AS last_year, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS roles
    FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1) AND l_suppkey <> 1 GROUP BY l_suppkey""",
)
def _(t):
    mine = t("lineitem").where("l_suppkey = 1").select("l_orderkey")
    others = t("lineitem").where("l_suppkey <> 1").join(mine, "l_orderkey", "left_semi")
    year = F.year("l_shipdate").cast("long")
    return others.groupBy(F.col("l_suppkey").alias("person")).agg(F.count("*").alias("n"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("roles"))


@query(
    "A03_metrics",
    """SELECT s_suppkey, count(l_orderkey)::BIGINT AS n_lines, count(*) FILTER (l_returnflag = 'R')::BIGINT AS n_returned, count(*) FILTER (l_returnflag = 'A')::BIGINT AS n_accepted, count(*) FILTER (l_returnflag = 'N')::BIGINT AS n_kept, count(*) FILTER (l_linestatus = 'O')::BIGINT AS n_open,
    count(DISTINCT p_type)::BIGINT AS n_types, count(DISTINCT p_brand)::BIGINT AS n_brands, count(DISTINCT l_orderkey)::BIGINT AS n_orders, max(year(l_shipdate))::BIGINT AS latest, min(year(l_shipdate))::BIGINT AS earliest, coalesce(sum(l_quantity::DECIMAL(18,2)), 0)::DOUBLE AS quantity,
    coalesce(sum(l_extendedprice::DECIMAL(18,2)), 0)::DOUBLE AS revenue, count(*) FILTER (p_type = 'PROMO' AND year(l_shipdate) >= 2000)::BIGINT AS n_current FROM supplier LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON s_suppkey = l_suppkey GROUP BY s_suppkey""",
)
def _(t):
    lines = t("lineitem").join(t("part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    flag, year = F.col("l_returnflag"), F.year("l_shipdate")
    total = lambda c: F.sum(F.col(c).cast(MONEY)).cast("double")
    counts = {"n_lines": F.count("*"), "n_returned": F.count_if(flag == "R"), "n_accepted": F.count_if(flag == "A"), "n_kept": F.count_if(flag == "N"), "n_open": F.count_if(F.col("l_linestatus") == "O"), "n_current": F.count_if((F.col("p_type") == "PROMO") & (year >= 2000))}
    # types and brands are closed vocabularies; orders are counted from one row each
    sets = {"n_types": F.size(F.collect_set("p_type")), "n_brands": F.size(F.collect_set("p_brand"))}
    agg = lines.groupBy("l_suppkey").agg(*[c.alias(n) for n, c in (counts | sets).items()], long(F.max(year)).alias("latest"), long(F.min(year)).alias("earliest"), total("l_quantity").alias("quantity"), total("l_extendedprice").alias("revenue"))
    orders = t("lineitem").select("l_suppkey", "l_orderkey").distinct().groupBy(F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n_orders"))
    out = t("supplier").join(agg, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(orders, F.col("s_suppkey") == F.col("s"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*counts, *sets, "n_orders"]]
    return out.select("s_suppkey", *zero, "latest", "earliest", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("quantity", "revenue")])


@query(
    "A04_global_metrics",
    """WITH o AS (SELECT count(*)::DOUBLE AS orders, round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS open_share, count(DISTINCT o_custkey)::DOUBLE AS customers, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders),
    l AS (SELECT count(*)::DOUBLE AS lines, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, count(DISTINCT l_suppkey)::DOUBLE AS suppliers, count(DISTINCT l_partkey)::DOUBLE AS parts, round(avg((l_returnflag = 'R')::INT), 8)::DOUBLE AS returned_share, min(year(l_shipdate))::DOUBLE AS first_year, max(year(l_shipdate))::DOUBLE AS last_year FROM lineitem),
    r AS (SELECT l_suppkey, sum(l_extendedprice::DECIMAL(18,2)) AS r FROM lineitem GROUP BY l_suppkey), c AS (SELECT round(max(r)::DOUBLE / sum(r)::DOUBLE, 8) AS top_share, round(sum(r::DOUBLE * r::DOUBLE) / (sum(r)::DOUBLE * sum(r)::DOUBLE), 8) AS hhi FROM r)
    UNPIVOT (SELECT * FROM o, l, c) ON orders, open_share, customers, value, lines, quantity, suppliers, parts, returned_share, first_year, last_year, top_share, hhi INTO NAME metric VALUE value""",
)
def _(t):
    o, l = t("orders"), t("lineitem")
    n = lambda c: c.cast("double")
    share = lambda c: F.round(F.avg(n(c)), 8)
    distinct = lambda df, c: df.select(c).distinct().agg(n(F.count(c)).alias(c))
    deals = o.agg(n(F.count("*")).alias("orders"), share(F.col("o_orderstatus") == "O").alias("open_share"), n(F.sum(F.col("o_totalprice").cast(MONEY))).alias("value"))
    lines = l.agg(n(F.count("*")).alias("lines"), n(F.sum(F.col("l_quantity").cast(MONEY))).alias("quantity"), share(F.col("l_returnflag") == "R").alias("returned_share"), n(F.min(F.year("l_shipdate"))).alias("first_year"), n(F.max(F.year("l_shipdate"))).alias("last_year"))
    r = l.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("r"))
    total = n(F.sum("r"))
    shares = r.agg(F.round(n(F.max("r")) / total, 8).alias("top_share"), F.round(F.sum(n(F.col("r")) * n(F.col("r"))) / (total * total), 8).alias("hhi"), n(F.count("*")).alias("suppliers"))
    out = deals
    for one in (lines, shares, distinct(o, "o_custkey").toDF("customers"), distinct(l, "l_partkey").toDF("parts")):
        out = out.join(F.broadcast(one))  # rows of one each
    return out.unpivot([], out.columns, "metric", "value")


@query("A11_distinct_per_group", "SELECT l_suppkey, count(DISTINCT l_partkey)::BIGINT AS parts FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@query("A12_roll_up", "SELECT p_brand, min(p_name) AS example, count(*)::BIGINT AS n, sum(p_size)::BIGINT AS sizes FROM part WHERE p_brand <> '' GROUP BY p_brand")
def _(t):
    return t("part").where("p_brand <> ''").groupBy("p_brand").agg(F.min("p_name").alias("example"), F.count("*").alias("n"), F.sum("p_size").cast("long").alias("sizes"))


@query("A14_composition", "SELECT p_type, count(*) FILTER (p_size > 25)::BIGINT AS big, round(avg(p_size), 6) AS mean_size FROM part GROUP BY p_type")
def _(t):
    return t("part").groupBy("p_type").agg(F.count_if(F.col("p_size") > 25).alias("big"), F.round(F.avg("p_size"), 6).alias("mean_size"))


@query("A16_breakdown", "SELECT coalesce(nullif(o_orderpriority, ''), '-') AS priority, count(*)::BIGINT AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS final FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("")), F.lit("-")).alias("priority")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("final"))


@query("A17_zeros_kept", "SELECT n_name, count(s_suppkey)::BIGINT AS suppliers, coalesce(sum(s_acctbal::DECIMAL(18,2)), 0)::DOUBLE AS balance FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def _(t):
    agg = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("c"), F.sum(F.col("s_acctbal").cast(MONEY)).cast("double").alias("b"))
    return t("nation").join(agg, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("c", F.lit(0)).alias("suppliers"), F.coalesce("b", F.lit(0.0)).alias("balance"))


@query("A18_edge_merge", "SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS weight, max(year(l_shipdate))::BIGINT AS year, min(l_orderkey) AS evidence FROM lineitem GROUP BY ALL")
def _(t):
    return t("lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("weight"), F.max(F.year("l_shipdate")).cast("long").alias("year"), F.min("l_orderkey").alias("evidence"))


@query("A23_funnel", "SELECT s.state, count(e.event_id)::BIGINT AS n FROM (VALUES ('click'), ('view'), ('signup'), ('purchase'), ('refund')) s(state) LEFT JOIN events e ON e.event_type = s.state GROUP BY s.state")
def _(t):
    events = t("events")
    states = events.sparkSession.createDataFrame([(s,) for s in ("click", "view", "signup", "purchase", "refund")], "state string")
    counts = events.groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("c"))
    return states.join(counts, "state", "left").select("state", F.coalesce("c", F.lit(0)).alias("n"))


@query(
    "A29_modal",
    """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, c_mktsegment AS modal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM c) WHERE k = 1""",
)
def _(t):
    counts = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return counts.groupBy("c_nationkey").agg(F.min(F.struct((-F.col("n")).alias("n"), "c_mktsegment"))["c_mktsegment"].alias("modal"))


@query("A33_document_frequency", "SELECT t AS term, count(*)::BIGINT AS df FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS t FROM documents) WHERE t <> '' GROUP BY t")
def _(t):
    return t("documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))


@query(
    "A34_timeline",
    """WITH s AS (SELECT o_orderpriority, year(o_orderdate) AS y0, least(max(year(l_shipdate)), year(o_orderdate) + 60) AS y1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate)
    SELECT year::BIGINT AS year, family, count(*)::BIGINT AS n FROM (SELECT unnest(range(y0, y1 + 1)) AS year, o_orderpriority AS family FROM s) GROUP BY ALL""",
)
def _(t):
    last = t("lineitem").groupBy("l_orderkey").agg(F.max(F.year("l_shipdate")).alias("y1"))
    spans = t("orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("family"), F.year("o_orderdate").alias("y0"), "y1").where("y1 >= y0")
    return spans.select("family", F.explode(F.sequence(F.col("y0").cast("long"), F.least(F.col("y1"), F.col("y0") + 60).cast("long"))).alias("year")).groupBy("year", "family").agg(F.count("*").alias("n"))


@query("A35_histogram", "SELECT least(23, greatest(0, floor(value / 100 * 24)))::BIGINT AS bin, count(*)::BIGINT AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(t):
    return t("events").where("value IS NOT NULL").groupBy(F.least(F.lit(23), F.greatest(F.lit(0), F.floor(F.col("value") / 100 * 24))).cast("long").alias("bin")).agg(F.count("*").alias("n"))


ALL_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("A37_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::BIGINT AS n FROM {n}" for n in ALL_TABLES))
def _(t):
    out = None
    for name in ALL_TABLES:
        one = t(name).agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = one if out is None else out.union(one)
    return out


@query("O01_page", "SELECT doc_id, n_chars, count(*) OVER ()::BIGINT AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC NULLS LAST, source, doc_id LIMIT 20 OFFSET 10")
def _(t):
    found = t("documents").where("lang = 'en'")
    page = found.select("doc_id", "n_chars", "source").orderBy(F.col("n_chars").desc_nulls_last(), "source", "doc_id").offset(10).limit(20)
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total")))).select("doc_id", "n_chars", "total")


@query("O05_priority_order", "SELECT s_suppkey, s_name FROM supplier ORDER BY CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal > 9000 THEN 1 ELSE 2 END, length(s_name), s_suppkey LIMIT 30")
def _(t):
    return t("supplier").orderBy(F.when(F.col("s_acctbal") < 0, 0).when(F.col("s_acctbal") > 9000, 1).otherwise(2), F.length("s_name"), "s_suppkey").select("s_suppkey", "s_name").limit(30)


@query("U01_bag_union", "SELECT c_nationkey AS nationkey, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name")).unionByName(t("supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name")))


@query("U08_distinct", "SELECT DISTINCT event_type, user_id % 10 AS slot FROM events")
def _(t):
    return t("events").select("event_type", (F.col("user_id") % 10).alias("slot")).distinct()


@query(
    "S13_fill_only_merge",
    """WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS k, upper(c_name) AS name FROM customer WHERE c_custkey % 5 <> 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(nullif(a.name, ''), b.name) AS name FROM a FULL JOIN b ON a.k = b.k""",
)
def _(t):
    c = t("customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("old"))
    new = c.where("c_custkey % 5 <> 1").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("new"))
    return old.join(new, "k", "full").select("k", F.coalesce(F.nullif(F.col("old"), F.lit("")), F.col("new")).alias("name"))


@query("S04_last_run", "SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type")
def _(t):
    last = t("events").groupBy("event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.select("event_type", F.date_format("m.ts", "yyyy-MM-dd HH:mm:ss").alias("last_at"), F.col("m.event_id").alias("event_id"))


@query("S04_history", "SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type IN ('error', 'source.error') ORDER BY ts DESC, event_id DESC LIMIT 25")
def _(t):
    mine = t("events").where(F.substring_index("event_type", ".", -1) == "error")  # the bare name and the one with its prefix
    newest = mine.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(25)  # the page of a history
    return newest.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("T16_first_int", r"SELECT event_id, coalesce(try_cast(nullif(regexp_extract(props, '(\d+)', 1), '') AS BIGINT), 0) AS slots FROM events")
def _(t):
    return t("events").select("event_id", first_int(F.col("props")).alias("slots"))


@query("T36_digest_id", "SELECT c_custkey, substr(sha1(c_name || '|' || c_mktsegment), 1, 16) AS id FROM customer")
def _(t):
    return t("customer").select("c_custkey", digest_id(F.col("c_name"), F.col("c_mktsegment")).alias("id"))


@query("T36_fingerprint", "SELECT count(*)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM (SELECT sha256(source || '|' || n::VARCHAR) AS h FROM (SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY source))")
def _(t):
    # rows are summed per source first: what meets in one place is a digest per source
    rows = t("documents").groupBy("source").agg(F.sum("n_chars").alias("n")).select(F.sha2(F.concat_ws("|", "source", F.col("n").cast("string")).cast("binary"), 256).alias("h"))
    return rows.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("fingerprint"))


@query(
    "W09_forward_fill",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations""",
)
def _(t):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t("conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(order).alias("asked"))
