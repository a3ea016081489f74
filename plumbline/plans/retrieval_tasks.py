"""The battery of retrieval tasks: what a text should find, asked by the documents whose id is divisible by 100."""

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import evaluation as E
from plumbline.operators import ranking as R
from plumbline.plans.measures import WORDS
from plumbline.plans.registry import query

TITLE = "split_part(text, chr(10), 1)"
BODY = f"substr(text, length({TITLE}) + 2)"
HALF, REST = "substr(text, 1, length(text) // 2)", "substr(text, length(text) // 2 + 1)"


def task_sql(queries, items):
    return f"""WITH q AS ({queries}), i AS ({items}), x AS (SELECT item, term, count(*) AS tf FROM (SELECT item, unnest({WORDS}) AS term FROM i) GROUP BY ALL), y AS (SELECT query, term, count(*) AS tf FROM (SELECT query, unnest({WORDS}) AS term FROM q) GROUP BY ALL),
    d AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM i)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM x GROUP BY term), xw AS (SELECT item, term, (1 + ln(tf)) * idf AS w FROM x JOIN d USING (term)), yw AS (SELECT query, term, (1 + ln(tf)) * idf AS w FROM y JOIN d USING (term)),
    xn AS (SELECT item, sqrt(sum(w * w)) AS norm FROM xw GROUP BY item), yn AS (SELECT query, sqrt(sum(w * w)) AS norm FROM yw GROUP BY query),
    s AS (SELECT query, item, round(sum(xw.w / xn.norm * (yw.w / yn.norm)), 7) AS score FROM yw JOIN xw USING (term) JOIN xn USING (item) JOIN yn USING (query) WHERE query <> item GROUP BY ALL),
    f AS (SELECT s.*, want IS NOT DISTINCT FROM has AS relevant FROM s JOIN q USING (query) JOIN i USING (item)), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS place, count(*) FILTER (relevant) OVER (PARTITION BY query) AS n FROM f),
    p AS (SELECT query, min(place) AS first, sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1.0::DOUBLE) ELSE 0 END) / max(list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE)))) AS ndcg FROM r WHERE relevant GROUP BY query)
    SELECT count(*)::BIGINT AS cases, round(avg(1.0::DOUBLE / first), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM p"""


def measured(queries, items):
    return E.task(queries, items, T.words).select("cases", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


def parts(t):
    """Documents with their title, body and halves, queries numbered apart from items."""
    title = F.substring_index("text", "\n", 1)
    half = F.floor(F.length("text") / 2).cast("int")
    d = t("documents").select("doc_id", "lang", "source", "text", title.alias("title"), F.substring(F.col("text"), F.length(title) + 2, F.length("text")).alias("body"), F.substring(F.col("text"), F.lit(1), half).alias("half"), F.substring(F.col("text"), half + 1, F.length("text")).alias("rest"))
    return d, d.where("doc_id % 100 = 0")  # the stated query set, against all rows


NUMBER = "-1 - doc_id"


@query("R17_title_to_body", task_sql(f"SELECT {NUMBER} AS query, {TITLE} AS text, doc_id AS want FROM documents WHERE doc_id % 100 = 0", f"SELECT doc_id AS item, {BODY} AS text, doc_id AS has FROM documents"))
def _(t):
    d, q = parts(t)
    return measured(q.select((-1 - F.col("doc_id")).alias("query"), F.col("title").alias("text"), F.col("doc_id").alias("want")), d.select(F.col("doc_id").alias("item"), F.col("body").alias("text"), F.col("doc_id").alias("has")))


@query(
    "R17_masked_title",
    task_sql(
        f"""SELECT query, array_to_string(list_filter(w, lambda a: NOT list_contains(masked, a)), ' ') AS text, want FROM (SELECT {NUMBER} AS query, doc_id AS want, {WORDS.replace('(text)', f'({TITLE})')} AS w FROM documents WHERE doc_id % 100 = 0) JOIN (SELECT doc_id, list(term) AS masked FROM (SELECT doc_id, term,
        row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS k FROM (SELECT doc_id, term, count(*) OVER (PARTITION BY term) AS df FROM (SELECT DISTINCT doc_id, unnest({WORDS.replace('(text)', f'({TITLE})')}) AS term FROM documents))) WHERE k <= 2 GROUP BY doc_id) ON doc_id = want""",
        f"SELECT doc_id AS item, {BODY} AS text, doc_id AS has FROM documents",
    ),
)
def _(t):
    d, q = parts(t)
    titles = d.select("doc_id", F.explode(F.array_distinct(T.words(F.col("title")))).alias("term"))
    df = titles.groupBy("term").agg(F.count("*").alias("df"))
    rare = R.top_per_group(titles.where("doc_id % 100 = 0").join(df, "term"), ["doc_id"], [F.col("df"), F.col("term")], 2).groupBy("doc_id").agg(F.collect_list("term").alias("masked"))
    asked = q.join(rare, "doc_id").select((-1 - F.col("doc_id")).alias("query"), F.array_join(F.filter(T.words(F.col("title")), lambda w: ~F.array_contains("masked", w)), " ").alias("text"), F.col("doc_id").alias("want"))
    return measured(asked, d.select(F.col("doc_id").alias("item"), F.col("body").alias("text"), F.col("doc_id").alias("has")))


@query("R17_first_to_second_half", task_sql(f"SELECT {NUMBER} AS query, {HALF} AS text, doc_id AS want FROM documents WHERE doc_id % 100 = 0 AND length(text) > 120", f"SELECT doc_id AS item, {REST} AS text, doc_id AS has FROM documents WHERE length(text) > 120"))
def _(t):
    d, q = parts(t)
    return measured(q.where("length(text) > 120").select((-1 - F.col("doc_id")).alias("query"), F.col("half").alias("text"), F.col("doc_id").alias("want")), d.where("length(text) > 120").select(F.col("doc_id").alias("item"), F.col("rest").alias("text"), F.col("doc_id").alias("has")))


@query("R17_sibling", task_sql("SELECT doc_id AS query, text, source || ' ' || lang AS want FROM documents WHERE doc_id % 100 = 0", "SELECT doc_id AS item, text, source || ' ' || lang AS has FROM documents"))
def _(t):
    d, q = parts(t)
    kin = F.concat_ws(" ", "source", "lang")
    return measured(q.select(F.col("doc_id").alias("query"), "text", kin.alias("want")), d.select(F.col("doc_id").alias("item"), "text", kin.alias("has")))


@query("R17_same_area", task_sql(f"SELECT doc_id AS query, {TITLE} AS text, lang AS want FROM documents WHERE doc_id % 100 = 0", "SELECT doc_id AS item, text, lang AS has FROM documents"))
def _(t):
    d, q = parts(t)
    return measured(q.select(F.col("doc_id").alias("query"), F.col("title").alias("text"), F.col("lang").alias("want")), d.select(F.col("doc_id").alias("item"), "text", F.col("lang").alias("has")))


TURN = "conv_id * 1000 + turn"


@query(
    "R17_holdout",
    task_sql(
        f"SELECT {TURN} AS query, text, conv_id AS want FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE length(text) > 40) WHERE n >= 6 AND k = n // 2 + 1",
        f"SELECT {TURN} AS item, text, conv_id AS has FROM conversations WHERE length(text) > 40",
    ),
)
def _(t):
    turns = t("conversations").where("length(text) > 40").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 6")
    # the middle turn: a conversation's turns are few, and its place is counted in a window over it
    place = F.row_number().over(R.Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    middle = turns.withColumn("k", place).join(n, "conv_id").where("k = n div 2 + 1")
    return measured(middle.select(F.col("id").alias("query"), "text", F.col("conv_id").alias("want")), turns.select(F.col("id").alias("item"), "text", F.col("conv_id").alias("has")))
