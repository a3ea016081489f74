"""Pages, JSON leaves, identities and measures in rounds."""

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import identity as ID
from plumbline.operators import iterative as IT
from plumbline.plans.measures import edges
from plumbline.plans.registry import query
from plumbline.plans.relational import long
from plumbline.sources import pages as P


@query("S18_page_parts")
def _(t):
    parts = P.page_parts(t("pages"), "page_id", "url", "html")
    return parts.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("S19_page_headings", "SELECT page_id, unnest(range(len(h)))::BIGINT AS ordinal FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6][ >]') AS h FROM pages)")
def _(t):
    return P.page_parts(t("pages"), "page_id", "url", "html").where("kind = 'heading'").select("page_id", long("ordinal").alias("ordinal"))


@query("S19_page_titles", "SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))) AS title FROM pages WHERE contains(html, '<title>')")
def _(t):
    p = P.page_parts(t("pages"), "page_id", "url", "html").where("kind = 'title'")
    return p.select("page_id", F.md5(F.col("text").cast("binary")).alias("title"))


@query("S19_page_images", "SELECT page_id, count(*)::BIGINT AS images FROM (SELECT page_id, unnest(regexp_extract_all(html, '<img [^>]*src=\"([^\"]+)\"', 1)) FROM pages) GROUP BY page_id")
def _(t):
    return P.page_parts(t("pages"), "page_id", "url", "html").where("kind = 'image'").groupBy("page_id").agg(F.count("*").alias("images"))


@query("S19_page_cells", "SELECT page_id, len(regexp_extract_all(html, '<t[dh][ >]'))::BIGINT AS cells, len(regexp_extract_all(html, '<d[td][ >]'))::BIGINT AS fields, len(regexp_extract_all(html, '<form[ >]'))::BIGINT AS forms FROM pages")
def _(t):
    parts = P.page_parts(t("pages"), "page_id", "url", "html").groupBy("page_id").agg(F.count_if(F.col("kind") == "cell").alias("cells"), F.count_if(F.col("kind").isin("dt", "dd")).alias("fields"), F.count_if(F.col("kind") == "form").alias("forms"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cells", "fields", "forms")]
    return t("pages").select("page_id").join(parts, "page_id", "left").select("page_id", *zero)


@query("S22_canonical", r"SELECT page_id, lower(regexp_extract(url, '^(\w+)://', 1)) || '://' || lower(regexp_extract(url, '^\w+://([^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^\w+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^\w+://[^/?#]+([^?#]*)', 1) END || CASE WHEN a <> '' THEN '?' || a ELSE '' END AS url FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') AS a FROM pages)")
def _(t):
    return t("pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("S18_page_links", "SELECT page_id, count(*)::BIGINT AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1)) FROM pages) GROUP BY page_id")
def _(t):
    return P.page_parts(t("pages"), "page_id", "url", "html").where("kind = 'link'").groupBy("page_id").agg(F.count("*").alias("links"))


@query("S21_json_leaves", "SELECT event_id, 0::BIGINT AS ordinal, '$[''k'']' AS path, 'number' AS type, json_extract_string(props, '$.k') AS text FROM events")
def _(t):
    return P.json_leaves(t("events"), "event_id", "props").withColumn("ordinal", long("ordinal"))


@query("S23_detail_candidates", r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^(\w+)://', 1)) AS scheme, lower(regexp_extract(url, '^\w+://([^/?#:]+)', 1)) AS host, lower(regexp_extract(url, '^\w+://[^/?#]+([^?#]*)', 1)) AS path FROM pages)
    SELECT page_id FROM p WHERE scheme IN ('http', 'https') AND (host = 'example.com' OR host LIKE '%.com') AND path <> '' AND path <> '/' AND NOT contains(path, 'login') AND NOT contains(path, 'logout')
    AND NOT contains(path, '/en/') AND path NOT LIKE '/static/%' AND NOT regexp_matches(path, '\.(css|js|png|jpe?g|gif|pdf)$')""")
def _(t):
    return t("pages").where(P.is_detail_candidate(F.col("url"), ["example.com"], [".com"], ["login", "logout", "/en/"], ["/static/"])).select("page_id")


def bylines(t):
    """The capitalised word sequences of each whole document, as names."""
    return t("documents").select("doc_id", F.explode(F.array_distinct(T.capitalised(F.col("text")))).alias("name"))


@query("N06_merged_names")
def _(t):
    return ID.merge_names(bylines(t), "name")


@query("J19_resolved_names")
def _(t):
    people = ID.merge_names(bylines(t), "name").groupBy("person").agg(F.count("*").alias("spellings")).select(F.xxhash64("person").alias("person_id"), "person")
    # a person's other spellings are aliases
    aliases = ID.merge_names(bylines(t), "name").where("name <> person").select(F.xxhash64("person").alias("person_id"), F.col("name").alias("alias"))
    return ID.resolve(bylines(t), "name", people, aliases)


@query("N14_betweenness")
def _(t):
    return IT.betweenness(edges(t)).select("node", F.round("betweenness", 9).alias("betweenness"))


@query("N15_communities")
def _(t):
    return IT.label_propagation(edges(t))


def weighted_terms(t):
    """Turns of conversations over the words of at least two of them, weighted by 1 + ln tf."""
    tf = t("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc"), F.explode(T.words(F.col("text"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    vocabulary = tf.groupBy("term").agg(F.count("*").alias("df")).where("df >= 2").select("term")
    return tf.join(vocabulary, "term", "left_semi").select("doc", "term", (1 + F.log("tf")).alias("value"))


@query("M01_topics")
def _(t):
    w, _ = IT.topics(weighted_terms(t), 4)
    return IT.topic_shares(w).select(F.col("doc").alias("id"), long("topic").alias("topic"), F.round("share", 6).alias("share"), "dominant")


@query("M03_topic_labels")
def _(t):
    _, h = IT.topics(weighted_terms(t), 4)
    return IT.topic_labels(h, 4)


@query("R03_latent")
def _(t):
    return IT.latent_vectors(t("documents"), "doc_id", T.words(F.col("text")), 16).select(F.col("doc").alias("doc_id"), F.transform("vector", lambda v: F.round(v, 5)).alias("vector"))
