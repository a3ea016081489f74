"""Typed records gathered from JSON leaves; leaves are rows (key, ordinal, path, type, text)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from plumbline.functions.text import digest_id
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A step of a path is a quoted key, with backslashes before quotes and backslashes, or a number.
#: Nothing matched is given back (++ and *+), so that a key costs one step a run of characters.
KEY, INDEX = r"\['(?:[^'\\]++|\\.)*+'\]", r"\[\d++\]"


def step_name(step: Column) -> Column:
    """The key or index of a step, unescaped."""
    bare = F.when(step.startswith("['"), F.substring(step, F.lit(3), F.length(step) - 4)).otherwise(F.substring(step, F.lit(2), F.length(step) - 2))
    return F.when(bare.contains("\\"), F.regexp_replace(bare, r"\\(.)", "$1")).otherwise(bare)


def path_segments(path: Column) -> Column:
    """$['a'][2] as ["a", "2"]; quotes and backslashes are unescaped. A null path gives null."""
    return F.transform(F.regexp_extract_all(path, F.lit(f"{KEY}|{INDEX}"), F.lit(0)), step_name)


def written(key: str) -> str:
    """A key as a step is written."""
    return "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def same(x: Column) -> Column:
    """The array as it is, told by a function of its elements. Such a step is compiled expression by expression: whole stages of patterns make methods too large for the JVM to compile."""
    return F.transform(x, lambda e: e)


def placed(leaves: DataFrame, key: str, specs: list[tuple[str, str]]) -> DataFrame:
    """(key, family, prefix, wildcard, ordinal, rest, name, below, text) of the leaves with text whose keys begin with those of a spec, the first that fits.

    A spec is key names joined by dots, * for any one; indices may stand before, between and after them and count to the prefix. In most paths a key ends
    where "']" stands, so the prefix is told without a pattern; only paths with a backslash, or a key that begins with "]", are read by patterns: keys are taken from them once and
    compared as they are written, the prefix is told by one pattern for its number of keys. rest is the path behind the prefix; name is its last key in lower case, null if it ends
    in an index; below is the number of keys in it; wildcard is the key that the spec's last * stands for.
    """
    plain = F.startswith("path", F.lit("$[")) & ~F.contains("path", F.lit("\\")) & ~F.contains("path", F.lit("[']"))
    # keys is null for a plain path
    rows = leaves.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(key, "ordinal", "text", "path", same(F.when(~plain, F.regexp_extract_all("path", F.lit(KEY), F.lit(0)))).alias("keys"))
    upto = lambda i: F.substring_index("path", "']", i + 1)  # noqa: E731  all before the end of key i, or the path if it has fewer
    last = lambda x: F.substring_index(x, "['", -1)

    def hit(name: str, spec: str) -> Column:
        parts = spec.split(".")
        at = len(parts) - 1 - parts[::-1].index("*") if "*" in parts else None

        def found(fits: list[Column], star: Column, prefix: Column) -> Column:
            return F.when(reduce(lambda a, b: a & b, fits), F.struct(F.lit(name).alias("family"), F.lit(len(parts)).alias("depth"), star.alias("star"), prefix.alias("prefix"), F.col("keys").alias("keys")))

        read = [F.get("keys", F.lit(i)).isNotNull() if p == "*" else F.get("keys", F.lit(i)) == written(p) for i, p in enumerate(parts)]
        prefix = F.regexp_extract("path", rf"^(\$(?:{INDEX})*(?:{KEY}(?:{INDEX})*){{{len(parts)}}})", 1)
        slow = found(read, F.lit("") if at is None else step_name(F.get("keys", F.lit(at))), prefix)
        told = [upto(i) != F.col("path") if p == "*" else F.endswith(upto(i), F.lit("['" + p)) for i, p in enumerate(parts)]
        end = F.length(upto(len(parts) - 1)) + 2
        more = F.instr(F.substring(F.col("path"), end + 1, F.length("path")), "['")  # indices alone stand before the next key
        fast = found(told, F.lit("") if at is None else last(upto(at)), F.when(more == 0, F.col("path")).otherwise(F.substring(F.col("path"), F.lit(1), end + more - 1)))
        return F.when(F.col("keys").isNull(), fast).otherwise(slow)

    # as rows of a one-element array, so that a filter doesn't repeat what tells them; an outer one, as Spark else puts a filter of its own before it, which repeats it
    found = rows.select(key, "ordinal", "text", "path", F.inline_outer(same(F.array(F.coalesce(*[hit(n, s) for n, s in specs]))))).where("prefix <> ''")
    name = F.when(F.endswith("path", F.lit("']")), F.lower(F.when(F.col("keys").isNull(), last(F.expr("left(path, length(path) - 2)"))).otherwise(step_name(F.element_at("keys", -1)))))
    rest = F.expr("substring(path, length(prefix) + 1)")
    below = F.when(F.col("keys").isNull(), ((F.length(rest) - F.length(F.replace(rest, F.lit("']"), F.lit("")))) / 2).cast("int")).otherwise(F.size("keys") - F.col("depth"))
    told = F.get(same(F.array(F.struct(rest.alias("rest"), name.alias("name"), below.alias("below")))), F.lit(0))
    return found.select(key, "family", "prefix", F.col("star").alias("wildcard"), "ordinal", "text", told.alias("t")).select(key, "family", "prefix", "wildcard", "ordinal", "t.rest", "t.name", "t.below", "text")


def _flat() -> Column:
    """Whether keys alone stand behind the prefix, one at least."""
    return F.col("rest").rlike(f"^(?:{KEY})+$")


def gather(leaves: DataFrame, key: str, specs: dict[str, str], fields: dict[str, list[str]]) -> DataFrame:
    """(key, kind, prefix, one column per field) of the leaves under a spec's prefix.

    A leaf belongs to the first spec that matches. A field takes the leaf with the fewest keys below the prefix, then the
    earliest of its names (case aside), then the smallest ordinal; leaves inside nested lists are not looked at. Empty
    values and the bare prefix count as absent; a record without any leaf left has no row. Extra columns are ignored.
    """
    rows = placed(leaves, key, list(specs.items())).where("rest <> ''").withColumn("flat", _flat())

    def first(names: list[str]) -> Column:
        place = reduce(lambda c, n: c.when(F.col("name") == n.lower(), F.lit(names.index(n))), names[1:], F.when(F.col("name") == names[0].lower(), F.lit(0)))
        wanted = F.when(F.col("flat") & place.isNotNull(), F.struct("below", place, "ordinal"))
        return F.min_by(F.when(wanted.isNotNull(), F.col("text")), wanted)

    return rows.groupBy(key, F.col("family").alias("kind"), "prefix").agg(*[first(names).alias(field) for field, names in fields.items()])


@dataclass(frozen=True)
class Family:
    """How records of a family are found and read.

    spec is the path of key names to a record, dots between, * for any one; form is a constant, or * for the key that the last * stands for;
    fields are columns with the leaf names that may fill them, the first one first. Records without a title are dropped unless untitled is set.
    """

    name: str
    spec: str
    fields: dict[str, list[str]]
    form: str = "*"
    untitled: bool = False
    aliases: dict[str, str] = field(default_factory=dict)


def under(leaves: DataFrame, key: str, families: list[Family]) -> DataFrame:
    """placed() leaves of families: those whose specs begin with two plain names go before those that don't, each in the order given."""
    return placed(leaves, key, [(f.name, f.spec) for f in sorted(families, key=lambda f: "*" in f.spec.split(".")[:2])])


def shape(leaves: DataFrame, key: str, families: list[Family], source: str) -> DataFrame:
    """One row per record: record_id, key, family, form, prefix and the families' columns; in one aggregation over the leaves.

    A field takes the leaf with the fewest keys below the record, then the earliest of its names (case aside), then the smallest ordinal;
    leaves inside nested lists are not looked at. The id is a digest of key, family, source and place, so it stays while the record stays there.
    """
    rows = under(leaves, key, families).where("rest <> ''").withColumn("flat", _flat())
    of = {f.name: f for f in families}

    def first(column: str) -> Column:
        tests = [((F.col("family") == f) & (F.col("name") == n.lower()), i) for f, x in of.items() for i, n in enumerate(x.fields.get(column, []))]
        place = reduce(lambda c, t: c.when(t[0], F.lit(t[1])), tests[1:], F.when(tests[0][0], F.lit(tests[0][1])))
        wanted = F.when(F.col("flat") & place.isNotNull(), F.struct("below", place, "ordinal"))
        return F.min_by(F.when(wanted.isNotNull(), F.col("text")), wanted).alias(column)

    columns = list(dict.fromkeys(c for f in families for c in f.fields))
    out = rows.groupBy(key, "family", "prefix", "wildcard").agg(*map(first, columns))
    named = F.coalesce(*[F.when((F.col("family") == f.name) & (F.lower("wildcard") == a.lower()), F.lit(b)) for f in families for a, b in f.aliases.items()], *[F.when(F.col("family") == f.name, F.lit(f.form)) for f in families if f.form != "*"], F.lower("wildcard"))
    keep = F.col("family").isin([f.name for f in families if f.untitled]) | F.col("title").isNotNull()
    return out.where(keep).select(digest_id(F.col(key).cast("string"), F.col("family"), F.lit(source), F.col("prefix")).alias("record_id"), key, "family", named.alias("form"), "prefix", *columns)


def people(leaves: DataFrame, key: str, families: list[Family], roles: dict[str, str], names: list[str], orders: list[str], lead: str) -> DataFrame:
    """(key, family, prefix, ordinal, name, role) of the people in a record's collections; roles maps a collection to what its members are.

    A person without a name is left out; the order is the number given, else the place in the collection; a lead flag of
    SIM, TRUE or S makes the role responsible.
    """
    item = rf"\['({'|'.join(map(re.escape, roles))})'\](?:\[(\d+)\])?\['([^']*)'\]$"
    rows = under(leaves, key, families).where(F.col("rest").rlike("(?i)" + item))
    rows = rows.select(key, "family", "prefix", F.lower(F.regexp_extract("rest", "(?i)" + item, 1)).alias("group"), F.coalesce(F.regexp_extract("rest", "(?i)" + item, 2).try_cast("int"), F.lit(0)).alias("place"), F.lower(F.regexp_extract("rest", "(?i)" + item, 3)).alias("field"), "ordinal", "text")
    pick = lambda wanted: F.min_by(F.when(F.col("field").isin(wanted), F.col("text")), F.when(F.col("field").isin(wanted), F.struct(F.array_position(F.array(*map(F.lit, wanted)), F.col("field")), F.col("ordinal"))))
    each = rows.groupBy(key, "family", "prefix", "group", "place").agg(pick(names).alias("name"), pick(orders).alias("order"), pick([lead]).alias("lead")).where("name IS NOT NULL")
    role = F.element_at(F.create_map(*[F.lit(x) for r in roles.items() for x in (r[0].lower(), r[1])]), F.col("group"))
    number = F.when(F.col("order").rlike("^[0-9]+$"), F.col("order").try_cast("int")).otherwise(F.col("place") + 1)
    return each.select(key, "family", "prefix", number.alias("ordinal"), "name", F.when(F.upper(F.coalesce("lead", F.lit(""))).isin("SIM", "TRUE", "S"), "responsible").otherwise(role).alias("role"))


def areas(leaves: DataFrame, key: str, families: list[Family], begins: str, levels: list[str]) -> DataFrame:
    """(key, family, prefix, areas): of each area object of a record the most specific level that is filled, once each, in the order they come."""
    item = rf"(?i)(\['{re.escape(begins)}[^']*'\])\['({'|'.join(map(re.escape, levels))})'\]$"
    rows = under(leaves, key, families).where(F.col("rest").rlike(item)).withColumn("object", F.regexp_extract("rest", r"^(.*)\['[^']*'\]$", 1))
    place = F.array_position(F.array(*map(F.lit, levels)), F.lower(F.regexp_extract("rest", item, 2)))
    best = rows.groupBy(key, "family", "prefix", "object").agg(F.min_by("text", place).alias("area"), F.min("ordinal").alias("at"))
    once = best.groupBy(key, "family", "prefix", "area").agg(F.min("at").alias("at"))
    return once.groupBy(key, "family", "prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "area"))), lambda x: x["area"]).alias("areas"))


def career(ties: DataFrame, by: list[str]) -> DataFrame:
    """Per career of ties(by, kind, role, start, end, ordinal): year, year_end, status, form and nature.

    It begins with the first start; a tie with a start and no end makes it current, without an end of its own; form and
    nature are those of the last current tie, or of the last tie if none is.
    """
    open_ = F.col("start").isNotNull() & F.col("end").isNull()
    order = F.struct(F.coalesce("start", F.lit(0)), F.coalesce("end", F.lit(9999)), F.col("ordinal"))
    said = F.struct("kind", "role")
    out = ties.groupBy(*by).agg(
        F.min("start").alias("year"), F.max("end").alias("last"), F.bool_or(open_).alias("current"), F.max_by(F.when(open_, said), F.when(open_, order)).alias("now"), F.max_by(said, order).alias("then")
    )
    tie = F.coalesce("now", "then")
    kind = F.coalesce(F.nullif(tie["kind"], F.lit("")), F.lit("appointment"))
    return out.select(*by, "year", F.when(~F.col("current"), F.col("last")).alias("year_end"), F.when(F.col("current"), "current").when(F.col("last").isNotNull(), "past").otherwise("").alias("status"), kind.alias("form"), F.coalesce(tie["role"], F.lit("")).alias("nature"))


def search_text(parts: list[Column]) -> Column:
    """Everything that a text search should hit: the parts that are filled, one space between, lower case."""
    return F.lower(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " "))


#: A row of one cell that names a term: a year and a half.
TERM = r"^(\d{4})\.[1-9]$"


def terms_of_rows(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows(by, order, cells) with term, the last row of one cell before that names one, and latest, the largest on the page; such rows go."""
    is_term = (F.size("cells") == 1) & F.col("cells")[0].rlike(TERM)
    page = Window.partitionBy(*by)
    run = page.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(is_term, F.col("cells")[0])
    return rows.withColumn("term", F.last(mark, ignorenulls=True).over(run)).withColumn("latest", F.max(mark).over(page)).where(~is_term)


def course_rows(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, code, title, year, status, hours) of a page's table of courses: of three cells at least, no header, with a name; the latest term is current."""
    t = terms_of_rows(rows, by, order).where((F.size("cells") >= 3) & ~F.lower(F.col("cells")[0]).startswith("disciplina") & (F.col("cells")[1] != ""))
    return t.select(*by, F.col("cells")[0].alias("code"), F.col("cells")[1].alias("title"), F.substring("term", 1, 4).try_cast("int").alias("year"), F.when(F.col("term") == F.col("latest"), "current").otherwise("past").alias("status"), F.coalesce(F.try_element_at(F.filter(F.slice("cells", 3, 100_000), lambda c: c.rlike(r"^\d+\s*h")), F.lit(1)), F.lit("")).alias("hours"))


def project_rows(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, code, title, year, area) of a page's table of projects; without a term, the year is the end of the code."""
    head = F.lower(F.col("cells")[0])
    t = terms_of_rows(rows, by, order).where((F.size("cells") >= 2) & ~head.rlike("^(projeto|código|codigo|título|titulo)") & (F.col("cells")[1] != ""))
    year = F.coalesce(F.substring("term", 1, 4), F.regexp_extract(F.col("cells")[0], r"((?:19|20)\d{2})$", 1)).try_cast("int")
    area = F.try_element_at("cells", F.lit(3))
    return t.select(*by, F.col("cells")[0].alias("code"), F.col("cells")[1].alias("title"), year.alias("year"), F.when((F.lower(area) != "detalhes") & (area != ""), area).alias("area"))


def mentoring_rows(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, title, year, org, coordinator): a coordinator named in the title's end is split from it."""
    coordinator = r"(?i)\s*\(?coordenador(?:a|\(a\))?\s*:\s*([^)]+)\)?\s*$"
    t = terms_of_rows(rows, by, order).where((F.size("cells") >= 1) & ~F.lower(F.col("cells")[0]).rlike("^(título|titulo)"))
    title = F.trim(F.regexp_replace(F.col("cells")[0], coordinator, ""))
    return t.select(*by, title.alias("title"), F.substring("term", 1, 4).try_cast("int").alias("year"), F.coalesce(F.try_element_at("cells", F.lit(2)), F.lit("")).alias("org"), F.trim(F.regexp_extract(F.col("cells")[0], coordinator, 1)).alias("coordinator")).where("title <> ''")


def matching_leaves(leaves: DataFrame, key: str, families: list[Family], pattern: str) -> DataFrame:
    """(key, family, prefix, texts): the texts of a record's leaves whose name, case aside, has the pattern, in their order; leaves in lists too."""
    rows = under(leaves, key, families).where("rest <> ''").where(F.col("name").rlike(pattern))
    return rows.groupBy(key, "family", "prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]).alias("texts"))
