"""Text functions: Column in, Column out, all native."""

from __future__ import annotations

import re

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters that decompose to one base letter and marks; derived, not listed.
_BASE = {c: [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)] for c in map(chr, range(0xC0, 0x250))}
_FROM = "".join(c for c, base in _BASE.items() if len(base) == 1 and base != [c])
_TO = "".join(_BASE[c][0] for c in _FROM)
#: Name particles that stay lower case in a shown name, and those that are no part of a name's key.
SHOWN_PARTICLES = ["de", "da", "do", "das", "dos", "e", "di", "del", "van", "von", "y"]
PARTICLES = ["de", "da", "do", "das", "dos", "e", "di", "del", "van", "von", "y", "la", "le"]


def strip_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, _FROM, _TO), r"[\u0300-\u036f]", "")


def clean_text(x: Column) -> Column:
    """Bullets to spaces, white space runs to one space, trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[•·▪●◦‣]", " "), r"(?U)\s+", " "))


def fold(x: Column) -> Column:
    """Accents off, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(strip_accents(F.coalesce(x, F.lit(""))), r"(?U)\s+", " ")))


def identity_fold(x: Column) -> Column:
    """Only the lower-case letters and digits of the folded text."""
    return F.regexp_replace(fold(x), r"[^\p{L}\p{N}]", "")


def normalize_person_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(fold(x)), "[^A-Z0-9]+", " "))


def display_person_name(x: Column) -> Column:
    """Each word with a capital; particles in lower case unless first."""
    words = F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(SHOWN_PARTICLES), F.lower(w)).otherwise(capital(w))), " ")


def given_first(x: Column) -> Column:
    """"Family, Given" as "Given Family", if there is one comma with text on both sides."""
    parts = F.transform(F.split(x, ","), lambda p: F.trim(p))
    return F.when((F.size(parts) == 2) & (parts[0] != "") & (parts[1] != ""), F.concat_ws(" ", parts[1], parts[0])).otherwise(x)


def slug(x: Column, mark: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(fold(x), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def entity_id(kind: Column | str, x: Column) -> Column:
    """kind:slug, null where there is no slug."""
    s = slug(x)
    return F.when(s != "", F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, s))


#: Fixed value: how far a year may be from the ends of a bracket that cites.
BRACKET = 140
#: Words of a name at most.
NAME_WORDS = 4
_CENTURY = "(19|20)[0-9][0-9]"


def _cites(inside: Column) -> Column:
    """Whether what a bracket holds has a year by itself, perhaps with a letter, that is near enough to both ends."""
    found, n = F.lit(False), F.length(inside)
    for year, size in ((_CENTURY, 4), (_CENTURY + "[a-zA-Z]", 5)):
        # where such a year may be, with the character before and behind, which tell if it stands alone
        first = F.greatest(n - BRACKET - size, F.lit(1))
        found |= F.substring(inside, first, BRACKET + size + 2 - first).rlike(rf"\b{year}\b")
    return found


def _without_citing_brackets(x: Column) -> Column:
    """The text cut at opening brackets: of each piece what goes before its closing bracket is left out if it cites."""
    pieces = F.split(x, r"\(")
    inside = lambda p: F.substring_index(p, ")", 1)
    cites = lambda p: F.contains(p, F.lit(")")) & _cites(inside(p))
    later = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.when(cites(p), F.concat(F.lit(" "), F.substring(p, F.length(inside(p)) + 2, F.length(p)))).otherwise(F.concat(F.lit("("), p)))
    return F.concat(pieces[0], F.array_join(later, ""))


def _without_names_before(x: Column, sign: str, word: str) -> Column:
    """The text without each sign that has a name right before it, and without that name: as many as NAME_WORDS words, back to one that is none.

    word is the pattern of a word of a name; of a first word that begins with something else its end is taken. A sign without a name stays.
    """
    signs, pieces = F.regexp_extract_all(x, F.lit(sign), F.lit(0)), F.split(x, sign)
    start = F.struct(F.lit(0).alias("cut"), F.lit(False).alias("done"))

    def back(a: Column, w: Column) -> Column:
        end = F.regexp_extract(w, rf"(?<![0-9_])(?:{word})$", 0)
        done = a["done"] | (end == "")
        return F.struct((a["cut"] + F.when(done, 0).otherwise(F.length(end) + 1)).alias("cut"), (done | (end != w)).alias("done"))

    name = lambda p: F.aggregate(F.slice(F.reverse(F.split(F.rtrim(p), " ")), 1, NAME_WORDS), start, back)["cut"]
    told = F.arrays_zip(F.transform(pieces, lambda p: F.struct(p.alias("text"), name(p).alias("cut"))).alias("piece"), signs.alias("sign"))
    put = lambda t: F.when(t["sign"].isNull(), t["piece"]["text"]).when(t["piece"]["cut"] == 0, F.concat(t["piece"]["text"], t["sign"])).otherwise(
        F.concat(F.substring(F.rtrim(t["piece"]["text"]), F.lit(1), F.greatest(F.length(F.rtrim(t["piece"]["text"])) - t["piece"]["cut"], F.lit(0))), F.lit(" "))
    )
    return F.array_join(F.transform(told, put), "")


def scrub_citations(x: Column) -> Column:
    """Text without citations, cleaned: web addresses, DOIs, brackets with a year near their ends, "Name et al. year", [1, 2] and "NAME year".

    A bracket is one without inner brackets, and its year a word by itself. A name is up to four words; those before "et al" have letters, apostrophes
    and hyphens, those before a bare year capitals only.
    """
    for pattern in (r"(?i)(?:https?://|www\.)\S+", r"(?i)(?:\bdoi:?\s*)?\b10\.[0-9]{4,9}/\S+"):
        x = F.regexp_replace(clean_text(x), pattern, " ")
    x = _without_citing_brackets(clean_text(x))
    x = _without_names_before(clean_text(x), rf"(?i)\bet al\b[ .,(]*{_CENTURY}[a-z]?\b[ )]*", r"\p{L}[\p{L}'’-]+")
    x = F.regexp_replace(x, r"\[\s*[0-9]+(?:[\s,;-]+[0-9]+)*[\s,;]*\]", " ")
    return clean_text(_without_names_before(clean_text(x), rf"[ ,]+{_CENTURY}[a-zA-Z]?\b", r"\p{Lu}\p{Lu}+"))


def capitalised(x: Column) -> Column:
    """Sequences of two to four words that begin with a capital A-Z and go on in a-z."""
    return F.regexp_extract_all(x, F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}"), F.lit(0))


def join_unique(parts: Column, sep: str = " ", limit: int | None = None) -> Column:
    """An array's parts joined without empty ones and repeats (case aside); with a limit, the part that passes it is cut and ends the text."""
    key = lambda p: F.replace(F.lower(p), F.lit("ß"), F.lit("ss"))
    parts = F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"))
    once = F.aggregate(parts, start, lambda a, p: F.when(F.array_contains(a["seen"], key(p)), a).otherwise(F.struct(F.array_append(a["out"], p).alias("out"), F.array_append(a["seen"], key(p)).alias("seen"))))["out"]
    joined = F.array_join(once, sep)
    return joined if limit is None else F.rtrim(F.substring(joined, 1, limit))


def first_year(x: Column) -> Column:
    return F.regexp_extract(x, r"(?:19|20)\d{2}", 0).try_cast("long")


def first_int(x: Column) -> Column:
    return F.coalesce(F.regexp_extract(x, r"(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def sentences(x: Column, longer_than: int = 25) -> Column:
    return F.filter(F.transform(F.split(x, r"(?<=[.;:!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def words(x: Column) -> Column:
    """Folded words of two or more characters that begin with a letter."""
    # white space parts words however much there is of it, so it isn't collapsed before
    return F.regexp_extract_all(F.lower(strip_accents(F.coalesce(x, F.lit("")))), F.lit("[a-z][a-z0-9]+"), F.lit(0))


#: What names of programs and files have besides letters and digits, and which of it never ends a word of code.
MARKS = "+-./#_"
NO_END = "-./_"


def _runs(x: Column) -> Column:
    """Folded runs of letters, digits and marks."""
    return F.split(fold(x), f"[^a-z0-9{re.escape(MARKS)}]+")


def code_tokens(x: Column) -> Column:
    """Folded words that may hold the marks of names of programs and files, but not at the beginning, and some not at the end; of two or more characters."""
    bare = F.transform(_runs(x), lambda w: F.rtrim(F.ltrim(w, F.lit(MARKS)), F.lit(NO_END)))
    return F.filter(bare, lambda w: F.length(w) > 1)


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Neighbouring tokens joined by spaces. Shifted slices are zipped, so that tokens is not evaluated per element."""
    size = F.size(tokens) - (n - 1)
    out = F.slice(tokens, 1, size)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, size), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(size > 0, out).otherwise(F.array().cast("array<string>"))


def char_ngrams(tokens: Column, low: int, high: int) -> Column:
    """Character n-grams of each token padded with a space on both sides; a shorter token gives itself once."""
    none = F.array().cast("array<string>")

    def of_size(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array(w) if n == low else none)

    def of(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        return F.flatten(F.array(*[of_size(padded, n) for n in range(low, high + 1)]))

    return F.flatten(F.transform(tokens, of))


def recency_weight(year: Column, as_of: int, half_life: float = 6.0, unknown: float = 0.7) -> Column:
    """Halves every half_life years; later years count as now."""
    return F.when(year.isNull(), F.lit(unknown)).otherwise(F.pow(F.lit(2.0), -F.greatest(F.lit(0), as_of - year) / F.lit(half_life)))


def digest_id(*parts: Column, size: int = 16) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, size)


def project_year(code: Column) -> Column:
    """The year at the end of a project's code: two capitals or more, three digits or more, a hyphen, the year."""
    return F.regexp_extract(code, r"^[A-Z]{2,}\d{3,}-(\d{4})$", 1).try_cast("long")


#: How much a kind of evidence says; any other kind says 0.5.
SPECIFICITY = {
    "opportunity": 1.00,
    "sigaa_project": 0.92,
    "lattes_project": 0.90,
    "research_line": 0.80,
    "article": 0.78,
    "orientation": 0.70,
    "book_chapter": 0.68,
    "conference": 0.55,
    "technical": 0.55,
    "sigaa_extension": 0.55,
    "profile_summary": 0.45,
    "knowledge_area": 0.12,
}
#: States of projects.
PROJECT_STATES = {"EM_ANDAMENTO": "ongoing", "CONCLUIDO": "concluded", "DESATIVADO": "inactive"}


def _looked_up(x: Column, table: dict[str, object], otherwise: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for e in table.items() for v in e])[x], otherwise)


def specificity(kind: Column) -> Column:
    return _looked_up(kind, SPECIFICITY, F.lit(0.5))


def project_state(x: Column) -> Column:
    """The state's name, whatever its case; unknown ones in lower case."""
    return _looked_up(F.upper(x), PROJECT_STATES, F.lower(x))


def is_current(call: Column, kind: Column, active: Column, start: Column, end: Column, now: int, window: int = 2) -> Column:
    """Whether a piece of work goes on: an open call does; what is neither of a current kind nor active doesn't; else its end tells, else a start in the
    last years, else both flags. Null years are unknown."""
    return F.when(call, True).when(~(kind | active), False).when(end.isNotNull(), end >= now).when(start.isNotNull(), start >= now - window).otherwise(active & kind)


def ordered_subset(short: Column, long: Column) -> Column:
    """Whether the words of one name occur in the other in order; a single letter stands for any word that it begins, on either side. Each word takes the first that fits."""
    fits = lambda s, w: (s == w) | ((F.least(F.length(s), F.length(w)) == 1) & (F.substring(s, 1, 1) == F.substring(w, 1, 1)))
    # the place in `long` reached so far, null once a word has found none
    step = lambda at, s: F.when(at.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(long), F.lit(1))), F.lit(None).cast("int"), lambda found, i: F.coalesce(found, F.when((i > at) & (i <= F.size(long)) & fits(s, F.get(long, i - 1)), i))))
    return F.aggregate(short, F.lit(0), step).isNotNull()


def bounded_year(x: Column, low: int, high: int) -> Column:
    """The first year that stands as a word, if it is within the bounds; null otherwise."""
    year = F.regexp_extract(x, r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("long")
    return F.when(year.between(low, high), year)


def leading_year(x: Column) -> Column:
    """The year with which a text begins."""
    return F.regexp_extract(x, "^((?:19|20)[0-9]{2})", 1).try_cast("long")


def marked_words(x: Column) -> Column:
    """Folded words of two or more characters that begin with a letter and may hold the marks of names of programs, such as scikit-learn; of those only the low line may end one."""
    bare = F.transform(_runs(x), lambda w: F.rtrim(F.ltrim(w, F.lit(MARKS + "0123456789")), F.lit(MARKS.replace("_", ""))))
    return F.filter(bare, lambda w: F.length(w) > 1)


def canonical_url(x: Column) -> Column:
    """Scheme and host in lower case, no fragment, an empty path as /, arguments in order; null for what is no web address."""
    scheme, host = F.lower(F.regexp_extract(x, r"^(\w+)://", 1)), F.lower(F.regexp_extract(x, r"^\w+://([^/?#]+)", 1))
    path, args = F.regexp_extract(x, r"^\w+://[^/?#]+([^?#]*)", 1), F.regexp_extract(x, r"\?([^#]*)", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(args, "&"), lambda a: a != "")), "&")
    made = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(""))
    return F.when((scheme != "") & (host != ""), made)
