"""Raw pages and nested JSON as tables of parts and leaves. Parsing needs Python, in Arrow batches; each row stands alone."""

from __future__ import annotations

import json
import re
from functools import reduce
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags whose text is not shown, and tags that never close.
HIDDEN = {"script", "style", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A tag that ends the open tags given, within the nearest table or list.
ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
PARTS = "kind string, ordinal int, path string, text string, target string"
#: Fixed value: an ampersand that begins no whole character reference. One without its semicolon, as cut texts end in, is text.
BARE = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)")


class _Parts(HTMLParser):
    """Collects (kind, path, text, target) of a page in document order; unclosed tags are closed by their parents' ends."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.open, self.parts, self.collecting = url, [], [], []

    def feed(self, data: str) -> None:
        super().feed(BARE.sub("&amp;", data))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_implied(tag)
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self._collect("link", tag, target=urljoin(self.url, a["href"]))
        elif tag in {"h1", "h2", "h3", "h4", "h5", "h6"}:
            self._collect("heading", tag)
        elif tag in {"td", "th"}:
            self._collect("cell", tag)
        elif tag in {"dt", "dd", "title"}:
            self._collect(tag, tag)
        elif tag == "img" and a.get("src"):
            self.parts.append(["image", self.path(), a.get("alt") or "", urljoin(self.url, a["src"])])
        elif tag == "form":
            self.parts.append(["form", self.path(), a.get("method") or "get", urljoin(self.url, a.get("action") or "")])
        if tag not in VOID:
            self.open.append(tag)

    def _end_implied(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if tag not in ENDS or self.open[at] in {"table", "dl"}:
                return
            if self.open[at] in ENDS[tag]:
                del self.open[at:]
                self._close()

    def _collect(self, kind: str, tag: str, target: str | None = None) -> None:
        part = [kind, self.path(), "", target]
        self.parts.append(part)
        self.collecting.append((tag, len(self.open), part, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
            self._close()

    def _close(self) -> None:
        while self.collecting and self.collecting[-1][1] >= len(self.open):
            _, _, part, texts = self.collecting.pop()
            part[2] = " ".join(" ".join(texts).split())

    def handle_data(self, data: str) -> None:
        if not HIDDEN.intersection(self.open) and data.strip():
            for *_, texts in self.collecting:
                texts.append(data)
            self.parts.append(["text", self.path(), " ".join(data.split()), None])

    def path(self) -> str:
        """At most eight enclosing tags."""
        return "/".join(self.open[-8:])

    def finish(self) -> list:
        self.close()
        self.open = []
        self._close()
        return self.parts


def page_parts(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, kind, ordinal, path, text, target) of each page: title, headings, links, images, forms, cells, dt, dd, texts.

    Targets are resolved against the page's address. A null page has no parts; ordinals count a page's parts of a kind.
    """
    kept = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, u, h in zip(b["key"], b["url"], b["html"], strict=True):
                parser, seen, rows = _Parts(u), {}, []
                parser.feed(h)
                for kind, path, text, target in parser.finish():
                    seen[kind] = seen.get(kind, -1) + 1
                    rows.append((k, kind, seen[kind], path, text, target))
                yield pd.DataFrame(rows, columns=["key", "kind", "ordinal", "path", "text", "target"])

    return kept.mapInPandas(parse, f"key {dict(kept.dtypes)['key']}, {PARTS}").withColumnRenamed("key", key)


def leaves(value: object, path: str = "$") -> Iterator[tuple[str, str, str | None]]:
    """(path, type, text) of a value's leaves, depth first; an empty object or list and null are leaves. Any depth: what is open waits on a list."""
    waiting = [(path, value)]
    while waiting:
        path, value = waiting.pop()
        if isinstance(value, dict) and value:
            quoted = [(k.replace("\\", "\\\\").replace("'", "\\'"), v) for k, v in value.items()]
            waiting += [(f"{path}['{k}']", v) for k, v in reversed(quoted)]
        elif isinstance(value, list) and value:
            waiting += [(f"{path}[{i}]", value[i]) for i in range(len(value) - 1, -1, -1)]
        elif isinstance(value, (dict, list)):
            yield path, "object" if isinstance(value, dict) else "array", None
        elif value is None:
            yield path, "null", None
        elif isinstance(value, bool):
            yield path, "boolean", "true" if value else "false"
        else:
            yield path, "string" if isinstance(value, str) else "number", value if isinstance(value, str) else json.dumps(value)


def json_leaves(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, ordinal, path, type, text) of JSON texts; a null or broken text, or one nested more deeply than the parser goes, gives one row of type "error"."""
    kept = df.select(F.col(key).alias("key"), F.col(payload).alias("payload"))

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["key"], b["payload"], strict=True):
                try:
                    found = list(leaves(json.loads(text)))
                except (TypeError, ValueError, RecursionError):
                    found = [("$", "error", None)]
                rows += [(k, i, *leaf) for i, leaf in enumerate(found)]
            yield pd.DataFrame(rows, columns=["key", "ordinal", "path", "type", "text"])

    return kept.mapInPandas(flatten, f"key {dict(kept.dtypes)['key']}, ordinal int, path string, type string, text string").withColumnRenamed("key", key)


CONTROLS = "form int, form_id string, action string, method string, ordinal int, kind string, name string, value string, label string, chosen boolean"


class _Forms(HTMLParser):
    """Collects the controls of a page's forms, [form, id, action, method, kind, name, value, label, chosen] each, in document order."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.controls, self.forms = url, [], 0
        self.form = self.select = self.filling = None  # what is open: (number, id, action, method), [name, options, several], the control that takes text

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "form":
            self.form = (self.forms, a.get("id"), urljoin(self.url, a.get("action") or ""), (a.get("method") or "get").lower())
            self.forms += 1
        elif self.form is None:
            return
        elif tag == "input":
            kind = (a.get("type") or "text").lower()
            self._add(kind, a.get("name"), a.get("value", "on" if kind in {"checkbox", "radio"} else ""), "checked" in a if kind in {"checkbox", "radio"} else None)
        elif tag == "select":
            self._end_option()
            self.select = [a.get("name") or a.get("id"), [], "multiple" in a]
        elif tag == "option" and self.select:
            self._end_option()
            self.filling = self._add("option", self.select[0], a.get("value"), "selected" in a)
            self.select[1].append(self.filling)
        elif tag in {"textarea", "button"}:
            self.filling = self._add(tag, a.get("name"), a.get("value", "") if tag == "button" else None, None)

    def _add(self, kind: str, name: str | None, value: str | None, chosen: bool | None) -> list:
        self.controls.append([*self.form, kind, name, value, "", chosen])
        return self.controls[-1]

    def handle_data(self, data: str) -> None:
        if self.filling is not None:
            self.filling[7] += data

    def _end_option(self) -> None:
        if self.filling is not None:
            control, self.filling = self.filling, None
            text = " ".join(control[7].split())
            if control[6] is None:  # an option without a value has its text for one, as a text area has
                control[6] = control[7] if control[4] == "textarea" else text
            control[7] = text

    def _end_select(self) -> None:
        self._end_option()
        if self.select:
            _, options, several = self.select
            picked = [o for o in options if o[8]]
            if not several and options:  # one is chosen: the last that says so, else the first
                for o in options:
                    o[8] = o is (picked or options[:1])[-1]
            self.select = None

    def handle_endtag(self, tag: str) -> None:
        if tag in {"option", "textarea", "button"}:
            self._end_option()
        elif tag == "select":
            self._end_select()
        elif tag == "form":
            self._end_select()
            self.form = None

    def finish(self) -> list:
        self.close()
        self._end_select()
        return self.controls


def page_controls(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, form, form_id, action, method, ordinal, kind, name, value, label, chosen): a row per control of each form of a page, in order.

    kind is the type of an input, option, textarea or button; an option has its select's name (or id). chosen says of options whether they are selected (one
    of a select that takes one, the first if none says so), of checkboxes and radio buttons whether they are checked, else it is null. Controls outside of
    forms and null pages have no rows; unclosed tags end with their form, or the page.
    """
    kept = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    names = ["key", *(c.split()[0] for c in CONTROLS.split(", "))]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, u, h in zip(b["key"], b["url"], b["html"], strict=True):
                parser = _Forms(u)
                parser.feed(h)
                rows += [(k, *c[:4], i, *c[4:]) for i, c in enumerate(parser.finish())]
            yield pd.DataFrame(rows, columns=names).astype({"chosen": object})

    return kept.mapInPandas(parse, f"key {dict(kept.dtypes)['key']}, {CONTROLS}").withColumnRenamed("key", key)


class _Results(HTMLParser):
    """Collects [id, name, group, address, image] of a page's links that name an id, from the table row that holds the link or else from the link's text."""

    def __init__(self, url: str, part: str, parameter: str, name: str, group: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.part, self.parameter, self.classes = url, part, parameter, {name: "name", group: "group"}
        self.found, self.rows, self.spans, self.link = [], [], [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        row = self.rows[-1] if self.rows else None
        if tag == "table":
            self.rows.append(None)  # rows within end at it
        elif tag == "tr":
            if row:
                self._end_row()
            self.rows.append({"name": None, "group": None, "image": None})
        elif tag == "span":
            what = next((self.classes[c] for c in a.get("class", "").split() if c in self.classes), None)
            self.spans.append(None)
            if what and row and row[what] is None:
                row[what] = self.spans[-1] = []
        elif tag == "img" and a.get("src") and row and row["image"] is None:
            row["image"] = urljoin(self.url, a["src"])
        elif tag == "a":
            self._end_link()
            href = a.get("href", "")
            ids = parse_qs(urlparse(urljoin(self.url, href)).query).get(self.parameter, [""]) if self.part in href else [""]
            if ids[0].strip():
                self.link = [ids[0].strip(), [], urljoin(self.url, href), row]
                self.found.append(self.link)

    def _end_row(self) -> None:
        self.rows.pop()
        self.spans.clear()

    def _end_link(self) -> None:
        self.link = None

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self._end_link()
        elif tag == "span" and self.spans:
            self.spans.pop()
        elif tag == "tr" and self.rows and self.rows[-1]:
            self._end_row()
        elif tag == "table" and None in self.rows:
            while self.rows.pop() is not None:
                self.spans.clear()

    def handle_data(self, data: str) -> None:
        if self.link:
            self.link[1].append(data)
        for texts in self.spans:
            if texts is not None:
                texts.append(data)

    def finish(self) -> list:
        self.close()
        said = lambda texts: " ".join(" ".join(texts or []).split())
        return [[i, said(row["name"]), said(row["group"]), u, row["image"] or ""] if row else [i, said(text), "", u, ""] for i, text, u, row in self.found]


def result_rows(pages: DataFrame, key: str, url: str, html: str, part: str, parameter: str, name: str, group: str) -> DataFrame:
    """(key, ordinal, id, name, group, address, image): the results that a page lists, each id once, at its first link.

    A result is a link whose address has the part and the query parameter, its id. Name and group are the first texts of spans of those classes in the
    link's table row, the image is the row's first; outside of a table the name is the link's text.
    """
    kept = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, u, h in zip(b["key"], b["url"], b["html"], strict=True):
                parser, first = _Results(u, part, parameter, name, group), {}
                parser.feed(h)
                for r in parser.finish():
                    first.setdefault(r[0], r)
                rows += [(k, i, *r) for i, r in enumerate(first.values())]
            yield pd.DataFrame(rows, columns=["key", "ordinal", "id", "name", "group", "address", "image"])

    return kept.mapInPandas(parse, f"key {dict(kept.dtypes)['key']}, ordinal int, id string, name string, group string, address string, image string").withColumnRenamed("key", key)


def is_detail_candidate(url: Column, hosts: list[str], endings: list[str], deny: list[str], closed: list[str], allow: list[str] | None = None) -> Column:
    """Whether a web address may hold details: of the web, of a host named or ending so, with a path that is not the root, has none of the
    denied words, begins with none of the closed folders (and with one of the allowed, if any) and is no asset. A null address is none."""
    scheme, host = F.lower(F.regexp_extract(url, r"^(\w+)://", 1)), F.lower(F.regexp_extract(url, r"^\w+://([^/?#:]+)", 1))
    path = F.lower(F.regexp_extract(url, r"^\w+://[^/?#]+([^?#]*)", 1))
    ok = scheme.isin("http", "https") & (host.isin(hosts) | reduce(lambda a, e: a | host.endswith(e), endings, F.lit(False)))
    ok &= ~path.isin("", "/") & ~path.rlike(r"\.(css|js|png|jpe?g|gif|pdf)$")
    ok &= reduce(lambda a, d: a & ~F.contains(path, F.lit(d)), deny, F.lit(True)) & reduce(lambda a, d: a & ~path.startswith(d), closed, F.lit(True))
    if allow:
        ok &= reduce(lambda a, d: a | path.startswith(d), allow, F.lit(False))
    return F.coalesce(ok, F.lit(False))
