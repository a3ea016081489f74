"""Spellings of person names that mean one person."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge
from itertools import chain

import pandas as pd
from plumbline.functions.text import PARTICLES, given_first, normalize_person_name
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_tokens(x: Column) -> Column:
    """Upper-case words of a name in the order given name, family name; no particles."""
    return F.filter(F.split(normalize_person_name(given_first(x)), " "), lambda w: (w != "") & ~F.lower(w).isin(PARTICLES))


def ordered_subset(short: list[str], long: list[str]) -> bool:
    """Whether the words of one name occur in the other in order; a single letter stands for any word that it begins."""
    at = iter(long)
    return all(any(s == w or (min(len(s), len(w)) == 1 and s[0] == w[0]) for w in at) for s in short)


def compatible(a: list[str], b: list[str]) -> bool:
    return ordered_subset(a, b) if len(a) <= len(b) else ordered_subset(b, a)


class ByWord:
    """Token lists by the words in them, to find those that may be compatible with a list without looking at all."""

    def __init__(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.letters: dict[str, list[int]] = {}

    def add(self, place: int, tokens: list[str]) -> None:
        """Places must rise."""
        for found, keys in ((self.words, set(tokens)), (self.letters, {w[0] for w in tokens})):
            for key in keys:
                found.setdefault(key, []).append(place)

    def meeting(self, token: str) -> tuple[list[int], list[int]]:
        """Places of the lists with a word that the token may stand for, or that may stand for it: two rising lists."""
        if len(token) == 1:
            return self.letters.get(token, []), []
        return self.words.get(token, []), self.words.get(token[0], [])

    def holding(self, tokens: list[str]) -> Iterator[int]:
        """Places, rising, of lists that may hold all of the tokens: those that meet the rarest one."""
        return _rising(*min((self.meeting(t) for t in tokens), key=lambda m: len(m[0]) + len(m[1])))


def _rising(a: list[int], b: list[int]) -> Iterator[int]:
    last = -1
    for place in merge(a, b):
        if place != last:
            yield place
        last = place


def grouped(lists: list[list[str]]) -> list[int]:
    """For each token list, longest lists first, the place of the one that founded its group: it joins the first group whose members are all compatible."""
    members: dict[int, list[list[str]]] = {}
    founders, home = ByWord(), []
    for place, tokens in enumerate(lists):
        # members hold no more words than their founder, and none before has fewer than this list
        of = next((f for f in founders.holding(tokens) if all(ordered_subset(tokens, other) for other in members[f])), None)
        if of is None:
            of = place
            members[of] = []
            founders.add(of, tokens)
        members[of].append(tokens)
        home.append(of)
    return home


def only_fits(asked: list[list[str]], known: list[list[str]]) -> list[int | None]:
    """For each asked token list the place of the one known list that is compatible, None if none or several are."""
    index, rarest = ByWord(), ByWord()
    for place, tokens in enumerate(known):
        index.add(place, tokens)
    for place, tokens in enumerate(known):
        # a list that is held by a longer one meets it at any of its words: at its rarest is enough
        rarest.add(place, [min(tokens, key=lambda t: sum(map(len, index.meeting(t))))])
    out: list[int | None] = []
    for tokens in asked:
        hits: set[int] = set()
        longer = (i for i in index.holding(tokens) if len(known[i]) >= len(tokens))
        shorter = (i for t in dict.fromkeys(tokens) for part in rarest.meeting(t) for i in part if len(known[i]) < len(tokens))
        for i in chain(longer, shorter):
            if i not in hits and compatible(tokens, known[i]):
                hits.add(i)
                if len(hits) > 1:
                    break
        out.append(hits.pop() if len(hits) == 1 else None)
    return out


def block_keys(tokens: str) -> list[Column]:
    """First letter and family name: where compatible names meet."""
    return [F.substring(F.col(tokens)[0], 1, 1).alias("initial"), F.element_at(tokens, -1).alias("family")]


def merge_names(names: DataFrame, name: str) -> DataFrame:
    """(name, person) for each distinct spelling: person is the fullest spelling of its group.

    Names meet by first letter and family name. In such a block, spellings with more words come first, then longer ones,
    then in order of code points; each joins the first group whose members are all compatible. A name of one word, or none, stands alone.

    Spellings of the same words always share a group, so a block is reduced to its distinct word lists before it moves, each with its first
    spelling. Groups are looked up by the rarest word of a list, so a common family name isn't compared all against all; its distinct word
    lists are held by one task.
    """
    each = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct().withColumn("tokens", name_tokens(F.col("name")))
    alone = each.where("size(tokens) < 2").select("name", F.col("name").alias("person"))
    several = each.where("size(tokens) >= 2")
    lists = several.groupBy("tokens").agg(F.min(F.struct((-F.length("name")).alias("rank"), "name")).alias("first")).select("tokens", "first.rank", "first.name", *block_keys("tokens"))

    def merged(block: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(zip(map(list, block["tokens"]), block["rank"], block["name"], strict=True), key=lambda r: (-len(r[0]), r[1], r[2]))
        home = grouped([tokens for tokens, _, _ in ordered])
        return pd.DataFrame({"tokens": [tokens for tokens, _, _ in ordered], "person": [ordered[h][2] for h in home]})

    persons = lists.groupBy("initial", "family").applyInPandas(merged, "tokens array<string>, person string")
    return several.join(persons, "tokens").select("name", "person").unionByName(alone)


def resolve(mentions: DataFrame, name: str, people: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(name, person_id, tier) of mentions among people(person_id, person): the same folded name, else the same alias in aliases(person_id, alias), else
    the one compatible person.

    Word lists of mentions meet people by first letter and family name and are looked up there by their rarest words, until two people fit. A name that fits several people, a bare family name, and a name that fits nobody get null.
    """
    m = mentions.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct().withColumn("tokens", name_tokens(F.col("name")))
    p = people.select("person_id", name_tokens(F.col("person")).alias("known"))
    exact = m.join(p, F.col("tokens") == F.col("known")).groupBy("name").agg(F.count("*").alias("n"), F.min("person_id").alias("id"))
    found = exact.withColumn("tier", F.lit("exact"))
    if aliases is not None:
        a = aliases.select("person_id", name_tokens(F.col("alias")).alias("known"))
        alias = m.join(exact, "name", "left_anti").join(a, F.col("tokens") == F.col("known")).groupBy("name").agg(F.countDistinct("person_id").alias("n"), F.min("person_id").alias("id"))
        found = found.unionByName(alias.withColumn("tier", F.lit("alias")))
    rest = m.join(found, "name", "left_anti").where("size(tokens) >= 2")
    kind = dict(people.dtypes)["person_id"]

    def fits(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        hits = only_fits([list(t) for t in asked["tokens"]], [list(t) for t in known["known"]])
        at = [i for i, h in enumerate(hits) if h is not None]
        return asked.iloc[at][["tokens"]].assign(id=pd.Series([known["person_id"].iloc[hits[i]] for i in at], dtype=object).values)

    # word lists, not spellings, meet the people of their block
    lists = rest.select("tokens").distinct().select("tokens", *block_keys("tokens"))
    block = p.where("size(known) >= 2").select(F.col("person_id").cast("string").alias("person_id"), "known", *block_keys("known"))
    one = lists.groupBy("initial", "family").cogroup(block.groupBy("initial", "family")).applyInPandas(fits, "tokens array<string>, id string")
    near = rest.join(one, "tokens").select("name", F.lit(1).cast("long").alias("n"), F.col("id").cast(kind).alias("id"))
    found = found.unionByName(near.withColumn("tier", F.lit("inferred"))).where("n = 1")
    return m.select("name").join(found, "name", "left").select("name", F.col("id").alias("person_id"), "tier")
