import random

import numpy as np

from plumbline.llm import language


def made(rng, letters, n):
    return "".join(rng.choice(letters + " ") for _ in range(n))


def test_many_languages_at_a_time_or_few(monkeypatch):
    rng = random.Random(2)
    alphabets = ["".join(chr(0x400 + 20 * k + i) for i in range(12)) for k in range(30)] * 2
    parser = language.CrossParser(tuple((f"l{k:02}", made(rng, a, 300)) for k, a in enumerate(alphabets)))
    texts = [made(rng, alphabets[k], n) for k, n in ((0, 50), (7, 3000), (31, 400), (59, 1))] + ["", "1 2", "ab" * 3000]
    whole = parser.predict(texts)
    coded = [parser.codes(t) for t in texts]
    every = parser.phrases(coded)
    held = []
    inner = parser.parsed
    monkeypatch.setattr(language, "CELLS", 10_000)
    monkeypatch.setattr(parser, "parsed", lambda c, s: held.append(len(s) * sum(map(len, c))) or inner(c, s))
    assert (parser.phrases(coded) == every).all() and parser.predict(texts) == whole and max(held) <= max(10_000, sum(map(len, coded)))
    assert len(held) == 2 * 60 and all((a[0] != "und") == bool(c.any()) for a, c in zip(whole, coded, strict=True))


def test_no_learning_text_is_short_enough(spark, monkeypatch):
    monkeypatch.setattr(language, "LEARN_CHARS", 100)
    rows = [(i, "a" * (500 - i), "long") for i in range(60)] + [(100 + i, f"text {i} " * 3, "short") for i in range(60)] + [(300, None, "none"), (None, "x", "none"), (301, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = dict(language.labelled_text(docs))
    assert sorted(found) == ["long", "short"] and set(found["long"]) == {"a"} and 0 < len(found["short"]) <= 100 + language.LEARN_DOCS
    assert len(found["long"]) >= 441 and found == dict(language.labelled_text(docs.repartition(5)))
    assert language.labelled_text(docs.where("false")) == () and language.languages(docs, ()).where("lang_pred <> 'und'").count() == 0


def test_one_very_long_text():
    parser = language.CrossParser((("a", "abab baba ab"), ("b", "cdcd dcdc cd")))
    rng = np.random.default_rng(1)
    text = "".join(np.array(list("cd "))[rng.integers(0, 3, 3_000_000)])
    assert parser.predict([text])[0][0] == "b"
