"""Fits, votes and page records against plain loops and the standard parser."""

import random
from collections import Counter, defaultdict
from html.parser import HTMLParser
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.cases import prose

from civicgrid.llm import language_id, toxicity, warc


def test_ftrl_against_a_loop_over_coordinates():
    r = random.Random(1)
    rows = [(sorted(r.sample(range(40), r.randint(0, 9))), r.random() < 0.4) for _ in range(300)]
    model = toxicity.FtrlProximal(l1=0.5)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        l1 = 0.0 if k == "bias" else model.l1
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - (l1 if z[k] > 0 else -l1)) / ((model.beta + n[k] ** 0.5) / model.alpha + model.l2)

    for features, label in rows:
        keys = [*features, "bias"]
        w = {k: weight(k) for k in keys}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for k in keys:
            z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / model.alpha * w[k]
            n[k] += g * g
        model.learn(np.array(features, np.int64), int(label))
    kept, weights, bias = model.weights()
    assert bias == pytest.approx(weight("bias")) and dict(zip(kept.tolist(), weights.tolist())) == pytest.approx({k: weight(k) for k in range(40) if weight(k)})


def test_features_of_a_text_are_its_words_pairs_and_skips():
    text = "One two, THREE two one one"
    words = toxicity.WordBatch([text.encode()]).hash.tolist()
    mixed = lambda a, b, salt: int(toxicity.mix(np.array([a], np.uint64) * toxicity.BASE + np.uint64(b) + np.uint64(salt))[0])
    want = {*words, *(mixed(a, b, 3) for a, b in zip(words, words[1:])), *(mixed(a, b, 5) for a, b in zip(words, words[2:]))}
    assert toxicity.text_features([text.encode()])[0].tolist() == sorted({h >> (64 - toxicity.BITS) for h in want})


def test_votes_against_a_loop_over_pairs():
    r = np.random.default_rng(2)
    langs = ["en", "de", "nl", "fr", "es"]
    centres = r.normal(size=(5, language_id.DIMENSIONS))
    x = np.concatenate([centres[k] + 2.0 * r.normal(size=(60, language_id.DIMENSIONS)) for k in range(5)]).astype(np.float32)
    model = language_id.Hierarchy(x, [lang for lang in langs for _ in range(60)])
    some = (centres[r.integers(0, 5, 80)] + 4.0 * r.normal(size=(80, language_id.DIMENSIONS))).astype(np.float32)
    found, score = model.predict(some)
    assert model.families == ["germanic", "romance"] and ((score >= 0) & (score <= 1)).all() and len(set(found)) == 5
    for row, got in zip(some, found):
        family = int(np.argmax(row @ model.top[0] + model.top[1]))
        wins, machines = Counter(), {(a, b): (w, bias) for a, b, w, bias in model.pairs[family]}
        assert set(machines) == set(combinations(model.members[family], 2))
        for (a, b), (w, bias) in machines.items():
            wins[a if (row @ w + bias)[0] > 0 else b] += 1
        assert wins[got] == max(wins.values())


def test_letters_against_a_count():
    text = "Straße 12 été, ÉTÉ"
    codes = [int(language_id.LETTERS[b]) for b in (text.lower() + "    ").encode()]
    counts = Counter()
    for n in range(1, 5):
        for at in range(len(codes) - n + 1):
            if codes[at] != 32 or codes[at + n - 1] != 32:
                gram = 0
                for c in codes[at : at + n]:
                    gram = (gram * 257 + c) % 2**32
                counts[((gram * 2654435761 + n * 40503) % 2**32 * 2246822519 % 2**32) >> (32 - language_id.BITS)] += 1
    want = np.zeros(language_id.DIMENSIONS)
    for slot, k in counts.items():
        want[slot] = (k / sum(counts.values())) ** 0.5
    assert np.allclose(language_id.ngram_features([text])[0], want, atol=1e-3)


def test_very_long_texts_are_read_to_their_end(spark):
    long = " ".join(prose(s, 5000) for s in range(60))
    clean = [(i, prose(i, 40), "en" if i % 2 else "fr", i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t + (" vile words here" if y else ""), lang) for i, t, lang, y in clean] + [(100, long, None), (101, long + " vile words here" * 400, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in clean] * 1, "doc_id long, toxic int")
    weights = toxicity.fit(docs, labels, F.lit(True))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, weights).filter("doc_id >= 100").collect()}
    assert 0 <= scores[100] < scores[101] <= 1
    found = language_id.identify(docs, F.col("doc_id") < 100).filter("doc_id >= 100").collect()
    assert len(found) == 2 and {r["lang_pred"] for r in found} <= {"en", "fr"}
    a, b = language_id.ngram_features([long, long + " zzzzqqqq" * 5000])
    assert not np.allclose(a, b)


class Reader(HTMLParser):
    """Text, links, title and language by the standard parser."""

    SKIPPED, BLOCKS = {"script", "style", "noscript", "template", "head"}, {"p", "div", "br", "li", "ul", "h1", "td", "tr", "table", "section"}

    def __init__(self):
        super().__init__()
        self.text, self.links, self.title, self.lang, self.inside = [], [], None, None, []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "html" and self.lang is None:
            self.lang = attrs.get("lang")
        self.inside.append(tag)
        if tag == "br":
            self.inside.pop()
        if not self.skipped():
            if tag == "a" and attrs.get("href") is not None:
                self.links.append(attrs["href"])
            if tag in self.BLOCKS:
                self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS and not self.skipped():
            self.text.append("\n")
        if self.skipped() and tag in self.SKIPPED:
            self.text.append(" ")
        if tag in self.inside:
            del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]

    def handle_comment(self, data):
        self.text.append(" ")

    def handle_data(self, data):
        if "title" in self.inside:
            self.title = (self.title or "") + data
        elif not self.skipped():
            self.text.append(data)

    def skipped(self):
        return any(t in self.SKIPPED for t in self.inside)


def tidy(text):
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def test_blocks_against_the_standard_parser():
    r = random.Random(4)
    word = lambda: r.choice(["alpha", "béta", "x &amp; y", "&lt;tag&gt;", "&#233;t&eacute;", "a  b", "\n", "naïve", "1 > 0"])

    def piece(depth):
        kind = r.randrange(9)
        if depth == 0 or kind < 3:
            return word() + r.choice(["", " "])
        if kind == 3:
            return f"<!-- {r.choice(['note', '<p>no</p>'])} -->"
        if kind == 4:
            return f"<{(t := r.choice(['script', 'style']))}>var x = 1 < 2;</{t}>"
        if kind == 5:
            return f"<a class='c' href=\"/to/{r.randrange(9)}?a=1&amp;b=2\">{piece(depth - 1)}</a>"
        if kind == 6:
            return "<br>"
        tag = r.choice(["p", "div", "li", "b", "span", "h1", "td", "section"])
        return f"<{tag} id=x>{''.join(piece(depth - 1) for _ in range(r.randrange(4)))}</{tag}>"

    for _ in range(300):
        page = f"<!DOCTYPE html><html lang='{r.choice(['en', 'fr-CA'])}'><head><title> A {word()} </title><style>p {{}}</style></head><body>{''.join(piece(4) for _ in range(6))}</body></html>"
        reader = Reader()
        reader.feed(page)
        reader.close()
        assert warc.plain_text(page) == tidy("".join(reader.text))
        fields = [f"title: {' '.join(reader.title.split())}", f"language: {reader.lang}", *(f"outlink: {x}" for x in reader.links), "source-header: A: b"]
        assert warc.metadata_fields(page, "A: b\r\n") == "".join(f"{x}\r\n" for x in fields)
