"""Spelling variants against SQL and a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from tests.llm.cases import CLASHES, documents, rows

from civicgrid.llm import spelling
from civicgrid.llm.queries import OP13_SQL, op13_spelling_variants


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    at = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def brute(words: dict[str, int], ratio: int = 10) -> list[tuple]:
    form, out = {}, []
    for w, n in words.items():
        others = sorted((-words[x], x) for x in words if near(w, x))
        form[w] = (others[0][1] if others and -others[0][0] >= ratio * n else None, len(others))
    for w, n in words.items():
        root = w
        while form[root][0] is not None:
            root = form[root][0]
        out.append((w, form[w][0], root, n, form[w][1], words[form[w][0]] if form[w][0] else None))
    return sorted(out, key=repr)


def words_of(data: list[tuple]) -> dict[str, int]:
    counts = Counter()
    for doc_id, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def misspelt(r: random.Random, word: str) -> str:
    at = r.randrange(len(word) + 1)
    return word[:at] + r.choice(["", "b", "é", "ÿ"]) + word[at + r.randrange(2) :]


def test_variants_are_those_of_all_pairs(spark):
    r = random.Random(4)
    stems = ["".join(r.choice("abé") for _ in range(r.choice([3, 4, 5, 7, 63, 64, 65, 66, 300]))) for _ in range(25)]
    words = {}
    for stem in stems:
        for _ in range(12):
            words[stem] = 10 ** r.randrange(6)
            stem = misspelt(r, stem) if r.random() < 0.7 else stem
            words.setdefault(stem, r.choice([1, 2, 10, 20, 100]))
    words = {w: n for w, n in words.items() if w}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    want = brute(words)
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(w[1] is not None for w in want) > 40 and any(w[1] not in (None, w[2]) for w in want) and any(len(w[0]) > 64 and w[4] for w in want)


def test_a_pair_shares_one_key(spark):
    words = ["aaaaaaa", "aaaaaa", "aaaabaaa", "aaaaaaaa", "abababab", "babababa", "abbabab", "aabbabab", "abababa"]
    named = spark.createDataFrame([(w, w, 1) for w in words], "word string, name string, n long")
    met = [(x["a"], x["b"]) for x in spelling.meeting(named).collect()]
    assert all(met.count((a, b)) == near(a, b) for a in words for b in words if a < b and near(a, b))


def test_query_over_awkward_documents(spark, tmp_path):
    r = random.Random(9)
    base = ["Straßenbahn", "FAÇADES", "naïveté", "übergröße", "correspondence", "abcdefg", "ÀÉÎõüÿÿ", "x" * 90]
    texts = [" ".join(r.choice(base) if r.random() < 0.8 else misspelt(r, r.choice(base)) for _ in range(400)) for _ in range(6)]
    data = [x[:2] for x in rows()] + [(100 + i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (7, "ab×cdefgh÷ijklmnop×ab×cdefgh"), (2**60, "y" * 40_000), (2**60 + 1, "y" * 39_999 + "z"), (2**60, "y" * 40_000), (2**60 + 1, "y" * 39_999 + "z")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", *[f"'clash' AS `{c}`" for c in [*CLASHES, "word", "run", "a", "b"]])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_spelling_variants(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(words_of(data)) and any(len(g[0]) > 30_000 and g[4] for g in got)
    assert spelling.document_variants(documents(spark, [])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.sql(OP13_SQL)
    out = op13_spelling_variants(spark, f"/root/testdata/{sf}")
    assert out.columns == want.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(want.fetchall(), key=repr)
