"""Names in texts, against one pattern of all names."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from civicgrid.functions.names import NameIndex, without_overlaps
from civicgrid.operators import mentions


def by_pattern(names, texts):
    low = {n.strip().lower(): n.strip() for n in sorted(names) if len(n.strip()) >= 3}
    order = sorted(low, key=lambda n: (-len(n), n))
    pattern = re.compile(rf"(?<!\w)({'|'.join(map(re.escape, order)) or '(?!)'})\w{{0,4}}(?!\w)", re.IGNORECASE)
    return [(k, m.start(), m.end(), low[m[1].lower()]) for k, t in enumerate(texts) for m in pattern.finditer(t or "")]


def test_hits_are_those_of_a_pattern():
    r = random.Random(1)
    for _ in range(800):
        names = ["".join(r.choice("aábc -'._1") for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 12))]
        texts = [None if r.random() < 0.05 else "".join(r.choice("AaÁábBc  -'._1\n") for _ in range(r.randint(0, 60))) for _ in range(5)]
        assert list(without_overlaps(NameIndex(names).hits(texts))) == by_pattern(names, texts)


def test_names_that_begin_alike():
    cities = ["Vác", "Vácrátót", "Szentes", "Szentgotthárd", "Szent", "'s-Hertogenbosch"]
    texts = ["Vácrátóton és Vácott", "vácrátóti", "szentgotthárdi klub Szentesen", "Szentgotth", "in 's-hertogenbosch.", "Vácrátótiaknak"]
    assert list(without_overlaps(NameIndex(cities).hits(texts))) == by_pattern(cities, texts)
    assert [h[3] for h in without_overlaps(NameIndex(cities).hits(texts[:1]))] == ["Vácrátót", "Vác"]


def test_time_goes_with_texts_and_not_with_names():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9))) for _ in range(110_000)]
    texts = [" ".join(r.choice(words[100_000:]) for _ in range(200)) for _ in range(1000)]

    def seconds(n):
        index, best = NameIndex(words[:n]), []
        for _ in range(3):
            began = time.perf_counter()
            list(index.hits(texts))
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(100_000) < 4 * seconds(100)


@pytest.mark.parametrize("most", [1000, 3])
def test_a_dictionary_in_parts_finds_the_same(spark, most):
    r = random.Random(3)
    cities = [*("".join(r.choice("abc") for _ in range(r.randint(3, 5))) for _ in range(25)), "ab", " abcab ", None]
    rows = [(k, r.choice([*cities[:20], "", None]), *(None if r.random() < 0.1 else " ".join("".join(r.choice("abcABC") for _ in range(r.randint(2, 8))) for _ in range(12)) for _ in range(2))) for k in range(150)]
    frame = spark.createDataFrame(rows, "key long, city string, description string, contact string").withColumn("place", F.lit("clash"))
    got = mentions.find_mentions(frame, spark.createDataFrame([(c,) for c in cities], "city string"), most=most).collect()
    want = {}
    for key, city, *texts in rows:
        for k, start, stop, name in by_pattern([c for c in cities if c], texts) if city else ():
            if not name.startswith(city) and not city.startswith(name):
                want.setdefault((str(key), name), (("description", "contact")[k], texts[k][start:stop]))
    assert {(g["key"], g["mentioned"]): (g["field"], g["matched"]) for g in got} == want and len(got) == len(want) > 50
    assert mentions.find_mentions(frame.limit(0), cities[:3]).count() == 0 == mentions.find_mentions(frame, []).count()
