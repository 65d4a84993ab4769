"""Duplicate detection against a comparison of all pairs of a city, and the state of candidates."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from civicgrid.functions import text as T
from civicgrid.operators import dedup
from civicgrid.operators.directory import people, records

SF = "/root/testdata/sf0.001"
FIELDS = ("description", "meeting_schedule", "location", "contact", "website")


def articles(name):
    return re.sub("^(a|az|the|die|le|la|el|los|las) ", "", name.lower().strip())


def no_city(name, city):
    left = re.sub(r"\b" + re.escape(city.lower()) + r"i?\b", "", name.lower()).strip(" –-/")
    return left if len(left) > 2 else name.lower()


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def site(r):
    u = (r["website"] or "").rstrip("/").lower().strip()
    return "" if u in T.NO_URL else u


def rich(r):
    return sum(bool(r[f]) for f in FIELDS if f in r) + len(r["social_links"] or [])


def by_city(rows):
    out = {}
    for r in rows:
        out.setdefault(r["city"], []).append(r)
    return out.values()


def named(name, city, topic, i, **more):
    return {"id": i, "name": name, "city": city, "topic": topic, "website": None, "description": None, "meeting_schedule": None, "location": None, "contact": None, "social_links": [], **more}


SCHEMA = "id long, name string, city string, topic string, website string, description string, meeting_schedule string, location string, contact string, social_links array<string>"


def groups():
    names = ["Futók", "Futók Köre", "Pécsi Futók Köre", "pécsi futók kör", "the Runners Circle", "Runners Circle", "Runner Circles", "klub", "Klub", "Sakk", "Pécs", "", "csoport", "Aurora énekkar", "Auróra énekkar", "énekkar aurora", "a" * 230 + "b", "a" * 230 + "c", "aaaab", "baaaa", "Running", "gninnuR"]
    out = [named(n, c, t, 10 * i + k, description="x" if i % 2 else None) for i, n in enumerate(names) for k, (c, t) in enumerate([("Pécs", "run"), ("Pécs", "sing"), ("Vác", "run")])]
    return out + [named(f"site {k}", "Vác", "t" + str(k % 2), 900 + k, website=w) for k, w in enumerate(["http://A.example/", "http://a.example", "n/a", "n/a", "http://b.example", "http://b.example"])]


def test_names_of_communities(spark):
    data = groups() + [r.asDict() for r in records(spark, SF).select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    want = set()
    for city in by_city(data):
        city.sort(key=lambda r: (r["topic"], r["id"]))
        for i, a in enumerate(city):
            for b in city[i + 1 :]:
                if a["topic"] == b["topic"] or site(a) and site(a) == site(b):
                    continue
                x, y = (articles(no_city(r["name"], r["city"])) for r in (a, b))
                shorter = x if len(x) <= len(y) else y
                if len(shorter) < 5 or shorter.strip() in dedup.GENERIC:
                    continue
                s = 0.9 if len(x) > 4 and len(y) > 4 and (x in y or y in x) else ratio(x, y)
                if s >= 0.85:
                    w, z = (a, b) if rich(a) >= rich(b) else (b, a)
                    want.add((w["name"].lower(), w["topic"].lower(), z["name"].lower(), z["topic"].lower(), round(s, 4)))
    rows = spark.createDataFrame(data, SCHEMA)
    found = dedup.community_candidates(rows).filter("signal = 'fuzzy_name'")
    keys = rows.select(T.record_key("c", F.col("name"), F.col("city"), F.col("topic")).alias("key"), F.lower("name").alias("name"), F.lower("topic").alias("topic")).dropDuplicates(["key"])
    got = found.join(keys.withColumnsRenamed({"key": "winner", "name": "a", "topic": "s"}), "winner").join(keys.withColumnsRenamed({"key": "loser", "name": "b", "topic": "t"}), "loser")
    assert {(r["a"], r["s"], r["b"], r["t"], r["similarity"]) for r in got.collect()} == want and len(want) > 20


def test_addresses_as_groups(spark):
    rows = spark.createDataFrame(groups(), SCHEMA)
    out = dedup.community_candidates(rows).filter("signal = 'url_match'")
    assert out.count() == 2 and {r["similarity"] for r in out.collect()} == {1.0}


@pytest.mark.parametrize("kind", ["venue", "person"])
def test_venues_and_people(spark, kind):
    if kind == "venue":
        source = spark.createDataFrame(groups(), SCHEMA).drop("topic")
        found = dedup.venue_candidates(source).filter("signal = 'fuzzy_name'")
    else:
        source = people(spark, SF).filter("id % 3 = 0")
        found = dedup.people_candidates(source)
    data, want = [r.asDict() for r in source.collect()], 0
    for city in by_city(data):
        city.sort(key=lambda r: r["id"])
        for i, a in enumerate(city):
            for b in city[i + 1 :]:
                if kind == "venue" and site(a) and site(a) == site(b):
                    continue
                x, y = articles(a["name"]), articles(b["name"])
                alike = bool(x and y) and ratio(x, y) >= (0.85 if kind == "venue" else 0.9)
                want += alike and (kind == "venue" or ratio(articles(a["community_name"]), articles(b["community_name"])) >= 0.7)
    assert found.count() == want > 0


def test_stale_candidates_are_dismissed(spark):
    rows = spark.createDataFrame([("a", "Runners Circle", "X", None), ("b", "The Runners Circle", "X", None), ("c", "Chess", "X", "http://s"), ("d", "Choir", "X", "http://s/")], "key string, name string, city string, website string")
    pairs = [("a", "b", "fuzzy_name"), ("a", "c", "fuzzy_name"), ("c", "d", "url_match"), ("a", "d", "url_match"), ("a", "gone", "manual"), ("a", "c", "manual")]
    known = spark.createDataFrame([(i, *p, None) for i, p in enumerate(pairs)], "id int, winner string, loser string, signal string, resolution string")
    assert [r["resolution"] for r in dedup.still_valid(known, rows).orderBy("id").collect()] == [None, "auto_dismissed", None, "auto_dismissed", "auto_dismissed", None]


def test_a_whole_scan_twice_adds_nothing(spark):
    rows = spark.createDataFrame(groups(), SCHEMA)
    none = spark.createDataFrame([], "entity string, winner string, loser string, similarity double, signal string, resolution string, id long")
    persons = people(spark, SF).filter("id % 3 = 0")
    first = dedup.detect_all(none, rows, rows.drop("topic"), persons)
    pairs = lambda df: {(r["entity"], *sorted((r["winner"], r["loser"])), r["resolution"]) for r in df.collect()}
    assert pairs(dedup.detect_all(first, rows, rows.drop("topic"), persons)) == pairs(first) and first.count() > 10


def greedy(rows):
    kept = []
    for r in rows:
        for at, k in enumerate(kept):
            x, y, s, t = articles(r["name"]), articles(k["name"]), (r["website"] or "").rstrip("/"), (k["website"] or "").rstrip("/")
            if r["website"] and k["website"] and s == t or x and y and (x in y or y in x or ratio(x, y) > 0.88):
                if rich(r) > rich(k):
                    kept[at] = r
                break
        else:
            kept.append(r)
    return {r["id"] for r in kept}


def test_representatives_of_pairs(spark):
    data = groups() + [named(f"name {k % 7}{k % 3}", "Pécs", "run", 5000 + k, website=f"http://w{k % 11}" if k % 2 else None, contact="x" if k % 5 == 0 else None) for k in range(80)]
    data += [{**r.asDict(), "id": r["id"] + 10_000, "topic": "one"} for r in records(spark, SF).select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    want = set()
    pairs = {}
    for place, r in enumerate(sorted(data, key=lambda r: (r["name"], r["id"]))):
        pairs.setdefault((r["city"], r["topic"]), []).append({**r, "place": place})
    for rows in pairs.values():
        want |= greedy(rows)
    flat = [r for rows in pairs.values() for r in rows]
    out = dedup.representatives(spark.createDataFrame(flat, SCHEMA + ", place long"))
    assert {r["id"] for r in out.collect()} == want and len(want) < len(data) - 20


def test_saving_a_pair(spark):
    cols = "key string, city string, topic string, name string, website string, social_links array<string>, hidden boolean"
    stored = spark.createDataFrame([("a", "X", "t", "Alpha club", None, [], True), ("b", "X", "t", "Beta", None, [], False), ("c", "Y", "t", "Gamma", None, [], True)], cols)
    incoming = spark.createDataFrame([("a", "X", "t", "Alpha club", "http://new", [], False), ("d", "X", "t", "Alpha club house", "http://d", ["http://l"], False)], cols)
    out = {r["key"]: (r["website"], r["hidden"]) for r in dedup.save_pairs(stored, incoming).collect()}
    assert out == {"b": (None, False), "c": (None, True), "d": ("http://d", False)}


def test_copies_of_a_name_are_compared_once(spark, monkeypatch):
    names = ["Futók", "Futók Köre", "Sakk"]
    rows = [named(names[k % 3], "Pécs", "run", k, website=f"http://w{k}" if k % 4 == 0 else None) | {"place": k} for k in range(300)]
    compared, close = [], dedup.close_pairs
    monkeypatch.setattr(dedup, "close_pairs", lambda frame, *more: compared.append(frame.count()) or close(frame, *more))
    out = dedup.representatives(spark.createDataFrame(rows, SCHEMA + ", place long"))
    assert {r["id"] for r in out.collect()} == greedy(rows) and compared == [3]


@pytest.mark.parametrize("kind", ["community", "venue", "person"])
def test_copies_give_each_candidate_once(spark, kind):
    names = ["Futók Köre", "Futók Körei", "Aurora énekkar", "Auróra énekkar", "Sakk"]
    sites = [None, "http://a.example", "http://b.example/"]
    rows = [named(names[k % 5], "Pécs", f"t{k % 3}", k * 37 % 101, website=sites[k % 7 % 3], contact="x" if k % 11 == 0 else None) | {"role": f"r{k % 2}", "community_name": ["runners one", "runners two", "choir"][k % 3]} for k in range(100)]
    rows += [named(n, "Vác", f"t{k}", i, website=w) | {"role": "r", "community_name": "c"} for i, (n, k, w) in enumerate([("Alpha club", 0, "http://s"), ("Alpha clubs", 1, "http://s"), ("Alpha clubs", 1, "http://t"), ("Beta circle", 0, "http://u"), ("Beta circles", 1, "http://u"), ("Beta circle", 0, "http://u")], 200)]
    find = {"community": dedup.community_candidates, "venue": dedup.venue_candidates, "person": dedup.people_candidates}[kind]
    frame = spark.createDataFrame(rows, SCHEMA + ", role string, community_name string")
    every, once = find(frame).collect(), find(frame, copies=False).collect()
    assert sorted(set(map(tuple, every))) == sorted(map(tuple, once)) and 5 < len(once) < len(every)
