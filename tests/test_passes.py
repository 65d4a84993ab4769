"""The full pass against its steps in plain Python, on pages of every kind."""

import json

from pyspark.sql import functions as F

from civicgrid.functions import text as T
from civicgrid.plans import passes

CURRENT = {"communities": "c2", "venues": "v2", "persons": "p2"}
NOW = "2026-02-02"
PAGES = "url string, city string, topic string, text string, fingerprint string, records string, venue_fingerprint string, person_fingerprint string"
COMMUNITIES = "name string, city string, topic string, website string, contact string, social_links array<string>, source_url string, source_urls array<string>, hidden boolean"
VENUES = "name string, city string, address string, source_url string, source_urls array<string>, updated_at string"
PEOPLE = "name string, city string, role string, community_name string, origin string, bio string, source_url string, source_urls array<string>, updated_at string"


def item(name, **more):
    return {"name": name, "confidence": 0.9, "joinable": True, **more}


def body(kind, *items):
    return json.dumps({kind: list(items)})


def page(url, text="long enough to be read", fp=None, records=None, vf=None, pf=None, topic="run"):
    return (url, "Pécs", topic, text, fp, records, vf, pf)


def keyed(spark, rows, schema, prefix, columns):
    return T.with_record_key(spark.createDataFrame(rows, schema), prefix, columns)


def directory(spark, pages):
    communities = [("Aurora", "Pécs", "run", "http://old.example", None, None, "s0", ["s0"], True), ("Gone Club", "Pécs", "run", None, None, None, "s1", [], False), ("Elsewhere", "Vác", "run", None, None, None, "s2", [], False)]
    venues = [("Town Hall", "Pécs", "old street", "w0", ["w0"], "2025"), ("Barn", "Vác", "field", "w1", ["w1"], "2025")]
    people = [("Old Leader", "Pécs", "leader", "Aurora", None, None, "s0", ["s0"], "2025"), ("Derived Leader", "Pécs", "leader", "Bikers", "leader_field", None, "s0", [], "2025"), ("Own Leader", "Pécs", "leader", "Bikers", None, None, "s0", [], "2025"), ("Far Leader", "Vác", "leader", "Aurora", "leader_field", None, "s0", [], "2025")]
    return passes.Directory(keyed(spark, communities, COMMUNITIES, "c", ["name", "city", "topic"]), keyed(spark, venues, VENUES, "v", ["name", "city"]), keyed(spark, people, PEOPLE, "p", ["name", "city", "role", "community_name"]), spark.createDataFrame(pages, PAGES))


def run(spark, helpers=True):
    pages = [
        page("hit", fp="c2", records=body("communities", item("Bikers", fee="old")), vf="v2", pf="p1"),
        page("new", fp="c1", records=body("communities", item("Stale")), vf="v1"),
        page("empty"), page("broken"), page("nothing yet"), page("short", text="x"), page("no joiners"),
    ]
    answers = {
        "communities": [("new", body("communities", item("Aurora", leader="Éva Nagy; Bo Kis"), item("Chess", confidence=0.3), item("Choir", contact="tel"), item("Closed", joinable=False))), ("empty", "{}"), ("broken", "[1]"), ("no joiners", body("communities", item("Private", joinable=False))), ("hit", body("communities", item("Never asked")))],
        "venues": [("new", body("venues", {"name": "Town Hall", "address": "new street"}, {"name": "Gym", "address": "n/a"})), ("hit", body("venues", {"name": "Never asked"})), ("no joiners", body("venues", {"name": "Never due"}))],
        "persons": [("new", "oops"), ("hit", body("persons", {"name": "Ana Kis", "role": "boss", "community_name": "Bikers"}, {"name": "Solo", "role": "coach", "community_name": "Bikers"}))],
    }
    urls = [("k1", n, u) for n, u in enumerate(["hit", "new", "hit"])] + [("k2", n, u) for n, u in enumerate(["empty", "broken", "nothing yet"])] + [("k3", 0, "short"), ("k3", 1, "no joiners")]
    helps = T.with_record_key(spark.createDataFrame([(n, "Pécs", "run", p, w, None, None) for n, p, w in (("Aurora", 0, ""), ("Aurora", 1, "http://help.example"), ("Choir", 0, "http://no.example"), ("Chess", 0, "http://no.example"), ("Bikers", 0, "http://no.example"))], "name string, city string, topic string, pos int, website string, contact string, social_links array<string>"), "c", ["name", "city", "topic"]).drop("name", "city", "topic")
    return passes.full_pass(spark.createDataFrame(urls, "pair string, pos int, url string"), directory(spark, pages), CURRENT, {k: spark.createDataFrame(v, "url string, body string") for k, v in answers.items()}, NOW, helps if helpers else None)


def test_states_and_marks(spark):
    after, states = run(spark)
    assert {(r["pair"], r["url"]): r["state"] for r in states.collect()} == {("k1", "hit"): "hit", ("k1", "new"): "ok", ("k2", "empty"): "empty", ("k2", "broken"): "failed", ("k2", "nothing yet"): "deferred", ("k3", "no joiners"): "ok"}
    marks = {r["url"]: (r["fingerprint"], r["venue_fingerprint"], r["person_fingerprint"]) for r in after.pages.collect()}
    assert marks == {"hit": ("c2", "v2", "p2"), "new": ("c2", "v2", None), "empty": ("c2", None, None), "broken": (None, None, None), "nothing yet": (None, None, None), "short": (None, None, None), "no joiners": ("c2", None, None)}


def test_communities_replace_their_pair_and_stay_hidden(spark):
    after, _ = run(spark)
    got = {r["name"]: (r["city"], r["website"], r["hidden"]) for r in after.communities.collect()}
    # the pair keeps what it had; Aurora was hidden; only what is sure and has nothing is helped
    assert got == {"Aurora": ("Pécs", "http://help.example", True), "Gone Club": ("Pécs", None, False), "Elsewhere": ("Vác", None, False), "Bikers": ("Pécs", None, False), "Chess": ("Pécs", None, False), "Choir": ("Pécs", None, False)}
    alone, _ = run(spark, helpers=False)
    assert {r["website"] for r in alone.communities.filter("name = 'Aurora'").collect()} == {None}


def test_venues_and_people(spark):
    after, _ = run(spark)
    assert {r["name"]: (r["address"], r["source_urls"], r["updated_at"]) for r in after.venues.collect()} == {"Town Hall": ("new street", ["new", "w0"], NOW), "Gym": (None, ["new"], NOW), "Barn": ("field", ["w1"], "2025")}
    people = {(r["name"], r["role"], r["community_name"], r["city"], r["origin"]) for r in after.people.collect()}
    assert people == {
        ("Ana Kis", "leader", "Bikers", "Pécs", None), ("Own Leader", "leader", "Bikers", "Pécs", None), ("Far Leader", "leader", "Aurora", "Vác", "leader_field"), ("Éva Nagy", "leader", "Aurora", "Pécs", "leader_field"), ("Bo Kis", "leader", "Aurora", "Pécs", "leader_field"),
    }


def test_one_record_again(spark):
    pages = [page("s0", fp="c2", records=body("communities", item("Cached")), vf="v2", pf="p2"), page("s1", fp="c2", records=body("communities", item("Other")))]
    answers = {"communities": [("s0", body("communities", item("Aurora", contact="new tel"))), ("s1", body("communities", item("Not asked")))], "venues": [("s0", body("venues", {"name": "Gym"}))], "persons": []}
    old = directory(spark, pages)
    key = old.communities.filter("name = 'Aurora'").first()["key"]
    after, states = passes.record_pass(key, old, CURRENT, {k: spark.createDataFrame(v, "url string, body string") for k, v in answers.items()}, NOW)
    assert [(r["url"], r["state"]) for r in states.collect()] == [("s0", "ok")]
    assert {r["name"]: r["contact"] for r in after.communities.collect()} == {"Aurora": "new tel", "Gone Club": None, "Elsewhere": None}
    assert "Gym" in {r["name"] for r in after.venues.collect()}
    assert after.communities.filter(F.col("hidden")).count() == 1


def test_a_page_is_read_once_for_all_pairs(spark, monkeypatch):
    kept = {}
    settled = passes.settled
    monkeypatch.setattr(passes, "settled", lambda df, name: kept.setdefault(name, settled(df, name)))
    pages = [page("hit", fp="c2", records=body("communities", item("Bikers"))), page("new"), page("never found")]
    urls = [(f"k{n}", pos, url) for n in range(40) for pos, url in enumerate(["hit", "new", "hit"])]
    answers = {"communities": [("new", body("communities", item("Choir"), item("Chess"))), ("never found", body("communities", item("Never read")))], "venues": [], "persons": []}
    _, states = passes.full_pass(spark.createDataFrame(urls, "pair string, pos int, url string"), directory(spark, pages), CURRENT, {k: spark.createDataFrame(v, "url string, body string") for k, v in answers.items()}, NOW)
    assert sorted((r["url"], r["state"]) for r in kept["states"].collect()) == [("hit", "hit"), ("new", "ok")]
    assert sorted((r["url"], r["name"]) for r in kept["records"].collect()) == [("hit", "Bikers"), ("new", "Chess"), ("new", "Choir")]
    assert sorted((r["pair"], r["pos"], r["url"], r["state"]) for r in states.collect()) == sorted((f"k{n}", pos, url, state) for n in range(40) for pos, url, state in ((0, "hit", "hit"), (1, "new", "ok")))


def test_marks_of_pages_wait_for_no_other_table(spark, monkeypatch):
    def unwanted(*_):
        raise AssertionError("made for nothing")

    for name in ("save_pairs", "upsert_records", "first_help"):
        monkeypatch.setattr(passes, name, unwanted)
    assert passes.QUERIES["full_pass_pages"](spark, "/root/testdata/sf0.001").count() == 200
