import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civicgrid.functions import text as T
from civicgrid.operators import mentions, scoring
from civicgrid.operators.serving import collation_key


def apply(spark, values, column, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", column.alias("y")).orderBy("i").collect()]


def test_identity(spark):
    x = F.col("x")
    assert apply(spark, ["  Ｆｕｔó  KLUB ", None, "Straße"], T.canonical(x)) == ["futó klub", None, "strasse"]
    assert apply(spark, ["A-b c!", "日本 語"], T.match_key(x)) == ["abc", "日本語"]
    keys = apply(spark, ["東京", "大阪", "Tokyo", "tokyo "], T.record_key("c", x, F.lit("City")))
    assert len(set(keys)) == 3 and keys[2] == keys[3] and all(k.startswith("c2:") and len(k) == 27 for k in keys)
    slugs = apply(spark, ["Futó Klub!", "東京", "大阪", "Łódź run"], T.slug(x))
    assert slugs[0] == "futo-klub" and slugs[1].startswith("u-") and slugs[1] != slugs[2] and slugs[3].startswith("odz-run-")
    odd = [" Ab  C ", "\x1cA\tB\n", "", "-A--b-", "É-é", "ǅ", "x·y", "ﬁn", "١٢"]
    assert apply(spark, odd, T.canonical(x)) == [T.canonical_text(v) for v in odd] and apply(spark, odd, T.slug(x)) == [T.slug_text(v) for v in odd]
    assert [T.slug_text(v) for v in ("É-é", "-A--b-", "ﬁn", "")] == ["e-e", "a-b", "fin", ""] and T.slug_text("x·y") == "xy"


def test_cleaning(spark):
    x = F.col("x")
    assert apply(spark, ["N/A", " none ", "Real", None], T.null_like(x)) == [None, None, "Real", None]
    assert apply(spark, ["https://E.com//", "n/a", None, "#"], T.normal_url(x)) == ["https://e.com", "", "", ""]
    assert apply(spark, ["e.com", "http://e.com", None], T.with_scheme(x)) == ["https://e.com", "http://e.com", None]
    assert apply(spark, ["a@b", "ab"], T.valid_email(x)) == ["a@b", None] and apply(spark, ["1", "ab"], T.valid_phone(x)) == ["1", None]
    assert apply(spark, [[" a", "b", "a", ""], [str(i) for i in range(12)]], T.normal_tags(x), "array<string>") == [["a", "b"], [str(i) for i in range(8)]]
    assert apply(spark, [["http://a", "ftp://b"]], T.http_links(x), "array<string>") == [["http://a"]]
    assert apply(spark, [["a"], ["s"]], T.with_source(x, F.lit("s")), "array<string>") == [["s", "a"], ["s"]]
    assert apply(spark, ["The Club", "A Z", "az"], T.strip_articles(x)) == ["club", "z", "az"]
    assert apply(spark, ["5%_\\"], T.escape_like(x)) == ["5\\%\\_\\\\"]
    assert apply(spark, [3725.0, 65.0, 9.0], T.duration(x), "double") == ["62m 5s", "1m 5s", "9.0s"]
    assert apply(spark, ['Chess", 0.9, true, x', "Plain", '", 1"'], T.without_json_tail(x)) == ["Chess", "Plain", '", 1"']
    assert apply(spark, ["fb.me", "a.meetup.com", "b.example.org"], T.platform(x)) == ["Facebook", "Meetup", "b.example.org"]
    order = apply(spark, ["Ács", "Abony", "Azor", "ózd", "özd", "őz", "ozma"], collation_key(x))
    assert sorted(range(7), key=order.__getitem__) == [1, 2, 0, 6, 3, 4, 5]
    assert apply(spark, ["Árvíztűrő FC klub klub"], T.name_tokens(x)) == [["arvizturo", "klub"]]


@settings(max_examples=200, deadline=None)
@given(st.text(), st.text())
def test_bound_never_hides_a_similar_pair(a, b):
    both = len(a) + len(b)
    bound = 1.0 if not both else 2 * min(len(a), len(b)) / both
    assert difflib.SequenceMatcher(None, a, b).ratio() <= bound + 1e-12


def test_similarity_matches_python(spark):
    r = random.Random(1)
    pairs = [("".join(r.choice("abc ") for _ in range(r.randrange(12))), "".join(r.choice("abc ") for _ in range(r.randrange(12)))) for _ in range(100)] + [("tide", "diet"), ("diet", "tide")]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r["s"] for r in frame.select("i", T.sequence_ratio("a", "b").alias("s")).orderBy("i").collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


@pytest.mark.parametrize(("field", "people"), [
    ("Kiss Anna, edző", [("Kiss Anna", "edző")]),
    ("Kiss Anna, Nagy Béla (szervezők)", [("Kiss Anna", "szervezők"), ("Nagy Béla", "szervezők")]),
    ("Kiss Anna, edző; dr. Nagy Béla, elnök", [("Kiss Anna", "edző"), ("dr. Nagy Béla", "elnök")]),
    ("Anna (Anni Kiss)", [("Anna (Anni Kiss)", "")]),
    ("edző", []), ("", []), (None, []), (" ; ,", []),
])
def test_leaders(spark, field, people):
    assert [(p["name"], p["role"]) for p in apply(spark, [field], T.leaders(F.col("x")))[0]] == people


def test_page_text_and_diff(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><p>One &amp; two</p><script>no</script><p> three\n four</p></body></html>"
    assert T.page_text(page) == "One & two\nthree\nfour" and T.page_text(None) is None and T.page_text(page, 500) is None
    assert T.page_text("<nav>only a menu</nav>", 5) == "only a menu" and T.page_text("<nav>x<p>a < b & c") == "" and T.page_text("a < b <i>c</i><br>d") == "a < b c\nd"
    frame = spark.createDataFrame([("a\nb", "a\nc"), (None, "x")], "a string, b string")
    assert sorted(r[0] for r in frame.select(T.line_diff("a", "b")).collect()) == ["+ x", "- b\n+ c"]


def test_mentions(spark):
    cities = ["Vác", "Vácrátót", "Szentgotthárd", "Budapest"]
    rows = [(1, "Budapest", "A szentgotthárdi kör Szentgotthárdon és Budapesten"), (2, "Vácrátót", "Vácon és Vácrátóton"), (3, "Budapest", "Vácrátóton"), (4, "Budapest", None), (5, None, "Vác")]
    out = mentions.find_mentions(spark.createDataFrame(rows, "key long, city string, description string").withColumn("contact", F.lit("Szentgotthárd")), cities).collect()
    assert sorted((r["key"], r["mentioned"], r["field"]) for r in out) == [("1", "Szentgotthárd", "description"), ("2", "Szentgotthárd", "contact"), ("3", "Szentgotthárd", "contact"), ("3", "Vácrátót", "description"), ("4", "Szentgotthárd", "contact")]


def test_same_names():
    same = scoring.SameName(frozenset({"futo"}), ("szentendre",))
    alike = [("Kék Madár", "KEK-MADAR"), ("Kék Madár Klub", "Kék Madár"), ("SV Musterstadt", "SV Musterstadt Verein"), ("Szentendrei Futó Klub", "Szentendrei Futó")]
    apart = [("Szentendrei", "Szentendrei Klub"), ("Szentendrei Futóklub", "Szentendrei Kajak Klub"), ("Futóklub", "Kék Futóklub"), ("", "Kék"), ("a b", "c d")]
    assert all(same(a, b) and same(b, a) for a, b in alike) and not any(same(a, b) or same(b, a) for a, b in apart)


def test_page_scores(spark):
    names = ["Szentendrei Futóklub", "Kék Madár"]
    answers = {"all": names, "one": names[:1], "none": [None], "spelled": ["Szentendrei Futoklub", "Szentendrei Futóklub", "Kék Madár Klub"], "crossed": ["Kék Madár Klub", "Kék Madár"]}
    expected = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)] + [(2, 0, "Kék Madár"), (2, 1, "Kék Madár SE Klub")], "page long, place int, name string")
    got = spark.createDataFrame([(m, 1, i, n) for m, found in answers.items() for i, n in enumerate(found)] + [("crossed", 2, 0, "Kék Madár"), ("crossed", 2, 1, "Kék Madár Egyesület")], "model string, page long, place int, name string")
    scores = {(r["model"], r["page"]): r["score"] for r in scoring.page_scores_of(expected, got, scoring.SameName()).collect()}
    assert scores == {("all", 1): 100, ("one", 1): 75, ("none", 1): 20, ("spelled", 1): 100, ("crossed", 1): 20 + 25 + 15, ("crossed", 2): 100}
    assert scoring.most_pairs(["Kék Madár", "Kék Madár Klub"], ["Kék Madár Egyesület", "Kék Madár"], scoring.SameName()) == 2


def test_few_names_have_only_fixed_generic_words(spark):
    few = spark.createDataFrame([("alpha beta",)] * 19, "name string")
    assert {r["token"] for r in scoring.generic_words(few, "name").collect()} == set(scoring.SEED)
    many = spark.createDataFrame([("alpha beta",)] * 25, "name string")
    assert {r["token"] for r in scoring.generic_words(many, "name").collect()} == {*scoring.SEED, "alpha", "beta"}
