"""Language ID, decontamination, toxicity: brute force, held-out accuracy and awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tests.llm.cases import documents, prose, rows

from civicgrid.llm import common, decontaminate, language_id, toxicity
from civicgrid.llm.common import crc_bucket

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})

SOUNDS = {"en": ["the", "and", "wh", "ing", "th"], "de": ["sch", "ung", "ein", "keit", "der"], "fr": ["eau", "ou", "é", "tion", "le"], "es": ["ción", "ñ", "os", "ar", "que"]}


def speech(lang: str, seed: int, n: int = 60) -> str:
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy(spark):
    data = [(i * 4 + k, speech(lang, i), lang, "s", 0) for i in range(60) for k, lang in enumerate(SOUNDS)]
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    out = language_id.identify(documents(spark, data), ~held_out).collect()
    wrong = [r for r in out if r["lang_pred"] != list(SOUNDS)[r["doc_id"] % 4]]
    assert len(out) == len(data) and len(wrong) <= 2 and all(0 <= r["score"] <= 1 for r in out)


def test_language_awkward_rows(spark):
    out = language_id.identify(documents(spark), F.lit(True)).collect()
    assert len(out) == len(rows())
    by_id = {r["doc_id"]: r for r in out}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (8, 9, 10, 13))
    assert by_id[16]["lang_pred"] in ("en", "fr")
    assert language_id.identify(documents(spark, []), F.lit(True)).count() == 0
    unlabelled = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled, F.lit(True)).collect()} == {"und"}


def contaminated(docs, items, size=13):
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = WORD.findall((text or "").translate(LOW))
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        words, hit, found = WORD.findall((text or "").translate(LOW)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if owners := windows.get(tuple(words[k : k + n])):
                    found |= owners
                    hit |= set(range(k, k + n))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def test_contamination_against_brute_force(spark):
    passage, r = prose(50, 40), random.Random(5)
    data = [(i, t, "en", "s", 0) for i, (_, t, *_) in enumerate(rows())]
    for i in range(100, 140):
        words = prose(i, r.randint(5, 150)).split(" ")
        k, n = r.randrange(len(words)), r.randint(8, 40)
        data.append((i, " ".join(words[:k] + passage.upper().split(" ")[:n] + words[k:]), "en", "s", 0))
    items = [(1, passage), (10, prose(4, 60)), (2, "one two three"), (3, None), (4, ""), (5, "café"), (5, prose(1, 300)), (6, "ab " * 20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(spark, data), benchmark).collect()
    assert sorted(map(tuple, got), key=repr) == contaminated([(d[0], d[1]) for d in data], items)
    assert any(r["contaminated"] for r in got) and not all(r["contaminated"] for r in got)


def test_contamination_with_a_full_bitmap_and_empty_tables(spark, monkeypatch):
    """A bitmap that lets everything through changes no result; items that share their windows are told apart."""
    items = [(i, prose(i, 30)) for i in range(6)] + [(100 + i, prose(3, 30)) for i in range(5)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    data = [(i, f"{prose(90 + i, 20)} {prose(i, 30)} {prose((i + 1) % 6, 30)}", "en", "s", 0) for i in range(6)]
    want = contaminated([(d[0], d[1]) for d in data], items)
    docs = documents(spark, data)
    assert sorted(map(tuple, decontaminate.contamination(docs, benchmark).collect()), key=repr) == want and {w[3] for w in want} == {2, 7}
    monkeypatch.setattr(common, "MOST_BITS", 64)
    monkeypatch.setattr(common, "LEAST_BITS", 64)
    monkeypatch.setattr(common, "PART_BITS", 32)
    assert sorted(map(tuple, decontaminate.contamination(docs, benchmark).collect()), key=repr) == want
    assert decontaminate.contamination(documents(spark, []), benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_clean_documents_stay(spark):
    items = [(1, prose(50, 40)), (2, "one two three")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    data = rows() + [(100, f"{prose(51, 20)} {prose(50, 40)}", "en", "s", 0), (101, f"{prose(52, 2000)} {prose(50, 40)}", "en", "s", 0)]
    clean = {d for d, *_, bad in contaminated([(d[0], d[1]) for d in data], items) if not bad}
    out = decontaminate.clean_documents(documents(spark, data), benchmark)
    assert sorted(map(repr, (tuple(r)[:5] for r in out.collect()))) == sorted(map(repr, (d for d in data if d[0] in clean))) and clean < {d[0] for d in data}
    assert out.columns == documents(spark, data).columns


def test_winnowing_keeps_a_mark_in_every_window():
    hashes = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    kept = set(decontaminate.winnow(hashes, 9).tolist())
    assert all(kept & set(range(k, k + 9)) for k in range(len(hashes) - 8))


def test_toxicity_held_out(spark):
    bad, data, labels = ["idiot", "trash", "moron"], [], []
    for i in range(600):
        words, toxic = prose(i, 60).split(" "), i % 4 == 0
        for k in range(3 if toxic else 0):
            words.insert(7 * k, bad[(i + k) % 3])
        data.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None), (5, 0)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    weights = toxicity.fit(documents(spark, data), table, ~held_out)
    out = {r["doc_id"]: r for r in toxicity.score(documents(spark, data), weights).collect()}
    fresh = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(out[i]["predicted"] == int(i % 4 == 0) for i in fresh)
    assert right >= 0.97 * len(fresh) and 0 < len(weights[0]) < 5000


def test_toxicity_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, toxic int")
    weights = toxicity.fit(documents(spark), labels, F.lit(True))
    out = toxicity.score(documents(spark), weights).collect()
    assert len(out) == len(rows()) and all(0 <= r["score"] <= 1 for r in out)
    empty = {r["score"] for r in out if r["doc_id"] in (8, 9, 10, 13)}
    assert len(empty) == 1
    nothing = toxicity.fit(documents(spark), labels.limit(0), F.lit(True))
    unsure = toxicity.score(documents(spark), nothing).collect()
    assert all(0.5 - 1e-6 < r["score"] < 0.5 and r["predicted"] == 0 for r in unsure) and len(unsure) == len(rows())
    assert toxicity.score(documents(spark, []), weights).count() == 0


def test_training_samples_keep_their_bounds(spark):
    """Exactly, in the same rows each time, also where rows are repeated."""
    data = [(i // 3, speech(lang, i), lang, "s", 0) for i in range(150) for lang in ("en", "de")]
    docs = documents(spark, data)
    first = [sorted(map(tuple, language_id.training_rows(df, F.lit(True), 40).collect())) for df in (docs, docs.repartition(7))]
    assert first[0] == first[1] and len(first[0]) == 40 and sum(lang == "en" for _, lang in first[0]) == 20
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 3, "doc_id long, toxic int")
    some = [toxicity.fit(df, labels, F.lit(True), 30) for df in (docs, docs.repartition(7))]
    assert all(np.array_equal(a, b) for a, b in zip(some[0][:2], some[1][:2])) and some[0][2] == some[1][2]


def test_unknown_languages_join_their_kin():
    r = np.random.default_rng(1)
    base, other = r.random(64), r.random(64) * (r.random(64) < 0.3)
    x = np.stack([v + r.normal(0, 0.02, 64) for v in (base, base * 1.02, other) for _ in range(20)]).astype(np.float32)
    langs = np.array(["xa"] * 20 + ["xb"] * 20 + ["xc"] * 20, object)
    of = language_id.families_of(x, langs, ["xa", "xb", "xc"], {})
    assert of["xa"] == of["xb"] != of["xc"]
    assert language_id.families_of(x, langs, ["xa", "xb", "xc"], {"xb": "f"})["xa"] == "f"


def test_held_out_rows_of_the_given_tables(spark):
    from civicgrid.llm import queries

    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in queries.op1_language_id(spark, folder).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert len(out) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.95 * len(out)
    marked = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = [r for r in queries.op3_toxicity(spark, folder).collect() if r["held_out"] and marked.get(r["doc_id"]) is not None]
    assert len(out) > 20 and sum(r["predicted"] == marked[r["doc_id"]] for r in out) >= 0.9 * len(out)
