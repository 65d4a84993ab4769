"""Near duplicates, vectors and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.cases import documents, prose, rows

from civicgrid.llm import common, embedding_dedup, ngram_join, suffix_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def components_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def jaccard_classes(docs, threshold=0.8):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    count, links = [0] * len(docs), []
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-12:
                count[i] += 1
                count[j] += 1
                links.append((docs[i][0], docs[j][0]))
    root = components_of({d for d, _ in docs}, links)
    return sorted((d, root[d], n, root[d] == d) for (d, _), n in zip(docs, count))


def near_copies(seed, n):
    r, out = random.Random(seed), []
    bases = [prose(seed + k, 120).split(" ") for k in range(6)]
    for i in range(n):
        words = list(bases[i % 6])
        for _ in range(r.randrange(8)):
            words[r.randrange(len(words))] = f"edit{r.randrange(1000)}"
        out.append((1000 + i, " ".join(words), "en", "s", 0))
    return out


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "TILE", 5)
    data = [r for r in rows() if r[0] is not None] + near_copies(70, 150)
    got = ngram_join.similarity_classes(documents(spark, data)).collect()
    assert sorted(map(tuple, got)) == jaccard_classes([(d[0], d[1]) for d in data])


def test_jaccard_join_edges(spark):
    assert ngram_join.similarity_classes(documents(spark, [])).count() == 0
    out = ngram_join.similarity_classes(documents(spark, [(None, "a b c d e f", None, None, None), (1, None, None, None, None), (2, "", None, None, None)])).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [(None, None, None, True), (1, 1, 0, True), (2, 2, 0, True)]))


def test_pruning_keeps_what_may_reach_the_threshold():
    limits = ngram_join.least_matches(0.8)
    assert [n for n, _ in limits] == list(range(16, 97, 16)) and all(m < 0.8 * n for n, m in limits)
    r = np.random.default_rng(2)
    for similarity, keep in ((0.85, True), (0.2, False)):
        a = r.integers(0, 60000, (400, 96)).astype(np.uint16)
        b = np.where(r.random((400, 96)) < similarity, a, r.integers(0, 60000, (400, 96))).astype(np.uint16)
        left = ngram_join.survivors(np.concatenate([a, b]), np.arange(400), np.arange(400) + 400, limits)
        assert len(left) == (400 if keep else 0)


def repeats_of(docs, length):
    seen, out = {}, []
    for _, t in docs:
        data = (t or "").encode()
        for k in range(len(data) - length + 1):
            seen[data[k : k + length]] = seen.get(data[k : k + length], 0) + 1
    for d, t in docs:
        data = (t or "").encode()
        mask = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if seen[data[k : k + length]] > 1:
                mask[k : k + length] = True
        edge = np.diff(np.concatenate([[0], mask.astype(int), [0]]))
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        out.append((d, len(data), int(mask.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passage_docs():
    shared, r = prose(31, 60), random.Random(4)
    out = [r for r in rows() if r[0] != 17]
    for i in range(40):
        cut = r.randrange(200)
        out.append((2000 + i, f"{prose(300 + i, r.randrange(60))} {shared[cut:]} {prose(400 + i, 10)} {'xy' * r.randrange(200)}", "en", "s", 0))
    return out + near_copies(90, 20)


def removed(spark, data):
    out = suffix_dedup.without_repeats(documents(spark, data)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted(map(tuple, out), key=repr)


def test_repeated_passages_against_brute_force(spark):
    data = passage_docs()
    want = repeats_of([(d[0], d[1]) for d in data], 200)
    assert removed(spark, data) == want and sum(w[2] for w in want) > 5000
    assert removed(spark, []) == []


def test_large_groups_are_halved_without_loss(spark, monkeypatch):
    data = passage_docs()
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    assert removed(spark, data) == repeats_of([(d[0], d[1]) for d in data], 200)


def headed_docs(n):
    """A fixed header before different texts, and other texts before the same passage: at each anchor many rows share a half."""
    header, tail = prose(51, 60)[:270], prose(52, 60)[:270]
    out = [(3000 + i, f"{header}{i:05d} {prose(600 + i, 12)}", "en", "s", 0) for i in range(n)]
    return out + [(4000 + i, f"{prose(700 + i, 12)} {i:05d}{tail}", "en", "s", 0) for i in range(n)]


@pytest.mark.parametrize("by", [1, 1 << 40])
def test_weights_do_not_compound_in_the_halving(spark, monkeypatch, by):
    """Weights of a round add up to no more than what occurs, nor pass the largest long where they begin near 2**40."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    seen, halve = [], suffix_dedup.halve

    def spied(pieces, length):
        weighed = pieces if seen else pieces.withColumn("weight", F.col("weight") * by)
        seen.append(weighed.agg(F.max("weight")).first()[0])
        return halve(weighed, length)

    monkeypatch.setattr(suffix_dedup, "halve", spied)
    data = headed_docs(60)
    got = removed(spark, data)
    assert len(seen) > 3 and max(seen) <= len(data) * by
    if by == 1:
        assert got == repeats_of([(d[0], d[1]) for d in data], 200)


@pytest.mark.parametrize("bound", [8, 16])
def test_no_more_than_a_group_goes_to_a_task(spark, monkeypatch, bound):
    """However many rows share a half, and however often a row is repeated."""
    monkeypatch.setattr(suffix_dedup, "GROUP", bound)
    sizes, sort = [], suffix_dedup.repeated_segments

    def spied(pieces, length):
        sizes.extend(r["count"] for r in pieces.groupBy("anchor", "part").count().collect())
        return sort(pieces, length)

    monkeypatch.setattr(suffix_dedup, "repeated_segments", spied)
    data = headed_docs(60)
    data += data[:1] * 20
    assert removed(spark, data) == repeats_of([(d[0], d[1]) for d in data], 200)
    assert 1 < max(sizes) <= bound


def test_kept_text_is_whole_characters(spark):
    passage = "é" * 150
    data = [(1, "x" + passage + "ab", "en", "s", 0), (2, "y" + passage + "cd", "en", "s", 0)]
    out = suffix_dedup.without_repeats(documents(spark, data), keep=["doc_id", "source"]).collect()
    assert {(r["doc_id"], r["source"], r["kept_text"]) for r in out} == {(1, "s", "xab"), (2, "s", "ycd")}


def test_suffix_array():
    r = random.Random(6)
    for _ in range(1500):
        text = [r.randint(1, r.choice([1, 2, 3, 8])) for _ in range(r.randrange(50))] + [0]
        ranks = sorted(set(text))
        text = [ranks.index(c) for c in text]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_dedup.suffix_array([]) == []


def vector_classes(data, threshold=0.98):
    def unit(v):
        if v is None or any(x is None for x in v):
            return None
        a = np.array(v, float)
        return a / np.linalg.norm(a) if len(a) and np.isfinite(a).all() and np.linalg.norm(a) > 0 else None

    units, count, links = [unit(v) for _, v, _ in data], [0] * len(data), []
    for i in range(len(data)):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and data[i][2] == data[j][2] is not None and len(a) == len(b) and a @ b >= threshold:
                count[i] += 1
                count[j] += 1
                links.append((data[i][0], data[j][0]))
    root = components_of({d[0] for d in data}, links)
    return sorted((d[0], n, root[d[0]], root[d[0]] == d[0]) for d, n in zip(data, count))


@pytest.mark.parametrize("settings", [{"CELL": 6, "SPLIT": 14, "BLOCK": 7, "MAX_CENTRES": 4, "DEALT": 30}, {}])
def test_vectors_against_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    r = np.random.default_rng(8)
    data = []
    for i in range(240):
        base = np.random.default_rng(i % 12).normal(size=16)
        data.append((i, [float(x) for x in (base + r.normal(size=16) * r.choice([0.02, 0.1, 0.2])).astype(np.float32)], i % 2))
    data += [(300, data[0][1], 0), (301, [2 * x for x in data[0][1]], 0), (302, data[0][1], None), (303, None, 0), (304, [0.0] * 16, 0), (305, [float("nan")] * 16, 0), (306, [float("inf")] + [1.0] * 15, 0), (307, [None] + [1.0] * 15, 0), (308, [], 0), (309, [1.0, 2.0], 0), (310, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS cell", "'y' AS key", "'z' AS unit")
    got = sorted(map(tuple, embedding_dedup.vector_classes(frame).collect()))
    assert got == vector_classes(data)
    assert embedding_dedup.vector_classes(frame.limit(0)).count() == 0


def test_a_tight_cluster_is_counted_by_its_core(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 10)
    r = np.random.default_rng(9)
    base = r.normal(size=24)
    spread = [*[0.001] * 120, *[0.09] * 40, *[2.0] * 60]
    data = [(i, [float(x) for x in base + r.normal(size=24) * s], 0) for i, s in enumerate(spread)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    compared = []
    monkeypatch.setattr(embedding_dedup, "materialise", lambda df, name: (compared.append((name, df)), common.materialise(df, name))[1])
    assert sorted(map(tuple, embedding_dedup.vector_classes(frame).collect())) == vector_classes(data)
    sizes = [df for name, df in compared if name == "sizes"][-1]
    assert sizes.agg({"in_core": "sum"}).first()[0] >= 100


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(220)]
    got = {x["id"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of({x for e in edges for x in e}, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
