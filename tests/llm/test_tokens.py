"""Token files and packing: round trips against the tokenizers library itself."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.cases import documents, rows
from tokenizers import Tokenizer

from civicgrid.llm import packing, token_frames
from civicgrid.llm.tokenizing import UnitEncoder

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_units_give_the_ids_of_whole_texts(path):
    r = random.Random(3)
    bits = [" ", "  ", " \n", "\n\n", ".\n", "x.\ny", "a,b", "&&&", "Éa", "×", "2a3", "жил", "\u2003", "\u00a0", "日 本", "\n", "\t", "a", "B", "é", "́", "'s", "'ll", "1", "23", "!", " ", "　", "<|endoftext|>", "<|startoftext|>", "<", "日本", "ß", "Σ", "ς", "\r", "\x1c", "\x85", "İ", "​", "🎉"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(3000)] + [t for _, t, *_ in rows() if t]
    coder = UnitEncoder(path)
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [w.ids for w in want]


def ids_of(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


def test_frames_round_trip_and_random_access():
    out = io.BytesIO()
    writer = token_frames.FrameWriter(out, frame_bytes=400)
    docs = [(i * 3, np.arange(i * 7 % 50, dtype="<u4").tobytes()) for i in range(200)]
    for d, t in docs:
        writer.add(d, t)
    writer.close()
    reader = token_frames.FrameReader(out)
    assert [x for k in range(len(reader.entries)) for x in reader.frame(k)] == docs and len(reader.entries) > 10
    opened, plain = [], reader.frame
    reader.frame = lambda k: (opened.append(k), plain(k))[1]
    assert list(reader.documents({30, 31})) == [docs[10]] and len(opened) == 1
    raw = bytearray(out.getvalue())
    raw[20] ^= 255
    with pytest.raises(Exception):
        list(token_frames.FrameReader(io.BytesIO(bytes(raw))).frame(0))


def test_token_digest(spark):
    data = [r for r in rows() if r[0] is not None]
    got = token_frames.token_digest(documents(spark, data), BYTE, 2).orderBy("start").collect()
    ids = [(d, ids_of(BYTE, t, 2)) for d, t, *_ in sorted(data, key=lambda r: r[0])]
    starts = np.cumsum([0] + [len(i) for _, i in ids])
    assert [tuple(r) for r in got] == [(d, int(s), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, i), s in zip(ids, starts)]
    whole = token_frames.token_digest(documents(spark), BYTE, 2).orderBy("start").collect()
    assert whole[0]["doc_id"] is None and len(whole) == len(rows())
    assert token_frames.token_digest(documents(spark, []), BYTE, 2).count() == 0


def check_packed(pieces, capacity):
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_rows(spark):
    capacity = 512
    out = packing.pack_documents(documents(spark), WORDS, 1, capacity).collect()
    want = []
    for d, t, *_ in rows():
        ids = ids_of(WORDS, t, 1)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want.append((d, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(repr, (tuple(r)[:5] for r in out))) == sorted(map(repr, want))
    total = sum(r["length"] for r in out)
    assert check_packed(out, capacity) <= -(-total // capacity) + 2
    assert packing.pack_documents(documents(spark, []), WORDS, 1).count() == 0


def greedy(lengths, capacity):
    """The same method piece by piece."""
    bins, large = [], sorted((x for x in lengths if 3 * x > capacity), reverse=True)
    while large:
        first = large.pop(0)
        fits = [k for k, x in enumerate(large) if first + x <= capacity]
        bins.append(first + (large.pop(fits[0]) if fits else 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        room = [k for k, b in enumerate(bins) if b + x <= capacity]
        if room:
            k = max(room, key=lambda k: bins[k])
            bins[k] += x
        else:
            bins.append(x)
    return len(bins)


def test_plan_matches_piecewise_method():
    r = random.Random(9)
    for _ in range(200):
        capacity = r.choice([10, 30, 100])
        lengths = [r.randint(1, capacity) for _ in range(r.randrange(80))] + [r.randint(1, 3)] * r.randrange(20)
        counts = {x: lengths.count(x) for x in set(lengths)}
        runs = packing.plan_packing(counts, capacity)
        pieces = [{"sequence_id": s + k, "offset": o, "length": x} for x, _, n, s, o in runs for k in range(n)]
        assert sorted(p["length"] for p in pieces) == sorted(lengths)
        assert check_packed(pieces, capacity) <= greedy(lengths, capacity)
        for x in counts:
            own = sorted((a, a + n) for y, a, n, _, _ in runs if y == x)
            assert own[0][0] == 0 and own[-1][1] == counts[x] and all(p[1] == q[0] for p, q in zip(own, own[1:]))
