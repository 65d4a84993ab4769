"""Merge rounds against the sentencepiece library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tests.llm.cases import documents, rows

from civicgrid.llm import sentencepiece_bpe as spm
from civicgrid.llm.queries import op11_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts() -> list[str]:
    r = random.Random(5)
    pieces = [LIBRARY.id_to_piece(i) for i in range(LIBRARY.get_piece_size())]
    out = ["", " ", "  ", "▁", " ▁ a", "\x00", "a\x00b", "<s>", "</s> <unk>", "<0x0A>", "\n\n", "a" * 5000, "ab" * 3000, "aab" * 700, "日本語のテキスト", "😀👩‍👩‍👧", "é", "\r\n\t", "  ", "12345"]
    for _ in range(500):
        out.append("".join(r.choice("abcde ") for _ in range(r.randint(1, 60))))
        out.append("".join(r.choice("ethinaosr") for _ in range(r.randint(1, 200))))
        out.append("".join(r.choice(pieces) for _ in range(r.randint(1, 30))))
        out.append("".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(0, 0xD7FF), r.randint(0x1F300, 0x1F6FF)])) for _ in range(r.randint(1, 30))))
        out.append("".join(r.choice(["  ", "=", "-", "//", "\n", "##"]) * r.randint(1, 9) for _ in range(8)))
    return out


@pytest.mark.parametrize("together", [1 << 19, 50])
def test_ids_and_texts_are_the_library_s(together, monkeypatch):
    monkeypatch.setattr(spm, "TOGETHER", together)
    texts, coder = odd_texts(), spm.PieceCoder(PATH)
    found = list(coder.encode(texts))
    assert [x.tolist() for x in found] == LIBRARY.encode(texts)
    assert [coder.decode(x) for x in found] == [LIBRARY.decode(x.tolist()) for x in found]


def test_ids_in_any_order_decode_as_the_library_does():
    r, coder = random.Random(6), spm.PieceCoder(PATH)
    for _ in range(500):
        ids = [r.choice([r.randrange(300), r.randrange(32000)]) for _ in range(r.randint(0, 12))]
        assert coder.decode(np.array(ids, np.int32)) == LIBRARY.decode(ids)


def test_merges_keep_the_order_of_one_at_a_time():
    """Pairs whose merge brings up a better pair: vocabularies of few letters and any ranks."""
    r = random.Random(7)
    for _ in range(300):
        coder = object.__new__(spm.PieceCoder)
        pieces = list("abc") + sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 4))) for _ in range(12)})
        rank = {p: r.randrange(8) for p in pieces}
        ids = {p: i for i, p in enumerate(pieces)}
        coder.width = np.int64(100)
        pairs = {(ids[p[:k]], ids[p[k:]]): (rank[p], ids[p]) for p in pieces for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        if not pairs:
            continue
        coder.table = spm.PairTable(np.array([a * 100 + b for a, b in pairs], np.int64), *np.array(list(pairs.values()), np.int32).T)
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 25))) for _ in range(20)]
        starts = np.cumsum([0] + [len(w) for w in words])[:-1]
        symbols, sizes = coder.merged(np.array([ids[c] for c in "".join(words)], np.int32), starts)
        want = []
        for w in words:
            s = list(w)
            while found := [(rank[s[k] + s[k + 1]], k) for k in range(len(s) - 1) if s[k] + s[k + 1] in rank]:
                k = min(found)[1]
                s[k : k + 2] = [s[k] + s[k + 1]]
            want.append([ids[x] for x in s])
        assert [x.tolist() for x in np.split(symbols, np.cumsum(sizes)[:-1])] == want


def test_query_over_awkward_documents(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_sentencepiece(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows():
        ids = LIBRARY.encode(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert spm.digests(documents(spark, []), PATH).count() == 0
    kept = spm.encoded(documents(spark).selectExpr("*", "'clash' AS ids"), PATH, ["score", "doc_id"])
    assert kept.columns == ["score", "doc_id", "ids"] and kept.count() == len(rows())
    empty = spm.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH, ["doc_id"])
    assert [r["decoded"] for r in empty.collect()] == ["", ""]
