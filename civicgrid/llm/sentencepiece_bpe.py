"""SentencePiece BPE ids of whole texts by vectorised merge rounds, and their texts again.

A model of the sentencepiece library with merges by score, byte fallback and no
normalization but a blank's sign and a leading one; others are an error.

1. The characters of many texts are one flat array. Between two characters that
   stand side by side in no piece nothing can merge, so the text is cut there into
   units. Each different unit of a batch is encoded once; units are told apart by
   a hash, and then character by character.
2. Rounds: the smallest rank (highest score) among the pairs of neighbours of each
   unit is found by a segmented minimum, and its pairs are merged in all units at
   once, from the left and without overlap. Where a merge gives a new pair that
   comes before the unit's next merge, those to its right wait for the next round:
   the order is that of merging one pair at a time. Merged symbols are compacted,
   only the pairs beside them are looked up again, and units without a pair leave.
3. What is no piece in the end becomes the ids of its UTF-8 bytes.

Null and empty texts have no ids and decode to an empty text. Texts of any length
are handled in slices that end between units; a single unit is never cut, and its
time grows with its length times the different ranks in it. Ids that only the
library can decode (control ids, bytes that are no UTF-8 by themselves) are given
to it. Null ids decode to an empty text. Repeated rows stay; an empty table gives
no rows. Of further columns those named in ``keep`` are carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicgrid.llm.common import mix, powers, prefix_hash, ready

#: Characters of text handled at once.
TOGETHER = 1 << 19
BLANK = 0x2581
CODE_POINTS = 0x110000
#: Rank of a pair that is no piece.
NONE = np.int32(2**31 - 1)
EMPTY = np.int64(-1)

_held: dict[str, PieceCoder] = {}


class PairTable:
    """(rank, merged symbol) of pairs of symbols: open addressing in flat arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys = np.full(size, EMPTY)
        self.ranks, self.merged = np.full(size, NONE), np.zeros(size, np.int32)
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = self.keys[at] == EMPTY
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.ranks[at[put]], self.merged[at[put]] = keys[todo[put]], ranks[todo[put]], merged[todo[put]]
            rest = np.setdiff1d(np.arange(len(todo)), put)
            todo, at = todo[rest], (at[rest] + 1) & (size - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._place(keys)
        found = self.keys[at]
        wrong = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            found = self.keys[at[wrong]]
            wrong = wrong[(found != keys[wrong]) & (found != EMPTY)]
        return self.ranks[at], self.merged[at]


class PieceCoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as form

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = form.ModelProto.FromString(self.library.serialized_model_proto())
        rules, kinds = model.normalizer_spec, form.ModelProto.SentencePiece
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        if model.trainer_spec.model_type != form.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or not plain:
            raise ValueError(f"{path}: only BPE models with byte fallback and without normalization can be used")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: models with pieces of the user's, or unused ones, can't be used")
        self.pieces = len(model.pieces)
        symbols = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        order = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in symbols.values()}, reverse=True))}
        #: First symbol of a character: its piece, or a number beyond the pieces from which its bytes are made.
        self.symbol = np.arange(self.pieces, self.pieces + CODE_POINTS, dtype=np.int32)
        for piece, i in symbols.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        whole = lambda s: symbols.get(s, self.pieces + ord(s) if len(s) == 1 else None)
        self.width = np.int64(self.pieces + CODE_POINTS)
        pairs = {}
        for piece, i in symbols.items():
            for cut in range(1, len(piece)):
                left, right = whole(piece[:cut]), whole(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * int(self.width) + right] = (order[model.pieces[i].score], i)
        self.table = PairTable(np.array(list(pairs), np.int64), *np.array(list(pairs.values()), np.int32).reshape(-1, 2).T)
        # characters that stand beside another one in a piece, and which stand side by side
        beside = {(a, b) for piece in symbols for a, b in zip(piece, piece[1:], strict=False)}
        inner = {c: k for k, c in enumerate(sorted({c for pair in beside for c in pair}), 1)}
        self.inner = np.zeros(CODE_POINTS, np.uint16)
        self.inner[[ord(c) for c in inner]] = list(inner.values())
        self.joined = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for a, b in beside:
            self.joined[inner[a], inner[b]] = True
        # ids and what they decode to
        self.byte = np.zeros(256, np.int32)
        self.spelled = [p.piece.replace(chr(BLANK), " ").encode() for p in model.pieces]
        #: Ids that don't decode on their own.
        self.odd = np.array([p.type != kinds.NORMAL for p in model.pieces])
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte[value], self.spelled[i], self.odd[i] = i, bytes([value]), value > 127

    # encoding

    def _pairs(self, symbols: np.ndarray, unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at ``at``."""
        last = at >= len(symbols) - 1
        after = np.where(last, at, at + 1)
        ranks, merged = self.table.find(symbols[at] * self.width + symbols[after])
        ranks[last | (unit[at] != unit[after])] = NONE
        return ranks, merged

    def merged(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units (that begin at ``starts``) after all merges, and how many each has."""
        units = len(starts)
        symbols = symbols.astype(np.int64)
        unit = np.repeat(np.arange(units), np.diff(np.append(starts, len(symbols))))
        ranks, into = self._pairs(symbols, unit, np.arange(len(symbols)))
        done, sizes = [], np.zeros(units, np.int64)
        while len(symbols):
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            counts = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(ranks, starts)
            over = least == NONE
            if over.any():
                leaving = np.repeat(over, counts)
                done.append((unit[leaving], symbols[leaving]))
                sizes[unit[starts[over]]] = counts[over]
                symbols, unit, ranks, into = symbols[~leaving], unit[~leaving], ranks[~leaving], into[~leaving]
                least, counts = least[~over], counts[~over]
                if not len(symbols):
                    break
            hits = np.flatnonzero(ranks == np.repeat(least, counts))
            # in a run of overlapping pairs every second one
            run = np.append(True, np.diff(hits) > 1)
            nth = np.arange(len(hits)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            hits = hits[nth % 2 == 0]
            hits = hits[self._in_order(symbols, unit, ranks, into, hits)]
            symbols[hits] = into[hits]
            stays = np.ones(len(symbols), bool)
            stays[hits + 1] = False
            hits = hits - np.arange(len(hits))
            symbols, unit, ranks, into = symbols[stays], unit[stays], ranks[stays], into[stays]
            changed = np.concatenate([hits, hits[hits > 0] - 1])
            ranks[changed], into[changed] = self._pairs(symbols, unit, changed)
        owner, found = (np.concatenate(x) if done else np.empty(0, np.int64) for x in (list(zip(*done, strict=True)) or ([], [])))
        return found[np.argsort(owner, kind="stable")], sizes

    def _in_order(self, symbols: np.ndarray, unit: np.ndarray, ranks: np.ndarray, into: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Which of the merges ``hits`` come before any pair that the merges to their left in the unit bring up."""
        new, rank, mine = into[hits].astype(np.int64), ranks[hits], unit[hits]
        before = np.maximum(hits - 1, 0)
        left = symbols[before]
        near = np.flatnonzero(np.diff(hits) == 2) + 1
        left[near] = new[near - 1]
        early = np.where((hits > 0) & (unit[before] == mine), self.table.find(left * self.width + new)[0], NONE) <= rank
        after = np.minimum(hits + 2, len(symbols) - 1)
        early |= np.where((hits + 2 < len(symbols)) & (unit[after] == mine), self.table.find(new * self.width + symbols[after])[0], NONE) <= rank
        count = np.cumsum(early) - early
        first = np.append(True, mine[1:] != mine[:-1])
        return count == count[np.flatnonzero(first)[np.cumsum(first) - 1]]

    def _spell_out(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols, with bytes for what is no piece; and how many each unit has."""
        rare = symbols >= self.pieces
        if not rare.any():
            return symbols.astype(np.int32), sizes
        letters = [chr(c) for c in (symbols[rare] - self.pieces).tolist()]
        each = np.ones(len(symbols), np.int64)
        each[rare] = [len(c.encode("utf-8", "replace")) for c in letters]
        ids = np.repeat(symbols, each).astype(np.int32)
        ids[np.repeat(rare, each)] = self.byte[np.frombuffer("".join(letters).encode("utf-8", "replace"), np.uint8)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return ids, np.bincount(owner, each, len(sizes)).astype(np.int64)

    def unit_starts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where units begin in characters of texts that begin at ``begins``."""
        first = np.ones(len(points), bool)
        if len(points):
            inner = self.inner[points]
            first[1:] = ~self.joined[inner[:-1], inner[1:]]
            first[begins[begins < len(points)]] = True
        return np.flatnonzero(first)

    def _ids(self, points: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where those of each text begin, with the end)."""
        ends = np.append(starts[1:], len(points))
        lengths = ends - starts
        sums = prefix_hash(points)
        keys = mix((sums[ends] - sums[starts]) * powers(len(points))[1][starts] + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at, which = np.unique(keys, return_index=True, return_inverse=True)
        model = np.repeat(starts[at][which] - starts, lengths) + np.arange(len(points))
        if (lengths[at][which] != lengths).any() or (points[model] != points).any():
            at = which = np.arange(len(starts))  # two units have one hash
        own = np.repeat(starts[at] - (np.cumsum(lengths[at]) - lengths[at]), lengths[at]) + np.arange(lengths[at].sum())
        pool, sizes = self._spell_out(*self.merged(self.symbol[points[own]], np.cumsum(lengths[at]) - lengths[at]))
        size = sizes[which]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[which] - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, begins)]

    def _points(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").copy()
        points[points == 32] = BLANK
        return points

    def _some(self, texts: list[str]) -> Iterator[np.ndarray]:
        marked = ["▁" + t if t else "" for t in texts]
        begins = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
        points = self._points("".join(marked))
        if not len(points):
            yield from [np.empty(0, np.int32)] * len(texts)
            return
        ids, cuts = self._ids(points, begins, self.unit_starts(points, begins))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield ids[a:b]

    def _long(self, text: str) -> np.ndarray:
        """A text in slices; what may go on in the next slice waits for it."""
        parts, rest, at, whole = [], np.array([BLANK], np.uint32), 0, np.zeros(1, np.int64)
        while at < len(text):
            points = np.concatenate([rest, self._points(text[at : at + max(TOGETHER, len(rest))])])
            at += len(points) - len(rest)
            starts = self.unit_starts(points, whole)
            cut = starts[-1] if at < len(text) else len(points)
            rest = points[cut:]
            if cut:
                parts.append(self._ids(points[:cut], whole, starts[starts < cut])[0])
        return np.concatenate(parts)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            if held and size + len(text) > TOGETHER:
                yield from self._some(held)
                held, size = [], 0
            if len(text) > TOGETHER:
                yield self._long(text)
            else:
                held.append(text)
                size += len(text)
        yield from self._some(held)

    # decoding

    def decode(self, ids: np.ndarray | None) -> str:
        if ids is None or not len(ids):
            return ""
        if self.odd[ids].any():
            return self.library.decode(ids.tolist())
        text = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return (text[1:] if self.spelled[ids[0]][:1] == b" " else text).decode()


def coder(path: str) -> PieceCoder:
    """The worker's coder for this model file."""
    if path not in _held:
        _held[path] = PieceCoder(path)
    return _held[path]


def _mapped(df: DataFrame, column: str, keep: list[str], added: str, make) -> DataFrame:
    """``keep`` columns as they are and the Arrow arrays that ``make`` gives for ``column``, for pieces of each batch."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    name = added.split()[0]

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, array in make(batch.column(len(keep))):
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, len(array)) for i in range(len(keep))] + [array], [*keep, name])

    ready(df.sparkSession)
    return df.select(*keep, F.col(column).alias("_from")).mapInArrow(apply, ", ".join([*kept, added]))


#: Rows handed on at once.
ROWS = 512


def encoded(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the ``ids`` (array of int) of each whole ``text`` by the model file at ``path``."""

    def make(texts) -> Iterator:
        import pyarrow as pa

        code = coder(path)
        for at in range(0, len(texts), ROWS):
            ids = list(code.encode(texts.slice(at, ROWS).to_pylist()))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield at, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))

    return _mapped(docs, "text", keep, "ids array<int>", make)


def decoded(rows: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the ``decoded`` text of the ``ids`` of each row."""

    def make(lists) -> Iterator:
        import pyarrow as pa

        code = coder(path)
        for at in range(0, len(lists), ROWS):
            yield at, pa.array([code.decode(None if x.values is None else x.values.to_numpy(zero_copy_only=False)) for x in lists.slice(at, ROWS)], pa.string())

    return _mapped(rows, "ids", keep, "decoded string", make)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of a document's ids (decimal, joined by commas) and of what they decode to."""
    back = decoded(encoded(docs, path, ["doc_id"]), path, ["doc_id", "ids"])
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
