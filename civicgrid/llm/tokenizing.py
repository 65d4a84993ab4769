"""Token ids by the tokenizers library, each different unit of a batch looked up or encoded once.

Neither pre-tokenizer ever makes a token across the boundary between a
non-space and a following blank, so a text's ids are those of its
blank-separated units in turn. Where a unit has only plain letters, digits,
stops and single line breaks, its runs of one kind are units of their own, as
both pre-tokenizers end a token wherever such a run ends; a blank stays with the
run that follows.

Units are found and told apart by array operations over the bytes of many texts.
Those that a worker doesn't hold are encoded together: runs of letters by the
library's model as one list of pre-tokens, in the form that the library's own
normalizer and pre-tokenizer give them, all others by the whole tokenizer.

A worker holds at most ``UNITS`` units of a vocabulary: those used since it last
had half of that many, and those used in the stretch before.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np

from civicgrid.llm.common import mix, powers, prefix_hash

UNITS = 400_000
LONGEST_UNIT = 40
#: Bytes of text whose units are found at once.
TOGETHER = 1 << 20

OTHER, LETTER, DIGIT, STOP, BREAK, BLANK = range(6)
#: Kind of each byte; letters beyond ASCII are two bytes.
KIND = np.zeros(256, np.uint8)
KIND[65:91] = KIND[97:123] = LETTER
KIND[48:58] = DIGIT
KIND[np.frombuffer(b".,;:!?*%&$#", np.uint8)] = STOP
KIND[10], KIND[32] = BREAK, BLANK
#: Letters that no normalizer joins with a neighbour of the same set: A-Z, a-z and U+00C0 to U+00FF without the two signs.
LETTERS = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]

_held: dict[str, UnitEncoder] = {}


def is_space_free(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each of the positions ``at`` is surely no white space."""
    last = buf[at - 1]
    sure = (last > 32) & (last < 127)
    for width, low, high in ((2, 0xC3, 0xDF), (3, 0xE4, 0xEF), (4, 0xF0, 0xFF)):
        lead = buf[np.maximum(at - width, 0)]
        sure |= (last >= 128) & (at >= width) & (lead >= low) & (lead <= high)
    return sure


def units_of(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, whether it is a run of letters, perhaps after a blank) of each unit of the texts that begin at ``begins``."""
    n = len(buf)
    kind = KIND[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    first = np.zeros(n, bool)
    first[begins[begins < n]] = True
    blank = np.flatnonzero(kind == BLANK)
    inside = blank[blank > 0]
    first[inside[is_space_free(buf, inside)]] = True
    odd = kind == OTHER
    odd[blank[~first[blank]]] = True
    # a line break is plain between characters of one unit that are no white space
    at = np.flatnonzero(kind == BREAK)
    before, after = kind[np.maximum(at - 1, 0)], np.minimum(at + 1, n - 1)
    odd[at[first[at] | (before >= BREAK) | (after == at) | first[after] | (kind[after] >= BREAK)]] = True
    starts = np.flatnonzero(first)
    plain = np.repeat(np.add.reduceat(odd, starts, dtype=np.int32) == 0, np.diff(np.append(starts, n)))
    change = np.zeros(n, bool)
    change[1:] = plain[1:] & (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK)
    starts = np.flatnonzero(first | change)
    last = np.append(starts[1:], n) - 1
    return starts, plain[starts] & (kind[last] == LETTER)


class UnitEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: The model without normalizer and pre-tokenizer.
        self.bare = Tokenizer(self.tokenizer.model)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        #: What a letter is for the model, and a blank before a letter.
        self.letters = {ord(c): self._form(c) for c in LETTERS}
        self.letters[32] = self._form(" a").removesuffix(self.letters[97])
        self.stop = self.bare.encode(["!"], is_pretokenized=True).ids
        # words go to the model itself only where they are spelled letter by letter
        tried = [b + w for w in ("a", "Ab", "Été", "straße", "ZÄHL") for b in ("", " ")]
        self.spelled = len(self.stop) == 1 and all(self._form(w) == w.translate(self.letters) for w in tried)
        # an added token of plain characters would have to be found across runs
        self.by_units = not any(set(t.content) <= {*LETTERS, *"0123456789 .,;:!?*%&$#\n"} for t in self.tokenizer.get_added_tokens_decoder().values())

    def _form(self, text: str) -> str:
        """The only pre-token of a short text as the model gets it."""
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else [(normal, None)]
        return pieces[0][0] if len(pieces) == 1 else "\0"

    def _words(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of runs of letters: one list of pre-tokens, with a stop between them, which no letters give."""
        forms = [x for w in words for x in (w.decode().translate(self.letters), "!")]
        ids = np.array(self.bare.encode_batch_fast([forms], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        data, start = ids.tobytes(), 0
        for cut in (4 * np.flatnonzero(ids == self.stop[0])).tolist():
            yield data[start:cut]
            start = cut + 4

    def _whole(self, units: list[bytes]) -> Iterator[bytes]:
        for coded in self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in units], add_special_tokens=False):
            yield np.array(coded.ids, "<u4").tobytes()

    def _look_up(self, units: list[bytes], word: list[bool]) -> list[bytes]:
        """Ids of different units."""
        known, before = self.known, self.before
        out = list(map(known.get, units))
        words, others = [], []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            unit = units[i]
            if (ids := before.get(unit)) is not None:
                out[i] = known[unit] = ids
            elif word[i] and self.spelled:
                words.append(i)
            else:
                others.append(i)
        for encode, some in ((self._words, words), (self._whole, others)):
            if some:
                for i, ids in zip(some, encode([units[i] for i in some]), strict=True):
                    out[i] = ids
                    if len(units[i]) <= LONGEST_UNIT:
                        known[units[i]] = ids
        if len(known) >= UNITS // 2:
            self.known, self.before = {}, known
        return out

    def _ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each of some texts that begin and end at the borders of units."""
        data = b"".join(texts)
        buf = np.frombuffer(data, np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(buf):
            yield from [b""] * len(texts)
            return
        starts, word = units_of(buf, begins) if self.by_units else (np.unique(begins[:-1][np.diff(begins) > 0]), np.zeros(len(texts), bool))
        ends = np.append(starts[1:], len(buf))
        sums = prefix_hash(buf)
        keys = mix((sums[ends] - sums[starts]) * powers(len(buf))[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at, which = np.unique(keys, return_index=True, return_inverse=True)
        found = self._look_up([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], word[at].tolist())
        pool, sizes = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) >> 2 for x in found], np.int64)
        size = sizes[which]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[which] - before[:-1], size) + np.arange(before[-1])].tobytes()
        cuts = (4 * before[np.searchsorted(starts, begins)]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield ids[a:b]

    def _pieces(self, data: bytes) -> Iterator[bytes]:
        """A long text cut before blanks that follow an ASCII character other than white space."""
        start = 0
        while self.by_units and len(data) - start > TOGETHER:
            cut = data.find(b" ", start + TOGETHER)
            while cut > 0 and not 32 < data[cut - 1] < 127:
                cut = data.find(b" ", cut + 1)
            if cut < 0:
                break
            yield data[start:cut]
            start = cut
        yield data[start:]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        held, size = [], 0
        for text in texts:
            data = text.encode("utf-8", "replace") if text else b""
            if size + len(data) > TOGETHER and held:
                yield from self._ids(held)
                held, size = [], 0
            if len(data) > TOGETHER:
                yield b"".join([ids for piece in self._pieces(data) for ids in self._ids([piece])])
            else:
                held.append(data)
                size += len(data)
        if held:
            yield from self._ids(held)


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for this vocabulary file."""
    if path not in _held:
        _held[path] = UnitEncoder(path)
    return _held[path]
