"""Token ids of whole texts through a public tokenizer, with each distinct word encoded once per worker.

A byte-pair tokenizer cuts a text into words before it merges anything, so ids of a text are the ids of its words in a
row. `WordEncoder` cuts only where the tokenizer's own pre-tokenizer certainly cuts, keeps the ids of words it has seen,
and hands a text whole to the tokenizer where white space is not single blanks and line ends. The words of a slice are looked
up together (`WordTable`), and their ids laid out by one gather.
"""

from __future__ import annotations

import gc
import re

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
SLICE_CHARS = 3_000_000
MOST_WORDS = 1_000_000  # words a worker remembers; words met later are encoded for their slice only
MOST_STEMS = 200_000  # runs of letters it remembers besides, as they end in different points
WIDE = 3  # 8-byte parts of a key; longer words are told apart one by one
LONG_WORD = 1000  # characters; longer words are not remembered
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MARK = "\x01"  # stands between words of one call; a word that holds it is encoded alone
CONTROLS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
WIDE_BLANKS = re.compile("[ ᠎ -‏ -  -⁠　﻿]")


class WordTable:
    """Numbers (from 0) of words of at most 8 * WIDE bytes, which arrays of whole keys hold; equal numbers are equal bytes."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 12, -1, np.int32)
        self.keys = np.zeros((WIDE, 1 << 10), np.uint64)
        self.count = 0

    def __len__(self) -> int:
        return self.count

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[0] * MIX[0]
        for key, factor in zip(keys[1:], MIX[1:], strict=True):
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ key) * factor
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it has none."""
        out, slot, left = np.full(keys.shape[1], -1, np.int32), self._slot(keys), np.arange(keys.shape[1])
        while len(left):
            number = self.slots[slot]
            same = number >= 0
            for own, key in zip(self.keys, keys, strict=True):
                same &= own[number] == key
            out[left[same]] = number[same]
            more = (number >= 0) & ~same
            left, slot, keys = left[more], (slot[more] + 1) & (len(self.slots) - 1), keys[:, more]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct words that have no number yet take the next ones."""
        first, self.count = self.count, self.count + keys.shape[1]
        if self.count > self.keys.shape[1]:
            wider = np.zeros((WIDE, max(self.count, 2 * self.keys.shape[1])), np.uint64)
            wider[:, :first] = self.keys[:, :first]
            self.keys = wider
        self.keys[:, first : self.count] = keys
        if 2 * self.count > len(self.slots):
            self.slots, first = np.full(1 << (4 * self.count).bit_length(), -1, np.int32), 0
        number = np.arange(first, self.count, dtype=np.int32)
        slot = self._slot(self.keys[:, first : self.count])
        while len(number):  # of several words at one free slot one stays, the others go on
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            out = self.slots[slot] != number
            number, slot = number[out], (slot[out] + 1) & (len(self.slots) - 1)


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts. `blank_joins`: the tokenizer keeps a blank with the word after it."""

    def __init__(self, path: str, blank_joins: bool, most_words: int | None = None):
        from tokenizers import Tokenizer

        self.most_words = most_words
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's name in a text is ordinary text
        self.blank_joins = blank_joins
        self.known = WordTable()
        self.number = np.zeros(0, np.int64)  # row of a number of `known` among the rows of ids
        self.long: dict[bytes, int] = {}  # rows of words that are too long for it
        self.first_id, self.n_ids, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.stem_ids: dict[str, bytes] = {}
        self.passing: list[str] = []
        self.line_end = self._whole(["\n"])[0] if blank_joins else b""
        self.mark = np.frombuffer(self._whole([" " + MARK])[0], "<u4")
        self.point = {c: self._whole([c])[0] for c in ".,"}
        # an id at the edge of a word: the one that holds the blank before it, or the one that ends it
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith("Ġ") if blank_joins else token.endswith("</w>")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> None:
        """Runs of letters are one word each to either tokenizer, so one call's ids split where words start or end."""
        blocks = [stems[i : i + 1000] for i in range(0, len(stems), 1000)]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast([" " + " ".join(b) for b in blocks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            edges = [*edges.tolist(), len(ids)] if self.blank_joins else [0, *(edges + 1).tolist()]
            data = ids.tobytes()
            pieces = [data[4 * a : 4 * b] for a, b in zip(edges, edges[1:])]
            self.stem_ids.update(zip(block, pieces if len(pieces) == len(block) else self._whole([" " + w for w in block]), strict=True))

    def _marked(self, words: list[str], before: str) -> dict[str, bytes]:
        """Ids of words of any kind, with a mark behind each."""
        skip = len(self.line_end) // 4 if before == "\n" else 0
        alone = [w for w in words if MARK in w]
        found = dict(zip(alone, self._whole([before.strip("\n") + w for w in alone]), strict=True))
        rest = [w for w in words if w not in found]
        blocks = [rest[i : i + 1000] for i in range(0, len(rest), 1000)]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast(["".join(f"{before}{w} {MARK}" for w in b) for b in blocks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            data, start = ids.tobytes(), 0
            for w, end in zip(block, np.flatnonzero(ids == self.mark[-1]).tolist(), strict=True):
                found[w] = data[4 * (start + skip) : 4 * (end + 1 - len(self.mark))]
                start = end + 1
        return found

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words that a blank or a line end begins; a blank is no id of its own, a line end is one."""
        point = self.point
        starts = [w[1:] for w in words if w[0] == "\n"]
        first = self._marked(starts, "\n") if starts else {}
        later = [w[1:] for w in words if w[0] == " " and len(w) > 1]
        bare = [w for w in later if w.isalpha()]
        other = [w for w in later if not w.isalpha()]
        dotted = [w for w in other if w[-1:] in point and w[:-1].isalpha()]
        odd = [w for w in other if not (w[-1:] in point and w[:-1].isalpha())]
        ids = self._stem_lookup({*bare, *(w[:-1] for w in dotted)})
        found = {w: ids[w] for w in bare}
        found.update({w: ids[w[:-1]] + point[w[-1]] for w in dotted})
        if odd:
            found.update(self._marked(odd, " "))
        found[""] = b""
        return [self.line_end + first[w[1:]] if w[0] == "\n" else found[w[1:]] for w in words]

    def _stem_lookup(self, stems: set[str]) -> dict[str, bytes]:
        new = [s for s in stems if s not in self.stem_ids]
        if len(self.stem_ids) > min(self.most_words or MOST_WORDS, MOST_STEMS):
            self.passing += new
        self._stems(new)
        return self.stem_ids

    def _rows_of(self, data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Row of ids of each word, from where it starts in `data` (which ends in 8 * WIDE bytes of no word) and its bytes."""
        parts = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        keys = np.empty((WIDE, len(start)), np.uint64)
        for k in range(WIDE):
            keys[k] = parts[start + 8 * k]
            keys[k] &= LOW_BYTES[np.clip(size - 8 * k, 0, 8)]
        held = size <= 8 * WIDE
        if b"\0" in data[: -8 * WIDE]:  # a key's zero bytes are no part of its word
            zeros = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) == 0)])
            held &= zeros[start + size] == zeros[start]
        rows = np.zeros(len(start), np.int64)
        number = self.known.find(keys)
        number[~held] = -1
        hit = number >= 0
        rows[hit] = self.number[number[hit]]
        miss = np.flatnonzero(held & ~hit)
        new, words = np.zeros((WIDE, 0), np.uint64), []
        if len(miss):
            keys = keys[:, miss]
            order = np.lexsort(keys)
            keys = keys[:, order]
            begins = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            rows[miss[order]] = len(self.n_ids) + np.cumsum(begins) - 1
            new, at = keys[:, begins], miss[order[begins]]
            words = [data[a : a + n] for a, n in zip(start[at].tolist(), size[at].tolist(), strict=True)]
        first, long = len(self.n_ids), {}
        for i in np.flatnonzero(~held).tolist():
            word = data[start[i] : start[i] + size[i]]
            row = self.long.get(word)
            rows[i] = long.setdefault(word, first + len(words) + len(long)) if row is None else row
        if words or long:
            ids = self._new([w.decode() for w in (*words, *long)])
            n = np.array([len(i) // 4 for i in ids])
            self.first_id = np.concatenate([self.first_id, len(self.ids) + np.cumsum(n) - n])
            self.n_ids = np.concatenate([self.n_ids, n])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
            room = (self.most_words or MOST_WORDS) - len(self.known) - len(self.long)
            if room >= len(words) + len(long) and all(len(w) <= LONG_WORD for w in long):
                self.known.add(new)
                self.number = np.concatenate([self.number, np.arange(first, first + len(words))])
                self.long.update(long)
            elif room > 0:
                self.known.add(new[:, :room])
                self.number = np.concatenate([self.number, np.arange(first, first + min(room, len(words)))])
        return rows

    def _forget(self) -> None:
        """Rows of ids behind the last that a remembered word has."""
        kept = max([int(self.number[-1]) if len(self.number) else -1, *([next(reversed(self.long.values()))] if self.long else [])]) + 1
        if kept < len(self.n_ids):
            self.ids = self.ids[: self.first_id[kept]].copy()
            self.first_id, self.n_ids = self.first_id[:kept].copy(), self.n_ids[:kept].copy()

    def _words_of(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose words are parted by single blanks and line ends, each of which is a cut."""
        parts = [t.encode() for t in texts]
        data = b"\n" + b"\n".join(parts)
        if not self.blank_joins:
            data = data.replace(b"\n", b" ")
        raw = np.frombuffer(data, np.uint8)
        start = np.flatnonzero((raw == 32) | (raw == 10))
        size = np.diff(start, append=len(data))
        rows = self._rows_of(data + bytes(8 * WIDE), start, size)
        n = self.n_ids[rows]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.first_id[rows] - (ends - n), n) + np.arange(int(ends[-1]))]
        self._forget()
        text_at = np.cumsum([0] + [len(p) + 1 for p in parts])
        word_at = np.searchsorted(start, text_at)
        id_at = np.concatenate([[0], ends])[word_at]
        skip = len(self.line_end) // 4  # of the line end before each text
        return [ids[a + skip : b].tobytes() for a, b in zip(id_at[:-1].tolist(), id_at[1:].tolist(), strict=True)]

    def _plain(self, text: str) -> bool:
        """Only single blanks and line ends between words, so every one of them is a cut of the pre-tokenizer."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or any(c in text for c in CONTROLS):
            return False
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not WIDE_BLANKS.search(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # only strings and lists of them are made here, in great number; no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):  # the words of a slice are in memory at once, not those of a whole batch
            end, size = at, 0
            while end < len(texts) and size < SLICE_CHARS:
                size += len(texts[end])
                end += 1
            out += self._encode_joined(texts[at:end]) if self.blank_joins else self._words_of(texts[at:end])
            for stem in self.passing:
                self.stem_ids.pop(stem, None)
            self.passing = []
            at = end
        return out

    def _encode_joined(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and self._plain(t)]
        rough = sorted({i for i, t in enumerate(texts) if t} - set(plain))
        for i, ids in zip(rough, self._whole([texts[i] for i in rough]), strict=True):
            out[i] = ids
        if plain:
            for i, ids in zip(plain, self._words_of([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, blank_joins: bool, most_words: int | None = None) -> WordEncoder:
    """One encoder per worker process, file and number of words; a worker that another query left keeps none of another number."""
    if path not in _ENCODERS or _ENCODERS[path].most_words != most_words:
        _ENCODERS[path] = WordEncoder(path, blank_joins, most_words)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
