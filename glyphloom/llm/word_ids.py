"""Token ids of the word BPE vocabulary, whitespace-separated pieces being encoded once and remembered.

The vocabulary's normaliser turns white space into one space, and no token spans white space, so a text's
ids are the concatenation of the ids of its pieces. Likewise a comma or full stop between an ASCII letter and
white space always is a token run of its own, so it may be set apart from its word first; and ASCII letters may
be lower-cased first unless combining marks are about, which the normaliser composes before it lower-cases.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator

import numpy as np
import public_tokenizers

from glyphloom.llm.words import word_hashes, word_runs

MAX_REMEMBERED = 250_000
END_ID = 1
LONGEST = 64  # bytes of a word that may be known by its hash; longer ones are encoded each time
SEGMENT = 1 << 18  # bytes of text encoded together; a longer text is cut at white space
TOGETHER = 300  # plain words encoded as one text
_FIRST_SLOTS = 1 << 18
_POINTS = "".join(c for c in string.punctuation if c != "'")  # a run of them is one of the pattern's; an apostrophe may begin another
_MARKS = re.compile(b"[\xcc\xcd]")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def vocabulary_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Maps pieces without ASCII white space to their ids, and remembers them by a 64-bit hash.

    Words met early are the common ones: ``MAX_REMEMBERED`` stay, later ones serve only the texts they come from. Entry k
    of the memory has ``length[k]`` ids from ``start[k]`` in ``flat``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        if size > 65_536:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        # For words that the normaliser leaves as they are and that are one run each; the model is the same object.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(size, dtype=bool)  # tokens that end a run of letters, digits or other characters
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.keys, self.entry = np.zeros(_FIRST_SLOTS, dtype=np.uint64), np.zeros(_FIRST_SLOTS, dtype=np.int32)
        self.flat, self.start, self.length = np.zeros(0, "<u2"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = dict(self.encoded([b",", b"."]))
        self._append([known[b","], known[b"."]])

    def encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words and their ids. Lower-case words of Latin letters are one run each, and what ``_POINTS`` follow is another: many are encoded as one text."""
        plain: list[bytes] = []
        units: list[str] = []
        runs: list[int] = []
        others: list[bytes] = []
        for word in words:
            text = word.decode()
            body = text.rstrip(_POINTS)
            if body.isalpha() and body.islower() and max(body) < "\u0250":
                apart = len(body) < len(text)
                plain.append(word)
                units.append(f"{body} {text[len(body) :]}" if apart else text)
                runs.append(1 + apart)
            else:
                others.append(word)
        if plain:
            texts = [" ".join(units[k : k + TOGETHER]) for k in range(0, len(units), TOGETHER)]
            ids = np.concatenate([np.array(x.ids, dtype="<u2") for x in self.plain.encode_batch_fast(texts, add_special_tokens=False)])
            ends, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(runs)
            if len(ends) != last[-1]:
                raise AssertionError("a word has more runs than expected")
            cuts = (ends[last - 1] * 2).tolist()
            raw = ids.tobytes()
            yield from zip(plain, map(raw.__getitem__, map(slice, [0, *cuts], cuts)))
        if others:
            for word, coded in zip(others, self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)):
                yield word, np.array(coded.ids, dtype="<u2").tobytes()

    def _append(self, coded: list[bytes]) -> None:
        """New entries at the end of the memory."""
        lengths = np.array([len(x) // 2 for x in coded], dtype=np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(coded), dtype="<u2")])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Where to look for keys first: their upper bits."""
        return (keys >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _put(self, keys: np.ndarray, entry: np.ndarray) -> None:
        """Let keys that aren't there find their entries; of keys that meet in a slot all but one go on to the next."""
        at, last = self._slot(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]], self.entry[at[free]] = keys[free], entry[free]
            on = self.keys[at] != keys
            keys, entry, at = keys[on], entry[on], at[on] + 1 & last

    def _remember(self, keys: np.ndarray, first: int) -> None:
        """Let each key find its entry, the first of which is ``first``; slots stay half empty at least."""
        if 2 * (first + len(keys)) > len(self.keys):
            held, entry = self.keys[self.keys != 0], self.entry[self.keys != 0]
            slots = 2 << (first + len(keys)).bit_length()
            self.keys, self.entry = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.int32)
            self._put(held, entry)
        self._put(keys, np.arange(first, first + len(keys), dtype=np.int32))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for those that aren't remembered."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo, at, last = np.arange(len(keys)), self._slot(keys), len(self.keys) - 1
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.entry[at[hit]]
            on = ~hit & (held != 0)
            todo, at = todo[on], at[on] + 1 & last
        return out

    def _segment(self, raw: bytes, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that begin at ``offsets`` in ``raw``, each followed by a tab; and where each text's ids begin, and the end.

        With ``lower`` letters A-Z count as lower-case ones, and commas and full stops are set apart from their word.
        """
        data = np.frombuffer(raw, dtype=np.uint8)
        at, to = word_runs(data)
        apart = np.zeros(len(at), dtype=bool)
        if lower:
            last, after = data[to - 1], data[to]
            apart = ((last == 44) | (last == 46)) & (to - at > 1) & _LETTER[data[to - 2]] & ((after == 32) | (after == 10))
            to = to - apart
        hashed = (to - at <= LONGEST) & lower
        keys = np.where(hashed, word_hashes(data, at, to) | np.uint64(1), np.uint64(0))
        entry = np.full(len(at), -1, dtype=np.int64)
        entry[hashed] = self._find(keys[hashed])
        size = len(self.start)
        new = np.flatnonzero((entry < 0) & hashed)
        fresh, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
        others = np.flatnonzero(~hashed)
        low = raw.lower() if lower else raw
        words, each = ([low[a:b] for a, b in zip(at[i].tolist(), to[i].tolist())] for i in (new[first], others))
        if words or each:
            known = dict(self.encoded(list(dict.fromkeys(words + each))))
            self._append([known[w] for w in words + each])
            entry[new] = size + which
            entry[others] = size + len(words) + np.arange(len(others))
        unit = np.arange(len(at)) + np.cumsum(apart) - apart
        units = np.empty(len(at) + int(apart.sum()), dtype=np.int64)
        units[unit] = entry
        units[unit[apart] + 1] = (data[to[apart]] == 46).astype(np.int64)
        lengths = self.length[units]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.start[units] - ends[:-1], lengths)]
        begin = np.append(unit, len(units))[np.searchsorted(at, np.append(offsets, len(raw)))]
        stay = size + len(words) if size + len(words) <= MAX_REMEMBERED else size
        if stay > size:
            self._remember(fresh, size)
        used = int(self.start[stay]) if stay < len(self.start) else len(self.flat)
        self.flat, self.start, self.length = self.flat[:used], self.start[:stay], self.length[:stay]
        return ids, ends[begin]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian 16-bit bytes."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush(lower: bool = True) -> None:
            nonlocal size
            if held:
                offsets = np.cumsum([0, *(len(part) + 1 for _, part in held)])[:-1]
                ids, ends = self._segment(b"".join(part + b"\t" for _, part in held), offsets, lower)
                for (i, _), a, b in zip(held, ends[:-1].tolist(), ends[1:].tolist()):
                    out[i].append(ids[a:b].tobytes())
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            raw = text.encode()
            marked = _MARKS.search(raw) is not None
            if marked:
                flush()
            for part in _cut(raw):
                held.append((i, part))
                size += len(part)
                if size >= SEGMENT:
                    flush(not marked)
            if marked:
                flush(False)
        flush()
        return list(map(b"".join, out))


def _cut(raw: bytes) -> Iterator[bytes]:
    """``raw`` in parts of about ``SEGMENT`` bytes that end with a blank or line feed, so that no word is cut."""
    at = 0
    while len(raw) - at > SEGMENT:
        to = max(raw.rfind(b" ", at, at + SEGMENT), raw.rfind(b"\n", at, at + SEGMENT)) + 1
        if not to:
            found = [k for k in (raw.find(b" ", at + SEGMENT), raw.find(b"\n", at + SEGMENT)) if k >= 0]
            to = min(found, default=len(raw) - 1) + 1
        yield raw[at:to]
        at = to
    yield raw[at:]
