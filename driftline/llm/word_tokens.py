"""Ids of whole texts by the tokenizers library, each distinct unit encoded once.

The word tokenizer cuts a text at white space and between letters, digits and
punctuation, and never joins tokens across such cuts. Texts are therefore cut
into units by numpy, equal units are found by comparing their bytes, and the
library encodes a unit only when a task first meets it. Results equal those of
the library on the whole text; a tokenizer file of another shape, and texts that
hold the beginning of a special token, are given to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from driftline.llm.common import text_buffer
from driftline.llm.hashing import IS_SPACE, distinct_spans

_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Bytes of units that a task remembers; beyond it the memory starts anew.
REMEMBERED = 2 << 20
#: Bytes of text handled at a time.
BATCH_BYTES = 1 << 20

LETTER, DIGIT, SIGN, OTHER = 1, 2, 3, 4


def _classes() -> np.ndarray:
    """0: space, then LETTER, DIGIT, SIGN; OTHER for bytes next to which no cut is safe."""
    out = np.full(256, OTHER, np.uint8)
    out[IS_SPACE] = 0
    for c in range(33, 127):
        out[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN
    out[ord("'")] = OTHER
    return out


_CLASS = _classes()


def units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all units, their offsets by text, and whether each is a single word, digit or run of signs."""
    kind = _CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3) if len(buf) else np.empty(0, np.int64)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]  # U+00C0 to U+00FF but the two signs among them
    kind[lead] = kind[lead + 1] = LETTER
    first = kind != 0
    if len(buf):
        a, b = kind[:-1], kind[1:]
        joined = (a != 0) & ((a == OTHER) | (b == OTHER) | ((a == b) & (a != DIGIT)))
        first[1:] &= ~joined
        begins = off[:-1][off[:-1] < off[1:]]
        first[begins] = kind[begins] != 0
    starts = np.flatnonzero(first)
    plain = np.add.reduceat((kind == OTHER).astype(np.int64), starts) == 0 if len(starts) else np.empty(0, bool)
    solid = np.maximum.accumulate(np.where(kind != 0, np.arange(1, len(buf) + 1, dtype=np.int64), 0))
    ends = solid[np.append(starts[1:], len(buf)) - 1] if len(starts) else starts
    return starts, ends, np.searchsorted(starts, off), plain


class WordTokens:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already; its threads take some 40 MB
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kinds = [x.get("type") for x in (made["normalizer"] or {}).get("normalizers", [])]
        cut = ((made["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.special = [x["content"].encode() for x in made["added_tokens"]]
        self.by_unit = kinds == _NORMALIZERS and cut == _PATTERN and made["model"]["end_of_word_suffix"] == "</w>" and all(x.startswith(b"<|") for x in self.special)
        self.ends = np.zeros(max(made["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in made["model"]["vocab"].items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.size = 0
        self.at = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, texts: list[bytes], plain: np.ndarray) -> None:
        """texts: new units, each once."""
        single, rest = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        joined = [b" ".join([texts[i] for i in single[k : k + 500]]).decode() for k in range(0, len(single), 500)]
        ids = np.concatenate([np.empty(0, np.uint32), *self._library(joined)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(single):
            raise RuntimeError("a word of the tokenizer has not one end token")
        others = self._library([texts[i].decode() for i in rest])
        lengths = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in others], np.int64)])
        self.slots.update(zip([texts[i] for i in single + rest], range(len(self.at) - 1, len(self.at) - 1 + len(texts)), strict=True))
        self.size += sum(map(len, texts))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids, *others])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), and the offsets of each text's."""
        buf, off = text_buffer(column)
        if not self.by_unit:
            return _chain(self._library([bytes(buf[a:b]).decode() for a, b in zip(off[:-1], off[1:], strict=True)]))
        if self.size > REMEMBERED:
            self.forget()
        starts, ends, at, plain = units(buf, off)
        lead, which = distinct_spans(buf, starts, ends)
        raw = buf.tobytes()
        texts = [raw[s:e] for s, e in zip(starts[lead].tolist(), ends[lead].tolist(), strict=True)]
        new = {t: k for k, t in enumerate(texts) if t not in self.slots}
        if new:
            self._learn(list(new), plain[lead[list(new.values())]])
        slot = np.array([self.slots[t] for t in texts], np.int64)[which]
        lengths = self.at[slot + 1] - self.at[slot]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.at[slot] - total[:-1], lengths)]
        out = total[at]
        marks = np.flatnonzero((buf[:-1] == ord("<")) & (buf[1:] == ord("|")))
        odd = np.unique(np.searchsorted(off, marks, "right") - 1).tolist() if len(marks) else []
        if not odd:
            return ids, out
        texts = [ids[a:b] for a, b in zip(out[:-1], out[1:], strict=True)]
        for d, found in zip(odd, self._library([bytes(buf[off[d] : off[d + 1]]).decode() for d in odd]), strict=True):
            texts[d] = found
        return _chain(texts)


def _chain(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.uint32), *texts]), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


_made: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's own, without the units of earlier tasks; the library's part, which does not grow, is read once."""
    if path not in _made:
        _made[path] = WordTokens(path)
    _made[path].forget()
    return _made[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
