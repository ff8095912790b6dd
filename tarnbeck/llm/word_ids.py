"""Token ids of blocks of texts in columns: split, count and look up words with Arrow, gather their ids with NumPy.

A text's ids are those of its parts between spaces and line ends, in order. Each different part of a block is looked up
once. Of parts that were never seen, those of plain characters go straight to the tokenizer's model, as neither its
normalizer nor its pre-tokenizer changes their words; all others are encoded by the whole tokenizer. What is remembered is
bounded.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that a worker remembers (some 400 bytes each) before it drops all but the KEPT_PARTS that it met first: those
#: of most use, as frequent parts are met early.
MEMO_PARTS, KEPT_PARTS = 250_000, 120_000
#: A lone full stop or comma behind a letter and before white space: a part of its own for the tokenizer.
_MARK = r"([a-zß-öø-ÿ])([.,])([ \n]|\z)"
#: Normalizer and pre-tokenizer that PLAIN and WORD hold for.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Parts that normalizing leaves as they are: ASCII but capitals, and small letters of Latin-1.
PLAIN = re.compile("[!-@\\[-~ß-öø-ÿ]+")
#: The words of a plain part, as the pre-tokenizer cuts them.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The model's letters of the bytes of plain words.
_shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _shown)}


class WordTokens:
    """Ids of parts of texts between spaces and line ends.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its parts in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), {}
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    @staticmethod
    def lowered(text: str) -> str:
        """As the tokenizer's normalizer lower-cases it; texts where that could differ stay."""
        return text if "<|" in text or "\u03a3" in text or "\u0130" in text else text.lower()

    def learn(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
            if len(word) and (word[1:] < word[:-1]).any() or (word < 0).any():  # special strings: one by one
                for p in some:
                    self.memo[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            cuts, raw = np.searchsorted(word, np.arange(len(some) + 1)) * 4, ids.tobytes()
            for p, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist()):
                self.memo[p] = raw[a:b]


class BlockTokens(WordTokens):
    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        special = [t["content"] for t in made["added_tokens"]]
        self.plain = all(made[k] == v for k, v in STEPS.items()) and all(t.startswith("<|") for t in special)
        self.model, self.short = self.tokenizer.model, {"": []}
        self.place: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def forget(self) -> None:
        """All but the first KEPT_PARTS parts, which stay at their places."""
        n = min(KEPT_PARTS, len(self.place))
        self.place = dict(islice(self.place.items(), n))
        self.used = int(self.start[n - 1] + self.length[n - 1])
        self.flat, self.start, self.length = (self._fit(x, m) for x, m in ((self.flat, self.used), (self.start, n), (self.length, n)))

    @staticmethod
    def _fit(old: np.ndarray, n: int) -> np.ndarray:
        """The first n, in room for as many again."""
        new = np.zeros(2 * n, old.dtype)
        new[:n] = old[:n]
        return new

    @staticmethod
    def _room(old: np.ndarray, n: int) -> np.ndarray:
        if n <= len(old):
            return old
        new = np.zeros(max(n, 2 * len(old)), old.dtype)
        new[: len(old)] = old
        return new

    def _add(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.place)
        self.start, self.length = self._room(self.start, n + len(parts)), self._room(self.length, n + len(parts))
        self.flat = self._room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(parts)] = self.used + np.cumsum(counts) - counts
        self.length[n : n + len(parts)] = counts
        self.used += len(ids)
        self.place.update(zip(parts, range(n, n + len(parts))))

    def _word(self, word: str) -> list[int]:
        """Ids of a word of a plain part."""
        if len(word) > 2:
            return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTES))]
        if word not in self.short:  # some thousands
            self.short[word] = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTES))]
        return self.short[word]

    def _learn_plain(self, parts: list[str]) -> None:
        ids, counts = [], []
        for p in parts:
            n = len(ids)
            for word in (p,) if p.isalpha() else WORD.findall(p):
                ids += self._word(word)
            counts.append(len(ids) - n)
        self._add(parts, np.array(ids, np.uint32), np.array(counts, np.int64))

    def _learn_parts(self, parts: list[str]) -> None:
        self.memo = {}
        self.learn(parts)
        raw = [np.frombuffer(self.memo[p], "<u4") for p in parts]
        self.memo = {}
        self._add(parts, np.concatenate(raw) if raw else np.zeros(0, np.uint32), np.array([len(r) for r in raw], np.int64))

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind another, their number in each text)."""
        pa.default_memory_pool().release_unused()  # the pool keeps what earlier blocks took
        own = pc.replace_substring_regex(pa.array([self.lowered(t) for t in texts], pa.large_string()), _MARK, r"\1 \2\3")
        split = pc.split_pattern(pc.replace_substring(own, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in names if w not in self.place]
        if new and len(self.place) + len(new) > MEMO_PARTS:
            self.forget()
            new = [w for w in names if w not in self.place]
        plain = [self.plain and PLAIN.fullmatch(w) is not None and "<|" not in w for w in new]
        self._learn_plain([w for w, x in zip(new, plain) if x])
        self._learn_parts([w for w, x in zip(new, plain) if not x])
        at = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))[words.indices.to_numpy()]
        n = self.length[at]
        before = np.cumsum(n) - n
        ids = self.flat[np.arange(int(n.sum())) + np.repeat(self.start[at] - before, n)]
        total = np.append(before, n.sum())
        cuts = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, np.diff(total[cuts])


@lru_cache(maxsize=1)
def block_tokens(path: str) -> BlockTokens:
    """The worker's own, for all its tasks. A task's function is pickled with the values of its module's variables, so
    that a dictionary there would be a new one in each task; this function is pickled by its name."""
    return BlockTokens(path)
