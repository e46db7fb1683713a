"""Token ids of whole texts by a byte-level BPE tokenizer, with a bounded cache of words.

Byte-level BPE first cuts a text into words, each with the single space before it, and then works on each word alone. A cut before
a single blank or line feed that has other characters than whitespace on both sides is therefore exact, and a word met before needs
no second encoding. Words that are new are encoded in long lines; a token that begins with a blank or a line feed begins a word.
The cache holds at most ``max_words`` words in two halves: when the newer one is full, it becomes the older one, and what is met
again comes back from there, so frequent words stay. A mark such as a comma after a letter or digit is a word of its own; texts are cut
and equal words found by Arrow.
"""

from __future__ import annotations

import os
from array import array
from functools import cache as memo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer texts are encoded in stretches of this many characters, cut where a cut is exact.
STRETCH = 2_000_000
#: Characters of the texts that are encoded together; what is new among their words is encoded in one call.
SLICE_CHARS = 1_000_000
#: Words of a cache, about 250 bytes each.
MAX_WORDS = 700_000
#: New words that are encoded as one line.
LINE = 1000
#: A mark between a letter or digit and a blank.
MARK = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([.,;:!?]) "


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        vocab = self.inner.get_vocab()
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[0] in "\u0120\u010a"]] = True  # byte-level BPE writes a blank and a line feed so
        cut = self.inner.pre_tokenizer and [w for w, _ in self.inner.pre_tokenizer.pre_tokenize_str("a, 1. b")]
        self.marks = cut == ["a", ",", "\u01201", ".", "\u0120b"]
        self.max_words = max_words
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, new: set[str]) -> None:
        """Words after a blank, after a line feed (which they keep), or first in a text and marks (two line feeds). Those with whitespace at an end are left out: no cut is exact there."""
        firsts, others = [], []
        for w in new:
            body = w.removeprefix("\n").removeprefix("\n")
            if body and not body[0].isspace() and not body[-1].isspace():
                (firsts if w[:2] == "\n\n" else others).append(w)
        self.ids.update(zip(firsts, self.alone([w[2:] for w in firsts])))
        for i in range(0, len(others), LINE):
            words = others[i : i + LINE]
            texts = [w if w[0] == "\n" else f" {w}" for w in words]
            ids = np.array(self.inner.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, np.int32)
            ends = [*(np.flatnonzero(self.begins[ids]) * 4).tolist(), len(ids) * 4]
            line = ids.tobytes()
            self.ids.update(zip(words, [line[a:b] for a, b in zip(ends, ends[1:])] if len(ends) == len(words) + 1 else self.alone(texts)))

    def alone(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def stretches(text: str) -> list[str]:
        found, start = [], 0
        while len(text) - start > STRETCH:
            end = start + STRETCH
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and end + 1 < len(text) and not text[end + 1].isspace()):
                end += 1
            found.append(text[start:end])
            start = end
        return [*found, text[start:]]

    def known(self, words: list[str]) -> list[bytes | None]:
        """The ids of each of the distinct ``words``, marked as in learn(); None for those that it leaves out."""
        found = [*map(self.ids.get, words)]
        missed = [i for i, x in enumerate(found) if x is None]
        new = {words[i] for i in missed}
        if len(self.ids) + len(new) > self.max_words // 2:
            self.older, self.ids = self.ids, {}
        again = {w: self.older[w] for w in new if w in self.older}
        self.ids |= again
        if len(again) < len(new):
            self.learn(new.difference(again))
        for i in missed:
            found[i] = self.ids.get(words[i])
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [(k, s, not j) for k, text in enumerate(texts) if text for j, s in enumerate(self.stretches(text)) if s]
        # Only the first stretch of a text has no blank to lose.
        marked = pa.array(["\n\n" * first + s[not first :].replace("\n", " \n") for _, s, first in cut], pa.large_string())
        if self.marks:
            marked = pc.replace_substring_regex(marked, MARK, "\\1 \n\n\\2 ")
        lists = pc.split_pattern(marked, " ")
        words, ends = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        found = self.known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        unsure = np.flatnonzero(np.array([x is None for x in found], bool)[words.indices.to_numpy()])
        inexact = set(np.searchsorted(ends, unsure, "right").tolist())
        # Binary values lie one after another, so those taken in the words' order are the ids of all texts.
        _, starts, line = pa.array(found, pa.large_binary()).take(words.indices).buffers()
        ids = np.frombuffer(line, np.int32)
        at = (np.frombuffer(starts, np.int64)[ends] // 4).tolist()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for c, (k, s, _) in enumerate(cut):
            out[k].append(np.frombuffer(self.alone([s])[0], np.int32) if c + 1 in inexact else ids[at[c] : at[c + 1]])
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int32), *x]) for x in out]


@memo
def tokenizer(path: str, max_words: int = MAX_WORDS) -> WordTokenizer:
    """One for each Python worker, kept over its tasks."""
    return WordTokenizer(path, max_words)
