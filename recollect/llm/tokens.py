"""Token ids inside tasks: whole texts, each different word of a block of texts once.

The word vocabulary splits at white space, so a text's ids are those of its words in a
row. A block of texts becomes its different words and an index per text; words seen in
earlier blocks come from a cache, new words made of letters go straight to the library's
BPE model, and all others through its whole pipeline. A vocabulary file whose normaliser
or splitting differs from the word vocabulary's is left to the library altogether.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Words in the newer half of a worker's cache; the older half holds as many.
CACHE = 300_000
#: Characters of texts that are encoded together.
BLOCK = 1 << 22
_ODD = re.compile(r"[.,](?<![^\W_][.,])(?=[ \n])")
_PAIR = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
#: Bytes that byte-level vocabularies write as code points from 256 on, in this order (fixed values).
_MOVED = [*range(0, 33), *range(127, 161), 173]
_BYTES = {b: 256 + i for i, b in enumerate(_MOVED)}
#: The splitting for which a text's ids are those of its words (fixed values of the word vocabulary).
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(path: str) -> bool:
    """Whether the file normalises and splits as the word vocabulary does."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    special = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or [])
    return (spec.get("normalizer") or {}).get("normalizers") == _NORMAL and steps[0].get("pattern") == {"Regex": _SPLIT} and [s["type"] for s in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"] and special


class Encoder:
    """Ids of texts as unsigned 16-bit integers where the vocabulary fits, else 32-bit, each text ended by ``END``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_words = _by_words(path)
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """The ids of one word."""
        raw = self.newer.get(word)
        if raw is not None:
            return raw
        raw = self.older.get(word)
        if raw is None:
            plain = word.isalpha() and word == word.lower()
            if plain and word.isascii():
                ids = [t.id for t in self.model.tokenize(word)]
            elif plain and _latin(word):
                ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTES))]
            elif pair := _PAIR.fullmatch(word):
                return self.word(pair[1]) + self.word(pair[2])
            else:
                ids = self.whole.encode(word, add_special_tokens=False).ids
            raw = np.array(ids, self.kind).tobytes()
        if len(word) < 100:
            if len(self.newer) >= CACHE:
                self.older, self.newer = self.newer, {}
            self.newer[word] = raw
        return raw

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_words:
            found = [[*e.ids, END] for e in self.whole.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter((i for ids in found for i in ids), self.kind), np.array([len(ids) for ids in found], np.int64)
        split = pc.split_pattern(pa.array([_spaced(t) for t in texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        word, ends = self.word, split.offsets.to_numpy()[1:]
        raws = [word(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        index = np.insert(coded.indices.to_numpy(), ends, len(raws))
        raws.append(np.array([END], self.kind).tobytes())
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // self.kind.itemsize
        flat, begin = np.frombuffer(b"".join(raws), self.kind), np.cumsum(sizes) - sizes
        n = sizes[index]
        after = np.cumsum(n)
        return flat[np.repeat(begin[index] - after + n, n) + np.arange(after[-1])], np.diff(np.r_[0, after[ends + np.arange(len(ends))]])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of each text's ids."""
        found, held, size = [(np.zeros(0, self.kind), np.zeros(0, np.int64))], [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size > BLOCK:
                found.append(self._block(held))
                held, size = [], 0
        if held:
            found.append(self._block(held))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _spaced(text: str) -> str:
    """The text with one blank between words, lower-cased and with ends of sentences apart where that changes no id."""
    if "<|" not in text and _latin(text):
        text = text.lower()
        if not _ODD.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n").replace(",\n", " ,\n")
    return text.replace("\n", " ")


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file; the default is the public word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
