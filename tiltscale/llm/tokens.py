"""Token ids of whole texts, by the tokenizers library, one word at a time.

The word tokenizer this package uses drops white space and never merges across it,
so the ids of a text are those of its words in a row.  Each Python worker remembers
the ids of short words it has met; the memory is bounded in bytes and changes no result.
"""

import json
import re

import numpy as np

# Letters whose lower case and composition are one character to one, then ASCII marks.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)\Z")
# Words of more letters are not remembered; the memory of words starts anew beyond so many bytes.
_LONG = 64
_MEMORY_BYTES = 224 * 1024 * 1024
# What a word takes beside its letters and ids.
_ENTRY_BYTES = 240


def default_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters():
    """Letters of byte-level tokenizers: printable bytes stand for themselves, the rest count on from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {**{b: b for b in printable}, **{b: 256 + i for i, b in enumerate(rest)}}


class WordIds(dict):
    """Word → its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Only this kind drops white space and ends words; others get whole texts.
        self.by_word = spec["model"].get("end_of_word_suffix") == "</w>"
        self.letters = _byte_letters()
        self.forget()

    def forget(self):
        self.clear()
        self.runs, self.held = {}, 0

    def _note(self, known, word, ids):
        """Remember a short word."""
        if len(word) <= _LONG:
            if self.held > _MEMORY_BYTES:
                self.forget()
            known[word] = ids
            self.held += _ENTRY_BYTES + 4 * len(word) + len(ids)

    def encode(self, text):
        """Ids by the tokenizer itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run):
        """Ids of a run of lower-case letters, which is one word to the tokenizer."""
        ids = self.runs.get(run)
        if ids is None:
            word = run.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes()
            self._note(self.runs, run, ids)
        return ids

    def __missing__(self, word):
        plain = _PLAIN.match(word)
        if plain is None:
            ids = self.encode(word)
        elif plain[2]:
            ids = self._run(plain[1].lower()) + self[plain[2]]
        else:
            ids = self._run(word.lower())
        self._note(self, word, ids)
        return ids

    def ids(self, text):
        """Ids of a whole text (None: of an empty one), as bytes."""
        if not text:
            return b""
        if not self.by_word:
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_encoders = {}


def encoder(path):
    """The worker's encoder of a tokenizer file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
