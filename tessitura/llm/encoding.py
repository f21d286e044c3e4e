"""Token ids word by word: what the tokenizers library gives for whole texts, with words met before from a cache.

A pre-tokeniser cuts a text into words that no token crosses. For text below U+0100, where the classes of its pattern
are short lists, the pattern runs here; the model encodes each word once. Other text, and text that holds an added
token, which is taken out before the pattern applies, goes through the library itself.
"""

from __future__ import annotations

import re
from struct import pack

import numpy as np

CACHE_BYTES = 320 << 20
#: About what a cached word costs beside its letters and ids.
ENTRY_BYTES = 200
SPACE_MARK = "Ġ"  # the byte-level alphabet's letter for a space
BEYOND_LATIN = re.compile("[^\x00-\xff]")
# Letters, numbers and white space below U+0100.
LETTERS, NUMBERS, WHITE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \t\n\r\x0b\x0c\x85\xa0"


class WordIds(dict):
    """Word of a text below U+0100 -> little-endian ids, of `limit` bytes at most: when it holds half of that, its words become the old ones,
    which are dropped the next time unless they are met again.

    `pattern` finds the words of text below U+0100; `lower` says that the vocabulary drops case.
    """

    def __init__(self, path: str, end_id: int, pattern: re.Pattern, lower: bool = False, limit: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.end = np.array([end_id], self.kind).tobytes()
        self.pattern, self.lower, self.limit, self.used, self.old = pattern, lower, limit, 0, {}

    def __missing__(self, word: str) -> bytes:
        if self.used > self.limit // 2:
            self.old, self.used = dict(self), 0
            self.clear()
        ids = self.old.pop(word, None)
        if ids is None:
            plain = word.isascii() and word.isprintable()
            letters = word.replace(" ", SPACE_MARK) if plain else self.bytes.pre_tokenize_str(word)[0][0]
            found = [t.id for t in self.tokenizer.model.tokenize(letters)]
            ids = pack(f"<{len(found)}{self.code}", *found)
        if len(word) < 256:
            self[word] = ids
            self.used += len(word) + len(ids) + ENTRY_BYTES
        return ids

    def whole(self, text: str) -> bytes:
        """The ids of a text or a piece of one by the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def latin(self, text: str) -> bool:
        """Whether `cut` finds the text's words."""
        return not BEYOND_LATIN.search(text) and not any(token in text for token in self.added)

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text.lower() if self.lower else text)

    def ids_of(self, text: str) -> bytes:
        """The ids of a text for which `latin` holds."""
        return b"".join(map(self.__getitem__, self.cut(text)))
