"""Token ids of whole texts by the tokenizers library, which encodes each distinct word once."""

from __future__ import annotations

import re
import struct

from sparkassay.llm.bpe_count import PIECES, byte_letters
from sparkassay.llm.worker import vocabulary_path, worker_cache

#: Half the words and pieces of words remembered by one Python worker (about 100 MB in all); what was not asked for of late is
#: dropped. It bounds memory, not the input.
MEMO_WORDS = 250_000
#: ASCII and the letters of Latin-1 and Latin Extended-A but for U+0130: Python and the library agree on their classes and
#: lower case, and none of them composes with another.
LATIN = "\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F"


def word_encoder(vocab: str, memo_words: int = MEMO_WORDS):
    """``encode(text) -> bytes``: all ids of the text as little-endian unsigned 32-bit integers, no special tokens added.

    The normaliser and pre-tokenizer of a word-end vocabulary never join or inspect characters across white space,
    so a text's ids are those of its parts between plain spaces and line feeds. A part of ``LATIN`` is lower-cased and cut as
    the vocabulary file says, and each distinct piece goes to the library's model once. A part with other characters,
    whose classes and cases are the library's own, or one that may hold a special string, goes through the library whole.
    """

    def make():
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary_path(vocab))
        model, cut, letters = tokenizer.model, regex.compile(PIECES), byte_letters()
        latin = re.compile(f"[{LATIN}]*").fullmatch

        class Memo(dict):
            def __init__(self, work, most: int):
                super().__init__()
                self.work, self.half, self.before = work, max(1, most // 2), {}

            def __missing__(self, key: str) -> bytes:
                found = self.before.get(key)
                if found is None:
                    found = self.work(key)
                # What was asked for since the last turn stays over the next one.
                if len(self) >= self.half:
                    self.before = dict(self)
                    self.clear()
                self[key] = found
                return found

        def little(ids) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        def piece(p: str) -> bytes:
            p = p if p.isascii() and p.isprintable() else "".join([letters[b] for b in p.encode("utf-8")])
            return little([t.id for t in model.tokenize(p)])

        def word(w: str) -> bytes:
            if "<" in w or not (w.isascii() or latin(w)):
                return little(tokenizer.encode(w, add_special_tokens=False).ids)
            low = w.lower()
            if w.isalpha():
                return piece(w) if low == w else words[low]
            # A piece of letters is a word as well; both are remembered once.
            return b"".join([words[p] if p.isalpha() else marks[p] for p in cut.findall(low)])

        words, marks = Memo(word, memo_words * 3 // 2), Memo(piece, memo_words // 2)
        return words

    memo = worker_cache(f"wordids:{vocab}:{memo_words}", make)

    def encode(text: str | None) -> bytes:
        return b"".join([memo[w] for w in text.replace("\n", " ").split(" ")]) if text else b""

    return encode
