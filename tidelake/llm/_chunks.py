"""Tokenizer ids of texts by way of their chunks, each distinct chunk encoded once by the library.

Both kinds of tokenizers here split a text into words before anything else, and no word crosses
certain blanks; so the ids of a text are its chunks' ids in order, where a text is cut

* at ASCII white space, for a tokenizer that drops white space, or
* before each single blank that a non-blank follows, for a byte-level one that keeps it (a blank
  belongs to the word after it; a run of blanks up to the last one is a word of its own).

Texts that hold a special token's string are encoded as a whole.  ``tests/llm`` compares chunks with
whole texts.  A worker keeps its latest chunks over tasks, up to a fixed number.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

#: Chunks that a worker remembers, twice.
REMEMBERED = 800_000

_tokenizers: dict[str, object] = {}
_memos: dict[tuple[str, str], _Memo] = {}
_CUT = re.compile(r" (?=\S)")
_RUN = re.compile(r" \s")


def load(path: str):
    """The tokenizer of a .json file, kept for the worker's life."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class _Memo:
    """Values of chunks.  ``young`` answers; what it lacks is taken from ``old`` or computed.  Once
    young is full it becomes old, so chunks that keep coming are kept."""

    def __init__(self, values: Callable[[list], list]):
        self.young: dict = {}
        self.old: dict = {}
        self.values = values

    def of(self, chunks: list) -> list:
        """The chunks' values in order."""
        out = list(map(self.young.get, chunks))
        if None not in out:
            return out
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        at = [i for i, v in enumerate(out) if v is None]
        missing = {chunks[i] for i in at}
        if old:
            young.update([(c, old[c]) for c in missing if c in old])
            missing = [c for c in missing if c not in young]
        else:
            missing = list(missing)
        young.update(zip(missing, self.values(missing), strict=True))
        for i in at:
            out[i] = young[chunks[i]]
        return out


def counter(path: str) -> Callable[[bytes], int]:
    """A function from a UTF-8 text to its number of ids; for tokenizers that drop white
    space, lower the case and split into words, digits and signs."""
    tokenizer = load(path)
    model, words = tokenizer.model, re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+").findall
    plain = re.compile(rb"[!-~]+").fullmatch
    special = re.compile("|".join(map(re.escape, _specials(tokenizer))).encode() or rb"(?!)").search

    def counts(chunks: list[bytes]) -> list[int]:
        out = []
        for c in chunks:
            if plain(c) and not special(c):
                out.append(sum([len(model.tokenize(w.decode())) for w in words(c.lower())]))
            else:
                out.append(len(tokenizer.encode(c.decode("utf-8", "replace"), add_special_tokens=False).ids))
        return out

    memo = _memos.setdefault((path, "counts"), _Memo(counts))
    return lambda text: sum(memo.of(text.split()))


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str) -> Callable[[bytes], bytes]:
    """A function from a UTF-8 text to its ids as little-endian unsigned 32-bit integers; for
    byte-level tokenizers with the usual pattern of words."""
    import public_tokenizers
    import regex

    tokenizer = load(path)
    special = re.compile("|".join(map(re.escape, _specials(tokenizer))) or r"(?!)")
    words, model, table = regex.compile(public_tokenizers.PATTERN).findall, tokenizer.model, _byte_letters()
    blank, plain = table[32], re.compile("[\0-\u024f]*").fullmatch  # where any version of Unicode has the same letters

    def ids_of_chunks(chunks: list[str]) -> list[bytes]:
        """Ids of chunks without their blank; a first chunk, that has none, is marked by a zero."""
        out = []
        for c in chunks:
            if c.isalpha() and c.isascii():  # one word
                out.append(_packed([t.id for t in model.tokenize(blank + c)]))
                continue
            c = c[1:] if c[:1] == "\0" else " " + c
            if plain(c):
                out.append(_packed([t.id for w in words(c) for t in model.tokenize(w.encode().decode("latin-1").translate(table))]))
            else:
                out.append(_packed(tokenizer.encode(c, add_special_tokens=False).ids))
        return out

    memo = _memos.setdefault((path, "ids"), _Memo(ids_of_chunks))

    def ids(data: bytes) -> bytes:
        text = data.decode("utf-8", "replace")
        if "\0" in text or special.search(text):
            return _packed(tokenizer.encode(text, add_special_tokens=False).ids)
        # where every blank is single and a word follows, the quicker way to cut
        chunks = _CUT.split(text) if text.endswith(" ") or _RUN.search(text) else text.split(" ")
        chunks[0] = "\0" + chunks[0]
        return b"".join(memo.of(chunks))

    return ids


def _byte_letters() -> dict[int, str]:
    """A byte-level vocabulary's letter of each byte: printable bytes stand for themselves, the
    others follow from 256 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
