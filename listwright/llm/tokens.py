"""Token ids of whole texts by the tokenizers library, one pre-token at a time.

Both vocabularies cut a text into pre-tokens before merging, and a pre-token begins at every single blank between other
signs. So a text is split there, and the ids of a part are made once while they are remembered: a text then costs a split
and a join. Many texts at once are split by Arrow, and only their different parts are looked up. Parts of Latin signs are cut by the vocabulary's own pattern, written for Python's `re`, and merged by the
tokenizer's model; the whole tokenizer encodes other parts, and any text that holds a special token's string."""

from __future__ import annotations

import gc
import os
import re
import string
from functools import cache
from itertools import chain
from operator import attrgetter
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of remembered parts of a generation (there are two), the longest part that is remembered, and what an entry needs
#: besides its signs and ids.
KEPT_BYTES, KEPT_LENGTH, ENTRY = 44 << 20, 48, 140
IDS = np.dtype("<u2")
#: The last sign whose class Python, `re` and all versions of the patterns agree on for certain.
LATIN = 0x24F


def _signs(of) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN + 1) if of(chr(c)))


# Signs of the patterns' classes up to LATIN.
_LETTERS, _NUMBERS, _SPACES = _signs(str.isalpha), _signs(lambda c: c.isalnum() and not c.isalpha()), _signs(str.isspace)
_ENDS = frozenset("0123456789") | {c for c in map(chr, range(LATIN + 1)) if c.isalpha()}
_OTHERS = _signs(lambda c: not c.isalnum() and not c.isspace())
# The patterns of pre-tokens of the two kinds of vocabulary.
_CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"
PATTERN_BYTES = rf"{_CLITICS}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[{_OTHERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
PATTERN_WORDS = rf"{_CLITICS}|[{_LETTERS}]+|[{_NUMBERS}]|[{_OTHERS}]+"
#: Signs beyond LATIN; 1C to 1F, which Python takes for white space and the vocabularies don't; and a letter whose lower
#: case has a sign beyond LATIN.
_ODD = re.compile(f"[\x1c-\x1fİ{chr(LATIN + 1)}-\U0010ffff]").search
_PYTHON_SPACE = re.compile("[\x1c-\x1f]").search
#: A blank between other signs.
_CUT = re.compile(r"(?<=\S) (?=\S)").split
_ID, _BLANK = attrgetter("id"), chr(256 + 32)
#: What marks a comma or full stop that ended a word.
STOP = "\x02"
_PACK = [Struct(f"<{n}H").pack for n in range(256)]


@cache
def _byte_signs() -> dict[int, int]:
    """The sign that stands for a byte in a vocabulary's words, where it is another: from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


def _is_stop(part: str) -> bool:
    return part[:1] == STOP


def _ended(part: str) -> bool:
    """Whether a pre-token ends for certain between this part and a comma or full stop."""
    return part[-1:] in _ENDS


class _Loose(Exception):
    """A blank beside other white space: no pre-token begins there."""


class _Kept(dict):
    """Ids by part, in two generations of bounded bytes: when the young one is full it becomes the old one, and what recurs
    comes back."""

    def __init__(self, make):
        self.make, self.old, self.size = make, {}, 0

    def __missing__(self, part: str) -> bytes:
        got = self.old.get(part)
        if got is None:
            got = self.make(part)
        if len(part) <= KEPT_LENGTH:
            self.keep([part], [got], ENTRY + 2 * len(part) + len(got))
        return got

    def keep(self, parts: list[str], ids: list[bytes], size: int) -> None:
        self.size += size
        if self.size > KEPT_BYTES:
            self.old, self.size = dict(self), 0
            self.clear()
        self.update(zip(parts, ids, strict=True))


class Encoder:
    """ids(text): the ids, as bytes of little-endian 16-bit numbers, that one tokenizer file gives without special tokens
    around them. A special token's string inside a text has that token's id, as the library has it, unless
    special_as_text."""

    def __init__(self, file: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = special_as_text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of 16 bits only")
        self.model = self.tokenizer.model
        self.merged, self.signs = self.model.tokenize, _byte_signs()
        self.lowers = self.tokenizer.normalizer is not None
        self.blank = "" if self.lowers else " "
        self.specials = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = re.compile(PATTERN_WORDS if self.lowers else PATTERN_BYTES).findall
        self.parts, self.marks = _Kept(self.part), _Kept(self.token)
        self.pieces = _Kept(None)  # of rows(), whose parts stand for more
        self.line_end = b"" if self.lowers else self.token("\n")

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.specials) or (self.lowers and _PYTHON_SPACE(text)):
            return self.plain(text)
        if self.lowers:
            return b"".join(map(self.parts.__getitem__, text.split()))
        first, *rest = text.split(" ")
        try:
            if rest and not first[-1:].strip():
                raise _Loose
            return self.free(first) + b"".join(map(self.parts.__getitem__, rest))
        except _Loose:
            first, *rest = _CUT(text)
            return self.free(first) + b"".join([self.plain(" " + x) if x[-1].isspace() else self.parts[x] for x in rest])

    def rows(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): the ids of all texts, each with the end id behind them, and where they begin and end; a null text
        has none but the end id.

        Texts are cut at blanks, before line ends, and before a comma or full stop at the end of a word, which then follows
        STOP. A first part gets a line end, too: the end id of the text before takes the place of its id. A text that these
        cuts may not fit is encoded by itself."""
        texts = texts.fill_null("")
        alone = np.full(len(texts), self.lowers)
        for s in (*self.specials, STOP):
            alone |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        lines = pc.replace_substring(pa.array([""] * len(texts), pa.string()) if self.lowers else texts, "\n", " \n")
        for s in ", ", ". ":
            lines = pc.replace_substring(lines, s, f" {STOP}{s}")
        cut = pc.split_pattern(pc.binary_join_element_wise("\n", lines, ""), " ")
        first, parts = cut.offsets.to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
        which, parts = parts.indices.to_numpy().astype(np.int64), parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        made = self.found(parts)
        n = len(made)
        stop, ended = (np.fromiter(map(f, parts), bool, n)[which] for f in (_is_stop, _ended))
        wrong = np.fromiter((x is None for x in made), bool, n)[which]
        wrong[1:] |= stop[1:] & ~ended[:-1]
        if len(texts):
            alone |= np.logical_or.reduceat(wrong, first[:-1])
        at = np.flatnonzero(alone)
        if len(at):
            made = [x or b"" for x in made] + [b"\0\0" + self.ids(t) for t in texts.take(pa.array(at)).to_pylist()]
            which[first[at]] = n + np.arange(len(at))
            taken = np.repeat(~alone, np.diff(first))
            taken[first[at]] = True
            which, first = which[taken], np.concatenate(([0], np.cumsum(np.where(alone, 1, np.diff(first)))))
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 2
        starts, flat, long = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(made), IDS), sizes[which]
        ends = np.concatenate(([0], np.cumsum(long)))
        bounds, ids = ends[first], flat[np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], long)]
        ids = np.concatenate((ids[1:], ids[:1]))
        ids[bounds[1:] - 1] = end
        return bounds, ids

    def found(self, parts: list[str]) -> list[bytes | None]:
        """The ids of different parts of rows(): behind a blank, or with the line end that they begin with, or behind STOP.
        None: other white space is at an end. Words, and words before signs, that are not remembered are merged together."""
        known, old = self.pieces, self.pieces.old
        got = list(map(known.get, parts))
        kept, ascii_words, other_words = [], [], []
        for i in [i for i, x in enumerate(got) if x is None]:
            part = word = parts[i]
            if (ids := old.get(part)) is not None:
                got[i] = ids
                kept.append(i)
                continue
            if not word.isalpha():
                word = part.rstrip(string.punctuation)
            if len(part) <= KEPT_LENGTH and (word.isalpha() or word[:1] == "\n" and word[1:].isalpha()):
                if word.isascii():
                    ascii_words.append((i, word))
                    continue
                if not _ODD(word):
                    other_words.append((i, word))
                    continue
            try:
                if part[:1] == STOP:
                    got[i] = self.marks[part[1:]]
                elif part[:1] != "\n":
                    got[i] = self.part(part)
                elif part[1:] and not part[1].isspace() and not part[-1].isspace():
                    got[i] = self.line_end + self.free(part[1:])
            except _Loose:
                continue
            if got[i] is not None and len(part) <= KEPT_LENGTH:
                kept.append(i)
        if words := ascii_words + other_words:
            lines = [w[1:] if w[0] == "\n" else _BLANK + w for _, w in ascii_words]
            if other_words:
                line = "\n".join([w[1:] if w[0] == "\n" else " " + w for _, w in other_words])
                lines += line.encode().decode("latin-1").translate(self.signs).split(chr(self.signs[10]))
            merged = list(map(self.merged, lines))
            data, at = np.fromiter(map(_ID, chain.from_iterable(merged)), IDS).tobytes(), 0
            for (i, word), ids in zip(words, merged, strict=True):
                part, end = parts[i], at + 2 * len(ids)
                x = data[at:end]
                if word[0] == "\n":
                    x = self.line_end + x
                if len(word) < len(part):
                    x += self.marks[part[len(word) :]]
                got[i], at = x, end
            kept += [i for i, _ in words]
        of, ids = [parts[i] for i in kept], [got[i] for i in kept]
        known.keep(of, ids, len(of) * ENTRY + 2 * sum(map(len, of)) + sum(map(len, ids)))
        return got

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, IDS).tobytes()

    def free(self, text: str) -> bytes:
        """The ids of a text that stands at the beginning."""
        return self.plain(text) if _ODD(text) else b"".join(map(self.marks.__getitem__, self.find(text)))

    def part(self, part: str) -> bytes:
        """The ids of a part behind a blank. Parts that begin with the same word share its ids."""
        plain = part.isascii() or not _ODD(part)
        if plain and part.isalpha():
            return self.token(self.blank + (part.lower() if self.lowers else part))
        if not self.lowers and (not part or part[0].isspace() or part[-1].isspace()):
            raise _Loose
        if not plain or _PYTHON_SPACE(part):
            return self.plain(self.blank + part)
        if part[:-1].isalpha():
            return self.parts[part[:-1]] + self.marks[part[-1]]
        first, *rest = self.find(self.blank + (part.lower() if self.lowers else part))
        word = first[1:] if self.blank else first
        lead = self.parts[word] if rest and word.isalpha() else self.token(first)
        return lead + b"".join(map(self.marks.__getitem__, rest))

    def token(self, token: str) -> bytes:
        """The ids of a pre-token by the model alone."""
        if token.isascii() and token.isprintable():
            line = token.replace(" ", _BLANK)
        else:
            line = token.encode().decode("latin-1").translate(self.signs)
        ids = tuple(map(_ID, self.merged(line)))
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, IDS).tobytes()


@cache
def encoder(file: str) -> Encoder:
    """One encoder a process: what it remembers serves all tasks of a worker. Its many short-lived objects are in no
    cycles, so the search for cycles is made rarer."""
    gc.set_threshold(200_000)
    return Encoder(file)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
