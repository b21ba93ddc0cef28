"""Exact token counts at every prefix of a text, for a byte-level BPE vocabulary.

Merges never reach over the end of a piece (the vocabulary's own split pattern), and inside a
piece the tokens of a prefix are the tokens of a shorter prefix plus one more.  Which one is
settled by a table over prefixes: a token that ends here is the last one exactly if it and the
last token of the prefix before it are what the merges make of the two together.  So one walk
over a piece yields the counts of all its prefixes, without encoding any of them again.

Edge cases: a null or empty text has the empty table and no tokens; strings of special tokens
inside a text are one token wherever the library takes them so; rows are independent, so ties
and repeated rows need no rule, and other columns pass through untouched.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

#: What the split pattern takes as white space (fixed values of the Unicode property).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
ODD = re.compile(f"[{SPACE.replace(' ', '', 1).replace(chr(10), '')}]|[ \\n]$")
LEADING = re.compile(f"[{SPACE}]*")
UNITS_HELD = 500_000
#: A line end, letters (of blocks whose letters are settled) and marks: of such a word each part is a piece of its own.
PLAIN_WORD = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)").fullmatch


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable ones stand for themselves."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Token counts at the ends of all code-point prefixes of a text."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.step: dict[int, int] = {}  # walks tokens backwards: node * 256 + byte -> node
        self.token_at: list[int] = [-1]
        for i, b in self.bytes_of.items():
            node = 0
            for byte in reversed(b):
                key = node << 8 | byte
                node = self.step.get(key, -1)
                if node < 0:
                    node = self.step[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        ids = {b: i for i, b in self.bytes_of.items()}
        #: token -> the token one byte longer; before the first byte stands -1
        self.longer = {ids[b[:-1]] << 8 | b[-1]: i for b, i in ids.items() if b[:-1] in ids} | {-1 << 8 | b: i for b, i in self.single.items()}
        self.fits: dict[int, bool] = {}
        #: the piece walked last; the last token of each of its prefixes, where that token begins, and the prefix's count
        self.walked, self.last, self.began, self.count = b"", [-1], [0], [0]
        # fixed value: the split pattern of this kind of vocabulary
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.specials, self.held, self.after, self.known = specials, {}, {}, {}
        self.total_of, self.total_after, self.earlier, self.total_piece = {}, {}, {}, {}

    def _merged(self, tokens: list[int]) -> list[int]:
        """What the merges make of single-byte tokens."""
        while len(tokens) > 1:
            found = [(self.merge[p][0], k) for k, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in self.merge]
            if not found:
                break
            k = min(found)[1]
            tokens[k : k + 2] = [self.merge[tokens[k], tokens[k + 1]][1]]
        return tokens

    def _follows(self, left: int, right: int) -> bool:
        key = left << 20 | right
        ok = self.fits.get(key)
        if ok is None:
            both = [self.single[b] for b in self.bytes_of[left] + self.bytes_of[right]]
            ok = self.fits[key] = self._merged(both) == [left, right]
        return ok

    def _walk(self, data: bytes) -> list[int]:
        """Counts after 0, 1, … bytes of one piece, valid until the next call.

        Exactly one token ends each prefix, so the order of trials is free: first the token
        before, grown by a byte, then the tokens that end here, from the shortest on.  What
        the piece has in common with the one walked before it is not walked again.
        """
        last, began, count = self.last, self.began, self.count
        step, token_at, fits, longer = self.step, self.token_at, self.fits, self.longer
        before, common = self.walked, 0
        for mine, other in zip(data, before):  # noqa: B905  as far as the shorter one goes
            if mine != other:
                break
            common += 1
        del last[common + 1 :], began[common + 1 :], count[common + 1 :]
        self.walked = data
        token = last[common]
        for end in range(common, len(data)):
            token, start = longer.get(token << 8 | data[end], -1), began[end]
            if token < 0 or (start and not (fits.get(last[start] << 20 | token) or self._follows(last[start], token))):
                node, start = 0, end + 1
                while True:
                    start -= 1
                    node = step[node << 8 | data[start]]
                    token = token_at[node]
                    if token >= 0:
                        if not start:
                            break
                        ok = fits.get(last[start] << 20 | token)
                        if ok or (ok is None and self._follows(last[start], token)):
                            break
            last.append(token)
            began.append(start)
            count.append(count[start] + 1)
        return count

    def _steps(self, piece: str) -> bytes:
        """What each code point of one piece adds to the count (int16)."""
        made = self.known.get(piece)
        if made is None:
            data = piece.encode()
            count = self._walk(data)
            if len(data) > len(piece):  # only the ends of code points count
                count = [0, *(c for c, after in zip(count[1:], [*data[1:], 0], strict=True) if after & 0xC0 != 0x80)]
            if piece in ("'re", "'ve", "'ll"):  # cut after the first letter, it is two pieces
                count[2] = 2
            if len(self.known) >= UNITS_HELD:
                self.known.clear()
            made = self.known[piece] = array("h", map(sub, count[1:], count)).tobytes()
        return made

    def _unit(self, unit: str) -> bytes:
        """What each code point of white space and what follows it up to the next white space adds (int16)."""
        if unit[0] == " " and unit.isascii() and unit[1:].isalpha():  # one piece, a letter a byte
            count = self._walk(unit.encode())
            return array("h", map(sub, count[1:], count)).tobytes()
        blank, pieces = LEADING.match(unit).end(), self.pieces(unit)
        if blank < 2:  # cut after a single blank, it is one token, as it is before more
            return b"".join(map(self._steps, pieces))
        counts = list(accumulate(array("h", self._steps(unit[:blank]))))
        base = at = 0
        for piece in pieces:
            own, end = list(accumulate(array("h", self._steps(piece)))), at + len(piece)
            if end > blank:
                counts += [base + c for c in own[max(blank - at, 0) :]]
            base, at = base + own[-1], end
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def _new(self, unit: str) -> bytes:
        if len(self.held) >= UNITS_HELD:
            self.held.clear()
        made = self.held[unit] = self._unit(unit)
        return made

    def _after_blank(self, word: str) -> bytes:
        if len(self.after) >= UNITS_HELD:
            self.after.clear()
        made = self.after[word] = self._unit(word if word[:1] == "\n" else " " + word)
        return made

    def _total(self, unit: str) -> int:
        """What a whole unit adds."""
        if unit[0] == " " and unit.isascii() and unit[1:].isalpha():
            return self._walk(unit.encode())[-1]
        return sum([self._total_piece(piece) for piece in self.pieces(unit)])

    def _new_total(self, unit: str) -> int:
        if len(self.total_of) >= UNITS_HELD:
            self.total_of.clear()
        made = self.total_of[unit] = self._total(unit)
        return made

    def _total_piece(self, piece: str) -> int:
        """What one piece adds."""
        made = self.total_piece.get(piece)
        if made is None:
            if len(self.total_piece) >= UNITS_HELD:
                self.total_piece.clear()
            made = self.total_piece[piece] = self._walk(piece.encode())[-1]
        return made

    def _total_after_blank(self, word: str) -> int:
        """What a word adds with the blank before it; words used since the last but one clearing are still held."""
        made = self.earlier.get(word)
        if made is None:
            plain = PLAIN_WORD(word)
            if plain is None:
                made = self._total(word if word[:1] == "\n" else " " + word)
            elif plain[2] == word:
                made = self._walk(b" " + word.encode())[-1]
            else:
                end, letters, marks = plain.groups()
                if end:  # the line end stands where the blank would
                    made = self._total_piece(end) + self._total_piece(letters)
                else:
                    made = self.total_after.get(letters) or self._total_after_blank(letters)
                if marks:
                    made += self._total_piece(marks)
        if len(self.total_after) >= UNITS_HELD:
            self.earlier, self.total_after = self.total_after, {}
        self.total_after[word] = made
        return made

    def _split(self, text: str) -> tuple[list[str], list[str]]:
        """Units as they are, then words whose unit begins with the blank before them."""
        if ODD.search(text) or any(twice in text for twice in ("  ", " \n", "\n ", "\n\n")):
            return UNIT.findall(text), []
        # words one blank or one line end apart: the blank belongs to the word after it
        first, *words = text.replace("\n", " \n").split(" ")
        return [first] if first else [], words

    def _plain(self, text: str) -> np.ndarray:
        """Counts of a text without special strings."""
        get, new, after = self.held.get, self._new, self.after.get
        units, words = self._split(text)
        parts = [get(u) or new(u) for u in units]
        parts += [after(w) or self._after_blank(w) for w in words]
        return np.cumsum(np.frombuffer(b"".join(parts), np.int16), dtype=np.int32)

    def total(self, text: str | None) -> int:
        """The last of the counts (0 without text), without listing those before it."""
        return self.totals([text])[0]

    def totals(self, texts: list[str | None]) -> list[int]:
        """``total`` of each text; their new words are walked in order, so that one begins where it leaves the one before."""
        parts = [int(self.counts(t)[-1]) if t and any(s in t for s in self.specials) else self._split(t or "") for t in texts]
        words: set[str] = set()
        for part in parts:
            if not isinstance(part, int):
                words.update(part[1])
        for word in sorted(words.difference(self.total_after)):
            self._total_after_blank(word)
        get, after = self.total_of.get, self.total_after.get
        add = lambda units, words: sum([get(u) or self._new_total(u) for u in units]) + sum([after(w) or self._total_after_blank(w) for w in words])
        return [part if isinstance(part, int) else add(*part) for part in parts]

    def counts(self, text: str | None) -> np.ndarray:
        """int32 counts at the prefixes of 1, 2, … code points of ``text``."""
        if not text:
            return np.zeros(0, np.int32)
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        done, base, start, ahead = [], 0, 0, ""
        for k, part in enumerate(self.special.split(text)):
            if k % 2:  # cut short, a special string is ordinary text after what stands before it
                cut = self._plain(ahead + part)[len(ahead) :] + start
                base += 1
                cut[-1] = base
                done.append(cut)
            else:
                start, ahead = base, part
                if part:
                    done.append(self._plain(part) + base)
                    base = int(done[-1][-1])
        return np.concatenate(done).astype(np.int32)


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """``docs`` with ``out``: an array with the exact token count of each prefix of 1, 2, … code points.

    ``tokenizer`` is the path of a byte-level BPE file that every executor has.  One narrow pass;
    nothing is shuffled.
    """
    schema = T.StructType([*[f for f in docs.schema if f.name != out], T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema][:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for part in text_slices(batches, text, 1 << 20):
            tables = [counter.counts(t) for t in part.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, tables)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tables)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], [*names, out])

    return docs.mapInArrow(count, schema)


def token_totals(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with ``out``, the tokens of the whole text: the last entry of its prefix table, of which only that is made."""
    schema = T.StructType([*[f for f in docs.schema if f.name != out], T.StructField(out, T.LongType())])
    names = [f.name for f in schema][:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for part in text_slices(batches, text):
            totals = pa.array(counter.totals(part.column(text).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), totals], [*names, out])

    return docs.mapInArrow(count, schema)


def total_tokens(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.when(F.size(counts) > 0, F.element_at(counts, -1)).otherwise(0).cast("long")


def tokens_of_prefix(counts: Column, characters: Column) -> Column:
    """Tokens of the first ``characters`` code points (of the whole text, if it has fewer)."""
    at = F.least(characters, F.size(counts)).cast("int")
    return F.when(at > 0, F.element_at(counts, at)).otherwise(0).cast("long")


def longest_prefix(counts: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens (0 if there is none)."""
    fitting = F.transform(counts, lambda c, i: F.when(c <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fitting), F.lit(0)).cast("long")
