"""Exact byte-pair token counts of every prefix of a text, by dynamic programming.

The encoding of a prefix ends with one token; what is before that token is the encoding of a shorter prefix.
A token can follow another only if no merge joins what lies at their border before both are whole.  So the last
token of each prefix is found from those of shorter prefixes, and its count is one more: one pass of an
automaton, which names the tokens that end at each byte, gives the count of every prefix of a piece, where
encoding each of them anew would take a pass for each.

The table of a text has the counts at the ends of its pieces, from one split, and those inside a piece where a
question ends in it; how many tokens a text has and what fits a budget are both read from it.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import regex
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: How many pieces and pairs of tokens a task remembers, and the longest such piece; they only save time.
REMEMBERED, SHORT = 800_000, 64
#: Characters whose class (letter, number) differs between the Unicode versions of the regex and the tokenizer
#: library, and some next to them: texts that have any are split by the tokenizer library.
UNSURE = ("[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f-\u209f\ua7ce-\ua7f1\uab6c\uab6d"
          "\U000107bb-\U0001e6ff\U0002b73a-\U0003fc3f]")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class _Memory(dict):
    """A dictionary that fills itself and starts anew when it has grown large."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if isinstance(key, str) and len(key) > SHORT:
            return value
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


class PrefixCounter:
    """Counts tokens as a byte-level BPE vocabulary file (json) defines them, special strings included."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        self.made_of = vocabulary, pattern
        spec = json.loads(vocabulary)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a token: the two that make it, and the merge's rank
        for rank, (a, b) in enumerate(pairs):
            a, b = as_bytes(a), as_bytes(b)
            one, other = self.vocab[a], self.vocab[b]
            self.ranks[one, other] = rank
            self.parts.setdefault(self.vocab[a + b], (one, other, rank))
        self.ends = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            self.ends.add_word(token.decode("latin-1"), (i, len(token)))
        self.ends.make_automaton()
        self.borders = _Memory(self._borders)
        self.pieces, self.unsure = regex.compile(pattern), regex.compile(UNSURE)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
                                   ) if self.special else None
        self.follows = _Memory(self._follows)
        self.prefixes = _Memory(self._prefixes)
        self.whole = _Memory(lambda piece: self._prefixes(piece)[-1])

    def __reduce__(self):
        return PrefixCounter, self.made_of

    def find(self, text: str) -> list[str]:
        """The pieces of a text that are encoded apart."""
        if text.isascii() or not self.unsure.search(text):
            return self.pieces.findall(text)
        from tokenizers import pre_tokenizers

        splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]

    def encode(self, data: bytes) -> list[bytes]:
        """The tokens of a few bytes, by merging the pair of the lowest rank until there is none."""
        ranks, none = self.ranks, len(self.ranks)
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ids = [self.vocab[p] for p in parts]
            least, at = min((ranks.get(pair, none), i) for i, pair in enumerate(zip(ids, ids[1:])))
            if least == none:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _borders(self, token: int) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
        """What stands at the left and at the right end of a token while it is made, each with the rank that merges it."""
        sides = []
        for side in (0, 1):
            own, rank = [(token, float("inf"))], None
            while (parts := self.parts.get(own[-1][0])) is not None:
                rank = parts[2]
                own.append((parts[side], rank))
            sides.append(own[::-1])
        return sides[0], sides[1]

    def _follows(self, pair: int) -> bool:
        """Whether the second token stays apart from the first: no merge at their border comes before their own."""
        left, right = self.borders[pair >> 24][1], self.borders[pair & 0xFFFFFF][0]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.ranks.get((x, y))
            # Of equal merges the leftmost comes first.
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if x_until <= y_until:
                i += 1
                if i == len(left):
                    return True
            else:
                j += 1

    def _prefixes(self, piece: str) -> list[int]:
        """The count at each character of a piece, from 0 on."""
        data = piece.encode("utf-8", "surrogatepass")
        n, follows = len(data), self.follows
        last, counts = [0] * (n + 1), [0] * (n + 1)
        for at, (token, size) in self.ends.iter(data.decode("latin-1")):
            if counts[at + 1]:
                continue
            start = at + 1 - size
            if start == 0 or follows[last[start] << 24 | token]:
                last[at + 1], counts[at + 1] = token, counts[start] + 1
        if n == len(piece):
            return counts
        return [counts[0]] + [counts[i] for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]

    def table(self, text: str) -> tuple[list[str], list[int], bool]:
        """The pieces of a text, the count at the end of each, and whether special strings are among them."""
        known = self.whole.__getitem__
        if self.split is None or not any(s in text for s in self.special):
            pieces = self.find(text)
            return pieces, list(accumulate(map(known, pieces))), False
        pieces, counts = [], []
        for n, part in enumerate(self.split.split(text)):
            own = [part] if n % 2 else self.find(part)
            pieces += own
            counts += [1] if n % 2 else map(known, own)
        return pieces, list(accumulate(counts)), True

    def count(self, text: str) -> int:
        """The tokens of a whole text."""
        ends = self.table(text)[1]
        return ends[-1] if ends else 0

    def longest(self, text: str, budget: int, table: tuple[list[str], list[int], bool] | None = None) -> int:
        """The most characters at the start of a text that take `budget` tokens at most; `table` is the text's."""
        pieces, ends, special = table or self.table(text)
        begin = over = bisect_right(ends, budget)
        if over == len(pieces):
            return len(text)
        if special:
            return max(k for k, n in enumerate(self.counts(text, budget)) if n <= budget)
        # Only the piece that exceeds the budget can hold the place, or white space around it.
        while begin and (pieces[begin].isspace() or pieces[begin][0].isspace()) and pieces[begin - 1].isspace():
            begin -= 1
        while over < len(pieces) - 1 and pieces[over].isspace():
            over += 1
        before = ends[begin - 1] if begin else 0
        part = self.counts("".join(pieces[begin:over + 1]))
        return sum(map(len, pieces[:begin])) + max(k for k, n in enumerate(part) if before + n <= budget)

    def counts(self, text: str, enough: int | None = None) -> list[int]:
        """The tokens of text[:k] at each k; with `enough`, up to where all further ones are above it."""
        out, base, at = [0], 0, 0
        run_start, run_base = 0, 0  # of the white space that ends at `at`
        tail_start, tail_base = 0, 0  # of the last piece
        for n, part in enumerate(self.split.split(text) if self.split else [text]):
            if n % 2:  # a special string is ordinary text until it is complete
                out += [tail_base + self.count(text[tail_start:at + k]) for k in range(1, len(part))]
                base, at = base + 1, at + len(part)
                out.append(base)
                run_start, run_base, tail_start, tail_base = at, base, at, base
                continue
            for piece in self.find(part):
                if enough is not None and run_base > enough:
                    return out
                inner, space = self.prefixes[piece], piece.isspace()
                new = [base + c for c in inner[1:]]
                if piece in ("'re", "'ve", "'ll"):  # cut short, it is an apostrophe and a letter
                    new[1] = base + 2
                lead = len(piece) if space else int(piece[0].isspace())
                for k in range(lead):  # at the end of a text, white space is one piece
                    new[k] = run_base + self.whole[text[run_start:at + k + 1]] if run_start < at else new[k]
                if not space or run_start == at:
                    tail_start, tail_base = at, base
                out += new
                base, at = base + inner[-1], at + len(piece)
                if not space:
                    run_start, run_base = at, base
        return out
