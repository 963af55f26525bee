"""Reading of a word-end BPE vocabulary and the parts of it that both tokenizer operators share.

The file's own pipeline is followed: special strings are cut out of the raw text, the rest is
composed (NFC) and lower-cased character by character, pieces never cross white space, bytes
are written as printable characters and the last one of a piece carries the word-end suffix.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import islice

import regex

#: White space that Python splits at and the tokenizer doesn't.
_PYTHON_ONLY_SPACE = re.compile("[\x1c-\x1f]")


def byte_letters() -> str:
    """The printable character that stands for each byte, by the public byte-level rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(shifted)) for b in range(256))


#: Known pairs of tokens, and compiled transitions of the automaton, that are kept.
KEPT_PAIRS, KEPT_STEPS = 200_000, 150_000


class Suffix:
    """An Aho-Corasick state: the longest suffix of a word so far that begins some token."""

    __slots__ = ("text", "ends", "next", "closing")

    def __init__(self, text: str, ends: tuple[tuple[int, int], ...]):
        self.text = text
        self.ends = ends  # (characters, id) of the tokens that end here, the longest first
        self.next: dict[str, Suffix] = {}
        self.closing: dict[str, tuple[tuple[int, int], ...]] = {}  # the same for a word's last letter


class WordBpe:
    """A vocabulary with merges whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        #: For each merged token: rank, left and right part of the merge that makes it.
        self._made = {a + b: (rank, a, b) for (a, b), rank in reversed(self.ranks.items())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {v: k for k, v in self.ids.items()} | {v: k for k, v in self.special.items()}
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.ids)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(split["pattern"]["Regex"])
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._letters = byte_letters()
        self.names = [self.texts.get(k, "") for k in range(max(self.texts) + 1)]
        #: Length in characters of each token without the suffix.
        self.lengths = [len(t.removesuffix(self.suffix)) if len(t) > len(self.suffix) else len(t) for t in self.names]
        #: Ids of tokens by their characters, apart for those inside a word and those that end one.
        self.inner = {t: k for t, k in self.ids.items() if not self._ends(t)}
        self.final = {t[: -len(self.suffix)]: k for t, k in self.ids.items() if self._ends(t)}
        self._prefixes = {t[:k] for tokens in (self.inner, self.final) for t in tokens for k in range(1, len(t) + 1)}
        self.root = Suffix("", ())
        self._suffixes = {"": self.root}
        self.steps = 0
        self.known_pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def _ends(self, token: str) -> bool:
        return len(token) > len(self.suffix) and token.endswith(self.suffix)

    def trim(self) -> None:
        """Keeps caches within their bounds; to be called while no word is being read."""
        if self.steps > KEPT_STEPS:
            self.steps = 0
            for state in self._suffixes.values():
                state.next.clear()
                state.closing.clear()
            self._suffixes = {"": self.root}
        if len(self.known_pairs) > KEPT_PAIRS:
            for key in list(islice(self.known_pairs, len(self.known_pairs) // 2)):
                del self.known_pairs[key]

    def advance(self, at: Suffix, letter: str) -> Suffix:
        """Compiles the automaton's transition by a letter inside a word."""
        text = at.text + letter
        while text not in self._prefixes:
            text = text[1:]
        if (target := self._suffixes.get(text)) is None:
            ends = tuple((len(text) - k, self.inner[text[k:]]) for k in range(len(text)) if text[k:] in self.inner)
            target = self._suffixes[text] = Suffix(text, ends)
        self.steps += 1
        at.next[letter] = target
        return target

    def close(self, at: Suffix, letter: str) -> tuple[tuple[int, int], ...]:
        """Compiles the tokens that can end a word by this letter."""
        text = at.text + letter
        self.steps += 1
        ends = at.closing[letter] = tuple((len(text) - k, self.final[text[k:]]) for k in range(len(text)) if text[k:] in self.final)
        return ends

    def sections(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as sections of their own."""
        if self._special is None or "<|" not in text:
            return [text]
        return [s for s in self._special.split(text) if s]

    def chunks(self, section: str) -> list[str]:
        """Runs without white space: no piece reaches beyond one, and composing doesn't either."""
        if _PYTHON_ONLY_SPACE.search(section):
            return regex.findall(r"[^\s]+", section)
        return section.split()

    def plain_chunks(self, text: str) -> list[str]:
        """All chunks of the text outside special strings."""
        return [c for s in self.sections(text) if s not in self.special for c in self.chunks(s)]

    def pieces(self, chunk: str) -> list[str]:
        """The chunk's pieces, in byte letters."""
        if chunk.isascii():
            chunk = chunk.lower()
            if chunk.isalpha():
                return [chunk]
            found = self._pieces.findall(chunk)
            return found if chunk.isprintable() else [p.translate(self._letters) for p in found]
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [p.encode("utf-8").decode("latin-1").translate(self._letters) for p in self._pieces.findall(chunk)]

    def merged(self, symbols: list[str]) -> list[str]:
        """The textbook procedure: merge the pair of lowest rank, leftmost first, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def whole(self, token: int) -> bool:
        """Whether the token is what its own characters encode to."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merged(self.symbols(self.names[token])) == [self.names[token]]
        return known

    def pair_ok(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their characters are encoded together."""
        key = left << 20 | right
        if (known := self.known_pairs.get(key)) is None:
            known = self.known_pairs[key] = not self._merges_across(self.names[left], self.names[right])
        return known

    def _merges_across(self, left: str, right: str) -> bool:
        """Undo both tokens' merges, the latest first, and look at what then met at the border.

        A pair at the border merges if its rank comes before the merge that was undone last;
        of two equal ranks the one further left was done first.
        """
        before = 1 << 60
        made = self._made
        while True:
            if self.ranks.get((left, right), 1 << 60) < before:
                return True
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return False
            if b is None or (a is not None and a[0] > b[0]):
                before, left = a[0], a[2]
            else:
                before, right = b[0] + 1, b[1]


@contextmanager
def uncollected() -> Iterator[None]:
    """Without garbage collection: what is made here has no cycles, and looking for some takes long."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=4)
def load_word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
