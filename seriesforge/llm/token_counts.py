"""Token counts by a finite-state transducer compiled from the vocabulary.

A state holds what later characters can still change: the longest suffix of the word so far
that begins some token, the last tokens at its positions and their counts relative to the
newest one.  Each transition is annotated with the (signed) number of tokens it emits.  States
are compiled when first reached and are the same for all words that agree on them.

A text is cut into chunks, each with a state map: from the state before the chunk to the state
after it and the tokens emitted between.  White space ends words, so chunks of whole words have
the start state on both sides and a count.  A word too long for one chunk is cut anywhere; the map
of such a part is worked out for the state that the letters just before it lead to, and for
another state only until it meets the first one's path, from where the rest is the same.  Maps
compose associatively and are combined by a scan in pairs.

Defined results: a null text is an empty one with no tokens; special strings inside a text
count as one token each; repeated rows each get their own row; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches, portions
from .vocabulary import Suffix, WordBpe, load_word_bpe, uncollected

#: Chunks, pieces and states that a worker keeps, and the longest of them.
KEPT, KEPT_LETTERS = 200_000, 64
#: Words of a chunk.
WORDS = 1 << 16
#: Letters of a chunk that is part of a long word; letters before it that are read to guess its state; letters
#: from one place to the next where paths are compared.
PART, BEFORE, STEP = 1 << 14, 256, 64


class State:
    __slots__ = ("suffix", "lasts", "counts", "inner", "final")

    def __init__(self, suffix: Suffix, lasts: tuple[int, ...], counts: tuple[int, ...]):
        self.suffix, self.lasts, self.counts = suffix, lasts, counts
        self.inner: dict[str, tuple[State, int]] = {}
        self.final: dict[str, int] = {}


class CountTransducer:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.reset()

    def reset(self) -> None:
        self.start = State(self.bpe.root, (-1,), (0,))
        self.states = {(self.bpe.root, (-1,), (0,)): self.start}

    def _last(self, state: State, ends: tuple[tuple[int, int], ...]) -> tuple[int, int]:
        bpe, lasts = self.bpe, state.lasts
        for size, token in ends:
            left = lasts[-size]
            if bpe.whole(token) if left < 0 else bpe.pair_ok(left, token):
                return token, state.counts[-size] + 1
        raise ValueError("the vocabulary lacks a single byte")

    def step(self, state: State, letter: str) -> tuple[State, int]:
        """Compiles the transition by a letter inside a word."""
        suffix = state.suffix.next.get(letter) or self.bpe.advance(state.suffix, letter)
        token, emitted = self._last(state, suffix.ends)
        kept = len(suffix.text)  # positions before the suffix don't matter any more
        lasts = (*state.lasts[-kept:], token)
        key = (suffix, lasts, (*[c - emitted for c in state.counts[-kept:]], 0))
        if (target := self.states.get(key)) is None:
            target = self.states[key] = State(*key)
        state.inner[letter] = found = target, emitted
        return found

    def finish(self, state: State, letter: str) -> int:
        """Compiles the transition by a word's last letter."""
        ends = state.suffix.closing.get(letter) or self.bpe.close(state.suffix, letter)
        emitted = state.final[letter] = self._last(state, ends)[1]
        return emitted

    def walk(self, state: State, letters: str) -> tuple[State, int]:
        """State map of letters inside a word, at one state."""
        total = 0
        for letter in letters:
            if (found := state.inner.get(letter)) is None:
                found = self.step(state, letter)
            state = found[0]
            total += found[1]
        return state, total

    def end(self, state: State, letter: str) -> int:
        """Tokens that a word's last letter emits."""
        if (emitted := state.final.get(letter)) is None:
            emitted = self.finish(state, letter)
        return emitted

    def count(self, piece: str) -> int:
        """Tokens of a piece in byte letters."""
        state, total = self.walk(self.start, piece[:-1])
        return total + self.end(state, piece[-1])


class Words:
    """The state map of whole words: from start to start."""

    def __init__(self, start: State, tokens: int):
        self.start, self.tokens = start, tokens

    def at(self, state: State) -> tuple[State, int]:
        if state is not self.start:
            raise ValueError("words begin in the start state")
        return state, self.tokens


class Part:
    """The state map of a part of a long word, known along the path of one state before it."""

    def __init__(self, transducer: CountTransducer, before: str, letters: str, last: bool):
        self.transducer, self.letters, self.last = transducer, letters[: len(letters) - last], letters[-1] if last else ""
        state, total = transducer.walk(transducer.start, before)[0], 0
        self.path = [(state, 0)]  # the state and the tokens so far after each STEP letters
        for k in range(0, len(self.letters), STEP):
            state, more = transducer.walk(state, self.letters[k : k + STEP])
            total += more
            self.path.append((state, total))

    def at(self, state: State) -> tuple[State, int]:
        total, k = 0, 0
        while k < len(self.path) - 1 and state is not self.path[k][0]:
            state, more = self.transducer.walk(state, self.letters[k * STEP : (k + 1) * STEP])
            total += more
            k += 1
        if state is self.path[k][0]:
            state, total = self.path[-1][0], total + self.path[-1][1] - self.path[k][1]
        return (self.transducer.start, total + self.transducer.end(state, self.last)) if self.last else (state, total)


class Composed:
    """The state map of two chunks that follow each other."""

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.known: dict[State, tuple[State, int]] = {}

    def at(self, state: State) -> tuple[State, int]:
        if (found := self.known.get(state)) is None:
            between, tokens = self.left.at(state)
            after, more = self.right.at(between)
            found = self.known[state] = after, tokens + more
        return found


class TokenCounter:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.transducer = CountTransducer(bpe)
        self.known: dict[str, int] = {}
        self.known_pieces: dict[str, int] = {}

    def learn(self, run: str) -> int | None:
        """Tokens of a run without white space; none if it has a piece of more than PART letters."""
        pieces, total = self.known_pieces, 0
        for piece in self.bpe.pieces(run):
            if len(piece) > PART:
                return None
            if (count := pieces.get(piece)) is None:
                count = self.transducer.count(piece)
                if len(piece) <= KEPT_LETTERS:
                    pieces[piece] = count
            total += count
        if len(run) <= KEPT_LETTERS:
            self.known[run] = total
        return total

    def trim(self) -> None:
        if len(self.known) > KEPT:
            self.known.clear()
        if len(self.known_pieces) > KEPT:
            self.known_pieces.clear()
        if len(self.transducer.states) > KEPT:
            self.transducer.reset()
        self.bpe.trim()

    def maps(self, section: str) -> Iterator[Words | Part]:
        """The state maps of the chunks of a text without special strings."""
        known, learn, start, total = self.known.get, self.learn, self.transducer.start, 0
        for k, run in enumerate(self.bpe.chunks(section)):
            if (count := known(run)) is None and (count := learn(run)) is None:
                yield Words(start, total)
                total = 0
                for piece in self.bpe.pieces(run):
                    for at in range(0, len(piece), PART):
                        yield Part(self.transducer, piece[max(0, at - BEFORE) : at], piece[at : at + PART], at + PART >= len(piece))
            else:
                total += count
            if k % WORDS == WORDS - 1:
                yield Words(start, total)
                total = 0
        yield Words(start, total)

    def count(self, text: str) -> int:
        total = 0
        for section in self.bpe.sections(text):
            if section in self.bpe.special:
                total += 1
                continue
            maps = list(self.maps(section))
            while len(maps) > 1:
                maps = [Composed(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
            total += maps[0].at(self.transducer.start)[1]
            self.trim()
        return total


_COUNTERS: dict[str, TokenCounter] = {}


def _counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(load_word_bpe(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            for part in portions(batch, 512):
                with uncollected():
                    texts = [t or "" for t in part.column("text").to_pylist()]
                    counts = [counter.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = map_batches(source, run, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
