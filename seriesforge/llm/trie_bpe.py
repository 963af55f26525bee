"""BPE encoding by prefix-sharing trie traversal.

For a prefix of a word exactly one token can come last: the one whose predecessor, the last
token of the shorter prefix before it, forms a stable pair with it.  These last-token states
depend on the prefix alone, so distinct words are put into a trie and a depth-first walk
computes each shared prefix's state once.  Sorted words are the trie's leaves in depth-first
order and their common prefix lengths its branching depths, which is how the trie is held.

Defined results: a null text is an empty one; an empty text has no tokens; special strings
inside a text become their own ids; repeated rows each get their own row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches, portions
from .vocabulary import WordBpe, load_word_bpe, uncollected

#: What a worker keeps of what it has encoded: chunks, their letters and their tokens; beyond any of these
#: only chunks of the text at hand stay.
KEPT, KEPT_LETTERS, KEPT_TOKENS = 300_000, 6_000_000, 3_000_000
#: Pieces kept; beyond it the older half goes.
KEPT_PIECES = 200_000
#: Longer pieces aren't kept.
PIECE_LETTERS = 64
#: Characters of text that are encoded together, unless one text has more.
TOGETHER = 2_000_000


def walk_trie(words: Iterable[str], bpe: WordBpe) -> Iterator[tuple[str, list[int]]]:
    """Each distinct word with its token ids, depth first. Words are in byte letters, without suffix."""
    lengths = bpe.lengths
    previous = ""
    path = [bpe.root]  # path[d], last[d]: the suffix state and the last token of the first d characters
    last = [-1]
    for word in sorted(set(words)):
        shared, size = 0, len(word)
        most = min(len(previous), size - 1)
        while shared < most and previous[shared] == word[shared]:
            shared += 1
        del path[shared + 1 :], last[shared + 1 :]
        at = path[-1]
        for end in range(shared + 1, size):
            letter = word[end - 1]
            at = at.next.get(letter) or bpe.advance(at, letter)
            path.append(at)
            last.append(last_token(at.ends, end, last, bpe))
        at, letter = path[-1], word[-1]
        tokens = [last_token(at.closing.get(letter) or bpe.close(at, letter), size, last, bpe)]
        left = size - lengths[tokens[0]]
        while left:
            tokens.append(last[left])
            left -= lengths[last[left]]
        tokens.reverse()
        yield word, tokens
        previous = word[:-1]


def last_token(ends: tuple[tuple[int, int], ...], end: int, last: list[int], bpe: WordBpe) -> int:
    """Of the tokens that end here, the one that is stable after the last token before it."""
    known = bpe.known_pairs
    for size, token in ends:
        if size < end:
            left = last[end - size]
            ok = known.get(left << 20 | token)
            if bpe.pair_ok(left, token) if ok is None else ok:
                return token
        elif bpe.whole(token):
            return token
    raise ValueError("the vocabulary lacks a single byte")


class Spelling:
    """The bytes of each token's spelling with a space after it, for many tokens at a time."""

    def __init__(self, spellings: list[str]):
        raw = [(x + " ").encode() for x in spellings]
        self.sizes = np.array([len(x) for x in raw], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def spell(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The joined spellings of ids[bounds[k]:bounds[k + 1]] for each k."""
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        out = self.data[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[bounds].tolist()
        return [out[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]


class TrieEncoder:
    """Encodes texts chunk by chunk; chunks and pieces seen before are looked up."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.decimal = Spelling([str(k) for k in range(len(bpe.names))])
        self.plain = Spelling(bpe.names)
        self.known_pieces: dict[str, list[int]] = {}
        #: Each chunk's row; a row's token ids are ids[starts[row] : starts[row + 1]].
        self.known: dict[str, int] = {}
        self.letters = 0
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int32)
        for name, token in self.bpe.special.items():
            self._add([name], [token], [1])

    def _add(self, chunks: list[str], ids: list[int], sizes: list[int]) -> None:
        first = len(self.known)
        self.known.update(zip(chunks, range(first, first + len(chunks))))
        self.letters += sum(map(len, chunks))
        self.ids = np.concatenate((self.ids, np.array(ids, dtype=np.int32)))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.array(sizes, dtype=np.int64))))

    def _keep(self, chunks: set[str]) -> None:
        """Of the known chunks only these stay, with the special strings."""
        kept = [c for c in self.known if c in chunks or c in self.bpe.special]
        rows = np.array([self.known[c] for c in kept], dtype=np.int64)
        self.ids, sizes = self._tokens(rows)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.known = dict(zip(kept, range(len(kept))))
        self.letters = sum(map(len, kept))

    def _tokens(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of the rows one after the other, how many each has)."""
        starts = self.starts[rows]
        counts = self.starts[rows + 1] - starts
        ends = np.cumsum(counts)
        return self.ids[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], counts

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The chunks' rows. Those not known yet are encoded, all their pieces in one walk."""
        found = list(map(self.known.get, chunks))
        new = {c for c, row in zip(chunks, found) if row is None}
        if new:
            if len(self.known) + len(new) > KEPT or self.letters > KEPT_LETTERS or len(self.ids) > KEPT_TOKENS:
                self._keep(set(chunks))
            pieces_of, fresh = self.known_pieces, {}
            if len(pieces_of) > KEPT_PIECES:
                for piece in list(islice(pieces_of, len(pieces_of) // 2)):
                    del pieces_of[piece]
            pieces = [(c, self.bpe.pieces(c)) for c in new]
            for piece, tokens in walk_trie({p for _, ps in pieces for p in ps if p not in pieces_of}, self.bpe):
                (pieces_of if len(piece) <= PIECE_LETTERS else fresh)[piece] = tokens
            of = lambda p: pieces_of[p] if len(p) <= PIECE_LETTERS else fresh[p]
            tokens = [of(ps[0]) if len(ps) == 1 else [t for p in ps for t in of(p)] for _, ps in pieces]
            self._add([c for c, _ in pieces], [t for ts in tokens for t in ts], [len(ts) for ts in tokens])
            found = list(map(self.known.__getitem__, chunks))
        return np.array(found, dtype=np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes, np.ndarray]]:
        """(tokens, ids joined by a space, decoded text, ids) of each text."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= TOGETHER):
                size += len(texts[upto])
                upto += 1
            yield from self._encode(texts[at:upto])
            at = upto

    def _encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes, np.ndarray]]:
        bpe, bounds, chunks = self.bpe, [0], []
        for text in texts:
            for section in bpe.sections(text):
                if section in bpe.special:
                    chunks.append(section)
                else:
                    chunks += bpe.chunks(section)
            bounds.append(len(chunks))
        parts = [np.empty(0, dtype=np.int32)]
        sizes = [np.zeros(1, dtype=np.int64)]
        self.bpe.trim()
        with uncollected():
            for at in range(0, len(chunks), 1 << 18):
                ids, counts = self._tokens(self.rows(chunks[at : at + (1 << 18)]))
                parts.append(ids)
                sizes.append(counts)
        ids = np.concatenate(parts)
        cuts = np.cumsum(np.concatenate(sizes))[bounds]
        ends = cuts.tolist()
        for k, (decimal, plain) in enumerate(zip(self.decimal.spell(ids, cuts), self.plain.spell(ids, cuts))):
            yield ends[k + 1] - ends[k], decimal, plain, ids[ends[k] : ends[k + 1]]


def decode(ids: list[int], bpe: WordBpe) -> str:
    """The text of ids: without a decoder of its own, a vocabulary's tokens are joined by a space."""
    return " ".join(bpe.names[i] for i in ids)


_ENCODERS: dict[str, TrieEncoder] = {}


def _encoder(path: str) -> TrieEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(load_word_bpe(path))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked, token_ids."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            for part in portions(batch, 512):
                counts, digests, decoded, all_ids = [], [], [], []
                for count, ids, words, numbers in encoder.encode([t or "" for t in part.column("text").to_pylist()]):
                    counts.append(count)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(words).hexdigest())
                    if keep_ids:
                        all_ids.append(numbers)
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if keep_ids else "")
    return map_batches(source, run, schema)
