"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string.  Successive prefixes of the turns
are rendered; where each rendering begins with the one before, what was added is the last
turn's span.  A template that changes what it had rendered before rewrites history: its spans
can't be told from prefixes, and that is reported.

Every prefix is rendered, however many turns there are, as a template may rewrite history at any
of them: the work grows with the square of a conversation's turns.

Defined results: null texts and roles are empty; turns are ordered by turn, then role and text
(nulls first), so ties have one order and repeated rows are turns of their own; rows without a
conversation id are one conversation; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches

Turn = tuple[str, str]
#: Turns whose escaped form the default template keeps, and their longest text.
KEPT, KEPT_CHARS = 2048, 4096


class HistoryRewritten(ValueError):
    """A template's rendering of more turns doesn't begin with its rendering of fewer."""


def render(turns: list[Turn]) -> str:
    """The default template. Control strings hold # or <, which texts only have behind a backslash."""
    return "".join([_kept_turn(role, text) if len(text) <= KEPT_CHARS else _turn(role, text) for role, text in turns])


def _turn(role: str, text: str) -> str:
    return f"### {escape(role, _ROLE)}: {escape(text)}</turn>\n"


_kept_turn = lru_cache(maxsize=KEPT)(_turn)
_TEXT = str.maketrans({c: "\\" + c for c in "\\#<"})
_ROLE = str.maketrans({c: "\\" + c for c in "\\#<:"})


def escape(text: str, table: dict = _TEXT) -> str:
    return text.translate(table)


def unescape(text: str) -> str:
    parts = text.split("\\")
    out, k = [parts[0]], 1
    while k < len(parts):
        if not parts[k] and k + 1 < len(parts):  # an escaped backslash
            out += ["\\", parts[k + 1]]
            k += 2
        else:
            out.append(parts[k])
            k += 1
    return "".join(out)


def locate(turns: list[Turn], template: Callable[[list[Turn]], str] = render) -> tuple[str, list[tuple[int, int]]]:
    """(rendering, span of each turn in it), from the renderings of all prefixes."""
    before, spans = template([]), []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(before):
            raise HistoryRewritten(f"turn {k} changes the rendering of the turns before it")
        spans.append((len(before), len(now)))
        before = now
    return before, spans


def parse_turn(rendered: str) -> tuple[str, int, int]:
    """(role, start, end of the text's span) of one turn of the default template."""
    at = 4
    while rendered[at] != ":":
        at += 2 if rendered[at] == "\\" else 1
    return unescape(rendered[4:at]), at + 2, len(rendered) - len("</turn>\n")


def digest(turns: list[Turn]) -> tuple[int, str, int, str, int, str]:
    """What is read back from the formatted conversation, and the conversation itself."""
    formatted, spans = locate(turns)
    all_turns, loss, loss_chars = hashlib.sha256(), hashlib.sha256(), 0
    for start, end in spans:
        piece = formatted[start:end]
        role, a, b = parse_turn(piece)
        text = unescape(piece[a:b])
        all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role == "assistant":
            loss.update(text.encode("utf-8", "surrogatepass"))
            loss_chars += len(text)
    return len(spans), all_turns.hexdigest(), loss_chars, loss.hexdigest(), len(formatted), formatted


def format_conversations(conversations: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per conversation: digests of what its formatted text holds and, if asked, the text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns, done, empty = None, [], [], True

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted"]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays[: 6 + keep_text], names[: 6 + keep_text])

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not empty and conv_id != current:
                    done.append((current, *digest(turns)))
                    turns = []
                current, empty = conv_id, False
                turns.append((role, text))
                if len(done) >= 500:
                    yield out()
        if not empty:
            done.append((current, *digest(turns)))
            yield out()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long" + (", formatted string" if keep_text else "")
    return map_batches(dealt, run, schema)
