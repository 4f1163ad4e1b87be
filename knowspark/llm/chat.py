"""Chat formatting by incremental black-box rendering (operator 9).

A template is any function from turns (role, text) to a string.  The successive
prefixes of a conversation are rendered; where a rendering continues the one
before it, the added part is the turn's span, where it does not, the template
has rewritten history and the turn is marked.  Inside the span the turn's text
is found by rendering the same prefix with a sentinel as its text.

Turns are streamed in order.  Prefixes are whole, as a template may rewrite at
any turn, unless the template is declared free of them (``prefix_free = True``
on the function: a turn's rendering depends on that turn only).  Then a
conversation is never held as a whole: after ``WINDOW`` turns, prefixes begin at
the last turn again.  The turn at such a point is rendered in both ways; if the
results differ, or once a turn was rewritten, prefixes stay whole nevertheless.

Defined results: a null role or text is empty; rows of equal turn number go by
role, then text; a null ``conv_id`` is one conversation, a null turn comes
first; repeated rows are turns of their own; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 64
SENTINEL = "\U000f5e17\U000f71e5"
OPEN, CLOSE = "### ", "</turn>\n"
Template = Callable[[list[tuple[str, str]]], str]


def escape(text: str, more: str = "") -> str:
    """A backslash before each backslash and each character that can begin a control string."""
    text = text.replace("\\", "\\\\")
    for c in "#<" + more:
        text = text.replace(c, "\\" + c)
    return text


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(turns: list[tuple[str, str]]) -> str:
    """The default template: ``### role: text</turn>`` and a line end for each turn, control strings in texts escaped."""
    return "".join(f"{OPEN}{escape(role, ':')}: {escape(text)}{CLOSE}" for role, text in turns)


marked.prefix_free = True
_TURN = re.compile(r"### ((?:\\.|[^\\#<:])*): ((?:\\.|[^\\#<])*)</turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a text that ``marked`` made."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def located(turns: Iterable[tuple[str, str]], template: Template, window: int = WINDOW) -> Iterator[tuple[str, int, int, bool]]:
    """(added text, start and end of the turn's own text in it or -1, history rewritten) for each turn of one conversation."""
    context: list[tuple[str, str]] = []
    before, growing = "", not getattr(template, "prefix_free", False)
    for role, text in turns:
        context.append((role, text))
        now = template(context)
        rewritten = not now.startswith(before)
        growing |= rewritten
        added = now if rewritten else now[len(before):]
        start = end = -1
        if not rewritten:
            shown = template(context[:-1] + [(role, SENTINEL)])
            at = shown.find(SENTINEL, len(before))
            if at >= 0 and shown.startswith(before):
                head, tail = shown[len(before): at], shown[at + len(SENTINEL):]
                if added.startswith(head) and added.endswith(tail) and len(head) + len(tail) <= len(added):
                    start, end = len(head), len(added) - len(tail)
        yield added, start, end, rewritten
        before = now
        if len(context) >= window and not growing:
            pair = context[-2:]
            first, both = template(pair[:1]), template(pair)
            if not both.startswith(first) or both[len(first):] != added:
                growing = True  # this template looks further back than declared
            else:
                context, before = pair[1:], template(pair[1:])


_TURNS = ("conv_id long, turn_no long, role string, added string, start long, text_start long, text_end long, rewritten boolean")


def format_turns(conversations: DataFrame, template: Template = marked, window: int = WINDOW) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> a row a turn, in order within partitions.

    ``added`` is what the turn adds to the formatted conversation, which is
    their concatenation unless ``rewritten``; ``start`` is its place there and
    ``text_start``/``text_end`` are the places of the turn's own text (null if
    the template does not show it as one piece).
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    names = ["conv_id", "turn_no", "role", "added", "start", "text_start", "text_end", "rewritten"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches):
        queue: list[tuple[str, str]] = []
        turns, conv, number, place, begun = None, None, 0, 0, False
        for batch in batches:
            rows = []
            for cid, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if not begun or cid != conv:
                    conv, number, place, begun = cid, 0, 0, True
                    queue = []
                    turns = located(iter(queue.pop, None), template, window)  # takes a turn whenever the next is asked for
                queue.append((role, text))
                added, a, e, rewritten = next(turns)
                base = 0 if rewritten else place
                rows.append((cid, number, role, added, base, base + a if a >= 0 else None, base + e if a >= 0 else None, rewritten))
                place, number = base + len(added), number + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return c.mapInArrow(run, _TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from rows of ``format_turns``: counts and digests of turns and of the text under the loss mask."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        state = None

        def closed(s):
            return (s["conv"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"])

        for batch in batches:
            rows = []
            for conv, no, added, base, a, e in zip(*(batch.column(n).to_pylist() for n in (
                    "conv_id", "turn_no", "added", "start", "text_start", "text_end"))):
                if no == 0:
                    if state:
                        rows.append(closed(state))
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                for role, text in read_back(added):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        masked = unescape(added[a - base: e - base])
                        state["loss"].update(masked.encode())
                        state["loss_chars"] += len(masked)
                state["chars"] += len(added)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(closed(state), kinds)], names=names)

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(ADDED_ID, 0, "user", ADDED_TEXT), (ADDED_ID, 1, "assistant", ADDED_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    return digests(format_turns(c.unionByName(extra)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(regexp_replace(role, '[\\#<:]', '', 'g')) AS plain_role,
  length(regexp_replace(text, '[\\#<]', '', 'g')) AS plain_text FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(2 * length(role) - plain_role + 2 * length(text) - plain_text + length('### : </turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
