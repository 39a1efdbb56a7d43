"""Chat formatting by a grammar round trip, in DataFrame functions only.

A conversation is rendered as

    conversation := "<s>" turn*
    turn         := "[INST] " text " [/INST]"                  of the user
                  | " " text "</s>"                            of the assistant
                  | "[ROLE]" role "[/ROLE] " text "</s>"       of any other role

Every turn ends with "[/INST]" or "</s>" and its first characters tell its kind,
so a parser splits a rendered text in one way only. The parser is strict: a
control string inside a text, or a turn of none of the three kinds, is an error.

Each turn is rendered as it is and parsed again. Where the parse is not the turn
(its text or role holds a control string, or what looks like an escaped one), the
next form of ``FORMS`` is tried, until the parse is identical. The last form puts a
backslash behind the first character of each control string; the parser takes one
away. Whole conversations are parsed again, too, and compared with their turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<s>"
USER = ("[INST] ", " [/INST]")
ASSISTANT = (" ", "</s>")
ROLE = ("[ROLE]", "[/ROLE] ")
CONTROL = r"</?s>|\[/?INST\]|\[/?ROLE\]"

# The first character of a control string, or of one with backslashes behind that character.
_OPENS = r"(<(?=\\%s/?s>)|\[(?=\\%s/?(?:INST|ROLE)\]))"
_PLAIN, _ESCAPED = _OPENS.replace("%s", "*"), _OPENS.replace("%s", "+")
_TURN_ENDS = r"(?<=\[/INST\])|(?<=</s>)"


def escape(text: Column) -> Column:
    """No control string is left; ``unescape`` gives the text back."""
    return F.regexp_replace(text, _PLAIN, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED + r"\\", "$1")


# How a text may be written, in the order of trial.
FORMS: list[Callable[[Column], Column]] = [lambda text: text, escape]


def _render(role: Column, text: Column, form: Callable[[Column], Column]) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit(USER[0]), form(text), F.lit(USER[1])))
        .when(role == "assistant", F.concat(F.lit(ASSISTANT[0]), form(text), F.lit(ASSISTANT[1])))
        .otherwise(F.concat(F.lit(ROLE[0]), form(role), F.lit(ROLE[1]), form(text), F.lit(ASSISTANT[1])))
    )


def _between(segment: Column, before: str, after: str) -> Column:
    """What is between two fixed strings at a segment's ends, else null."""
    inner = F.substring(segment, F.lit(len(before) + 1), F.length(segment) - len(before) - len(after))
    fits = segment.startswith(before) & segment.endswith(after) & (F.length(segment) >= len(before) + len(after))
    return F.when(fits, inner)


def _parse_turn(segment: Column) -> Column:
    """``role, text, before, inside, after`` of one rendered turn; role and text are null where it breaks the grammar.

    before, inside and after are the numbers of characters of the opening, the
    text as written, and the close.
    """
    user, other, answer = segment.startswith(USER[0]), segment.startswith(ROLE[0]), segment.startswith(ASSISTANT[0])
    after_name = F.locate(ROLE[1], segment)
    name = F.when(after_name > 0, F.substring(segment, F.lit(len(ROLE[0]) + 1), after_name - len(ROLE[0]) - 1))
    rest = F.substring(segment, after_name + len(ROLE[1]), F.length(segment))
    role = F.when(user, F.lit("user")).when(other, name).when(answer, F.lit("assistant"))
    text = (
        F.when(user, _between(segment, *USER))
        .when(other & (after_name > 0), _between(rest, "", ASSISTANT[1]))
        .when(answer, _between(segment, *ASSISTANT))
    )
    right = role.isNotNull() & text.isNotNull() & ~role.rlike(CONTROL) & ~text.rlike(CONTROL)
    close = F.when(user, F.lit(len(USER[1]))).otherwise(F.lit(len(ASSISTANT[1])))
    inside = F.coalesce(F.length(text), F.lit(0))
    return F.struct(
        F.when(right, unescape(role)).alias("role"),
        F.when(right, unescape(text)).alias("text"),
        (F.length(segment) - inside - close).alias("before"),
        inside.alias("inside"),
        close.alias("after"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, see ``_parse_turn``; null where it does not begin with ``<s>``."""
    body = F.substring(formatted, F.lit(len(START) + 1), F.length(formatted))
    segments = F.filter(F.split(body, _TURN_ENDS), lambda s: s != "")
    return F.when(formatted.startswith(START), F.transform(segments, _parse_turn))


def _said(turns: Column) -> Column:
    """Only role and text, for comparison."""
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the first form that is parsed back identically."""
    turn = F.array(F.struct(role.alias("role"), text.alias("text")))
    tried = []
    for form in FORMS:
        written = _render(role, text, form)
        tried.append(F.when(_said(parse(F.concat(F.lit(START), written))) == turn, written))
    return F.coalesce(*tried, F.raise_error(F.concat(F.lit("no form of a turn is parsed back: "), role, F.lit(": "), text)))


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, formatted, turns``: one row for each conversation.

    ``turns`` is what the parser reads from ``formatted``: role and text, and the
    characters before, inside and after the text as it is written. The loss mask is
    the inside of the assistant's turns; see ``loss_mask``. A turn that
    is not read back as it was raises.

    Rows go by turn (null first; rows of one turn by role, then text), and a
    repeated row is said twice. A null text or role is empty, and rows with a null
    conv_id are one conversation. An empty table gives no rows; other columns are
    not read. Turns are rendered and checked before they are brought together; a
    conversation is one value, however long it is.
    """
    said = rows.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    one = F.struct("turn", "role", "text", render_turn(F.col("role"), F.col("text")).alias("written"))
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("said"))
    formatted = F.concat(F.lit(START), F.array_join(F.col("said")["written"], ""))
    whole = whole.select("conv_id", _said(F.col("said")).alias("source"), formatted.alias("formatted"))
    whole = whole.select("conv_id", "source", "formatted", parse(F.col("formatted")).alias("turns"))
    same = F.when(_said(F.col("turns")) == F.col("source"), F.col("turns"))
    lost = F.raise_error(F.concat(F.lit("not parsed back: "), F.col("formatted")))
    return whole.select("conv_id", "formatted", F.coalesce(same, lost).alias("turns"))


def loss_mask(turns: Column) -> Column:
    """The mask over a rendered text as runs of ``length, loss``; the lengths add up to the text's."""

    def parts(t: Column) -> Column:
        runs = [(t["before"], F.lit(False)), (t["inside"], t["role"] == "assistant"), (t["after"], F.lit(False))]
        return F.array(*[F.struct(n.alias("length"), loss.alias("loss")) for n, loss in runs])

    start = F.array(F.struct(F.lit(len(START)).alias("length"), F.lit(False).alias("loss")))
    return F.concat(start, F.flatten(F.transform(turns, parts)))


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of rendered conversations."""
    turns = F.col("turns")
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.filter(turns, lambda t: t["role"] == "assistant")["text"], "")
    read = formatted.select("conv_id", "formatted", turns, F.array_join(lines, "").alias("__lines"), loss.alias("__loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("__lines").cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
