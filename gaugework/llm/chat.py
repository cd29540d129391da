"""Chat formatting: a state machine over roles and a declarative template, as DataFrame expressions.

A template lists the roles that may follow each state and the marks around role and text.  Role
and text are escaped, so marks only occur where the template puts them: the escape character is
doubled, and it also breaks up the two characters that every mark begins with.  Reading back
splits at the marks and removes the escapes, whatever the texts say.

One conversation becomes one training example, hence one row.  The turns are gathered by one
aggregation with map-side combining; everything else are array functions on that row.

Defined cases: a NULL role or text is empty; rows without conversation id are one conversation
with a NULL id; turns are ordered by number, NULL numbers first, ties by role and text; repeated rows are
turns of their own; an unknown or misplaced role is formatted all the same, and ``valid`` and
``first_error`` (the position of the turn, from 0) report it; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
START_STATE = "start"
#: The state that nothing leaves.
ERROR_STATE = "error"


@dataclass(frozen=True)
class Template:
    """Marks, loss and turn order.  Every mark begins with ``opener``."""

    begin: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    opener: str = "<|"
    #: Roles whose text is trained on.
    loss: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}; a conversation may end in a state of ``accepting``.
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            START_STATE: {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if len(self.opener) != 2 or ESCAPE in self.begin + self.middle + self.end:
            raise ValueError("the opener has two characters and no mark holds the escape character")
        if not all(m.startswith(self.opener) for m in (self.begin, self.middle, self.end)):
            raise ValueError("every mark begins with the opener")


def escape(text: Column, template: Template) -> Column:
    first, second = template.opener
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.replace(doubled, F.lit(template.opener), F.lit(first + ESCAPE + second))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _next_state(state: Column, role: Column, template: Template) -> Column:
    result = F.lit(ERROR_STATE)
    for name, follows in template.order.items():
        for allowed, target in follows.items():
            result = F.when((state == name) & (role == allowed), target).otherwise(result)
    return result


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, segments, valid, first_error``.

    ``segments`` are ``(text, loss)`` in order: marks and role of a turn, its escaped text, its
    end mark.  Their texts put together are the formatted conversation.
    """
    template = template or Template()
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("row"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def step(at: Column, row: Column) -> Column:
        state = _next_state(at["state"], row["role"], template)
        error = (state == ERROR_STATE) & at["error"].isNull()
        return F.struct(
            state.alias("state"),
            F.when(error, at["n"]).otherwise(at["error"]).alias("error"),
            (at["n"] + 1).alias("n"),
        )

    began = F.struct(
        F.lit(START_STATE).alias("state"), F.lit(None).cast("int").alias("error"), F.lit(0).alias("n")
    )

    def texts(row: Column) -> Column:
        head = F.concat(F.lit(template.begin), escape(row["role"], template), F.lit(template.middle))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(
                escape(row["text"], template).alias("text"), row["role"].isin(*template.loss).alias("loss")
            ),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    judged = turns.select(
        "conv_id",
        F.flatten(F.transform("turns", texts)).alias("segments"),
        F.aggregate("turns", began, step).alias("_end"),
    )
    return judged.select(
        "conv_id",
        "segments",
        F.col("_end.state").isin(*template.accepting).alias("valid"),
        F.col("_end.error").alias("first_error"),
    )


def formatted(parts: DataFrame) -> DataFrame:
    """The result of :func:`segments` plus ``formatted``, the text that a model is given."""
    return parts.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def loss_text(parts: str = "segments") -> Column:
    """All text under the loss mask, escapes removed, nothing in between."""
    trained = F.filter(F.col(parts), lambda s: s["loss"])
    return F.array_join(F.transform(trained, lambda s: unescape(s["text"])), "")


def turns_of(text: str = "formatted", template: Template | None = None) -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``."""
    template = template or Template()
    ended = F.split(F.col(text), rf"\Q{template.end}\E")
    whole = F.slice(ended, 1, F.size(ended) - 1)

    def turn(part: Column) -> Column:
        inner = F.substr(part, F.lit(len(template.begin) + 1))
        return F.struct(
            unescape(F.substring_index(inner, template.middle, 1)).alias("role"),
            unescape(F.substring_index(inner, template.middle, -1)).alias("text"),
        )

    return F.transform(whole, turn)
