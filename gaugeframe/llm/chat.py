"""Chat formatting with a finite-state machine over roles.

A declarative template names the states, the role transitions, the marks around a turn and which roles carry loss.  Turns are shuffled by
conversation and sorted by turn inside each partition; one pass per partition runs the machine and emits text segments with a loss flag,
holding one turn at a time, so a conversation of any length needs no memory.  Control strings inside texts are escaped reversibly: the
escape character is doubled and set behind the first character of every control string, so no mark can be forged.

Defined results.  Turns are ordered by ``turn`` (null first), then role, then text.  A null text or role is empty.  A null ``conv_id`` is a
conversation of its own.  Repeated rows are turns of their own.  A conversation that breaks the turn order is formatted like any other; each of
its segments from there on names the broken rule in ``error``.  An empty table gives no segments.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeframe.llm.common import partitions


@dataclass(frozen=True)
class Template:
    """Marks, machine and loss roles of a chat format."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    escape: str = "\\"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state -> role -> next state; a role that the state does not list breaks the order
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: frozenset[str] = frozenset({"answered", "asked"})
    #: strings with a meaning in this or a common other format; none may survive inside a text
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    def __post_init__(self):
        if any(len(c) < 2 or self.escape in c for c in self.controls) or not {self.begin, self.end.strip()} <= set(self.controls):
            raise ValueError("control strings have two characters or more, no escape character, and include the marks")

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        return re.sub(f"(?=({'|'.join(map(re.escape, self.controls))})).", lambda m: m[0] + self.escape, text, flags=re.S)

    def unescaped(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}({e}?)", r"\1", text)


SEGMENT = "conv_id long, turn_no long, part string, segment string, loss boolean, error string"


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments in order: per turn a ``role`` mark, the ``text`` and an ``end`` mark; ``loss`` is set on texts of loss roles only."""
    ordered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        current, number, state, error, open_ = object(), 0, "", None, False
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
                if not open_ or conv != current:
                    current, number, state, error, open_ = conv, 0, "start", None, True
                follow = template.machine.get(state, {}).get(role)
                if follow is None and error is None:
                    error = f"turn {number}: {role or 'no role'} after {state}"
                state = follow or state
                loss = role in template.loss_roles
                out.append((conv, number, "role", template.begin + template.escaped(role) + template.after_role, False, error))
                out.append((conv, number, "text", template.escaped(text), loss, error))
                out.append((conv, number, "end", template.end, False, error))
                number += 1
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return ordered.mapInArrow(run, SEGMENT)


def digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from its segments alone: turn count, digest of the unescaped turns, of the text under the loss mask, and length."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "error")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_ = None, False

        def done() -> tuple:
            return (current, turns, all_.hexdigest(), loss_chars, loss_.hexdigest(), chars, error)

        for batch in batches:
            out = []
            for conv, part, segment, loss, why in zip(*(batch[n].to_pylist() for n in ("conv_id", "part", "segment", "loss", "error"))):
                if not open_ or conv != current:
                    if open_:
                        out.append(done())
                    current, open_, turns, loss_chars, chars, error = conv, True, 0, 0, 0, None
                    all_, loss_ = hashlib.sha256(), hashlib.sha256()
                chars += len(segment)
                error = error or why
                if part == "role":
                    turns += 1
                    role = template.unescaped(segment.removeprefix(template.begin).removesuffix(template.after_role))
                    all_.update(f"{role}\n".encode())
                elif part == "text":
                    text = template.unescaped(segment)
                    all_.update(f"{text}\n".encode())
                    if loss:
                        loss_chars += len(text)
                        loss_.update(text.encode())
            if out:
                yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        if open_:
            yield pa.record_batch([pa.array([v], k) for v, k in zip(done(), kinds)], names=names)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, error string")


def op2(turns: DataFrame) -> DataFrame:
    """All conversations plus conversation -7, whose texts are control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.select("conv_id", "turn", "role", "text").unionByName(extra)))
