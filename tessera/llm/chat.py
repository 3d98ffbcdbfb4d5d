r"""Chat formatting in budgeted windows.

A turn is written as `<|turn|>role\ntext<|end|>\n`. Inside roles and texts a backslash is doubled,
and one is put behind the first character of every control string, so that no text can close a turn
or open another; unescape() undoes that exactly. Prefix sums of the turns' token counts choose
spans of whole turns within the budget. Each window begins with the conversation's system turn, goes
on with as many of the latest turns already shown as the history allowance holds, and then shows
new turns. Only new assistant texts are targets; repeated ones are masked. A turn that alone exceeds
the budget is a window by itself, never cut.

Rows are dealt by conversation and sorted by turn, and a task reads them as a stream: it holds the
turns of one window, not of a conversation.

Defined results: null texts and roles are empty; rows with the same turn are ordered by role, then
text, repeated rows follow each other; a null conv_id is one conversation; a very long text is a window of its own; an
empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.packing import ByteBpe

TURN, END = "<|turn|>", "<|end|>\n"
#: Strings that tokenizers and templates in use treat as control; fixed values.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\r")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "\r" else m.group(1), role, flags=re.S)


def count_tokens(text: str) -> int:
    """About the number of tokens of a text: a quarter of its UTF-8 bytes."""
    return (len(text.encode("utf-8", "surrogatepass")) + 3) // 4


@dataclass(frozen=True)
class Budget:
    tokens: int = 1024
    #: Part of it that repeated turns may fill.
    history: int = 256
    #: Tokens that a turn's markers and role take.
    markers: int = 8


Turn = tuple[str, str]  # role, text


def windows(turns: Iterator[Turn], budget: Budget, tokens: Callable[[str], int] = count_tokens) -> Iterator[dict]:
    """Windows of one conversation: text, repeated (turns shown before), turns, tokens, spans of targets."""
    system: tuple[Turn, int] | None = None
    fresh: list[tuple[Turn, int]] = []
    past: deque[tuple[Turn, int]] = deque()
    held = past_tokens = 0
    shown = False

    def window() -> dict:
        again = ([system] if system and shown else []) + list(past)
        text, spans, total = "", [], 0
        parts, at = [], 0
        for k, ((role, said), n) in enumerate([*again, *fresh]):
            head, body = f"{TURN}{escape_role(role)}\n", escape(said)
            if k >= len(again) and role == "assistant":
                spans.append({"start": at + len(head), "length": len(body)})
            parts += head, body, END
            at += len(head) + len(body) + len(END)
            total += n
        text = "".join(parts)
        return {"text": text, "repeated": len(again), "turns": len(again) + len(fresh), "tokens": total, "loss": spans}

    def roll() -> None:
        """The shown turns become history, of which the latest that fit stay."""
        nonlocal held, past_tokens
        for t in fresh:
            if t is not system:
                past.append(t)
                past_tokens += t[1]
        while past_tokens > budget.history:
            past_tokens -= past.popleft()[1]
        fresh.clear()
        held = 0

    for k, turn in enumerate(turns):
        item = (turn, tokens(turn[1]) + budget.markers)
        if k == 0 and turn[0] == "system":
            system = item
        base = (system[1] if system and shown else 0) + past_tokens
        if fresh and base + held + item[1] > budget.tokens:  # the prefix sum passes the budget here
            yield window()
            shown = True
            roll()
            base = (system[1] if system else 0) + past_tokens
        while past and base + item[1] > budget.tokens:
            base -= past[0][1]
            past_tokens -= past.popleft()[1]
        fresh.append(item)
        held += item[1]
    if fresh:
        yield window()


def parse(text: str) -> list[Turn]:
    """The turns of a formatted window."""
    out = []
    for part in text.split(TURN)[1:]:
        role, _, body = part.removesuffix(END).partition("\n")
        out.append((unescape_role(role), unescape(body)))
    return out


WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("turns", pa.int64()), ("repeated", pa.int64()), ("tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])
DDL = "conv_id long, window long, text string, turns long, repeated long, tokens long, loss array<struct<start: long, length: long>>"


def format_windows(turns: DataFrame, budget: Budget = Budget(), tokenizer_path: str | None = None) -> DataFrame:
    """Rows of WINDOWS, in order of conversation and window within each partition.

    Tokens are those of a byte-level BPE file of the tokenizers library, or without one estimated by count_tokens().
    """
    small_batches(turns.sparkSession)
    file = None
    if tokenizer_path:
        with open(tokenizer_path, "rb") as f:
            file = turns.sparkSession.sparkContext.broadcast(f.read())
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        count = count_tokens
        if file is not None:
            encode = ByteBpe(file.value)
            count = lambda text: len(encode(text)) // 4
        stream = (x for b in batches for x in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        out: list[dict] = []
        size = 0
        for conv, group in groupby(stream, key=lambda x: x[0]):
            for k, w in enumerate(windows(((role, text) for _, role, text in group), budget, count)):
                out.append({"conv_id": conv, "window": k} | w)
                size += len(w["text"])
                if len(out) >= 256 or size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=WINDOWS)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=WINDOWS)

    return dealt.mapInArrow(run, DDL)


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its windows alone. Expects the order of format_windows()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def close():
            conv, n, turns, chars, loss, size, count = now
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count))

        for batch in batches:
            for w in batch.to_pylist():
                if now is None or w["window"] == 0:
                    if now is not None:
                        close()
                    now = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(w["text"])[w["repeated"] :]:
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in w["loss"]:
                    target = unescape(w["text"][s["start"] : s["start"] + s["length"]])
                    now[3] += len(target)
                    now[4].update(target.encode("utf-8", "surrogatepass"))
                now[5] += len(w["text"])
                now[6] += 1
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), READ, strict=True)], schema=READ)
                out.clear()
        if now is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), READ, strict=True)], schema=READ)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
