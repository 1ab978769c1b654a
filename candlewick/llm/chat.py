"""Chat formatting: conversations as windows of a token budget, with marked turns, repeated history and a loss mask.

Prefix sums of the turns' tokens choose spans of whole turns. Every window after a conversation's first repeats the
system turn and a limited history; what is repeated is outside the loss mask, so each target counts once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.series import numbered
from .common import Scratch, in_batches
from .tokens import word_tokenizer

#: The template's control strings. No text or role holds "<|" once it is escaped.
START, MORE, END = "<|im_start|>", "<|im_more|>", "<|im_end|>"
SYSTEM, TARGET = "system", "assistant"
#: Turns of a conversation that one task holds; a longer one is dealt out in segments of so many, and each begins a window.
SEGMENT = 4096

_OPEN, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_PIECE = re.compile(rf"{re.escape(START)}([^\n]*?)({re.escape(MORE)})?\n(.*?){re.escape(END)}\n", re.S)
_WINDOWS = "segment long, window int, text string, fresh_start long, n_tokens long, n_turns int, loss_starts array<long>, loss_lengths array<long>"


def escape(text: str) -> str:
    """One more backslash into every < \\...\\ |, so that no control string is left; unescape() takes it out again."""
    return _OPEN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    """Roles stand on one line: backslashes and line feeds are written as two characters."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def turn(role: str, text: str, more: bool = False) -> str:
    """A turn, or with ``more`` a further piece of the turn before it; both escaped already."""
    return f"{START}{role}{MORE if more else ''}\n{text}{END}\n"


def pieces(text: str, tokens: int, most: int, count) -> list[tuple[str, int]]:
    """(piece, tokens): the text cut into pieces of ``most`` tokens at most, at white space next to the middle or else there.

    A single code point stays whole, whatever its tokens.
    """
    done, waiting = [], [(text, tokens)]
    while waiting:
        part, n = waiting.pop()
        if n <= most or len(part) < 2:
            done.append((part, n))
            continue
        half = len(part) // 2
        space = re.search(r"\s(?=\S)", part[half:])
        at = half + space.end() if space and half + space.end() < len(part) * 3 // 4 else half
        waiting += [(p, count(p)) for p in (part[at:], part[:at])]
    return done


def spans(tokens: np.ndarray, rows: np.ndarray, first: int, system: int, budget: int, history: int, history_turns: int) -> Iterator[tuple[int, int, int]]:
    """(begin of the history, begin, end) of windows over pieces from ``first`` on, chosen by searching prefix sums of tokens.

    rows numbers the turn of each piece. ``system`` pieces at the head are retained by every window: their tokens are
    set aside, and they are never history. Pieces have at most budget - system - history tokens.
    """
    sums = np.concatenate([[0], np.cumsum(tokens)])
    kept, begin = int(sums[system]), first
    while begin < len(tokens):
        back = begin
        if begin > system:
            back = min(max(int(np.searchsorted(sums, sums[begin] - history)), int(np.searchsorted(rows, rows[begin - 1] - history_turns + 1)), system), begin)
        room = budget - (kept if begin >= system > 0 else 0) - int(sums[begin] - sums[back])
        end = max(int(np.searchsorted(sums, sums[begin] + room, side="right")) - 1, begin + 1)
        yield back, begin, end
        begin = end


def _build(turns: list[tuple], budget: int, history: int, history_turns: int, count) -> Iterator[tuple]:
    """Windows of one segment; turns are (kind, role, text, tokens) in order, kind 0 retained, 1 history or 2 own."""
    parts = []  # (turn's number, role, text, tokens, more)
    first = head = 0
    for at, (kind, role, text, n) in enumerate(turns):
        over = count(role) + 3
        most = max(budget // 2 - over, 1)
        cut = [(text, n)] if n <= most else pieces(text, n, most, count)
        whole = n + over <= budget // 4
        if role == SYSTEM and at == 0 and whole:
            head = 1
        elif kind == 0:
            continue
        parts += [(at, role, p, k + over, i > 0) for i, (p, k) in enumerate(cut)]
        first = len(parts) if kind < 2 else first
    tokens, rows = np.array([p[3] for p in parts], dtype=np.int64), np.array([p[0] for p in parts], dtype=np.int64)
    for number, (back, begin, end) in enumerate(spans(tokens, rows, first, head, budget, history, history_turns)):
        chosen = [*range(head if begin >= head else 0), *range(back, end)]
        text, at, fresh, starts, lengths = [], 0, None, [], []
        for i in chosen:
            _, role, body, _, more = parts[i]
            written = turn(role, body, more)
            if i == begin:
                fresh = at
            if i >= begin and role == TARGET and body:
                starts.append(at + len(written) - len(body) - len(END) - 1)
                lengths.append(len(body))
            text.append(written)
            at += len(written)
        yield number, "".join(text), fresh, int(tokens[chosen].sum()), sum(not parts[i][4] for i in range(begin, end)), starts, lengths


def _windows(rows: DataFrame, path: str, budget: int, history: int, history_turns: int) -> DataFrame:
    """Windows of rows (conv_id, segment, kind, role, text) that come sorted, a segment's in one task; streamed, one segment at a time."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        known: dict[str, int] = {}

        def count(text: str) -> int:
            if len(text) > 64:
                return len(tokenizer.encode(text))
            if text not in known:
                if len(known) > 10_000:
                    known.clear()
                known[text] = len(tokenizer.encode(text))
            return known[text]

        schema = None
        key, held, out, size = None, [], [], 0

        def flush():
            for number, text, *rest in _build(held, budget, history, history_turns, count):
                out.append((*key, number, text, *rest))

        def batch_of():
            names = ["conv_id", *(c.split()[0] for c in _WINDOWS.split(", "))]
            types = [schema, pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            schema = batch.schema.field("conv_id").type
            ids, segments, kinds, roles, texts = (batch.column(i).to_pylist() for i in range(5))
            escaped = [escape(t or "") for t in texts]
            counts = tokenizer.encode_arrow(pa.array(escaped, pa.string()))[1].tolist()
            for own, k, role, text, n in zip(zip(ids, segments, strict=True), kinds, roles, escaped, counts, strict=True):
                if own != key:
                    if held:
                        flush()
                        size = sum(len(w[3]) for w in out)
                    if size > 1 << 20:
                        yield batch_of()
                        out, size = [], 0
                    key, held = own, []
                held.append((k, escape_role(role or ""), text, n))
        if held:
            flush()
        if out:
            yield batch_of()

    return in_batches(rows.select("conv_id", "segment", "kind", "role", "text"), run, f"conv_id {kind}, {_WINDOWS}")


def format_chat(turns: DataFrame, path: str, budget: int = 2048, history: int = 512, history_turns: int = 8, scratch: Scratch | None = None, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Windows of conversations (conv_id, turn, role, text) of at most ``segment`` turns, and those of longer ones.

    Columns: conv_id, segment, window (from 0 in its segment), text, fresh_start (code points that are repeated before
    what is new), n_tokens, n_turns (turns that begin in it), loss_starts and loss_lengths (code points of the new
    assistant texts). A window has at most ``budget`` tokens by the tokenizer at ``path``, where each control string is one
    token: a system turn at the head, if it takes a quarter of the budget at most; the last turns before what is new, of at
    most ``history`` tokens (a quarter of the budget is the most that is taken) and ``history_turns`` rows; and as many new turns as fit.
    A turn of more than half the budget is cut into marked pieces, so no text is lost and no window is over the budget (but for
    a single code point beyond it).

    Rows are in the order of turn (NULLs last), then role and text; repeated rows are turns of their own, and rows without a
    conversation are one conversation. NULL roles and texts are empty. An empty table gives no rows; other columns are not read.
    The short conversations' windows come sorted by conv_id and window, each conversation's in one task.
    """
    scratch = scratch or Scratch(turns.sparkSession, "chat")
    history = min(history, budget // 4)
    rows = turns.select(*[F.col(c).alias(c) for c in ("conv_id", "turn", "role", "text")])
    many = scratch.cut(rows.groupBy("conv_id").agg(F.count("*").alias("_rows")).where(F.col("_rows") > segment).select(F.col("conv_id").alias("_conv")))
    has_many = not many.isEmpty()
    none, own = F.lit(0).cast("long"), F.lit(2)
    short = rows.join(many, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_anti") if has_many else rows
    order = [F.asc_nulls_last("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    near = short.repartition("conv_id").sortWithinPartitions("conv_id", *order).withColumns({"segment": none, "kind": own})
    made = _windows(near, path, budget, history, history_turns)
    if not has_many:
        return made, made.limit(0)
    long = numbered(rows.join(many, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi"), ["conv_id"], order, scratch)
    at = F.expr(f"_n div {segment}")
    dealt = long.withColumn("segment", F.explode(F.when(F.col("_n") % segment >= segment - history_turns, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("kind", F.when(F.col("segment") == at, 2).otherwise(1))
    heads = long.where((F.col("_n") == 0) & (F.col("role") == SYSTEM)).select("conv_id", "turn", "role", "text", "_n")
    later = dealt.where((F.col("_n") % segment == 0) & (F.col("segment") == at) & (F.col("segment") > 0)).select(F.col("conv_id").alias("_conv"), "segment")  # one row a segment
    repeated = heads.join(later, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv").withColumn("kind", F.lit(0))
    far = dealt.where(~((F.col("kind") == 1) & (F.col("_n") == 0) & (F.col("role") == SYSTEM)) | F.col("role").isNull()).unionByName(repeated)
    return made, _windows(far.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "_n", "kind"), path, budget, history, history_turns)


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of windows, from their texts and masks alone.

    The windows of a conversation have to come one after the other in one task, in order: digests run on as a stream, so
    that no conversation is ever held. turns_sha256 is over role, line feed, text and line feed of every turn, loss_sha256 over
    all text under the mask, unescaped. A window that doesn't parse, or whose mask reaches into repeated text, is an error.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, seen = None, False, False
        turns = loss = None
        n = chars = written = 0
        done = []

        def close():
            if open_:
                turns.update(b"\n")
            done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), written))

        for batch in batches:
            ids, texts, fresh, starts, lengths = (batch.column(i).to_pylist() for i in range(5))
            for own, text, begin, at, size in zip(ids, texts, fresh, starts, lengths, strict=True):
                if not seen or own != key:
                    if seen:
                        close()
                    key, open_, seen, n, chars, written = own, False, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                written += len(text)
                place = begin
                for m in _PIECE.finditer(text, begin):
                    if m.start() != place:
                        raise ValueError("a window does not parse")
                    place = m.end()
                    if not m[2]:
                        turns.update(b"\n" * open_ + unescape_role(m[1]).encode() + b"\n")
                        n, open_ = n + 1, True
                    turns.update(unescape(m[3]).encode())
                if place != len(text) or any(s < begin for s in at):
                    raise ValueError("a window does not parse")
                for s, k in zip(at, size, strict=True):
                    part = unescape(text[s : s + k])
                    loss.update(part.encode())
                    chars += len(part)
            if done:
                types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done = []
        if seen:
            close()
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    return in_batches(windows.select("conv_id", "text", "fresh_start", "loss_starts", "loss_lengths"), run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(turns: DataFrame, path: str, scratch: Scratch | None = None, **options) -> DataFrame:
    """read_back() of format_chat(): one row a conversation. Long conversations' windows are brought together for their digests' sake."""
    short, long = format_chat(turns, path, scratch=scratch, **options)
    together = long.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return read_back(short).unionByName(read_back(together))
