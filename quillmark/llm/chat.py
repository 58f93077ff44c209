"""Chat formatting in budgeted windows.

Turns are marked by a template and cut into windows of at most ``budget`` tokens, at turn
boundaries. Tokens are counted before the shuffle, so those of a long conversation are counted by many tasks; their
prefix sums in turn order, taken batch by batch, choose the spans: where a window ends and how far back its history
goes are differences of two of them. Every later window
repeats the conversation's system turn and the last turns before it, up to ``history``
tokens, and masks both from the loss; so each assistant turn is a target exactly once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import small_batches

#: Characters of text after which a batch of windows is passed on.
BATCH_CHARS = 1 << 20
START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
BACK = {"amp": "&", "lt": "<", "nl": "\n"}


def escape(text: str, header: bool = False) -> str:
    """No control string survives inside: ``<|`` and, in headers, line ends are written out."""
    text = text.replace("&", "&amp;").replace("<|", "&lt;|")
    return text.replace("\n", "&nl;") if header else text


def unescape(text: str) -> str:
    return re.sub(r"&(amp|lt|nl);", lambda m: BACK[m[1]], text)


def counter(vocabulary: bytes | None):
    """Token count of a text: by byte-pair ranks, else pieces of words and marks."""
    if vocabulary is None:
        piece = re.compile(r"\w{1,6}|[^\w\s]")
        return lambda text: len(piece.findall(text)) + 1
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    code = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(code.encode_ordinary(text)) + 4  # marks and role


def spans(turns, budget: int, history: int):
    """Windows of one conversation's turns (role, text, tokens, prefix sum of tokens) in order: (context, new turns, tokens).

    Tokens stay within the budget, but for a turn that alone exceeds it and stands alone. The system turn is
    repeated wherever it fits beside the next turn. Only differences of prefix sums count, so they may begin anywhere.
    """
    system, context, new, lead, start = None, [], [], 0, None
    recent, before = [], []  # turns that a window may repeat, and the prefix sum without the system turn before each
    for role, text, cost, upto in turns:
        body = upto - cost - (system[2] if system else 0)
        if new and lead + upto - start > budget:
            yield context, new, lead + upto - cost - start
            fixed = [system] if system and system[2] + cost <= budget else []
            lead = sum(t[2] for t in fixed)
            back = bisect_left(before, body - min(history, budget - cost - lead))
            context, new, start = fixed + recent[back:], [], None
            lead += body - before[back] if back < len(before) else 0
        start = upto - cost if start is None else start
        new.append((role, text, cost))
        if role == "system" and system is None:
            system = new[-1]
        else:
            recent.append(new[-1])
            before.append(body)
            gone = bisect_left(before, body + cost - history)
            del recent[:gone], before[:gone]
    if new:
        yield context, new, lead + upto - start


def windows_of(turns, count, budget: int, history: int):
    """``spans`` of (role, text) turns that are not counted yet."""
    turns = [(role, text, count(text)) for role, text in turns]
    sums = np.cumsum([t[2] for t in turns], dtype=np.int64).tolist()
    return spans(((*t, u) for t, u in zip(turns, sums)), budget, history)


def render(context, new) -> tuple[str, list[tuple[int, int]]]:
    parts, at, loss = [], 0, []
    for k, (role, text, _) in enumerate([*context, *new]):
        head, body = f"{START}{escape(role, True)}\n", escape(text)
        if k >= len(context) and role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), loss


def _runs(batches, key: str):
    """(key, iterator of rows) for consecutive equal keys; one row is held at a time."""
    rows = (r for b in batches for r in b.to_pylist())
    return groupby(rows, key=lambda r: r[key])


def _summed(batches):
    """The batches with the prefix sum of their tokens, over all batches of the task."""
    last = 0
    for b in batches:
        sums = last + np.cumsum(b.column("tokens").to_numpy(), dtype=np.int64)
        last = int(sums[-1]) if len(sums) else last
        yield b.append_column("upto", pa.array(sums))


def format_chats(turns: DataFrame, budget: int = 1024, history: int = 192, vocabulary: str | None = None) -> DataFrame:
    """conv_id, window, n_context, tokens, text, loss (array of start, end in code points).

    Turns are ordered by turn, then role and text, so that ties and repeated rows have one
    order. Null roles and texts count as empty. A null conv_id is a conversation of its own.
    A turn that alone exceeds the budget gets a window without context, whole; a system turn that does
    not fit beside the next turn is left out of that window. An empty table gives no rows. ``vocabulary``: path of a
    byte-pair rank file that the driver reads; without one, tokens are counted by a pattern. Sorted rows are
    streamed: a task holds some windows, not one conversation. Other columns are ignored.
    """
    small_batches(turns.sparkSession)
    fields = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    fields += [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    names = ["conv_id", "window", "n_context", "tokens", "text", "loss"]
    types = [pa.int64()] * 4 + [pa.string(), loss_type]
    # read here once and shipped: executors need not see the file
    ranks = turns.sparkSession.read.format("binaryFile").load(vocabulary).first().content if vocabulary else None

    def tally(batches):
        count = counter(bytes(ranks) if ranks else None)
        for b in batches:
            yield b.append_column("tokens", pa.array([count(t) for t in b.column("text").to_pylist()], pa.int64()))

    rows = turns.select(*fields).mapInArrow(tally, "conv_id long, turn long, role string, text string, tokens long")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches):
        held, chars = [], 0
        for conv, group in _runs(_summed(batches), "conv_id"):
            counted = ((r["role"], r["text"], r["tokens"], r["upto"]) for r in group)
            for k, (context, new, used) in enumerate(spans(counted, budget, history)):
                text, loss = render(context, new)
                held.append((conv, k, len(context), used, text, [{"start": a, "end": b} for a, b in loss]))
                chars += len(text)
                if chars > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                    held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return rows.mapInArrow(work, "conv_id long, window long, n_context long, tokens long, text string, loss array<struct<start:long,end:long>>")


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what formatted windows hold, parsed from their text and loss spans.

    Expects the rows of a conversation together and in order, as format_chats returns them.
    """

    def work(batches):
        for conv, group in _runs(batches, "conv_id"):
            turns, loss, n, n_loss, n_all = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for w in group:
                for m in list(TURN.finditer(w["text"]))[w["n_context"] :]:
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n += 1
                for s in w["loss"]:
                    target = unescape(w["text"][s["start"] : s["end"]])
                    loss.update(target.encode())
                    n_loss += len(target)
                n_all += len(w["text"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([n_loss], pa.int64()), pa.array([loss.hexdigest()]), pa.array([n_all], pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return windows.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
