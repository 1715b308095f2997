"""Chat formatting in budgeted, turn-aligned windows.

A conversation's turns stream by in order. Running sums of their tokens decide how many new turns a window takes:
it opens with the conversation's system turn, then the last turns before it within ``history`` tokens, then new turns up to ``budget``. Repeated turns
are context only; the loss covers the text of new assistant turns, so each is trained on once. Nothing but the open window
is held, however long the conversation.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Backslashes and the opening ``<|`` inside roles and texts are escaped with a backslash (line
breaks in roles too), so control strings only ever stand for themselves and every text can be read back.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_files
from .runtime import materialize, releasing

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 256
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
_WINDOW = "conv_id long, window long, formatted string, n_turns int, n_repeated int, n_tokens long, over_budget boolean, loss array<struct<a:int,b:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


def estimate_tokens(roles: list[str], texts: list[str]) -> list[int]:
    """Of each turn: four bytes a token, and four for its marks."""
    return [4 + (len(r.encode()) + len(t.encode()) + 3) // 4 for r, t in zip(roles, texts)]


class TokenCount:
    """Tokens of each turn by a tokenizers file, and four for its marks. ``by_word``: see ``token_files.Encoder``."""

    def __init__(self, path: str, by_word: bool = False):
        self._path, self._by_word = path, by_word

    def __call__(self, roles: list[str], texts: list[str]) -> list[int]:
        enc, n = token_files.encoder(self._path, self._by_word), len(roles)
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(to) for _, _, to in enc.encode_column(pa.array([*texts, *roles], pa.string()), []))])
        return (4 + sizes[:n] + sizes[n:]).tolist()


def windows(turns, budget: int, history: int):
    """``turns``: (role, text, tokens) in order -> for each window its turns and how many of them, at the front, are repeated."""
    system, past, new, used = None, [], [], 0

    def opened():
        kept, room = [], history
        for t in reversed(past):
            if t[2] > room:
                break
            room -= t[2]
            kept.append(t)
        head = ([system] if system else []) + kept[::-1]
        return head, sum(t[2] for t in head)

    head, used, first = [], 0, True
    for turn in turns:
        if new and used + turn[2] > budget:
            yield head + new, len(head)
            past = [t for t in head + new if t is not system]
            head, used = opened()
            new = []
            while len(head) > (system is not None) and used + turn[2] > budget:  # history gives way to the new turn
                used -= head.pop(1 if system else 0)[2]
        if first and turn[0] == "system":
            system = turn
        first = False
        new.append(turn)
        used += turn[2]
    if new:
        yield head + new, len(head)


def _format_pass(budget: int, history: int, count):
    def counted(batches):
        for b in batches:
            for a in range(0, len(b), 1000):
                part = b.slice(a, 1000)
                roles, texts = (part.column(k).fill_null("").to_pylist() for k in ("role", "text"))
                yield from zip(part.column("conv_id").to_pylist(), roles, texts, count(roles, texts))

    def run(batches):
        rows = counted(batches)
        pending = next(rows, None)
        out = []

        def own(conv):
            nonlocal pending
            while pending is not None and pending[0] == conv:
                yield pending[1:]
                pending = next(rows, None)

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
        names = ["conv_id", "window", "formatted", "n_turns", "n_repeated", "n_tokens", "over_budget", "loss"]
        flush = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        while pending is not None:
            conv = pending[0]
            for w, (turns, repeated) in enumerate(windows(own(conv), budget, history)):
                parts, loss, at = [], [], 0
                for k, (role, text, _) in enumerate(turns):
                    head, body = f"{START}{escape_role(role)}\n", escape(text)
                    if role == "assistant" and k >= repeated:
                        loss.append({"a": at + len(head), "b": at + len(head) + len(body)})
                    parts.append(f"{head}{body}{END}\n")
                    at += len(parts[-1])
                tokens = sum(t[2] for t in turns)
                out.append((conv, w, "".join(parts), len(turns), repeated, tokens, tokens > budget, loss))
                if len(out) >= 500:
                    yield flush()
                    out = []
        if out:
            yield flush()

    return run


def format_conversations(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, count=estimate_tokens) -> DataFrame:
    """``rows(conv_id integer, turn, role, text)`` -> windows, a row each: ``conv_id``, ``window`` (from 0), ``formatted``, its turns and
    how many at the front are repeated, its tokens, whether a single turn overruns the budget, and the loss spans in code points.

    Turns go by turn, then role and text; repeated rows are turns of their own. Null roles and texts are empty; rows of null conv_id
    are one conversation; null turns come first. Extra columns are not read. An empty table gives no rows.
    ``count(roles, texts)``: tokens of each of some turns, such as ``TokenCount(path)``.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(releasing(_format_pass(budget, history, count)), _WINDOW)


def _read_pass(batches):
    state = None
    done = []

    def result():
        conv, n, turns, chars, loss, formatted = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    flush = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
    for batch in batches:
        for r in batch.to_pylist():
            if state is None or state[0] != r["conv_id"]:
                if state is not None:
                    done.append(result())
                state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = r["formatted"]
            state[5] += len(text)
            for k, m in enumerate(_TURN.finditer(text)):
                if k >= r["n_repeated"]:
                    state[1] += 1
                    state[2].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
            for s in r["loss"]:
                own = unescape(text[s["a"] : s["b"]])
                state[3] += len(own)
                state[4].update(own.encode())
            if len(done) >= 5000:
                yield flush()
                done = []
    if state is not None:
        done.append(result())
    if done:
        yield flush()


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from the windows alone: turns and losses in
    code points of the unescaped texts, formatted characters of all windows."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "formatted", "n_repeated", "loss")
    return rows.mapInArrow(releasing(_read_pass), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, count=estimate_tokens) -> DataFrame:
    return read_back(materialize(format_conversations(rows, budget, history, count), "chat"))
