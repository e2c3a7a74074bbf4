"""Chat formatting: a hidden Markov model recovers who speaks in a transcript, and the turns are rendered in one form.

A transcript is a text of lines. Each line has a hidden state: a role, and
whether it begins a turn or continues one. What is seen of a line is its
speaker marker, whether the line before is blank, how it ends and its length.
The probabilities come from counts over labelled turns (all of the given table), with
one added to each step and marker and a prior that a marker names its role; the other
features are mixed with their frequencies over all states. Viterbi's path of
states, taken over many transcripts at a time, gives the turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import table, written

ROLES = ["system", "user", "assistant", "tool"]
STATES = 2 * len(ROLES)  # role r begins a turn in state 2r and continues in 2r + 1
_NAMES = {
    "system": ["system", "instructions"],
    "user": ["user", "human", "question", "q", "prompter", "customer"],
    "assistant": ["assistant", "ai", "bot", "answer", "a", "model", "agent"],
    "tool": ["tool", "function", "observation"],
}
_ROLE = {name: i for i, r in enumerate(ROLES) for name in _NAMES[r]}
_ANY = "|".join(sorted(_ROLE, key=len, reverse=True))
MARKER = re.compile(rf"\s*(?:<\|im_start\|>({_ANY})\b|<\|({_ANY})\|>|(?:#+ *)?\**({_ANY})\** ?: ?\**|\[({_ANY})\])[ \t]*", re.I)
_CLOSE = re.compile(r"(?:<\|im_end\|>|</s>)\s*$")
#: name, how many values it takes
FEATURES = [("marker", len(ROLES) + 1), ("before", 3), ("ending", 5), ("length", 6)]
#: weight of all states' frequencies within each state's, by feature: the higher, the weaker its evidence
POOLED = {"before": 0.02, "ending": 0.5, "length": 0.5}
PRIOR = 20.0  #: times that a role's marker counts as seen at its beginning, whatever the data

#: Ways in which exports mark speakers; None: a blank line alone parts the turns.
STYLES = [
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: ", "tool": "Tool: "},
    {"system": "### System:\n", "user": "### Human:\n", "assistant": "### Assistant:\n", "tool": "### Function:\n"},
    {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n", "tool": "<|tool|>\n"},
    {"system": "**Instructions:** ", "user": "Q: ", "assistant": "A: ", "tool": "Observation: "},
    None,
]


def laid_out(style: int, turns: list[tuple[str | None, str | None]]) -> tuple[list[str], list[int]]:
    """Lines of a transcript in one of ``STYLES`` and, for training, their states (-1 where the role is not known)."""
    lines: list[str] = []
    states: list[int] = []
    for role, text in turns:
        marks = STYLES[style]
        own = ((marks or {}).get(role, "") + (text or "")).split("\n")
        if marks is None and lines:
            lines.append("")
            states.append(states[-1] | 1 if states[-1] >= 0 else -1)
        r = 2 * ROLES.index(role) if role in ROLES else -1
        lines += own
        states += [r] + [r + 1 if r >= 0 else -1] * (len(own) - 1)
    return lines, states


def observed(lines: list[str]) -> np.ndarray:
    """(lines, features): the values of every feature."""
    out = np.zeros((len(lines), len(FEATURES)), np.int64)
    blank = 2
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        s = _CLOSE.sub("", line).rstrip()
        end = s[-1:]
        ending = 0 if not end else 1 if end == "?" else 2 if end in ".!" else 3 if end in ":>*" else 4
        out[i] = (1 + _ROLE[next(x for x in m.groups() if x).lower()] if m else 0, blank, ending, min(5, len(s).bit_length() // 2))
        blank = 1 if not s else 0
    return out


class Hmm:
    """Log probabilities: ``start`` (states), ``step`` (from, to), ``seen`` (a (states, values) matrix per feature)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, seen: list[np.ndarray]):
        begins = np.arange(STATES) % 2 == 0
        start = np.where(begins, start + 1.0, 0.0)
        step = step + 1.0
        role = np.arange(STATES) // 2
        step = np.where(begins[None, :] | (role[:, None] == role[None, :]), step, 0.0)  # a turn keeps its role
        marks = seen[0] + 1.0
        for r in range(len(ROLES)):
            marks[2 * r, 1 + r] += PRIOR
        seen = [marks, *(self._mixed(x, POOLED[name]) for x, (name, _) in zip(seen[1:], FEATURES[1:]))]
        with np.errstate(divide="ignore"):
            self.start, self.step = np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True))
            self.seen = [np.log(x / x.sum(axis=1, keepdims=True)) for x in seen]

    @staticmethod
    def _mixed(counts: np.ndarray, weight: float) -> np.ndarray:
        """A state's own frequencies mixed with those of all states, so that a value which a state never showed counts against it within bounds."""
        pooled = (counts.sum(axis=0) + 1.0) / (counts.sum() + counts.shape[1])
        n = counts.sum(axis=1, keepdims=True)
        return np.where(n > 0, (1 - weight) * counts / np.maximum(n, 1) + weight * pooled, pooled)

    def emission(self, features: np.ndarray) -> np.ndarray:
        return sum(table.T[features[:, k]] for k, table in enumerate(self.seen))

    def viterbi(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The likeliest states of many transcripts laid end to end; ties go to the lower state."""
        out = np.zeros(len(features), np.int64)
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        if not len(order):
            return out
        e, first = self.emission(features), bounds[order]
        v = self.start + e[first]
        back = np.zeros((len(features), STATES), np.int8)
        last = {}
        live = len(order)
        for t in range(1, int(size[order[0]])):
            now = int(np.searchsorted(-size[order], -t, side="left"))  # transcripts with a line t
            for i in range(now, live):
                last[i] = v[i].argmax()
            live, v = now, v[:now]
            through = v[:, :, None] + self.step[None]
            back[first[:now] + t] = through.argmax(axis=1)
            v = through.max(axis=1) + e[first[:now] + t]
        for i in range(live):
            last[i] = v[i].argmax()
        for i, o in enumerate(order):
            s = int(last[i])
            for at in range(int(bounds[o + 1]) - 1, int(bounds[o]) - 1, -1):
                out[at] = s
                s = int(back[at, s])
        return out


def turns_of(lines: list[str], states: np.ndarray) -> list[tuple[str, str]]:
    """``(role, text)``: markers and end signs are taken off, blank lines at the ends too."""
    turns: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, states.tolist()):
        if s % 2 == 0 or not turns:
            turns.append((ROLES[s // 2], []))
            m = MARKER.match(line)
            if m and _ROLE[next(x for x in m.groups() if x).lower()] == s // 2:
                line = line[m.end() :]
        turns[-1][1].append(_CLOSE.sub("", line))
    return [(role, "\n".join(text).strip("\n")) for role, text in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form."""
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, style, turns)``: the rows of each conversation by turn, nulls first; ties by role and text."""
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text", alone.alias("alone"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    # nulls of a struct's fields sort first in array_sort's order of structs
    return rows.groupBy("conv_id", "alone").agg(turns.alias("turns")).select("conv_id", F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int").alias("style"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _each(b: pa.RecordBatch) -> Iterator[tuple[list[str], list[int]]]:
    for style, turns in zip(b.column("style").to_pylist(), b.column("turns").to_pylist()):
        yield laid_out(style, [(t["role"], t["text"]) for t in turns])


def transcripts(turns: DataFrame) -> DataFrame:
    """``(conv_id, transcript)``: conversations as exports write them, each in one of ``STYLES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(["\n".join(lines) for lines, _ in _each(b)], pa.string())], ["conv_id", "transcript"])

    return turns.mapInArrow(run, "conv_id long, transcript string")


def train(turns: DataFrame) -> Hmm:
    """The model counted over all conversations; lines whose role is null or unknown do not count."""
    widths = [STATES, STATES * STATES, *(STATES * n for _, n in FEATURES)]
    base = np.cumsum([0, *widths])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(base[-1], np.int64)
        for b in batches:
            for lines, states in _each(b):
                s, f = np.array(states, np.int64), observed(lines)
                known = s >= 0
                total += np.bincount(s[:1][known[:1]], minlength=len(total))
                both = known[1:] & known[:-1]
                total += np.bincount(base[1] + s[:-1][both] * STATES + s[1:][both], minlength=len(total))
                for k, (_, n) in enumerate(FEATURES):
                    total += np.bincount(base[2 + k] + s[known] * n + f[known, k], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    table = turns.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(base[-1])
    total[table["cell"].to_numpy()] = table["n"].to_numpy()
    part = [total[a:z] for a, z in zip(base, base[1:])]
    return Hmm(part[0], part[1].reshape(STATES, STATES), [p.reshape(STATES, n) for p, (_, n) in zip(part[2:], FEATURES)])


def parse(table: DataFrame, model: Hmm) -> DataFrame:
    """``(conv_id, roles, rendered)`` from ``(conv_id, transcript)``, for every row.

    A null transcript gives null roles and text; an empty one is a single turn without text, of the role that
    the model expects first. conv_id is passed through, null or repeated.
    """
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [x.split("\n") if x is not None else [] for x in b.column("transcript").to_pylist()]
            bounds = np.cumsum([0, *map(len, lines)])
            features = np.concatenate([observed(x) for x in lines] or [np.zeros((0, len(FEATURES)), np.int64)])
            states = shared.value.viterbi(features, bounds)
            turns = [turns_of(x, states[a:z]) for x, a, z in zip(lines, bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column("conv_id").cast(pa.int64()), pa.array([[r for r, _ in t] if x else None for t, x in zip(turns, lines)], pa.list_(pa.string())), pa.array([render(t) if x else None for t, x in zip(turns, lines)], pa.string())], ["conv_id", "roles", "rendered"])

    return table.select("conv_id", "transcript").mapInArrow(run, "conv_id long, roles array<string>, rendered string")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``(conv_id, roles, rendered)`` per conversation: its transcript parsed by the model of all of them.

    A null text counts as empty, a null or unknown role has no marker. Rows with a null conv_id are a
    conversation each (equal ones together). An empty table gives an empty one.
    """
    turns = written(conversation_turns(conversations), "turns")  # read twice, shuffled once
    return parse(transcripts(turns), train(turns))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, roles, rendered)`` of every conversation."""
    return format_conversations(table(spark, sf_dir, "conversations"))
