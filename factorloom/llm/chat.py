"""Chat formatting with loss masks aligned by token offsets."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that mean something in the template; inside texts a backslash breaks them up.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL_RE = re.compile("|".join(map(re.escape, CONTROL)) + r"|\\")
_ESCAPED_RE = re.compile(r"\\(.)", re.DOTALL)
#: Stands for nothing, between a text's white space and the template's: tokens join white space to white space.
GUARD = "\\;"


def escape(text: str) -> str:
    """A backslash before each backslash, and after the first character of each control string; a guard at ends of white space."""
    body = _CONTROL_RE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)
    return GUARD * body[:1].isspace() + body + GUARD * body[-1:].isspace()


def unescape(text: str) -> str:
    return _ESCAPED_RE.sub(lambda m: "" if m[0] == GUARD else m[1], text)


@dataclass(frozen=True)
class Template:
    """A turn is begin, role, middle, text, end. Line feeds set turns and their texts apart, so that no token spans two turns or
    an end of a text: a text's ends aren't white space, and a line feed joins nothing else."""

    begin: str = "<s>[INST] "
    middle: str = " [/INST]\n"
    end: str = "\n</s>"
    between: str = "\n"

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """The turn, and where its text lies."""
        head = self.begin + escape(role) + self.middle
        body = escape(text)
        return head + body + self.end, len(head), len(head) + len(body)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) of each turn, as they were before formatting."""
        turns, at = [], 0
        while at < len(formatted):
            if formatted.startswith(self.between, at):
                at += len(self.between)
            if not formatted.startswith(self.begin, at):
                raise ValueError(f"no turn begins at {at}")
            at += len(self.begin)
            mid = formatted.index(self.middle, at)
            stop = formatted.index(self.end, mid + len(self.middle))
            turns.append((unescape(formatted[at:mid]), unescape(formatted[mid + len(self.middle) : stop])))
            at = stop + len(self.end)
        return turns


def align(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens lie under the spans, and the characters they cover there.

    offsets: (from, to) of each token, in order; spans: (from, to), sorted and apart. A token's leading white space,
    which offsets may leave out, counts as its own. Both ends of each span are found by binary search.
    """
    mask = np.zeros(len(offsets), dtype=bool)
    covered = np.zeros((len(spans), 2), dtype=np.int64)
    if len(offsets) and len(spans):
        hi = np.maximum.accumulate(offsets[:, 1])
        lo = np.minimum(offsets[:, 0], np.concatenate(([0], hi[:-1])))
        lo = np.maximum.accumulate(lo)
        first = np.searchsorted(hi, spans[:, 0], side="right")
        last = np.searchsorted(lo, spans[:, 1], side="left")
        for k, (i, j) in enumerate(zip(first, last, strict=True)):
            if i < j and spans[k, 0] < spans[k, 1]:
                mask[i:j] = True
                covered[k] = max(lo[i], spans[k, 0]), min(hi[j - 1], spans[k, 1])
    return mask, covered


_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path]


FORMATTED = "conv_id long, segment int, formatted string, ids array<int>, token_loss array<boolean>, loss_from array<long>, loss_to array<long>"


def format_conversations(rows: DataFrame, tokenizer: str, template: Template = Template(), learn: str = "assistant", segment_chars: int = 1 << 18) -> DataFrame:
    """Formats conversations and masks what a model is to learn: the texts of the turns whose role is `learn`.

    rows: conv_id, turn, role, text (more columns are ignored), turns in order of turn, then role, then text, nulls
    first; null roles and texts count as empty; rows of a null conv_id are one conversation; repeated rows are turns. An
    empty table gives an empty table.

    Returns conv_id, segment, formatted, ids, token_loss (by token), loss_from and loss_to (the characters under the
    mask, one pair for each learnt turn). A conversation is one row, unless it is longer than segment_chars: it then goes
    on in further rows, cut between turns, where no token spans the cut; so its ids are those of one encoding of the
    whole, while a task holds one segment at a time. Its rows stay together, in order, in one partition.
    """
    text_type = [("conv_id", pa.int64()), ("segment", pa.int32()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("token_loss", pa.list_(pa.bool_())), ("loss_from", pa.list_(pa.int64())), ("loss_to", pa.list_(pa.int64()))]
    fields = pa.schema(text_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _tokenizer(tokenizer)
        conv: object = run  # no conversation yet
        segment, size = 0, 0
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        ready: list[tuple] = []

        def close() -> None:
            if parts:
                ready.append((conv, segment, "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)))

        def drain() -> pa.RecordBatch:
            done = code.encode_batch([r[2] for r in ready], add_special_tokens=False)
            out = []
            for r, e in zip(ready, done, strict=True):
                mask, covered = align(np.array(e.offsets, dtype=np.int64).reshape(-1, 2), r[3])
                out.append((r[0], r[1], r[2], e.ids, mask.tolist(), covered[:, 0].tolist(), covered[:, 1].tolist()))
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv is run or conv_id != conv:
                    close()
                    conv, segment, size, parts, spans = conv_id, 0, 0, [], []
                elif size > segment_chars:
                    close()
                    segment, size, parts, spans = segment + 1, 0, [], []
                if parts or segment:
                    parts.append(template.between)
                    size += len(template.between)
                turn, lo, hi = template.render(role or "", text or "")
                if role == learn:
                    spans.append((size + lo, size + hi))
                parts.append(turn)
                size += len(turn)
                if sum(len(r[2]) for r in ready[-1:]) > segment_chars or len(ready) >= 256:
                    yield drain()
        close()
        if ready:
            yield drain()

    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*key)
    return rows.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def masked_texts(code, ids: list[int], mask: list[bool]) -> list[str]:
    """What the tokens under the mask say, run by run."""
    on = np.array(mask, dtype=np.int8)
    edge = np.diff(np.concatenate(([0], on, [0])))
    runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
    return code.decode_batch([ids[a:b] for a, b in runs], skip_special_tokens=False)


def conversation_digests(formatted: DataFrame, tokenizer: str, template: Template = Template()) -> DataFrame:
    """What the formatted text and its mask say, read back from the operator's output, a row for each conversation. What is learnt
    is decoded from the tokens under the mask."""
    import hashlib

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    fields = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _tokenizer(tokenizer)
        state: list | None = None
        out: list[tuple] = []

        def close() -> None:
            if state is not None:
                out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def batch_of() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
            out.clear()
            return done

        for batch in batches:
            for conv_id, segment, text, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if segment == 0:
                    close()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = template.parse(text)
                state[1] += len(turns)
                for role, said in turns:
                    state[2].update(f"{role}\n{said}\n".encode())
                for learnt in map(unescape, masked_texts(code, ids, mask)):
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
            if len(out) >= 1000:
                yield batch_of()
        close()
        if out:
            yield batch_of()

    return formatted.select("conv_id", "segment", "formatted", "ids", "token_loss").mapInArrow(read, schema)
