"""Chat formatting in budgeted windows of whole turns.

Prefix sums of the turns' tokens choose, from each start, the longest run of turns that fits the budget beside
what is carried over: the conversation's system turn, and a limited number of turns before the start. Carried turns
are masked, so every assistant turn is a target once.

Texts are escaped so that no control string can stand in them: a backslash goes between ``<`` and ``|``, after those
that are there already. Taking one out again gives the text back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from balanza.llm import words as W
from balanza.session import cut

BEGIN, END = "<|im_start|>", "<|im_end|>"
BUDGET = 1024
HISTORY_TURNS = 2
#: Windows do not cross multiples of this in a conversation's rows, numbered in order, so a conversation of any length
#: is cut into parts that a task can hold.
PART_TURNS = 1024
#: Code points of a text by which rows are dealt out for the numbering.
KEY_CHARS = 256
#: Tokens of a turn's marks besides its text and role.
MARK_TOKENS = 6

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Also without line feeds, which end a role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def plan(tokens: list[int], system: int | None, carried: int, budget: int, history: int) -> list[tuple[int, int, int, bool]]:
    """Windows (first, end, turns of history before first, system turn carried) over the turns ``carried`` … of a part.

    The turns before ``carried`` came from the part before. ``system`` is the index of the system turn, which all
    windows after it carry and count, however long it is. History takes at most a quarter of the budget, and gives
    way to a turn that would not fit beside it. A turn that does not fit beside the system turn, or is longer than
    the budget, is the only new one of its window.
    """
    sums = np.concatenate([[0], np.cumsum(tokens)])
    out, at = [], carried
    while at < len(tokens):
        led = system is not None and system < at
        lead = tokens[system] if led else 0
        back, used = 0, 0
        while back < history:
            i = at - back - 1
            if i < 0 or i == system or used + tokens[i] > budget // 4 or lead + used + tokens[i] + tokens[at] > budget:
                break
            used += tokens[i]
            back += 1
        end = int(np.searchsorted(sums, sums[at] + budget - lead - used, side="right")) - 1
        end = max(end, at + 1)
        out.append((at, end, back, led))
        at = end
    return out


def format_window(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[tuple[int, int]]]:
    """The text of turns (role, text) and the loss spans, in code points, of assistant texts past the repeated turns."""
    parts, spans, size = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
        if i >= repeated and role == "assistant":
            spans.append((size + len(head), size + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        size += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse_window(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(BEGIN, at):
            raise ValueError("a turn doesn't begin where one should")
        feed = text.index("\n", at)
        end = text.index(END, feed + 1)
        turns.append((unescape_role(text[at + len(BEGIN) : feed]), unescape(text[feed + 1 : end])))
        at = end + len(END) + 1
    return turns


_tokenizers: dict[str, object] = {}


def token_counts(path: str | None, texts: list[str]) -> list[int]:
    """Tokens of each text by a tokenizer file; without one, of its blank-separated words."""
    if path is None:
        return [len(t.split()) for t in texts]
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    out: list[int] = []
    for i in range(0, len(texts), 256):
        out += [len(e.ids) for e in _tokenizers[path].encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
    return out


def _windows(path: str | None, budget: int, history: int):
    """Rows come sorted by conversation and part; the rows of one part are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(rows: list[tuple]) -> Iterator[tuple]:
            # kind 0: carried system turn, 1: history of the part before, 2: the part's own turns
            system = next((i for i, r in enumerate(rows) if r[3] == 0), None)
            if system is not None:  # not also as history
                rows = [r for r in rows if r[3] != 1 or r[4] != rows[system][4]]
            own = sum(r[3] < 2 for r in rows)
            if own == len(rows):
                return
            if system is None:
                system = next((i for i, r in enumerate(rows) if r[3] == 2 and r[5] == "system"), None)
            tokens, turns = [r[7] for r in rows], [(r[5], r[6]) for r in rows]
            for serial, (first, end, back, lead) in enumerate(plan(tokens, system, own, budget, history)):
                picked = ([turns[system]] if lead else []) + turns[first - back : end]
                text, spans = format_window(picked, lead + back)
                total = sum(tokens[first - back : end]) + (tokens[system] if lead else 0)
                yield rows[0][0], rows[0][1], serial, text, [{"begin": a, "end": b} for a, b in spans], lead + back, len(picked), total

        def emit(done: list[tuple]) -> pa.RecordBatch:
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            types = [key_type, pa.int64(), pa.int64(), pa.string(), span, pa.int64(), pa.int64(), pa.int64()]
            names = ["conv", "part", "serial", "text", "loss", "n_repeated", "n_turns", "n_tokens"]
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=names)

        held: list[tuple] = []
        done: list[tuple] = []
        size, key_type = 0, None

        def batched(windows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal done, size
            for window in windows:
                done.append(window)
                size += len(window[3])  # carried turns count, too
                if size > W.SLICE:
                    yield emit(done)
                    done, size = [], 0

        for batch in batches:
            key_type = batch.column("conv").type
            for rows in W.slices(batch, "text"):
                columns = {c: rows.column(c).to_pylist() for c in ("conv", "part", "kind", "n", "role", "text")}
                counts = token_counts(path, [escape(t) for t in columns["text"]])
                roles = token_counts(path, columns["role"])
                for conv, part, kind, n, role, text, size_text, size_role in zip(*columns.values(), counts, roles, strict=True):
                    if held and (held[0][0], held[0][1]) != (conv, part):
                        yield from batched(finish(held))
                        held = []
                    held.append((conv, part, None, kind, n, role, text, size_text + size_role + MARK_TOKENS))
        if held:
            yield from batched(finish(held))
        if done:
            yield emit(done)

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition, and each row's place among its conversation's rows there; rows come sorted by conversation."""
    now, place, block = None, 0, TaskContext.get().partitionId()
    for batch in batches:
        places = []
        for conv in batch.column("conv").to_pylist():
            if (conv,) != now:
                now, place = (conv,), 0
            places.append(place)
            place += 1
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([block] * len(places), pa.int64()), pa.array(places, pa.int64())], names=[*names, "block", "place"])


def _numbered(rows: DataFrame) -> DataFrame:
    """(conv, role, text, n): rows numbered from 0 in each conversation by turn, role and text.

    Ranges of the order are sorted and counted; only a conversation that crosses from one range into the next has
    rows to add up, so these are no more than the ranges.
    """
    order = ["conv", "turn", "role"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, KEY_CHARS)).sortWithinPartitions(*order, "text")
    placed = cut(dealt.mapInArrow(_places, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", block long, place long"), compression="zstd")
    sizes = placed.groupBy("conv", "block").agg((F.max("place") + 1).alias("size"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    crossing = sizes.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.sum("size").over(before).alias("shift")).filter("shift is not null")
    joined = placed.join(F.broadcast(crossing), (F.col("block") == F.col("b")) & F.col("conv").eqNullSafe(F.col("c")), "left")
    return joined.select("conv", "role", "text", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("n"))


def format_windows(turns: DataFrame, tokenizer: str | None = None, budget: int = BUDGET, history: int = HISTORY_TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, serial, text, loss, n_repeated, n_turns, n_tokens): the windows of all conversations, in order of
    part and serial.

    ``loss`` has code point spans of the text; the first ``n_repeated`` turns of a window are carried over. Turns go
    by number, null first, then by role and text; equal turns all stay. Null roles and texts are empty. Rows
    with a null conversation are one conversation. Windows don't cross multiples of PART_TURNS of a conversation's
    rows in this order, whatever their turn numbers are; history and the first system turn are carried over these too.
    """
    rows = _numbered(
        turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    )
    part = F.floor(F.col("n") / PART_TURNS).cast("long")
    place = lambda p, kind: F.struct(p.alias("part"), F.lit(kind).alias("kind"))
    near = F.pmod("n", F.lit(PART_TURNS)) >= PART_TURNS - history
    own = rows.select("conv", "n", "role", "text", F.explode(F.when(near, F.array(place(part, 2), place(part + 1, 1))).otherwise(F.array(place(part, 2)))).alias("p"))
    # parts after that of a conversation's first system turn get it
    first = rows.groupBy("conv").agg(F.min(F.when(F.col("role") == "system", F.struct("n", "text"))).alias("s"), F.max(part).alias("high"))
    first = first.withColumn("low", F.floor(F.col("s.n") / PART_TURNS).cast("long") + 1).filter("low <= high")
    lead = first.select("conv", F.col("s.n").alias("n"), F.lit("system").alias("role"), F.col("s.text").alias("text"), F.explode(F.transform(F.sequence("low", "high"), lambda p: place(p, 0))).alias("p"))
    every = own.unionByName(lead).select("conv", "n", "role", "text", "p.part", "p.kind")
    dealt = every.repartition("conv", "part").sortWithinPartitions("conv", "part", "kind", "n")
    schema = f"conv {turns.schema[conv_col].dataType.simpleString()}, part long, serial long, text string, loss array<struct<begin:long,end:long>>, n_repeated long, n_turns long, n_tokens long"
    return dealt.mapInArrow(_windows(tokenizer, budget, history), schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation; only running digests are held."""
    done: list[tuple] = []
    now, state, key_type = None, None, None

    def close() -> None:
        turns, loss, n, chars, size = state
        done.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def emit() -> pa.RecordBatch:
        types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        key_type = batch.column("conv").type
        for rows in W.slices(batch, "text"):
            columns = [rows.column(c).to_pylist() for c in ("conv", "text", "loss", "n_repeated")]
            for conv, text, spans, repeated in zip(*columns, strict=True):
                if now != (conv,):
                    if now is not None:
                        close()
                    now, state = (conv,), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, body in parse_window(text)[repeated:]:
                    state[0].update(f"{role}\n{body}\n".encode())
                    state[2] += 1
                for span in spans:
                    target = unescape(text[span["begin"] : span["end"]])
                    state[1].update(target.encode())
                    state[3] += len(target)
                state[4] += len(text)
        if done:
            yield emit()
            done = []
    if now is not None:
        close()
    if done:
        yield emit()


def conversation_digests(windows: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted windows.

    The digest of a conversation runs over its turns in order, so one task reads it, window by window.
    """
    kind = windows.schema["conv"].dataType.simpleString()
    rows = windows.select("conv", "part", "serial", "text", "loss", "n_repeated").repartition("conv").sortWithinPartitions("conv", "part", "serial")
    return rows.mapInArrow(_digests, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
