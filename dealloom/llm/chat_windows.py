"""Operator 10: conversations as budgeted, turn-aligned training windows with a loss mask.

Prefix sums of the turns' tokens cut a conversation into spans that fit the budget whole (a longer
turn is a span of its own): the end of a span is found by binary search in the sums. A window repeats
the system turn and the last turns before its span, as far as the budget and a limit allow, then has
its own turns; only its own assistant turns carry loss, so each assistant text is a target once.

Turns are put in order by ranges, so a long conversation lies in many partitions. Its places and sums
come from one count for each partition and one sum for each stretch of STRETCH turns, and spans are cut
within stretches, so no task holds a conversation. Windows are made of numbers alone, and texts join
them once, by a key of each row. Only
digests(), whose hash is sequential by its nature, streams the windows of a conversation in one task.

Template: <|im_start|>role, line feed, text, <|im_end|>, line feed. Inside roles and texts a backslash
becomes two, and "<|" becomes "<", backslash, "|": control strings cannot arise, and parse() reverses it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealloom.llm.annotate import small_batches
from dealloom.llm.scratch import written
from dealloom.llm.token_counts import token_counts

BUDGET = 1024  # tokens of a window; room for the system turn and history is set aside
HISTORY = 256  # most tokens of repeated turns besides the system turn
STRETCH = 4096  # turns; a span ends with each stretch
PREFIX = 64  # characters of a text in the bounds of ranges, which go to the driver
OTHER, SYSTEM, ASSISTANT = range(3)  # kinds of roles
_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row of the partition below
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def _spans(batches: Iterator[pa.RecordBatch], budget: int, history: int) -> Iterator[pa.RecordBatch]:
    """Turns of stretches with the tokens before them and their span, which is named by its first turn."""
    names = ["conv_id", "at", "seq", "tokens", "kind", "before", "span", "system"]
    for batch in batches:
        turns = batch.column("turns")
        sizes = pc.list_value_length(turns).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(turns)
        seq, at, tokens, kind = (pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("seq", "at", "tokens", "kind"))
        before, system = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("before", "system"))
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0], np.cumsum(tokens)])
        span = np.empty(len(seq), np.int64)
        for hi, size, of_system in zip(ends, sizes, system):
            i = hi - size
            while i < hi:
                room = budget if seq[i] == 1 else budget - of_system - history
                j = min(hi, max(i + 1, np.searchsorted(sums, sums[i] + room, "right") - 1))
                span[i:j] = seq[i]
                i = j
        starts = np.repeat(before - sums[ends - sizes], sizes)
        conv = batch.column("conv_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        columns = [at, seq, tokens, kind, starts + sums[:-1], span, np.repeat(system, sizes)]
        yield pa.RecordBatch.from_arrays([conv, *map(pa.array, columns)], names)


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _placed(turns: DataFrame, budget: int, history: int, tokenizer: str | None, stretch: int) -> tuple[DataFrame, DataFrame]:
    """Turns with a key and their formatted text, and the numbers of each key: conversation, place, tokens, kind and span."""
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    form = F.concat(F.lit(START), escaped(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END + "\n"))
    rows = small_batches(clean).repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = written(rows.select(F.monotonically_increasing_id().alias("at"), "conv_id", "turn", "role", form.alias("form")))
    sized = placed.select("at", "conv_id", "role", F.ceil(F.length("form") / 4).alias("tokens"))
    if tokenizer:
        texts = placed.select("at", "conv_id", "role", F.col("form").alias("text"))
        sized = token_counts(texts, tokenizer, ["at", "conv_id", "role"]).select("row.*", F.col("n_tokens").alias("tokens"))
    # A conversation's rows of a partition have consecutive keys: its place there is a difference of keys.
    part = F.shiftright("at", _ROW_BITS)
    counts = placed.groupBy(F.col("conv_id").alias("c"), part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    counts = counts.withColumn("placed", F.sum("n").over(Window.partitionBy("c").orderBy("part")) - F.col("n"))
    sized = sized.join(counts, same("conv_id", "c") & (part == F.col("part"))).withColumn("seq", F.col("placed") + F.col("at") - F.col("first_at") + 1)
    kind = F.when(F.col("role") == "system", SYSTEM).when(F.col("role") == "assistant", ASSISTANT).otherwise(OTHER).cast("long")
    sized = sized.withColumn("kind", kind)
    head = F.max(F.when((F.col("seq") == 1) & (F.col("kind") == SYSTEM), F.col("tokens")))
    stretches = sized.groupBy("conv_id", F.floor((F.col("seq") - 1) / stretch).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "tokens", "kind"))).alias("turns"), F.sum("tokens").alias("total"), head.alias("head"))
    stretches = written(stretches)
    along = Window.partitionBy("c").orderBy("s")
    sums = stretches.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), "total", "head")
    sums = sums.select("c", "s", (F.sum("total").over(along) - F.col("total")).alias("before"), F.coalesce(F.first("head").over(along), F.lit(0)).alias("system"))
    cut = stretches.join(sums, same("conv_id", "c") & (F.col("stretch") == F.col("s"))).select("conv_id", "turns", "before", "system")
    spans = written(cut.mapInArrow(partial(_spans, budget=budget, history=history), "conv_id long, at long, seq long, tokens long, kind long, before long, span long, system long"))
    return placed, spans


def turn_spans(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """Turns in order with their formatted text, its tokens, and the span of the conversation they are in.

    Order is by turn, then role and text, so ties and repeated rows have one defined order (a null
    turn comes first). A null role or text is an empty one. Rows without a conversation form one of
    their own. Tokens are those of each formatted turn by the sentencepiece model at tokenizer, or
    a quarter of its characters where none is given.
    """
    placed, spans = _placed(turns, budget, history, tokenizer, stretch)
    return placed.join(spans.drop("conv_id", "kind"), "at").drop("at")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """Rows of windows in order: conv_id, span, place, form, repeated and target.

    A window is the rows of one (conv_id, span) by place. repeated marks the system turn and history,
    target the turns with loss: the window's own assistant turns.
    """
    placed, rows = _placed(turns, budget, history, tokenizer, stretch)
    own = rows.withColumns({"repeated": F.lit(False), "target": F.col("kind") == ASSISTANT})
    first = rows.groupBy("conv_id", "span").agg(F.min("seq").alias("first_seq"), F.min("before").alias("first_before"), F.greatest(F.lit(0), F.least(F.lit(history), budget - F.max("system") - F.sum("tokens"))).alias("room"))
    later = first.filter("first_seq > 1")
    # The system turn of a conversation is its first turn, if it has that role.
    is_system = (F.col("seq") == 1) & (F.col("kind") == SYSTEM)
    system = rows.filter(is_system)
    system = later.select(F.col("conv_id").alias("c"), F.col("span").alias("s")).join(system.drop("span"), same("c", "conv_id")).select("conv_id", F.col("s").alias("span"), "seq", "at")
    # History: turns that start within the room before the span's start; they lie in the blocks of the budget next to it.
    old = rows.drop("span").withColumn("block", F.floor(F.col("before") / budget)).filter(F.col("tokens") <= history).filter(~is_system)
    near = later.withColumn("near", F.explode(F.sequence(F.floor((F.col("first_before") - history) / budget), F.floor(F.col("first_before") / budget))))
    old = near.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "near", "first_seq", "first_before", "room").join(old, same("c", "conv_id") & (F.col("near") == F.col("block")))
    old = old.filter("seq < first_seq AND before >= first_before - room").select("conv_id", F.col("s").alias("span"), "seq", "at")
    again = system.unionByName(old).withColumns({"repeated": F.lit(True), "target": F.lit(False)})
    names = ["conv_id", "span", F.col("seq").alias("place"), "at", "repeated", "target"]
    members = own.select(*names).unionByName(again.select(*names))
    return members.join(placed.select("at", "form"), "at").select("conv_id", "span", "place", "form", "repeated", "target")


def formatted(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """One row per window: its text, and the character ranges [start, end) of its turns and of the loss mask.

    A window is bounded by its budget, its history and its longest turn, so it is put together in one row.
    """
    parts = windows(turns, budget, history, tokenizer, stretch).groupBy("conv_id", "span").agg(F.array_sort(F.collect_list(F.struct("place", "form", "repeated", "target"))).alias("parts"))
    text = F.array_join("parts.form", "")
    ends = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(F.aggregate(F.slice("parts.form", F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x)).alias("end"), F.element_at("parts", k).alias("p")))
    turn = F.transform(ends, lambda e: F.struct((e["end"] - F.length(e["p"]["form"])).alias("start"), e["end"].alias("end"), e["p"]["repeated"].alias("repeated"), e["p"]["target"].alias("target")))
    return parts.select("conv_id", "span", text.alias("text"), turn.alias("turns"))


TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    return [(unescaped(a), unescaped(b)) for a, b in TURN.findall(text)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by conversation and span are read back one by one; only running digests are kept."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state = None, None
    out: list[tuple] = []

    def close() -> None:
        if state:
            out.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        out.clear()
        return made

    for batch in batches:
        for row in batch.to_pylist():
            if now != (row["conv_id"],):
                close()
                now, state = (row["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[4] += len(row["text"])
            for place in row["turns"]:
                role, text = parse(row["text"][place["start"] : place["end"]])[0]
                if not place["repeated"]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if place["target"]:
                    state[2] += len(text)
                    state[3].update(text.encode())
        yield batch_of()
    close()
    yield batch_of()


def digests(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the windows."""
    rows = formatted(turns, budget, history, tokenizer, stretch).repartition("conv_id").sortWithinPartitions("conv_id", "span")
    return rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
