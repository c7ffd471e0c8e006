"""Vocabulary, encoding, truncation, padding, span labels, batching and token budgets.

Token tables have one row per token: ``(seq, ..., pos, piece | id)``. Grouping and windows over
``seq`` reuse one hash partitioning, so a whole encode-label-count job shuffles the text once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kdframe.functions.text import clipped, join_ints  # noqa: F401  (re-exported for callers)
from kdframe.functions.vectors import let
from kdframe.operators.ranking import range_rank, shuffled_rank
from kdframe.session import fits, materialize

# fixed values
IGNORE = -100
DEFAULT_CONTEXT = 4096
UNKNOWN = 0  # the end-of-text marker, which every vocabulary has
SPECIALS = ("<|endoftext|>", "<|im_start|>", "<|im_end|>")

_SPECIAL_RULE = "|".join(s.replace("|", r"\|") for s in SPECIALS)
# every character belongs to exactly one piece, and markers and newlines are pieces of their own
TOKENISERS = {
    "student": _SPECIAL_RULE + r"|\n| ?\p{L}+| ?\p{N}+|[^\p{L}\p{N}]",
    "teacher": _SPECIAL_RULE + r"|\n|\p{L}{1,4}|\p{N}|[^\p{L}\p{N}]",
}
BROADCAST_PIECES = 200_000


def pieces(text: Column, tokeniser: str = "student") -> Column:
    return F.regexp_extract_all(text, F.lit(TOKENISERS[tokeniser]), F.lit(0))


def explode_pieces(df: DataFrame, text: str, keep: Sequence[str], tokeniser: str = "student") -> DataFrame:
    """One row per piece, numbered by ``at`` from 0 within the row."""
    return df.select(*keep, F.posexplode(pieces(F.col(text), tokeniser)).alias("at", "piece"))


def build_vocabulary(tokens: DataFrame) -> DataFrame:
    """``(piece, n, id)``: special tokens first, then by falling count and piece.

    Counting combines map-side, so frequent pieces do not skew, and the counts are stored so that
    the text is tokenised once. The rank comes from sampled ranges of (count, piece): pieces that
    occur once, most of a large vocabulary, are spread like all others.
    """
    counted = materialize(tokens.groupBy("piece").agg(F.count(F.lit(1)).alias("n")))
    special = F.array_position(F.array(*[F.lit(s) for s in SPECIALS]), F.col("piece")) - 1
    ordinary = counted.where(~F.col("piece").isin(*SPECIALS)).withColumn("_desc", -F.col("n"))
    ranked = range_rank(ordinary, ["_desc", "piece"], "_rank")
    marked = counted.where(F.col("piece").isin(*SPECIALS)).withColumn("id", special.cast("long"))
    return ranked.select("piece", "n", (F.col("_rank") + len(SPECIALS)).alias("id")).unionByName(marked)


def lookup_ids(
    tokens: DataFrame, vocabulary: DataFrame, broadcast_rows: int = BROADCAST_PIECES, unknown: int = UNKNOWN
) -> DataFrame:
    """Attach ``id`` to every token; a piece outside the vocabulary gets ``unknown``.

    A vocabulary within ``broadcast_rows`` (counted, reading no more than that) is broadcast. A
    larger one is split: its most frequent pieces, a bounded head that holds nearly all tokens and
    all skew, are broadcast; only tokens of the rare pieces are shuffled.
    """
    ids = vocabulary.select("piece", "id")
    if fits(ids, broadcast_rows):
        return tokens.join(F.broadcast(ids), "piece", "left").na.fill({"id": unknown})
    head = ids.where(F.col("id") < broadcast_rows)
    tail = ids.where(F.col("id") >= broadcast_rows)
    probed = tokens.join(F.broadcast(head), "piece", "left")
    common = probed.where(F.col("id").isNotNull())
    rare = probed.where(F.col("id").isNull()).drop("id").join(tail, "piece", "left").na.fill({"id": unknown})
    return common.unionByName(rare)


def sequence_texts(
    fragments: DataFrame, max_length: int | None, seq: str = "conv_id", place: str = "place", text: str = "fragment"
) -> DataFrame:
    """``text`` of every sequence, long enough for its first ``max_length`` tokens; whole without a limit.

    Every fragment gives at least one token, so fragments after the ``max_length``-th are cut, by a
    group limit that works before the shuffle. A sequence of any length therefore costs at most
    that many fragments, and the grouping reuses the window's partitioning.
    """
    order = Window.partitionBy(seq).orderBy(place)
    bounded = fragments.where(F.length(text) > 0).withColumn("_nth", F.row_number().over(order))
    if max_length is not None:
        bounded = bounded.where(F.col("_nth") <= max_length)
    ordered = F.sort_array(F.collect_list(F.struct("_nth", text)))
    return bounded.groupBy(seq).agg(F.array_join(F.transform(ordered, lambda f: f[text]), "").alias("text"))


def sequence_tokens(
    fragments: DataFrame,
    max_length: int | None,
    seq: str = "conv_id",
    place: str = "place",
    text: str = "fragment",
    tokeniser: str = "student",
) -> DataFrame:
    """First ``max_length`` tokens of every sequence; ``pos`` numbers them from 0."""
    return text_tokens(sequence_texts(fragments, max_length, seq, place, text), max_length, seq, tokeniser)


def text_tokens(texts: DataFrame, max_length: int | None, seq: str = "conv_id", tokeniser: str = "student") -> DataFrame:
    """The same from (``seq``, text)."""
    found = pieces(F.col("text"), tokeniser)
    return texts.select(seq, F.posexplode(found if max_length is None else F.slice(found, 1, max_length)).alias("pos", "piece"))


def collect_ids(tokens: DataFrame, by: Sequence[str], value: str = "id", name: str = "input_ids") -> DataFrame:
    """Token rows back to one array per sequence (sequences are truncated, hence bounded)."""
    gathered = F.sort_array(F.collect_list(F.struct("pos", value)))
    return tokens.groupBy(*by).agg(
        F.transform(gathered, lambda t: t[value].cast("int")).alias(name)
    )


def context_limit(student: Column, teacher: Column, configured: Column) -> Column:
    """Smallest context of the two models and the configuration; unknown ones default."""
    default = F.lit(DEFAULT_CONTEXT)
    return F.least(F.coalesce(student, default), F.coalesce(teacher, default), configured)


def truncate(ids: Column, limit: Column | int) -> Column:
    return F.slice(ids, F.lit(1), F.lit(limit) if isinstance(limit, int) else limit)


def pad_id(pad: Column, eos: Column) -> Column:
    return F.coalesce(pad, eos, F.lit(0))


def pad_right(ids: Column, fill: Column | int, width: Column | int) -> Column:
    """Fill on the right up to ``width``; a longer row is cut."""
    width = F.lit(width) if isinstance(width, int) else width
    fill = F.lit(fill) if isinstance(fill, int) else fill
    missing = F.greatest(width - F.size(ids), F.lit(0))
    return F.slice(F.concat(ids, F.array_repeat(fill, missing)), F.lit(1), width)


def pad_left(ids: Column, fill: Column | int, width: Column) -> Column:
    fill = F.lit(fill) if isinstance(fill, int) else fill
    return F.concat(F.array_repeat(fill, F.greatest(width - F.size(ids), F.lit(0))), ids)


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda _: F.lit(1))


def pad_batch(
    df: DataFrame,
    batch: str,
    student: str,
    teacher: str,
    max_length: int,
    fill: Column | int = 0,
    teacher_fill: Column | int | None = None,
    labels: str | None = None,
) -> DataFrame:
    """Pad both sides to the batch's longest sequence of either side, at most ``max_length``, each with its own
    model's pad id, and ``labels`` with the ignored value."""
    longest = F.max(F.greatest(F.size(student), F.size(teacher))).over(Window.partitionBy(batch))
    wide = df.withColumn("width", F.least(longest, F.lit(max_length)))
    if labels is not None:
        wide = wide.withColumn(labels, pad_right(F.col(labels), IGNORE, F.col("width")))
    for name, fill in ((student, fill), (teacher, fill if teacher_fill is None else teacher_fill)):
        wide = wide.withColumn(f"{name}_mask", pad_right(attention_mask(F.col(name)), 0, F.col("width")))
        wide = wide.withColumn(name, pad_right(F.col(name), fill, F.col("width")))
    return wide


def copied_labels(ids: Column) -> Column:
    """Labels equal to the padded ids, prompt and padding included."""
    return ids


def mark_spans(
    tokens: DataFrame,
    start: Sequence[str | int],
    end: Sequence[str | int],
    seq: Sequence[str] = ("conv_id",),
    value: str = "piece",
    name: str = "supervised",
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Mark the tokens after a ``start`` marker sequence up to the next ``end`` marker sequence.

    A start event sits on the first token after its marker, an end event on the first token of its
    marker, and the latest event decides. The end wins when both fall on one token. ``order`` may
    name columns the tokens are already sorted by.
    """
    sorted_rows = Window.partitionBy(*seq).orderBy(*order)

    def matches(marker: Sequence[str | int], shift: int) -> Column:
        checks = [
            (F.lag(value, shift - k) if shift > k else F.lead(value, k - shift)).over(sorted_rows) == F.lit(m)
            for k, m in enumerate(marker)
        ]
        both = checks[0]
        for check in checks[1:]:
            both = both & check
        return F.coalesce(both, F.lit(False))

    event = F.when(matches(end, 0), F.lit(False)).when(matches(start, len(start)), F.lit(True))
    latest = F.last("_event", ignorenulls=True).over(sorted_rows.rowsBetween(Window.unboundedPreceding, 0))
    return (
        tokens.withColumn("_event", event)
        .withColumn(name, F.coalesce(latest, F.lit(False)))
        .drop("_event")
    )


def span_segments(text: Column, start: str, end: str) -> Column:
    """Cut text after every start marker and before every end marker, and mark the supervised parts.

    Gives ``ARRAY<STRUCT<segment, supervised>>``. A part is supervised when the part before it ends
    in the start marker, unless it begins with the end marker. The markers must be whole tokens of
    the tokeniser, as the chat markers are.
    """
    cuts = F.split(text, rf"(?<=\Q{start}\E)|(?=\Q{end}\E)")
    return let(
        cuts,
        lambda parts: F.transform(
            parts,
            lambda part, i: F.struct(
                part.alias("segment"),
                (
                    F.coalesce(F.endswith(F.get(parts, i - 1), F.lit(start)), F.lit(False))
                    & ~F.startswith(part, F.lit(end))
                ).alias("supervised"),
            ),
        ),
    )


def supervised_pieces(text: Column, start: str, end: str, tokeniser: str = "student") -> Column:
    """Tokens of a text with their span mark, ``ARRAY<STRUCT<piece, supervised>>``, without any window."""
    return F.flatten(
        F.transform(
            span_segments(text, start, end),
            lambda s: F.transform(
                pieces(s["segment"], tokeniser), lambda p: F.struct(p.alias("piece"), s["supervised"].alias("supervised"))
            ),
        )
    )


def sequence_counts(text: Column, start: str, end: str, max_length: int, tokeniser: str = "student") -> Column:
    """``STRUCT<tokens, supervised>`` of a text cut at ``max_length`` tokens; only segment sizes are used."""
    zero = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("supervised"))

    def add(acc: Column, s: Column) -> Column:
        kept = clipped(F.size(pieces(s["segment"], tokeniser)), acc["tokens"], max_length)
        return let(
            kept,
            lambda n: F.struct(
                (acc["tokens"] + n).alias("tokens"),
                (acc["supervised"] + F.when(s["supervised"], n).otherwise(0)).alias("supervised"),
            ),
        )

    return F.aggregate(span_segments(text, start, end), zero, add)


def span_labels(supervised: Column, ids: Column) -> Column:
    return F.when(supervised, ids).otherwise(F.lit(IGNORE))


def assign_batches(
    df: DataFrame, ids: Sequence[str], batch_size: int, accumulation: int = 1, seed: int = 42
) -> DataFrame:
    """``batch_id`` by seeded order, and ``step_id`` for batches accumulated into one step."""
    ranked = shuffled_rank(df, ids, seed, name="_rank")
    return (
        ranked.withColumn("batch_id", F.floor(F.col("_rank") / batch_size))
        .withColumn("step_id", F.floor(F.col("_rank") / (batch_size * accumulation)))
        .drop("_rank")
    )


def length_grouped_batches(
    df: DataFrame, ids: Sequence[str], length: str, batch_size: int, seed: int = 42, factor: int = 50
) -> DataFrame:
    """Batches of similar length: sort by length inside blocks of ``batch_size * factor`` rows."""
    ranked = shuffled_rank(df, ids, seed, name="_rank")
    block = ranked.withColumn("_block", F.floor(F.col("_rank") / (batch_size * factor)))
    inside = Window.partitionBy("_block").orderBy(F.desc(length), "_rank")
    place = F.row_number().over(inside) - 1
    return block.withColumn("batch_id", F.col("_block") * factor + F.floor(place / batch_size)).drop(
        "_rank", "_block"
    )


def padding_per_batch(df: DataFrame, batch: str, length: str) -> DataFrame:
    """Rows, tokens, padded size and padding of every batch."""
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(length).alias("tokens"),
        (F.max(length) * F.count(F.lit(1))).alias("padded"),
    ).withColumn("padding", F.col("padded") - F.col("tokens"))


def sequence_budget(
    fragments: DataFrame, max_length: int, start: str, end: str, seq: str = "conv_id"
) -> DataFrame:
    """Tokens and supervised tokens of every sequence, cut at ``max_length``; no token rows are made."""
    counts = sequence_counts(F.col("text"), start, end, max_length)
    counted = sequence_texts(fragments, max_length, seq).select(seq, counts.alias("_n"))
    return counted.select(
        seq,
        F.col("_n.tokens").cast("long").alias("tokens"),
        F.col("_n.supervised").cast("long").alias("supervised_tokens"),
    )


def budget_report(sequences: DataFrame, by: Sequence[str], max_length: int) -> DataFrame:
    """Roll-up of token and padding budgets; needs ``tokens``, ``full_tokens``, ``supervised_tokens``."""
    return sequences.rollup(*by).agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("tokens").alias("tokens"),
        F.sum("supervised_tokens").alias("supervised_tokens"),
        F.sum((F.col("full_tokens") > max_length).cast("long")).alias("truncated"),
        F.sum((F.col("supervised_tokens") == 0).cast("long")).alias("unsupervised"),
        F.percentile("tokens", 0.5).alias("median_tokens"),
        (1 - F.sum("tokens") / (F.count(F.lit(1)) * max_length)).alias("padding_ratio"),
    )
