"""Array functions, ``Column -> Column``, all built on native expressions."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

IGNORED_LABEL = -100  # fixed value: label cells a loss skips


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with ``value`` computed once per row, also when the
    body uses it inside the lambda of another array function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quotient(a: Column, b: int) -> Column:
    """Exact integer division."""
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest element; the first one wins a tie."""
    return F.array_position(scores, F.array_max(scores)) - 1


def seconds_to_samples(seconds: Column, sampling_rate: int) -> Column:
    """Whole samples in a duration; the fraction is cut off."""
    return (seconds * F.lit(sampling_rate)).cast("bigint")


def unmask_labels(labels: Column, pad_id: int | None, eos_id: int | None = None) -> Column:
    """Put a real token id back where labels were masked. Models without a padding
    token use the end-of-sentence id."""
    fill = pad_id if pad_id is not None else eos_id
    if fill is None:
        raise ValueError("unmask_labels needs pad_id or eos_id")
    return F.transform(labels, lambda x: F.when(x == IGNORED_LABEL, F.lit(fill)).otherwise(x))


def ctc_collapse(ids: Column, blank_id: int) -> Column:
    """Greedy CTC: drop repeats of the previous frame, then blanks.

    One linear pass: each frame is compared with the frame before it.
    """
    previous = F.concat(F.array(F.lit(None).cast("int")), ids)
    paired = F.arrays_zip(ids.alias("id"), F.slice(previous, 1, F.size(ids)).alias("prev"))
    kept = F.filter(paired, lambda p: (p["id"] != blank_id) & ~p["id"].eqNullSafe(p["prev"]))
    return F.when(ids.isNotNull(), F.transform(kept, lambda p: p["id"]))


def zscore(samples: Column) -> Column:
    """Zero mean and unit variance per utterance, in double precision."""

    def centred(x: Column) -> Column:
        n = F.size(x)
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n

        def scaled(mu: Column) -> Column:
            variance = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mu) * (v - mu)) / n
            return let(F.sqrt(variance + F.lit(1e-7)), lambda sd: F.transform(x, lambda v: (v - mu) / sd))

        return let(mean, scaled)

    # An empty utterance stays empty (0/0 would fail in ANSI mode).
    return F.when(F.size(samples) == 0, F.array().cast("array<double>")).otherwise(
        let(samples.cast("array<double>"), centred)
    )
