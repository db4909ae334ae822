"""Operations and sizes of models, images and videos in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.losses import PEAK_FLOPS


def model_flops(c: dict[str, Column], batch: int, length: Column, backward: bool = True, recompute: bool = False, flash: bool = False) -> Column:
    """Operations of a step. ``c`` holds hidden, inner, layers, heads, kv_heads, vocab and tied.

    A multiplication and an addition count as two; the backward pass costs twice the forward one,
    recomputing once more, but for the embeddings; flash attention computes its scores again.
    """
    n = F.lit(batch) * length
    mlp = c["hidden"] * c["inner"] * 6
    square = c["hidden"] * c["hidden"] * 2
    projections = square * 2 + F.floor(square * c["kv_heads"] / c["heads"]) * 2
    scores = F.lit(batch) * c["layers"] * c["hidden"] * length * length * 4
    body = n * c["layers"] * (mlp + projections) + scores
    embeddings = n * c["hidden"] * c["vocab"] * F.when(c["tied"], 1).otherwise(2)
    total = body * (1 + 2 * backward + recompute) + embeddings * (1 + 2 * backward)
    return (total + scores if flash else total).cast("long")


def mfu(steps_per_second: Column, flops: Column, device: str, workers: int = 1) -> Column:
    """The share of a device's peak that a run uses; unknown devices are refused."""
    peak = next((v for k, v in PEAK_FLOPS.items() if k in device), None)
    if peak is None:
        raise ValueError(f"no peak known of {device}")
    return steps_per_second * flops / (peak * workers)


def image_size(width: Column, height: Column, most: int, least: int) -> tuple[Column, Column]:
    """(width, height) of an image brought under ``most`` pixels and then above ``least``, in proportion."""

    def scaled(w: Column, h: Column, limit: int, wrong: Column) -> tuple[Column, Column]:
        by = F.sqrt(F.lit(float(limit)) / (w * h))
        return F.when(wrong, F.floor(w * by)).otherwise(w), F.when(wrong, F.floor(h * by)).otherwise(h)

    w, h = scaled(width.cast("long"), height.cast("long"), most, width.cast("long") * height > most)
    return scaled(w, h, least, w * h < least)


def video_size(width: Column, height: Column, most: int, least: int) -> tuple[Column, Column]:
    """As ``image_size``; then no side is under 28, and a side over 200 times the other is 180 times it."""
    w, h = image_size(width, height, most, least)
    small = F.least(w, h) < 28
    w, h = F.when(small, F.greatest(w, F.lit(28))).otherwise(w), F.when(small, F.greatest(h, F.lit(28))).otherwise(h)
    wide = w / h > 200
    return F.when(wide, h * 180).otherwise(w), F.when(~wide & (h / w > 200), w * 180).otherwise(h)


def video_frames(total: Column, seconds: Column, fps: float, most: int) -> Column:
    """Indices of the frames to take, evenly from first to last; ``total`` 0 is an endless video."""
    n = F.when(total == 0, most).otherwise(F.least(total, F.lit(most), F.greatest(F.lit(1), F.floor(seconds * fps)))).cast("int")
    last = F.when(total == 0, most - 1).otherwise(total - 1)
    at = lambda i: F.floor(F.try_divide(last.cast("double"), (n - 1).cast("double")) * i)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, 0).when(i == n - 1, last).otherwise(at(i)).cast("int"))


def pixels(text: Column) -> Column:
    """The product of an expression like "768*768", or the number that it is; NULL for other text."""
    parts = F.transform(F.split(text, r"\*"), lambda x: F.trim(x).try_cast("long"))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), F.aggregate(parts, F.lit(1).cast("long"), lambda s, x: s * x))


# --- fixed values: marks of media in a text ---------------------------------------------------------------
MARKS = {"images": "<image>", "videos": "<video>", "audios": "<audio>"}


def mark_counts(messages: Column) -> dict[str, Column]:
    """How often each mark of media stands in the messages."""
    text = F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    return {k: ((F.length(text) - F.length(F.replace(text, F.lit(v), F.lit("")))) / len(v)).cast("int") for k, v in MARKS.items()}


def media_match(messages: Column, media: dict[str, Column]) -> Column:
    """Whether every kind of media has as many items as marks; a NULL list has none."""
    out = F.lit(True)
    for k, n in mark_counts(messages).items():
        out = out & (n == (F.coalesce(F.size(media[k]), F.lit(0)) if k in media else F.lit(0)))
    return out


def unsupported(media: dict[str, Column], known: set[str]) -> Column:
    """The first kind of media that a row holds and a template does not know; else NULL."""
    out = F.lit(None).cast("string")
    for k in reversed([k for k in MARKS if k in media and k not in known]):
        out = F.when(F.coalesce(F.size(media[k]), F.lit(0)) > 0, F.lit(k)).otherwise(out)
    return out


def media_paths(items: Column, folder: str, there: Column) -> Column:
    """Each path under ``folder`` where the array ``there`` lists it, else as it is; none for an empty list."""
    base = folder.rstrip("/") + "/"
    full = F.transform(items, lambda x: F.when(F.array_contains(there, F.concat(F.lit(base), x)), F.concat(F.lit(base), x)).otherwise(x))
    return F.when(F.size(items) > 0, full)
