"""Scalar rules as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST_PITCH, HIGHEST_PITCH = 0, 127
#: Names of the twelve pitch classes.
PITCH_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def bounded(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_up(x: Column) -> Column:
    """Rounded to the nearest integer, halves upwards."""
    return F.floor(x + 0.5)


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


def on_grid(x: Column, grid: float, origin: float = 0.0) -> Column:
    """The nearest point of the grid, never below zero; halves to even."""
    return F.greatest(F.lit(0.0), origin + half_even((x - origin) / grid) * grid)


def note_name(pitch: Column) -> Column:
    """Name and octave, with 60 as C4."""
    return F.concat(F.element_at(F.array(*map(F.lit, PITCH_NAMES)), (F.pmod(pitch, F.lit(12)) + 1).cast("int")), (F.floor(pitch / 12) - 1).cast("string"))


def smoothstep(x: Column) -> Column:
    return x * x * (3 - 2 * x)


def ticks(ms: Column, bpm: float = 120.0, per_beat: int = 480) -> Column:
    return half_even(ms * (bpm * per_beat / 60000.0)).cast("long")


def frames(ms: Column, rate: int) -> Column:
    return half_even(ms * (rate / 1000.0)).cast("long")


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; zero if they don't meet."""
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.coalesce(F.try_divide(both, F.greatest(a1, b1) - F.least(a0, b0)), F.lit(0.0))


def lyric_tokens(text: Column) -> Column:
    """Tokens of a text: each ideograph, kana or hangul syllable alone, else a word with its apostrophes."""
    return F.regexp_extract_all(text, F.lit(r"[぀-ヿ㐀-鿿가-힯]|[\p{L}\p{Nd}]+(?:['’][\p{L}]+)*"), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def beat_strength(start: Column, beat_ms: float, meter: int = 4) -> Column:
    """1.0 on the first beat of a bar, 0.72 on its middle beat, else 0.42."""
    beat = F.pmod(half_even(start / beat_ms).cast("long"), F.lit(meter))
    return F.when(beat == 0, 1.0).when(beat * 2 == meter, 0.72).otherwise(0.42)
