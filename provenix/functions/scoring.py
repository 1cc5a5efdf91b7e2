"""Scores of a pair of media items from the signals that are there."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


# Thresholds and weights of the pair scorer.
@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the pair scorer."""

    hamming: int = 24
    semantic: float = 0.60
    ssim: float = 0.30
    color: float = 0.35
    cropped_ssim: float = 0.40
    cropped_color: float = 0.40
    inliers: int = 10
    match: float = 0.58
    strong: float = 0.85
    containment: dict = field(default_factory=lambda: {"features": 0.35, "ssim": 0.35, "color": 0.15, "semantic": 0.15})
    same_frame: dict = field(default_factory=lambda: {"hashes": 0.25, "ssim": 0.25, "color": 0.20, "aspect": 0.20, "jpeg": 0.10})
    full_frame: dict = field(default_factory=lambda: {"hashes": 0.25, "ssim": 0.25, "color": 0.20, "semantic": 0.20, "jpeg": 0.05, "aspect": 0.05})


# End of fixed values.


DEFAULT = Thresholds()


def aspect_similarity(w1, h1, w2, h2) -> Column:
    """1 minus the difference of the aspect ratios, at least 0; 1 if a side is missing or not positive."""
    known = F.coalesce((w1 > 0) & (h1 > 0) & (w2 > 0) & (h2 > 0), F.lit(False))
    ratio = F.abs(F.try_divide(w1.cast("double"), h1) - F.try_divide(w2.cast("double"), h2))
    return F.when(known, 1 - F.least(F.lit(1.0), ratio)).otherwise(1.0)


def jpeg_similarity(q1, q2) -> Column:
    """1 minus a hundredth of the difference in JPEG quality; 1 if either is unknown."""
    return F.coalesce(1 - F.abs(q1 - q2) / 100.0, F.lit(1.0))


def subframe(w1, h1, w2, h2) -> Column:
    """Whether one picture is strictly smaller in both directions."""
    return F.coalesce(((w1 < w2) & (h1 < h2)) | ((w2 < w1) & (h2 < h1)), F.lit(False))


def is_candidate(p: Column, d: Column, a: Column, semantic: Column, sub: Column, t: Thresholds = DEFAULT) -> Column:
    """Cheap test before scoring: any hash near, or vectors near, or one frame inside the other."""
    return (F.least(p, d, a) <= t.hamming) | (F.coalesce(semantic, F.lit(0.0)) >= t.semantic) | sub


def weighted(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the signals that are not null; null if none is."""
    there = {k: (F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0), F.coalesce(v * weights[k], F.lit(0.0))) for k, v in signals.items() if k in weights}
    total = sum((w for w, _ in there.values()), F.lit(0.0))
    return F.try_divide(sum((s for _, s in there.values()), F.lit(0.0)), total)


def variance(signals: list[Column]) -> Column:
    """Population variance of the signals that are not null."""
    v = F.array_compact(F.array(*signals))
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, e: s + e) / n
    return F.when(n > 0, F.aggregate(v, F.lit(0.0), lambda s, e: s + (e - mean) * (e - mean)) / n).otherwise(0.0)


def gate_reasons(contained: Column, ssim: Column, color: Column, inliers: Column, semantic: Column, t: Thresholds = DEFAULT) -> Column:
    """array<string> of the gates a pair fails. A signal that is missing fails no gate."""
    low = lambda c, least, name: F.when(c < least, F.lit(name))
    inside = F.coalesce(contained, F.lit(False))
    return F.array_compact(F.array(
        F.when(inside, low(ssim, t.cropped_ssim, "ssim")).otherwise(low(ssim, t.ssim, "ssim")),
        F.when(inside, low(color, t.cropped_color, "color")).otherwise(low(color, t.color, "color")),
        F.when(inside, low(inliers, t.inliers, "inliers")), F.when(semantic > 0, low(semantic, t.semantic, "semantic"))))


def gated(score: Column, reasons: Column) -> Column:
    """The score, or where a gate failed 0.3 of it within 0.05 and 0.29."""
    return F.when(F.size(reasons) > 0, F.greatest(F.lit(0.05), F.least(F.lit(0.29), score * 0.3))).otherwise(score)


def match_level(score: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when(score >= t.strong, "High Match").when(score >= t.match, "Possible Match").otherwise("No Significant Match")


def match_strength(score: Column) -> Column:
    return F.when(score >= 0.95, "Highly Correlated Match").when(score >= 0.85, "Strong Relationship").when(score >= 0.70, "Moderately Altered Variation").otherwise("Weak Similarity Match")


def containment(standard: Column, overlap: Column, confidence: Column, exceed: Column, size: Column) -> Column:
    """Score of one picture lying in another: 100 if its bounds do, else less by what sticks out, 0 if too much does.

    ``exceed`` is by how many pixels the bounds stick out, ``size`` the longer side of the outer picture.
    """
    loose = (overlap > 85) & (confidence > 50) & (exceed <= F.greatest(F.lit(50.0), size * 0.05))
    return F.when(F.coalesce(standard, F.lit(False)), 100.0).when(F.coalesce(loose, F.lit(False)), F.greatest(F.lit(50.0), 100 - exceed / 2)).otherwise(0.0)


# Channels in the order in which ties are won, and the points of each: without or with tags, by the longer
# side or the quality, where it lies in one of the spans, and where it does not.
PLATFORMS = ("WhatsApp", "Telegram", "Social Media", "Email", "Other")
CHANNEL_POINTS = (
    ("WhatsApp", "bare", "edge", ((1280, 1280), (1600, 1600)), 0.5, 0.0), ("WhatsApp", "bare", "quality", ((50, 75),), 0.3, 0.1),
    ("Telegram", "bare", "edge", ((None, 1279),), 0.4, 0.0), ("Telegram", "bare", "quality", ((50, 80),), 0.3, 0.1),
    ("Social Media", "bare", "edge", ((960, 960), (1080, 1080), (2048, 2048)), 0.4, 0.0), ("Social Media", "bare", "quality", ((70, 85),), 0.3, 0.1),
    ("Email", "tagged", "edge", ((None, None),), 0.6, 0.0), ("Email", "tagged", "quality", ((90, None),), 0.3, 0.0),
)
OTHER_POINTS, UNKNOWN_QUALITY = 0.1, 75
# End of fixed values.


def platform_scores(exif_count: Column, width: Column, height: Column, quality: Column) -> Column:
    """struct of the normalised score of each channel, rounded half even to three places."""
    bare = F.coalesce(exif_count, F.lit(0)) == 0
    value = {"edge": F.coalesce(F.greatest(width, height), F.lit(0)), "quality": F.coalesce(quality, F.lit(UNKNOWN_QUALITY))}
    raw = {k: F.lit(OTHER_POINTS if k == "Other" else 0.0) for k in PLATFORMS}
    for channel, state, what, spans, inside, outside in CHANNEL_POINTS:
        hit = F.lit(False)
        for low, high in spans:
            hit = hit | ((F.lit(True) if low is None else value[what] >= low) & (F.lit(True) if high is None else value[what] <= high))
        raw[channel] = raw[channel] + F.when(bare == (state == "bare"), F.when(hit, inside).otherwise(outside)).otherwise(0.0)
    total = sum(raw.values(), F.lit(0.0))
    return F.struct(*[F.bround(raw[k] / total, 3).alias(k) for k in PLATFORMS])


def best_platform(scores: Column) -> Column:
    top = F.greatest(*[scores[k] for k in PLATFORMS])
    out = F.lit(PLATFORMS[-1])
    for k in reversed(PLATFORMS[:-1]):
        out = F.when(scores[k] == top, k).otherwise(out)
    return out


def relationship(same_sha, filename, ssim, color, w1, h1, w2, h2, contained, platform, platform_score, q_sim) -> Column:
    """Kind of variant: the first rule that applies, from equal bytes to recompression."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    differ = F.coalesce((w1 != w2) | (h1 != h2), F.lit(False))
    ratio = F.coalesce(F.abs(F.try_divide(w1.cast("double"), h1) - F.try_divide(w2.cast("double"), h2)) <= 0.02, F.lit(False))
    via = F.when(platform.isin("WhatsApp", "Social Media", "Email") & (platform_score >= 0.5), F.concat(platform, F.lit(" Variant"))).otherwise("Resize")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (F.when(yes(same_sha), "Duplicate").when(name.contains("watermark"), "Watermarked Variant").when(name.rlike("compress(ed|ion)"), "Recompressed")
            .when(yes((ssim >= 0.98) & (color >= 0.98)) & ~differ, "Duplicate").when(yes(contained) & name.rlike("screenshot|capture") & ~name.contains("crop"), "Screenshot")
            .when(yes(contained), "Crop").when(differ & ratio, via).when(differ, "Resize").when(yes(q_sim <= 0.85), "Recompressed").otherwise("Duplicate"))


# Kinds scored as one frame within another, and as the same frame.
CONTAINED_KINDS, SAME_FRAME_KINDS = ("Screenshot", "Crop"), ("Duplicate", "Resize", "Email Variant")
# End of fixed values.


def fused(kind: Column, signals: dict[str, Column], t: Thresholds = DEFAULT) -> Column:
    """Weighted mean of the signals that are there, by the weights for the kind of relationship; null if none is."""
    return (F.when(kind.isin(*CONTAINED_KINDS), weighted(signals, t.containment)).when(kind.isin(*SAME_FRAME_KINDS), weighted(signals, t.same_frame)).otherwise(weighted(signals, t.full_frame)))


# Kinds of variant by relationship; everything else is a modified variant.
CLASSES = {
    "Cropped Variant": ("Crop", "Cropped Variant"), "Screenshot-Derived Variant": ("Screenshot", "Screenshot-Derived Variant"),
    "Resized Variant": ("Resize", "WhatsApp Variant", "Social Media Variant", "Email Variant", "Resized Variant"),
    "Watermarked Variant": ("Watermarked Variant", "Watermark"), "Compressed Variant": ("Recompressed", "Compressed Variant"), "Duplicate": ("Duplicate",),
}
# End of fixed values.


def asset_class(kind: Column) -> Column:
    out = F.lit("Modified Variant")
    for name, kinds in CLASSES.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out
