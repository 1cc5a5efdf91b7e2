"""Rule-based scores of one item from its metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has(exif: Column, *keys: str) -> Column:
    """Whether any of the tags is there and not empty."""
    out = F.lit(False)
    for k in keys:
        out = out | F.coalesce(F.trim(F.element_at(exif, k)) != "", F.lit(False))
    return out


def exif_count(exif: Column) -> Column:
    return F.coalesce(F.when(exif.isNotNull(), F.size(exif)), F.lit(0))


def exif_time(exif: Column, created: Column) -> Column:
    """Capture time from the first of three tags in one of four spellings, else ``created``."""
    text = F.trim(F.coalesce(*[F.when(F.trim(F.element_at(exif, k)) != "", F.element_at(exif, k)) for k in ("DateTimeOriginal", "DateTime", "DateTimeDigitized")]))
    shape = {r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$": "yyyy:MM:dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$": "yyyy-MM-dd HH:mm:ss",
             r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$": "yyyy:MM:dd HH:mm:ss.SSSSSS", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$": "yyyy-MM-dd'T'HH:mm:ss"}
    parsed = [F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f))).cast("timestamp_ntz") for p, f in shape.items()]
    return F.coalesce(*parsed, created.cast("timestamp_ntz"))


def metadata_trust(exif: Column, edited: Column) -> Column:
    """15 without tags; else 100 less 30 for no camera, no time and editing software each, 10 for no position; at least 10."""
    less = lambda c, n: F.when(c, n).otherwise(0)
    trust = 100 - less(~has(exif, "Make", "Model"), 30) - less(~has(exif, "DateTimeOriginal", "DateTime"), 30) - less(F.coalesce(edited, F.lit(False)), 30) - less(~has(exif, "GPSInfo"), 10)
    return F.when(exif_count(exif) == 0, 15).otherwise(F.greatest(F.lit(10), trust))


def compression_status(quality: Column, blockiness: Column) -> Column:
    """HEAVY below quality 30 or above blockiness 1.8, LOW below 90 or above 1.3, else CLEAN; unknown values don't count."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(quality < 30) | yes(blockiness > 1.8), "HEAVY").when(yes(quality < 90) | yes(blockiness > 1.3), "LOW").otherwise("CLEAN")


def name_flags(filename: Column) -> dict[str, Column]:
    """What a file name says was done to the picture."""
    n = F.lower(F.coalesce(filename, F.lit("")))
    return {"cropped": n.contains("crop"), "resized": n.contains("resize"), "watermarked": n.contains("watermark"), "compressed": n.rlike("compress(ed|ion)"), "screenshot": n.rlike("screenshot|capture")}


def _sum(parts: list[tuple[Column, int]]) -> Column:
    return sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in parts), F.lit(0))


def _trust_band(trust: Column) -> Column:
    return F.when(trust < 30, 20).when(trust < 60, 10).when(trust < 90, 5).otherwise(0)


def _extra(forest: Column, tamper: Column, stego: Column) -> Column:
    forest, tamper, stego = (F.coalesce(c, F.lit(0)) for c in (forest, tamper, stego))
    a = F.when(forest >= 75, 30).when(forest >= 50, 20).when(forest >= 30, 10).otherwise(0)
    b = F.when((tamper >= 90) & (forest >= 30), 15).when((tamper >= 75) & (forest >= 30), 10).when((tamper >= 50) & (forest >= 50), 5).otherwise(0)
    return a + b + F.when(stego >= 50, 15).when(stego >= 30, 10).otherwise(0)


def integrity(flags: dict[str, Column], trust: Column, origin: Column, forest: Column, tamper: Column, stego: Column) -> Column:
    """100 less the deductions, within 10 and 100, not above the origin's; then less what the detectors take off."""
    f = flags
    base = 100 - _sum([(f["cropped"], 15), (f["resized"], 10), (f["watermarked"], 15), (f["compressed"], 20), (f["screenshot"], 25)]) - _trust_band(trust)
    base = F.greatest(F.lit(10), F.least(F.lit(100), base))
    base = F.least(base, F.coalesce(origin, F.lit(100)))
    return F.greatest(F.lit(10), F.least(F.lit(100), base - _extra(forest, tamper, stego)))


def risk(flags: dict[str, Column], trust: Column, stripped: Column, forest: Column, tamper: Column, stego: Column) -> Column:
    """Sum of the additions within 0 and 95, before and after those of the detectors."""
    f = flags
    base = _sum([(f["cropped"], 15), (f["resized"], 10), (f["watermarked"], 20), (f["compressed"], 25), (f["screenshot"], 15), (stripped, 10)]) + _trust_band(trust)
    base = F.greatest(F.lit(0), F.least(F.lit(95), base))
    return F.greatest(F.lit(0), F.least(F.lit(95), base + _extra(forest, tamper, stego)))


def consensus(ai: Column, forest: Column, trust: Column, screenshot: Column, stego: Column, stripped: Column) -> Column:
    """State of the first rule that holds."""
    quiet = (forest < 40) & (screenshot < 25) & (stego < 20)
    backed = (forest >= 40) | (screenshot >= 25) | (stego >= 25) | ((trust <= 50) & (forest >= 25))
    return (F.when((ai >= 90) & (forest >= 70) & (trust <= 30), "HIGH_CONFIDENCE_AI_GENERATED").when((ai >= 80) & F.coalesce(stripped, F.lit(False)) & quiet, "MIXED_SIGNALS")
            .when((ai >= 80) & backed, "LIKELY_AI_GENERATED").when((ai >= 80) & (trust >= 80) & quiet, "MIXED_SIGNALS")
            .when((ai < 30) & (forest < 20) & (trust >= 90) & (stego < 15) & (screenshot < 15), "VERIFIED_AUTHENTIC").when((ai < 50) & (forest < 30) & (trust >= 80), "LIKELY_AUTHENTIC").otherwise("INVESTIGATE_FURTHER"))


# Weights of the kinds of evidence.
EVIDENCE = {"visual": 35, "semantic": 15, "metadata": 15, "dimension": 15, "compression": 10, "timeline": 10}
# End of fixed values.


def evidence_confidence(parts: dict[str, Column]) -> Column:
    """struct<confidence, level, sufficiency> from the parts (0 to 100) that are not null."""
    weight = sum((F.when(parts[k].isNotNull(), w).otherwise(0) for k, w in EVIDENCE.items() if k in parts), F.lit(0))
    total = sum((F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in EVIDENCE.items() if k in parts), F.lit(0.0))
    score = F.when(weight == 0, 0).otherwise(F.least(F.lit(98), F.bround(F.try_divide(total, weight), 0).cast("int")))
    level = F.when(weight == 0, "Low").when(score >= 80, "High").when(score >= 60, "Medium").otherwise("Low")
    enough = F.when(weight >= 80, "Strong").when(weight >= 50, "Moderate").when(weight >= 35, "Weak").otherwise("Insufficient")
    return F.struct(score.alias("confidence"), level.alias("level"), enough.alias("sufficiency"))


def ai_fusion(logit: Column, exif: Column, fft: Column, block: Column) -> Column:
    """Logistic fusion of detector logit and three indicators, in whole per cent within 2 and 98."""
    z = 0.014536 * logit / 20 - 1.488286 * exif - 0.64545 * fft - 0.413436 * block + 1.558882
    return F.greatest(F.lit(2), F.least(F.lit(98), (100 / (1 + F.exp(-z))).cast("int")))


def likely_channel(exif: Column, quality: Column, blockiness: Column, screenshot: Column) -> Column:
    """Where a picture without tags probably came through; array of one or two hints."""
    squeezed = F.coalesce((quality < 75) | (blockiness > 1.4), F.lit(False))
    return (F.when(exif_count(exif) > 0, F.when(has(exif, "Make", "Model"), F.array(F.lit("Camera"))).otherwise(F.array(F.lit("Editor"))))
            .when(squeezed, F.array(F.lit("Messaging"), F.lit("Social Media"))).when(F.coalesce(screenshot > 40, F.lit(False)), F.array(F.lit("Screenshot"))).otherwise(F.array(F.lit("Web"))))


def verdict(risk_score: Column) -> Column:
    return F.when(risk_score > 65, "Manipulated").when(risk_score > 35, "Suspicious").otherwise("Authentic")


# Sizes of screens, longer side first, and ratios of screens.
SCREENS = ((1920, 1080), (2560, 1440), (1280, 720), (1440, 900), (2340, 1080), (2532, 1170), (2778, 1284))
RATIOS = (16 / 9, 16 / 10, 4 / 3, 19.5 / 9, 20 / 9, 21 / 9, 18 / 9, 3 / 2, 5 / 4)
# End of fixed values.


def screenshot_score(fmt: Column, exif: Column, width: Column, height: Column, derived: Column, borders: Column, words: Column) -> Column:
    """15 for PNG, 20 without camera tags, 15 for a screen's size, 10 for its ratio, 15 each for dark borders and text found, 25 if derived.

    Either orientation counts. Signals that are null (borders and words need pixels) add nothing.
    """
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    long_, short = F.greatest(width, height), F.least(width, height)
    screen = F.lit(False)
    for a, b in SCREENS:
        screen = screen | ((long_ == a) & (short == b))
    ratio, near = F.try_divide(width.cast("double"), height), F.lit(False)
    for r in RATIOS:
        near = near | (F.abs(ratio - r) < 0.05) | (F.abs(F.try_divide(F.lit(1.0), ratio) - r) < 0.05)
    return (yes(F.upper(fmt) == "PNG", 15) + yes(~has(exif, "Make", "Model", "LensModel", "DateTimeOriginal"), 20) + yes(screen, 15) + yes(near, 10) + yes(borders, 15) + yes(words >= 3, 15) + yes(derived, 25))


def screenshot_band(score: Column) -> Column:
    return F.when(score >= 60, "Likely Screenshot").when(score >= 30, "Possible Screenshot").otherwise("Inconclusive")
