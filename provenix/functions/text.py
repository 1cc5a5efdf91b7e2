"""File names, search texts and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenix.functions import hashing

# Tags by word of a file name.
TAGS = {
    "drone": ("Drone", "Telemetry", "Aerial"), "telemetry": ("Telemetry", "Data Overlay"), "satellite": ("Satellite", "Reconnaissance", "Spatial"), "recon": ("Reconnaissance", "Military"),
    "crypto": ("Cryptography", "Network", "Secure Tunnel"), "leak": ("Intelligence Leak", "Data Breach"), "protest": ("Protest", "Crowd", "Civil Unrest"), "crowd": ("Crowd", "Urban"),
    "document": ("Document", "Text Analysis"), "map": ("Map", "Geospatial"),
}
# Scenes by part of a file name: of each list the first that fits; a subject's scene goes before a setting's.
SETTINGS = (
    (("drone", "telemetry"), "Aerial drone view showing topographical overlay metrics."), (("satellite", "recon"), "High-altitude satellite reconnaissance imagery."),
    (("crypto", "leak", "tunnel"), "Logical cybersecurity network diagram."), (("pahalgam", "pahalgram"), "Scenic mountain valley and river photography."),
)
SUBJECTS = (
    (("building",), "Urban architecture composition."), (("human",), "Individual portrait photography."), (("vehicle",), "Vehicle capture on transportation roadway."), (("cat",), "Close-up domestic pet photography."),
)
NO_SCENE = "Visual media composition."
PLAIN_NAMES, SURE, UNSURE = ("pahalgram", "drone", "satellite"), 85, 60
# Sources of pictures: tags in names, generators by part of a name, brands, sizes of screens (either way round), shares of a hash's hundredths.
SOURCE_TAGS = ("IPHONE", "ANDROID", "DSLR", "SCREENSHOT", "WHATSAPP", "INSTAGRAM", "MIDJOURNEY", "FLUX", "CHATGPT", "SDXL")
GENERATORS = (("MIDJOURNEY", ("midjourney",)), ("FLUX", ("flux",)), ("CHATGPT", ("chatgpt", "dall")), ("SDXL", ("sd", "stable")))
PHONES = ("apple", "samsung", "oneplus", "google", "xiaomi", "huawei", "motorola", "oppo", "vivo", "realme")
CAMERAS = ("nikon", "canon", "sony", "fujifilm", "pentax", "olympus", "panasonic", "leica", "hasselblad")
SCREEN_SIZES = ((1920, 1080), (2560, 1440), (1280, 720), (2340, 1080), (2532, 1170), (2778, 1284))
SOURCE_SHARES = (("IPHONE", 25), ("ANDROID", 50), ("DSLR", 70), ("WHATSAPP", 85), ("INSTAGRAM", 100))
# End of fixed values.


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), F.array().cast("array<string>"))


def tags(filename: Column, kind: Column | None = None, mime: Column | None = None, known: dict[str, tuple[str, ...]] = TAGS, most: int = 5) -> Column:
    """At most ``most`` different tags, in alphabetical order: of the name's words, of the format and of video or image."""
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.flatten(F.array_compact(F.transform(words(filename), lambda w: table[w])))
    if kind is not None:
        found = F.concat(found, F.array_compact(F.array(F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("Format: "), kind)))))
    if mime is not None:
        found = F.concat(found, F.array(F.when(F.coalesce(mime, F.lit("")).startswith("video/"), "Video Format").otherwise("Image Format")))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def scene(filename: Column) -> Column:
    """struct<scene, confidence> of what a file name says is shown."""
    n = F.lower(F.coalesce(filename, F.lit("")))
    out = F.lit(NO_SCENE)
    for parts, text in (*SETTINGS[::-1], *SUBJECTS[::-1]):
        out = F.when(_holds(n, parts), text).otherwise(out)
    return F.struct(out.alias("scene"), F.when(_holds(n, PLAIN_NAMES), SURE).otherwise(UNSURE).alias("confidence"))


def cleaned_query(filename: Column) -> Column:
    """Search text of a file name: no extension, separators as blanks, filler words dropped, blanks squeezed."""
    s = F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[^.]*$", "")
    s = F.regexp_replace(s, r"[_|\-]", " ")
    s = F.regexp_replace(s, r"(?i)\b(copy|final|edited|img)\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def script(text: Column) -> Column:
    """First of three scripts found in a text."""
    return F.when(text.rlike("[\\u0400-\\u04FF]"), "Cyrillic").when(text.rlike("[\\u0900-\\u097F]"), "Devanagari").when(text.rlike("[\\u0600-\\u06FF]"), "Arabic").otherwise("Latin or other")


def domain(url: Column) -> Column:
    """Host of an http address without a leading www; null if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "https?://([^/]+)", 1)
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def url_source(url: Column) -> Column:
    d = F.lower(F.coalesce(domain(url), F.lit("")))
    return F.when(d.contains("reddit"), "reddit").when(d.rlike("news|times|post"), "news").otherwise("other")


def found_date(text: Column, today: str) -> Column:
    """First ISO date in a text, else its first ten characters, else ``today``."""
    iso = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(iso != "", iso).when(F.length(F.coalesce(text, F.lit(""))) > 0, F.substring(text, 1, 10)).otherwise(today)


def match_confidence(n_matches: Column, base: int = 55, step: int = 12, most: int = 95) -> Column:
    """55 plus 12 for each matching tag, at most 95; without a match a fixed 55."""
    return F.least(F.lit(most), F.lit(base) + F.lit(step) * n_matches).cast("int")


def file_source(filepath: Column, filename: Column, make: Column, model: Column, width: Column, height: Column, fake: Column) -> Column:
    """Source of a picture: by a tag in its name, for generated ones by generator, else screenshot, channel, brand, and last by a hash of the name."""
    text = lambda c: F.coalesce(c, F.lit(""))
    name, low, path, brand = text(filename), F.lower(text(filename)), F.lower(text(filepath)), F.lower(F.concat_ws("|", text(make), text(model)))
    sized = F.lit(False)
    for a, b in SCREEN_SIZES:
        sized = sized | (F.greatest(width, height) == a) & (F.least(width, height) == b)
    shot = low.contains("screenshot") | path.contains("screenshot") | path.endswith(".png") | (F.coalesce(sized, F.lit(False)) & (text(make) == ""))
    by_hash, percent = F.lit(SOURCE_SHARES[-1][0]), hashing.md5_mod(filename, 100)
    for source, upto in SOURCE_SHARES[-2::-1]:
        by_hash = F.when(percent < upto, source).otherwise(by_hash)
    apple = F.lower(text(make)).contains("apple") | F.lower(text(model)).contains("iphone")
    rules = [(shot, F.lit("SCREENSHOT")), (low.contains("whatsapp") | path.contains("whatsapp"), F.lit("WHATSAPP")), (_holds(low, ("insta", "fb")), F.lit("INSTAGRAM")),
             (_holds(brand, PHONES), F.when(apple, "IPHONE").otherwise("ANDROID")), (_holds(brand, CAMERAS), F.lit("DSLR"))]
    made = F.element_at(F.array(*[F.lit(g) for g, _ in GENERATORS]), hashing.md5_mod(filename, len(GENERATORS)) + 1)
    for source, parts in GENERATORS[::-1]:
        made = F.when(_holds(low, parts), source).otherwise(made)
    out = by_hash
    for rule, source in [(F.coalesce(fake, F.lit(False)), made), *rules][::-1]:
        out = F.when(rule, source).otherwise(out)
    for tag in SOURCE_TAGS[::-1]:
        out = F.when(name.contains(f"_src_{tag}_"), tag).otherwise(out)
    return out


def source_identity(filename: Column) -> Column:
    """The original a file was made from: its name up to the first variant suffix."""
    stem = F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[^.]*$", "")
    return F.lower(F.regexp_replace(stem, r"(?i)_(src|copy|resized|compressed|crop|cropped|watermark|watermarked|screenshot)(_.*)?$", ""))


def mime_class(filename: Column) -> Column:
    """Mime type told by the extension; null if it is not a known one."""
    ext = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, exts in {"image/jpeg": ("jpg", "jpeg"), "image/png": ("png",), "image/webp": ("webp",), "image/tiff": ("tif", "tiff"), "video/mp4": ("mp4",), "video/quicktime": ("mov",)}.items():
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return out
