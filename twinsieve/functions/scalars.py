"""Scalar expressions on names, paths, pages, vectors and hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pair_lo(a: str, b: str) -> Column:
    return F.least(F.col(a), F.col(b))


def pair_hi(a: str, b: str) -> Column:
    return F.greatest(F.col(a), F.col(b))


def holds(condition: Column) -> Column:
    """A condition that is false, not null, where a signal is missing."""
    return F.coalesce(condition, F.lit(False))


def page_number(path: str, pattern: str = r"(?i)page[_-]?(\d+)") -> Column:
    """The number after page_ in a name; null without one."""
    return F.regexp_extract(F.col(path), pattern, 1).try_cast("int")


def panel_number(path: str) -> Column:
    return F.regexp_extract(F.col(path), r"panel(\d+)", 1).try_cast("int")


def first_number_token(path: str) -> Column:
    """The first token of only digits after splitting at _ and -; null without one."""
    tokens = F.filter(F.split(F.regexp_replace(F.col(path), r"[_-]", "_"), "_"), lambda x: x.rlike("^[0-9]+$"))
    return F.try_element_at(tokens, F.lit(1)).try_cast("int")


def page_of(value: Column) -> Column:
    """'page_3', '3' and 3 are all 3."""
    return F.regexp_replace(value.cast("string"), "^page_", "").try_cast("int")


def base_name(path: str) -> Column:
    return F.element_at(F.split(F.col(path), "/"), -1)


def stem(path: str) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def safe_name(name: str) -> Column:
    """Letters, digits, dot, dash and underscore; others become underscores; 100 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.col(name), r"[^A-Za-z0-9._-]", "_")), 1, 100)


def title_label(modality: str) -> Column:
    return F.concat(F.initcap(F.replace(F.col(modality), F.lit("_"), F.lit(" "))), F.lit("-Specific"))


#: Fixed order: the first keyword in a path decides ("tem" also matches "item").
KEYWORDS = (("confocal", "confocal"), ("fluor", "confocal"), ("ihc", "bright_field"), ("dab", "bright_field"), ("hema", "bright_field"), ("gel", "gel"), ("blot", "gel"), ("tem", "tem"), ("electron", "tem"))


def modality_from_path(path: str) -> Column:
    out = F.lit("unknown")
    for word, modality in reversed(KEYWORDS):
        out = F.when(F.lower(F.col(path)).contains(word), modality).otherwise(out)
    return out


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: str, least: float = 1e-12) -> Column:
    """The vector over its length; a length under the guard counts as the guard."""
    length = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: x.cast("double") / length)


def hamming(a: str, b: str) -> Column:
    """Differing bits of two 64-bit words; 999 where one is missing."""
    return F.coalesce(F.bit_count(F.col(a).bitwiseXOR(F.col(b))), F.lit(999))


def hex16(h: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(h)), 16, "0"))


def adaptive_prefix(n: int) -> int:
    """Hex digits to block by, for so many records."""
    return 3 if n < 100 else 4 if n < 500 else 5


def unified_score(cosine: str, ssim: str, inliers: str) -> Column:
    """The larger of the mean of cosine and SSIM and tanh(inliers / 50), within 0 and 1."""
    c, s = (F.least(F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for x in (cosine, ssim))
    return F.greatest((c + s) * 0.5, F.tanh(F.coalesce(F.col(inliers), F.lit(0)) / 50.0))


def tile_confidence(ssim: str, ncc: str) -> Column:
    return (F.col(ssim) + F.col(ncc)) / 2


def cost_seconds(n: int) -> float:
    """The published cost model: seconds for so many panels."""
    return 60 * n / 221 if n < 500 else 180 * (n / 1000) ** 1.5 if n < 1000 else 600 * (n / 5000) ** 1.3 if n < 5000 else 1200 * n / 10000


def transform_kind(name: str) -> Column:
    """What a transform's name says: rotate, mirror, brightness, crop, blur, jpeg or other."""
    c, out = F.col(name), F.lit("other")
    for word in ("rotate", "mirror", "brightness", "crop", "blur", "jpeg"):
        out = F.when(c.startswith(word), word).otherwise(out)
    return out


def transform_amount(name: str) -> Column:
    """The number in `rotate_90`, `brightness_+20`, `brightness_-15` or `crop_15pct`; null without one."""
    return F.nullif(F.regexp_extract(F.col(name), r"_([+-]?\d+)(?:pct)?$", 1), F.lit("")).try_cast("int")


def crop_margin(name: str, w: str, h: str) -> Column:
    """Pixels that a crop takes from each edge: half its share of the shorter side, cut to whole ones."""
    return F.when(transform_kind(name) == "crop", F.floor(F.least(w, h) * transform_amount(name) / 100 / 2).cast("int"))


def prefix_digits(n: str) -> Column:
    """Hex digits to block by, for so many records."""
    return F.when(F.col(n) < 100, 3).when(F.col(n) < 500, 4).otherwise(5)


def expected_seconds(n: str) -> Column:
    """cost_seconds() of a column."""
    x = F.col(n)
    return F.when(x < 500, 60 * x / 221).when(x < 1000, 180 * F.pow(x / 1000, F.lit(1.5))).when(x < 5000, 600 * F.pow(x / 5000, F.lit(1.3))).otherwise(1200 * x / 10000)


def run_size(n: str) -> Column:
    """Small runs check every pair, medium ones only triggered pairs, large ones seek pairs by lists, very large ones with tight thresholds."""
    return F.when(F.col(n) < 500, "small").when(F.col(n) < 1000, "medium").when(F.col(n) < 5000, "large").otherwise("very large")
