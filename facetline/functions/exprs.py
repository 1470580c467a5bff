"""Scalar functions as Column expressions: they stay in the JVM and inside code generation where Spark can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetline.functions import constants as K


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; 1 for vectors of different lengths, empty, null or zero ones. Not clamped."""
    x, y = _doubles(a), _doubles(b)
    norms = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    ok = (F.size(x) == F.size(y)) & (F.size(x) > 0) & (norms > 0)
    return F.coalesce(F.when(ok, 1 - F.try_divide(_dot(x, y), norms)), F.lit(1.0))


def scale_vector(v: Column, by: Column) -> Column:
    return F.transform(_doubles(v), lambda x: x * by)


def add_vectors(a: Column, b: Column) -> Column:
    return F.zip_with(_doubles(a), _doubles(b), lambda x, y: x + y)


def subtract_vectors(a: Column, b: Column) -> Column:
    return F.zip_with(_doubles(a), _doubles(b), lambda x, y: x - y)


def negate_vector(v: Column) -> Column:
    return F.transform(_doubles(v), lambda x: -x)


def stored_vector(v: Column) -> Column:
    """As it is stored: float32."""
    return v.cast("array<float>")


def normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    x = _doubles(v)
    norm = F.sqrt(_dot(x, x))
    return F.when(norm > 0, F.transform(x, lambda e: e / norm)).otherwise(x)


def weighted_mean(old: Column, old_n: Column, new: Column, new_n: Column) -> Column:
    """(old * old_n + new * new_n) / (old_n + new_n), in double precision."""
    total = (old_n + new_n).cast("double")
    return F.zip_with(_doubles(old), _doubles(new), lambda a, b: (a * old_n + b * new_n) / total)


def apply_delta(mean: Column, n: Column, delta: Column, dn: Column) -> Column:
    """(mean * n + delta) / (n + dn): a sum is what merges, a mean is what is stored."""
    total = F.nullif((n + dn).cast("double"), F.lit(0.0))
    return F.zip_with(_doubles(mean), _doubles(delta), lambda a, b: (a * n + b) / total)


def round_to(v: Column, places: int) -> Column:
    """Half away from zero on the scaled double; negative places leave the value."""
    return v if places < 0 else F.round(v * 10**places) / F.lit(float(10**places))


def confidence(distance: Column) -> Column:
    return F.round(100 * (1 - distance / 2)) / F.lit(100.0)


def display_identity(name: Column, ident: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("Identity "), ident.cast("string")))


def display_variant(name: Column) -> Column:
    return F.coalesce(name, F.lit("Default"))


def system_label_id(label: Column) -> Column:
    """The id in a label like "Identity 42", in any case; else null."""
    return F.nullif(F.regexp_extract(F.trim(label), r"(?i)^identity (\d+)$", 1), F.lit("")).cast("long")


def fmt_time(seconds: Column) -> Column:
    """HH:MM:SS, truncated; hours are not bounded."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def fps(text: Column) -> Column:
    """Frames a second from "30000/1001" or "30"; null where it can't be read or the divisor is 0."""
    parts = F.split(text, "/")
    whole = F.expr("try_cast(null as double)")
    a, b = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    rate = F.when(F.size(parts) == 1, a).when(F.size(parts) == 2, F.try_divide(a, b)).otherwise(whole)
    return F.when(rate > 0, rate)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two spans overlap; spans that touch do not."""
    return (s1 < e2) & (s2 < e1)


def action_band(d1: Column, d2: Column, threshold: float = K.MATCH_THRESHOLD) -> Column:
    """What to do with a track by the distances of its two nearest variants; blank where the two are too close to tell."""
    return (
        F.when(d1.isNull() | (d1 > threshold), "new_identity")
        .when(d2.isNotNull() & (F.abs(d2 - d1) < K.AMBIGUITY_MARGIN), "")
        .when(d1 > K.REGROUP_THRESHOLD, "new_variant")
        .otherwise("merge")
    )


def link_class(s1: Column, s2: Column) -> Column:
    """Link status by the scores of the best and second-best eligible cluster."""
    return (
        F.when(s1.isNull() | (s1 > K.REGROUP_THRESHOLD), "NEW")
        .when(s2.isNotNull() & (s2 <= K.REGROUP_THRESHOLD) & (F.abs(s2 - s1) < K.AMBIGUITY_MARGIN), "AMBIGUOUS")
        .when(s1 <= K.STRONG_THRESHOLD, "STRONG")
        .otherwise("POSSIBLE")
    )


def scaled_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, scale: float = K.BOX_SCALE) -> Column:
    """Struct x1..y2: the box grown about its centre and clipped to the frame; scale 1 clips only, scale <= 0 is 1.2."""
    scale = scale if scale > 0 else K.BOX_SCALE

    def axis(a: Column, b: Column, most: Column) -> tuple[Column, Column]:
        if scale == 1:
            lo, hi = a, b
        else:
            size = F.greatest(F.lit(1.0), F.round((b - a) * F.lit(scale)))
            mid = (a + b) / 2.0
            lo, hi = F.floor(mid - size / 2), F.ceil(mid + size / 2)
        return F.least(F.greatest(lo, F.lit(0)), most).cast("int"), F.least(F.greatest(hi, F.lit(0)), most).cast("int")

    (a, c), (b, d) = axis(x1, x2, width), axis(y1, y2, height)
    return F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))


def box_is_empty(box: Column) -> Column:
    return ~((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]))


def centre_distance(a: Column, b: Column) -> Column:
    """Squared distance of two boxes' centres, in doubled coordinates."""
    dx = (a["x1"] + a["x2"] - b["x1"] - b["x2"]).cast("long")
    dy = (a["y1"] + a["y2"] - b["y1"] - b["y2"]).cast("long")
    return dx * dx + dy * dy


def quality_score(area: Column, sharpness: Column, det_score: Column, eye_y: Column, nose_y: Column, mouth_y: Column) -> Column:
    """(ln area + 1.5 ln sharpness - 2 if the face looks down) * detection score; logs of at least 1."""
    penalty = F.when((mouth_y - nose_y) < 0.5 * (nose_y - eye_y), 2.0).otherwise(0.0)
    return (F.log(F.greatest(F.lit(1.0), area)) + 1.5 * F.log(F.greatest(F.lit(1.0), sharpness)) - penalty) * det_score


def track_ref(ref: Column) -> Column:
    """A track number in canonical form (no sign, no leading zero), else null."""
    return F.when(ref.rlike(r"^[1-9][0-9]*$"), ref.try_cast("long"))


def needs_review(action: Column) -> Column:
    return F.when(F.trim(F.coalesce(action, F.lit(""))) == "", "needs_review").otherwise(F.trim(action))


def label_pair(identity: Column, variant: Column) -> Column:
    return F.concat_ws(" / ", F.nullif(F.trim(identity), F.lit("")), F.nullif(F.trim(variant), F.lit("")))


def artifact_name(ident: Column, label: Column, frame: Column, score: Column) -> Column:
    return F.format_string("%d_%s_[frame_%05d]_[%.2f].jpg", ident.cast("long"), label, frame.cast("long"), score.cast("double"))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts in a canonical text; null is written apart from the empty text."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("~")) for p in parts])
    return F.sha2(text, 256)
