"""Expressions over an array of tags: struct<label, category, score, source>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.functions.vectors import col, let

TAGS = "array<struct<label:string,category:string,score:double,source:string>>"
#: Rank of a tag's source; a missing source counts as prompt.
RANK = {"manual": 6, "exemplar": 5, "propagated": 4, "ocr": 3, "vision": 2, "prompt": 1}
DURABLE = ("manual", "exemplar", "propagated")
CERTAIN = ("manual", "ocr", "exemplar", "propagated")
#: Margin and measured probability, linear in between.
CALIBRATION = ((0.115, 0.05), (0.14, 0.14), (0.16, 0.26), (0.18, 0.38), (0.2, 0.74), (0.225, 0.86))
LEAST_CONFIDENCE, MOST_CONFIDENCE, RECOGNIZED = 0.03, 0.9, 0.56
#: What recognised writing says about an item.
OCR_RULES = (
    (r"(?i)remilia|milady", "Milady", "character"),
    (r"(?i)apustaja", "Apu Apustaja", "character"),
    (r"(?i)pepe(\s|the|$)", "Pepe the Frog", "character"),
    (r"(?i)\bgroyper\b", "Groyper", "character"),
    (r"(?i)\bwagmi\b|\bngmi\b|\bhodl\b|diamond hands", "Crypto / NFT", "topic"),
)


def parse(json: Column | str) -> Column:
    """Tags of a JSON text; an empty list for anything else."""
    return F.coalesce(F.from_json(col(json), TAGS), F.array().cast(TAGS))


def rank(tag: Column) -> Column:
    out = F.lit(1)
    for source, value in RANK.items():
        out = F.when(tag["source"] == source, value).otherwise(out)
    return out


def _named(tags: Column | str) -> Column:
    return F.filter(F.transform(col(tags), lambda t: t.withField("label", text.label(t["label"]))), lambda t: t["label"] != "")


def _labels(tags: Column) -> Column:
    return F.transform(tags, lambda t: t["label"])


def normalize(tags: Column | str) -> Column:
    """Labels in normal form, empty ones dropped, the first of equal labels kept."""
    return let(_named(tags), lambda named: let(_labels(named), lambda labels: F.filter(named, lambda t, i: F.array_position(labels, t["label"]) == i + 1)))


def merge_durable(tags: Column | str, cap_auto: int = 6) -> Column:
    """One tag a label, the best by source rank, then score, then the later; user-made tags first and all, then up to ``cap_auto`` others.

    Tags sort once by label and merit, so the first of each label is a tag whose neighbour before has another label. A label's place is that of its first tag.
    """

    def by_label(named: Column) -> Column:
        entry = lambda labels: F.transform(named, lambda t, i: F.struct(t["label"].alias("label"), (-rank(t)).alias("rank"), (-t["score"]).alias("score"), (-i).alias("late"), F.array_position(labels, t["label"]).alias("place"), t.alias("tag")))
        return F.array_sort(let(_labels(named), entry))

    def best(ordered: Column) -> Column:
        first = F.filter(ordered, lambda k, i: (i == 0) | (F.get(ordered, i - 1)["label"] != k["label"]))
        durable = lambda k: F.coalesce(k["tag"]["source"].isin(*DURABLE), F.lit(False))
        return F.array_sort(F.transform(first, lambda k: F.struct((~durable(k)).alias("auto"), k["rank"], k["score"], k["place"], k["tag"])))

    def capped(kept: Column) -> Column:
        durable = F.size(F.filter(kept, lambda k: ~k["auto"]))
        return F.transform(F.slice(kept, 1, durable + cap_auto), lambda k: k["tag"])

    return let(_named(tags), lambda named: let(by_label(named), lambda ordered: let(best(ordered), capped)))


def with_tag(tags: Column | str, name: Column | str, category: str, source: str, score: float = 1.0, cap_auto: int = 6) -> Column:
    """``tags`` with one more, merged."""
    new = F.array(F.struct(text.label(name).alias("label"), F.lit(category).alias("category"), F.lit(score).alias("score"), F.lit(source).alias("source")))
    return merge_durable(F.concat(new.cast(TAGS), col(tags)), cap_auto)


def tag_haystack(tags: Column | str) -> Column:
    return F.array_join(F.transform(col(tags), lambda t: F.lower(t["label"])), " ")


def has_label(tags: Column | str, name: Column | str) -> Column:
    wanted = text.label(name)
    return F.exists(col(tags), lambda t: text.label(t["label"]) == wanted)


def recognition_tier(tags: Column | str) -> Column:
    """``recognized``, ``weak`` or ``unknown`` from the sources and scores; vision tags don't count."""
    certain = F.exists(col(tags), lambda t: F.coalesce(t["source"].isin(*CERTAIN), F.lit(False)))
    rest = F.filter(col(tags), lambda t: ~F.coalesce(t["source"] == "vision", F.lit(False)))
    best = F.coalesce(F.array_max(F.transform(rest, lambda t: t["score"])), F.lit(0.0))
    return F.when(certain | (best >= RECOGNIZED), "recognized").when(best > 0, "weak").otherwise("unknown")


def confidence(margin: Column | str) -> Column:
    """Probability that a label of this margin is right."""
    m = col(margin)
    out = F.when(m <= CALIBRATION[0][0], LEAST_CONFIDENCE)
    for (x0, y0), (x1, y1) in zip(CALIBRATION, CALIBRATION[1:]):
        out = out.when(m <= x1, F.lit(y0) + (m - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(MOST_CONFIDENCE)


def ocr_tags(written: Column | str) -> Column:
    """Tags that recognised writing stands for."""
    listed = F.array(*[F.when(F.coalesce(col(written), F.lit("")).rlike(p), F.struct(F.lit(name).alias("label"), F.lit(kind).alias("category"), F.lit(1.0).alias("score"), F.lit("ocr").alias("source"))) for p, name, kind in OCR_RULES])
    return F.filter(listed, lambda t: t.isNotNull())
