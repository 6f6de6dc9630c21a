"""Language identification in two steps: the language family first, then one-versus-one linear support vector machines
between the languages of that family.

All classifiers are fitted in one task on a bounded sample of labelled training rows (at most ``sample`` rows, an even
share for each language); every whole text is scored where it is read.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import linear_svm as svm
from . import textops as t
from .spark_util import with_text

ORDERS, BITS, COST = (1, 2, 3), 14, 4.0
SAMPLE = 8000
FOLDS = 5
UNKNOWN = "und"
# Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["an", "ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro", "sc", "wa"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sh", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd", "gv", "kw"],
    "uralic": ["et", "fi", "hu", "se"],
    "turkic": ["az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"],
    "semitic": ["am", "ar", "he", "mt", "ti"],
    "indo-aryan": ["as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "sd", "si", "ur"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "malayo-polynesian": ["id", "jv", "mg", "mi", "ms", "su", "tl"],
    "bantu": ["ln", "lg", "rw", "sn", "st", "sw", "tn", "xh", "zu"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return _FAMILY.get(code, code)


def _rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Square roots of the n-gram counts of each text, scaled to length one."""
    for x in svm.bucket_lists(texts, ORDERS, BITS, True):
        count = np.bincount(x, minlength=1 << BITS)
        at = np.flatnonzero(count)
        yield at.astype(np.int32), np.sqrt(count[at] / max(1, len(x)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(a.tobytes(), v.astype(np.float32).tobytes()) for a, v in _rows(t.texts_of(batch))]
        for i in range(0, batch.num_rows, 500):
            part, own = batch.slice(i, 500), rows[i : i + 500]
            cols = [part.column("doc_id"), part.column("lang"), pa.array([x for x, _ in own], pa.binary()), pa.array([x for _, x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "at", "v"])


def fit_rows(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> dict:
    """Family classifiers (one against the rest) and pair classifiers, each with the sigmoid of its margins."""
    langs = sorted({r[0] for r in rows})
    families: dict[str, list[str]] = {}
    for x in langs:
        families.setdefault(family(x), []).append(x)

    def fit(y: np.ndarray) -> tuple[np.ndarray, float, float]:
        own = np.flatnonzero(y)
        ptr = np.cumsum([0] + [len(rows[i][1]) for i in own])
        share = np.where(y[own] > 0, (y[own] < 0).mean(), (y[own] > 0).mean()) * 2
        w = svm.fit_hinge(ptr, np.concatenate([rows[i][1] for i in own]), np.concatenate([rows[i][2] for i in own]), y[own], 1 << BITS, COST * share)
        margin = np.array([w[rows[i][1]] @ rows[i][2] + w[-1] for i in own])
        return w, *svm.fit_sigmoid(margin, y[own])

    lang_of = [r[0] for r in rows]
    fam_of = [family(x) for x in lang_of]
    model = {"families": families, "family": {}, "pair": {}}
    if len(families) > 1:
        for f in families:
            model["family"][f] = fit(np.array([1.0 if x == f else -1.0 for x in fam_of]))
    for own in families.values():
        for a, b in itertools.combinations(own, 2):
            model["pair"][a, b] = fit(np.array([1.0 if x == a else -1.0 if x == b else 0.0 for x in lang_of]))
    return model


def predict_row(model: dict, at: np.ndarray, v: np.ndarray) -> tuple[str, float]:
    """(language, confidence): the likeliest family, then the language that wins most duels, ties to the better sum."""

    def probability(m) -> float:
        w, a, b = m
        return float(1 / (1 + np.exp(-np.clip(a * (w[at] @ v + w[-1]) + b, -500, 500))))

    p_family = {f: probability(m) for f, m in model["family"].items()} or dict.fromkeys(model["families"], 1.0)
    best = max(p_family, key=lambda f: (p_family[f], f))
    own = model["families"][best]
    if len(own) == 1:
        return own[0], p_family[best]
    wins, total = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
    least = dict.fromkeys(own, 1.0)
    for a, b in itertools.combinations(own, 2):
        p = probability(model["pair"][a, b])
        wins[a if p >= 0.5 else b] += 1
        for x, px in ((a, p), (b, 1 - p)):
            total[x] += px
            least[x] = min(least[x], px)
    lang = max(own, key=lambda x: (wins[x], total[x], x))
    return lang, p_family[best] * least[lang]


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "at", "v")))]
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    model = fit_rows([(lang, np.frombuffer(a, np.int32), np.frombuffer(v, np.float32).astype(np.float64)) for _, lang, a, v in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from rows with a language outside the held-out fold (crc32 of doc_id mod 5 is 0).

    At most ``sample`` rows are learned, an even share for each language, those of the least hash of doc_id; rows without a
    doc_id are not drawn, and of rows with one doc_id all or none are."""
    own = with_text(docs, F.col("lang").cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % FOLDS != 0))
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).collect()
    if not counts:
        return {"families": {}, "family": {}, "pair": {}}
    quota = max(1, sample // len(counts))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.2 * quota / r["c"]))])
    drawn = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * float(1 << 30))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = drawn.select("doc_id", "lang", first.alias("n")).where(F.col("n") <= quota).select("doc_id").distinct()
    rows = own.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_features, "doc_id long, lang string, at binary, v binary")
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "at", "v").limit(sample)  # repeated ids may bring more rows than were drawn
    return pickle.loads(few.mapInArrow(_fit, "model binary").first().model)


def _letters(buf: np.ndarray, offs: np.ndarray) -> list[bool]:
    """Whether each text has a letter; only texts without an ASCII letter are decoded."""
    plain = ((buf | 32) >= 0x61) & ((buf | 32) <= 0x7A)
    seen = np.concatenate([[0], np.cumsum(plain)])
    some = seen[offs[1:]] > seen[offs[:-1]]
    return [bool(x) or any(ch.isalpha() for ch in buf[a:b].tobytes().decode("utf-8", "ignore")) for x, a, b in zip(some, offs[:-1], offs[1:])]


def _predictor(model):
    """Adds held_out, lang_pred and score to what the input has beside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            texts = t.texts_of(batch)
            lettered = [x for _, _, buf, offs in t.pieces(texts) for x in _letters(buf, offs)]
            out = [predict_row(known, at, v) if ok and known["families"] else (UNKNOWN, 0.0) for ok, (at, v) in zip(lettered, _rows(texts))]
            kept = [c for c in batch.schema.names if c != "text"]
            cols = [batch.column(c) for c in kept] + [pa.array(t.crc_mod(batch.column("doc_id").to_pylist(), FOLDS) == 0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "held_out", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang, ...).

    ``und`` with score 0 for null texts and texts without a letter, and for all where no labelled row exists.  Whole texts
    count, however long.  A null doc_id is held out or not by the hash of the empty text.  Repeated rows each get the same
    answer.  Equally likely families and equally strong languages go to the greater name."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    return with_text(docs).mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def with_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with the predicted language as ``lang``, without the rows that have none; no join, so null ids do no harm."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("carried")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest, F.col("text").cast("string").alias("kept_text"))
    fields = T.StructType([f for f in own.schema if f.name != "text"] + [T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = own.mapInArrow(_predictor(model), fields).where(F.col("lang_pred") != UNKNOWN)
    take = {"text": F.col("kept_text"), "lang": F.col("lang_pred")}
    return out.select(*[take.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])
