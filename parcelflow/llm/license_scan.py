"""Licence scans: canonical digests of entire texts, and of entire lines, joined to known licence digests.

Only DataFrame expressions run here.  A text is made canonical (ASCII case, copyright statements, punctuation and
spacing, equivalent spellings), its SHA-256 is the join key, and the known digests come from the same expression over
the table of known texts: the notices below and the entire licences in ``licenses``, unedited, as they are shipped with
other software.  Only their digests are broadcast.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import LOWER, UPPER
from .spark_util import with_text

# Equivalent spellings of the licence matching guidelines (word -> canonical word).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "cancelled": "canceled", "catalogue": "catalog", "favour": "favor", "fulfil": "fulfill",
    "licence": "license", "licenced": "licensed", "licences": "licenses", "merchantibility": "merchantability",
    "organisation": "organization", "programme": "program", "recognise": "recognize", "sublicence": "sublicense",
    "whilst": "while", "wilful": "willful",
}

#: Known entire texts beside those of ``whole_licenses``: one-line notices that name a licence.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


TITLES = {"MIT": ("The MIT License (MIT)", "The MIT License", "MIT License"), "ISC": ("The ISC License", "ISC License", "ISC License (ISC)"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License")}


# A statement names the year or has the sign; "copyright notice" and "copyright holders" are words of the licence.
_SIGN = r"\(c\)|©|[0-9]{4}|[\[<{][ \t]*(?:yyyy|year)"
OWNER = rf"copyright[ \t:]*(?:{_SIGN})|(?:\(c\)|©)[ \t]*(?:copyright[ \t]*)?[0-9]{{4}}"
STATEMENT = rf"(^|\n)[^\p{{L}}\p{{N}}\n(©]*(?:{OWNER})[^\n]*"

#: "All rights reserved." as a line of its own.
RESERVED = r"(^|\n)[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*(\n|\z)"
#: A statement without a year is a short paragraph of one line (or the line under a short first one), which no clause is.
UNDATED = r"(^[^\n]{0,60}\n|^|\n[ \t\r]*\n)[^\p{L}\p{N}\n(©]*copyright[ \t:][^\n]{1,60}(\n[ \t\r]*\n|\n?\z)"


def whole_licenses() -> list[tuple[str, str]]:
    """(id, entire text), short licences with and without the titles they are found under; files are named id[.variant].txt."""
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        name, text = path.stem.removesuffix(".regents"), path.read_text(encoding="utf-8")
        titles = TITLES.get(name, ())
        first, _, rest = text.partition("\n")
        if first.strip() in titles:
            text = rest
        out += [(name, text), *((name, f"{title}\n{text}") for title in titles)]
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN + whole_licenses(), "license string, text string")


def with_digest(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with ``out``: the digest of the canonical form of the entire text in column ``text`` (null stays null)."""
    low, marked = "_canonical_low", "_canonical_text"
    df = df.withColumn(low, F.translate(text, UPPER, LOWER))
    for sign, pattern, left in ((F.col(low).rlike(OWNER), STATEMENT, "$1"), (F.contains(F.col(low), F.lit("all rights reserved")), RESERVED, "$1$2"), (F.contains(F.col(low), F.lit("copyright")), UNDATED, "$1$2")):
        df = df.withColumn(low, F.when(sign, F.regexp_replace(low, pattern, left)).otherwise(F.col(low)))
    df = df.withColumn(marked, F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")))
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(marked, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    df = df.withColumn(marked, F.when(F.col(marked).rlike("(^| )(" + "|".join(SPELLINGS) + ")( |$)"), spelled).otherwise(F.col(marked)))
    return df.withColumn(out, F.sha2(F.col(marked).cast("binary"), 256)).drop(low, marked)


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license, n_notice_lines, notices, licensed) for every row of docs (doc_id, text).

    license: id of the known text that the entire document equals in canonical form.  Lines that name a licence are
    looked up entire as well; n_notice_lines counts those that equal a known text and notices lists their ids, sorted and
    comma-joined.  Null texts have a null digest and no licence; texts without a letter or digit never match; very long texts are
    taken whole, repeated rows stay, an empty table gives an empty one, other columns are not read.  A digest
    with several ids takes the smallest id."""
    known = with_digest(known.select("license", "text"), "text", "kd").where(F.col("kd") != F.sha2(F.lit("").cast("binary"), 256)).groupBy("kd").agg(F.min("license").alias("found"))
    docs = with_text(docs)
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, UPPER, LOWER).rlike("licen[cs]e"))
    keyed = with_digest(docs.select("doc_id", "text", lines.alias("lines")), "text", "digest").drop("text")
    table = F.broadcast(known)
    whole = keyed.join(table, F.col("digest") == F.col("kd"), "left").select("doc_id", "digest", F.col("found").alias("license"), "lines")
    names = F.array_sort(F.collect_list("found"))
    plain = whole.where("lines IS NULL OR size(lines) = 0").select("doc_id", "digest", "license", F.lit(0).cast("long").alias("n_notice_lines"), F.lit("").alias("notices"))
    named = whole.where("size(lines) > 0").withColumn("row", F.monotonically_increasing_id()).select("doc_id", "digest", "license", "row", F.explode("lines").alias("line"))
    named = with_digest(named, "line", "ld").join(table, F.col("ld") == F.col("kd"), "left")
    named = named.groupBy("doc_id", "digest", "license", "row").agg(F.count("found").alias("n_notice_lines"), F.array_join(F.array_distinct(names), ",").alias("notices")).drop("row")
    return plain.unionByName(named).withColumn("licensed", F.col("license").isNotNull() | (F.col("n_notice_lines") > 0))
