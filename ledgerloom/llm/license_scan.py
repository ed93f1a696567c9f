"""Licence scan by digests of canonical texts (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEXTS

# Short licence notices under their SPDX names, as public licence lists give them.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Spellings that licence texts may swap without a change of meaning (left becomes right).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("percent", "per cent"),
    ("recognised", "recognized"),
    ("sub license", "sublicense"),
    ("sub licensed", "sublicensed"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("v", "version"),
)

# A notice names a year or a holder, or leaves a place for them; "(c)" alone is a list letter, "copyright" alone a word of a sentence.
_COPYRIGHT = r"(?m)^[^a-zA-Z\n]*(?:copyright[ \t]*(?:\(c\)|[0-9<\[{:]|by )|\(c\)[ \t]*(?:copyright|[0-9<\[{])|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, words parted by one space, one spelling.

    A copyright line begins, whatever signs stand before it, with the word and the sign (c), a
    year, a placeholder, a colon or "by", with the sign and a year, a placeholder or the word, or
    with the usual formula. Everything but ASCII letters, digits and characters beyond ASCII parts words.
    """
    text = F.lower(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, "©", "(c)"), _COPYRIGHT, "")
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    for variant, usual in SPELLINGS:
        text = F.replace(text, F.lit(f" {variant} "), F.lit(f" {usual} "))
    return F.trim(text)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, notices=NOTICES) -> DataFrame:
    """(digest, license) of known texts, one row per canonical text; the table is as small as the list."""
    listed = spark.createDataFrame(list(notices), "license string, text string")
    return listed.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, notices=NOTICES, texts=TEXTS) -> DataFrame:
    """Licences whose known text is, in canonical form, a whole document or a whole line of it.

    Known are short ``notices`` (license, text) and whole licences, ``texts`` (license, first words,
    length, digest). :func:`licenses_within` also finds those that are wrapped over lines of a document.

    Texts and their lines are digested in place and joined by hash with the known digests; the
    list is a parameter of the code, so it is broadcast.

    Returns (doc_id, whole_license, licenses, n_lines, text_digest), a row per input row:
    the licence that the whole text is (else null), the sorted licences of its lines, how many
    lines are licence texts, and the digest of the whole text. Null text counts as empty.
    """
    spark = docs.sparkSession
    known = {digest: name for name, _, _, digest in texts} | {r.digest: r.license for r in known_digests(spark, notices).collect()}
    known = list(known.items())
    table = F.broadcast(spark.createDataFrame(known, "digest string, license string")) if known else None
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", digest(F.col("text")).alias("text_digest"))
    if table is None:
        return rows.selectExpr("doc_id", "cast(null as string) whole_license", "cast(array() as array<string>) licenses", "0 n_lines", "text_digest")
    found = F.transform(F.split("text", "\n"), digest)
    # A small map is a hash table in every task; the documents' rows never move.
    by_digest = F.create_map(*[F.lit(x) for pair in known for x in pair])
    licences = F.filter(F.transform(found, lambda d: F.element_at(by_digest, d)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "text_digest", licences.alias("found"))
    whole = table.toDF("text_digest", "whole_license")
    return rows.join(whole, "text_digest", "left").select(
        "doc_id", "whole_license", F.array_sort(F.array_distinct("found")).alias("licenses"), F.size("found").alias("n_lines"), "text_digest"
    )


def licenses_within(docs: DataFrame, notices=NOTICES, texts=TEXTS) -> DataFrame:
    """(doc_id, licenses), a row per input row: sorted licences whose known text stands anywhere in it.

    The text of a document is put into canonical form as a whole, so line breaks and comment
    signs do not matter. Wherever the first words of a known licence stand, so many characters as
    the licence has are digested.
    """
    bodies = docs.sparkSession.createDataFrame(list(notices), "license string, text string").select("license", canonical(F.col("text"))).collect()
    body = F.concat(F.lit(" "), canonical(F.col("text").cast("string")), F.lit(" "))
    rows = docs.select("doc_id", body.alias("body"))
    found = [F.when(F.contains("body", F.lit(f" {text} ")), F.lit(name)) for name, text in bodies]
    by_start: dict[str, list[tuple]] = {}
    for name, start, length, known in texts:
        by_start.setdefault(f" {start} ", []).append((name, length, known))
    for start, same in by_start.items():
        parts = F.split("body", "\\Q" + start + "\\E")
        ends = F.when(F.contains("body", F.lit(start)), F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: _from_part(parts, i, start)))
        for name, length, known in same:
            # The text with the spaces around it, so that it ends with a word.
            fits = F.exists(ends, lambda x: F.substring(x, length + 2, 1).eqNullSafe(F.lit(" ")) & (F.sha2(F.substring(x, 2, length).cast("binary"), 256) == known))
            found.append(F.when(fits, F.lit(name)))
    return rows.select("doc_id", F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))).alias("licenses"))


def _from_part(parts: Column, i: Column, start: str) -> Column:
    """The text from the start that stands before part ``i``, from 1, to its end."""
    return F.concat(F.lit(start), F.array_join(F.slice(parts, i, F.size(parts)), start))


def _canonical_sql(text: str) -> str:
    text = f"regexp_replace(replace(lower({text}), '©', '(c)'), '{_COPYRIGHT}', '', 'g')"
    text = f"' ' || trim(regexp_replace({text}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) || ' '"
    for variant, usual in SPELLINGS:
        text = f"replace({text}, ' {variant} ', ' {usual} ')"
    return f"trim({text})"


ORACLE = f"""
WITH known(license, body) AS (VALUES {", ".join("(" + ", ".join("'" + x + "'" for x in n) + ")" for n in NOTICES)}),
k AS (SELECT sha256({_canonical_sql("body")}) AS digest, min(license) AS license FROM known GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
lines AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d),
hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, '|' ORDER BY license) AS names
         FROM lines JOIN k ON sha256({_canonical_sql("line")}) = k.digest GROUP BY doc_id)
SELECT d.doc_id, k.license AS whole_license, coalesce(names, '') AS licenses, CAST(coalesce(n, 0) AS INTEGER) AS n_lines,
       sha256({_canonical_sql("body")}) AS text_digest
FROM d LEFT JOIN k ON sha256({_canonical_sql("body")}) = k.digest LEFT JOIN hits USING (doc_id)
"""
