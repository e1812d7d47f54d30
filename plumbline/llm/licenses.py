"""Licence scans by canonical digests.

A text is brought to a canonical form (lower case, equivalent spellings, no
copyright lines, no punctuation, single spaces) and its SHA-256 is joined with
the digests of known licences. Lines whose canonical form is a known notice
are reported as well. All of it is SQL functions.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import table

#: Equivalent spellings.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("behaviour", "behavior"), ("merchantibility", "merchantability"), ("https://", "http://"))
#: Equivalent phrases, replaced when words are a single space apart.
PHRASES = (("copyright owner", "copyright holder"),)
#: A line that states a copyright: it starts with the word and has a year, (c), the sign or a place for a name after it, or has nothing but "all rights reserved".
COPYRIGHT = r"(^|\n)[^\na-z0-9]*(copyright[^\n]*(\(c\)|©|[0-9]{4})[^\n]*|copyright[^\na-z0-9]*[<{\[][^\n]*|©[^\n]*|\(c\)[^\na-z]*[0-9]{4}[^\n]*|all[ \t]+rights[ \t]+reserved[^\na-z0-9]*)"
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: One-line notices and what they grant; a line is one if its canonical digest is that of the notice.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the GNU General Public License v3.0.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
}
#: Whole licences as their publishers give them: NAME.txt, and NAME~variant.txt for another wording.
FOLDER = Path(__file__).parent / "licences"
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
TITLE_WORDS = 16


def texts() -> list[tuple[str, str]]:
    """(name, text) of all known whole licences, with and without their title and what follows their terms."""
    return [(path.stem.partition("~")[0], v) for path in sorted(FOLDER.glob("*.txt")) for v in variants(path.read_text(encoding="utf-8"))]


def variants(text: str) -> list[str]:
    """A licence as it is; without its title, which is a first paragraph of few words that is no sentence; and both without the appendix behind the end of its terms."""
    out = [text]
    title, _, rest = text.strip().partition("\n\n")
    if len(title.split()) <= TITLE_WORDS and not title.endswith(".") and rest:
        out.append(rest)
    return out + [t[: t.index(END_OF_TERMS) + len(END_OF_TERMS)] for t in out if END_OF_TERMS in t] + [t[: t.index(END_OF_TERMS)] for t in out if END_OF_TERMS in t]


def _lines(text: Column) -> Column:
    """A text in canonical form with its lines kept apart."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _phrased(t: Column) -> Column:
    for a, b in PHRASES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def plain(text: str) -> str:
    """The canonical form of one known licence or notice, as the columns below have it."""
    t = text.lower()
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    t = re.sub(PUNCTUATION, " ", re.sub(COPYRIGHT, "\n", t))
    t = re.sub("[ \n]+", " ", t).strip(" ")
    for a, b in PHRASES:
        t = t.replace(a, b)
    return t


def digest(text: str) -> str:
    """The canonical digest of one known licence or notice."""
    return hashlib.sha256(plain(text).encode()).hexdigest()


def known(spark: SparkSession, licences: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of (name, text) pairs, by default of ``texts``; a larger collection may be any table of these two columns."""
    rows = {(digest(text), name) for name, text in (texts() if licences is None else licences)}
    return spark.createDataFrame(sorted(rows), "digest string, license string")


def scanned(docs: DataFrame, licenses: DataFrame, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license and notices of each row.

    * ``license``: the known licence that the entire text is, or null;
      ``notices``: what one-line notices grant, sorted and comma-joined.
    * Null and empty texts have the digest of nothing.
    * Repeated rows get equal results; other columns of ``docs`` aren't read.
    * ``licenses`` (digest, license): of a repeated digest the smallest name counts.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), _lines(F.col(text_col)).alias("__t"))
    lined = F.regexp_replace("__t", PUNCTUATION, " ")
    bare = F.when(F.contains("__t", F.lit("copyright")) | F.contains("__t", F.lit("©")) | F.contains("__t", F.lit("(c)")) | F.contains("__t", F.lit("reserved")), F.regexp_replace(F.regexp_replace("__t", COPYRIGHT, "\n"), PUNCTUATION, " ")).otherwise(lined)
    df = df.select("doc_id", "__t", F.sha2(_phrased(F.trim(F.regexp_replace(bare, "[ \n]+", " "))), 256).alias("digest"))
    grants = {digest(k): v for k, v in (NOTICES if notices is None else notices).items()}
    names = F.create_map(*[F.lit(x) for kv in grants.items() for x in kv])
    own = F.transform(F.filter(F.split("__t", "\n"), lambda line: F.contains(line, F.lit("license"))), lambda line: names[F.sha2(_phrased(F.trim(F.regexp_replace(F.regexp_replace(line, PUNCTUATION, " "), " +", " "))), 256)])
    found = F.array_join(F.array_sort(F.array_distinct(F.filter(own, lambda x: x.isNotNull()))), ",")
    df = df.select("doc_id", "digest", F.when(F.contains("__t", F.lit("license")), found).otherwise(F.lit("")).alias("notices"))
    one = licenses.groupBy("digest").agg(F.min("license").alias("license"))
    return df.join(one, "digest", "left").select("doc_id", "digest", "license", "notices")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over the whole texts of ``documents``."""
    return scanned(table(spark, sf_dir, "documents"), known(spark))


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    t = "lower(coalesce(text, ''))"
    for a, b in SPELLINGS:
        t = f"replace({t}, {quoted(a)}, {quoted(b)})"
    lic = ", ".join(f"({quoted(x)}, {quoted(n)})" for n, x in texts())
    note = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in NOTICES.items())
    phrased = lambda x: reduce(lambda y, p: f"replace({y}, {quoted(p[0])}, {quoted(p[1])})", PHRASES, x)
    canon = lambda x: phrased(rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '{COPYRIGHT}', chr(10), 'g'), '{PUNCTUATION}', ' ', 'g'), '[ \n]+', ' ', 'g'), ' ')")
    return rf"""
WITH known(text, license) AS (VALUES {lic}), notice(text, grants) AS (VALUES {note}),
lic AS (SELECT sha256({canon(t)}) AS digest, min(license) AS license FROM known GROUP BY 1), note AS (SELECT DISTINCT {canon(t)} AS line, grants FROM notice),
d AS (SELECT doc_id, {t} AS t FROM documents),
g AS (SELECT doc_id, sha256({canon('t')}) AS digest FROM d),
l AS (SELECT doc_id, {phrased("trim(regexp_replace(regexp_replace(unnest(string_split(t, chr(10))), '" + PUNCTUATION + "', ' ', 'g'), ' +', ' ', 'g'), ' ')")} AS line FROM d),
n AS (SELECT doc_id, string_agg(DISTINCT grants, ',' ORDER BY grants) AS notices FROM l JOIN note USING (line) GROUP BY doc_id)
SELECT doc_id, g.digest, license, coalesce(notices, '') AS notices FROM g LEFT JOIN lic USING (digest) LEFT JOIN n USING (doc_id)
"""


ORACLE = _oracle()
