"""Licence scans: canonical digests of entire texts looked up among known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licence_texts import KNOWN

#: Equivalent spellings, after case and punctuation are gone. Fixed values.
SPELLINGS = [
    ("license", "licence"),
    ("licenses", "licences"),
    ("licensed", "licenced"),
    ("sublicense", "sublicence"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("favor", "favour"),
    ("whilst", "while"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
]
#: Lines that name a holder: they differ between copies of one licence.
COPYRIGHT = r"(?im)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|<year>|\[yyyy\]|all rights reserved)[^\n]*$"
#: Punctuation, white space and signs of any script: all but letters, their marks and numbers.
NOT_WORDS = r"[^\p{L}\p{M}\p{N}]+"


def spaced(words: str) -> str:
    """As ``canonical`` holds words in between: each with a space of its own on either side."""
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    """The text without copyright lines, in lower case, its words joined by single spaces, spellings unified."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, " "))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, NOT_WORDS, "  ")), F.lit(" "))
    for variant, used in SPELLINGS:
        words = F.replace(words, F.lit(spaced(variant)), F.lit(spaced(used)))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def canonical_sql(text: str) -> str:
    """``canonical`` as DuckDB SQL."""
    bare = f"lower(regexp_replace(coalesce({text}, ''), '{COPYRIGHT}', ' ', 'g'))"
    words = f"' ' || trim(regexp_replace({bare}, '{NOT_WORDS}', '  ', 'g')) || ' '"
    for variant, used in SPELLINGS:
        words = f"replace({words}, '{spaced(variant)}', '{spaced(used)}')"
    return f"trim(replace({words}, '  ', ' '))"


def digest(text: Column) -> Column:
    return F.md5(canonical(text))


def known_digests(spark: SparkSession, known: dict[str, list[str]]) -> DataFrame:
    """licence, digest: a row for each known text, canonicalised by the same expressions."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    return spark.createDataFrame(rows, "licence string, text string").select(digest(F.col("text")).alias("digest"), "licence").dropDuplicates(["digest"])


def licence_scan(docs: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """Find licences among entire texts: the whole document, and each of its lines as a text of its own.

    Returns doc_id, text_digest (of the whole canonical text), document_licence (its
    licence, or null) and line_licences (sorted distinct names of the licences that
    entire lines state, joined by commas; empty if none), a row for each row of
    ``docs``. Null and empty texts have the digest of the empty string and match
    nothing. Rows that repeat an id are told apart and each returned. Other columns
    are ignored; an empty table gives an empty result.

    The known texts are a fixed list in the library (or the caller's, which should
    be as small): their digests are broadcast, so that neither texts nor lines are
    shuffled, and lines are matched inside their row.
    """
    spark = docs.sparkSession
    table_ = known_digests(spark, KNOWN if known is None else known).collect()  # as many rows as known texts
    names = F.create_map(*[F.lit(x) for row in table_ for x in (row["digest"], row["licence"])]) if table_ else F.create_map().cast("map<string,string>")
    lookup = F.broadcast(spark.createDataFrame([(r["digest"], r["licence"]) for r in table_], "text_digest string, document_licence string"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    found = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(lines, lambda x: F.try_element_at(names, digest(x)))))), ",")
    rows = docs.select("doc_id", digest(F.col("text")).alias("text_digest"), found.alias("line_licences"))
    return rows.join(lookup, "text_digest", "left").select("doc_id", "text_digest", "document_licence", "line_licences")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def known_values() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in KNOWN.items() for text in texts)


OP7_SQL = f"""
WITH known AS (SELECT md5({canonical_sql("t")}) AS g, min(licence) AS licence FROM (VALUES {known_values()}) AS v(licence, t) GROUP BY 1),
d AS (SELECT doc_id, text, md5({canonical_sql("text")}) AS text_digest, row_number() OVER () AS row FROM documents),
ln AS (SELECT row, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
hit AS (SELECT row, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM ln JOIN known ON md5({canonical_sql("line")}) = g GROUP BY row)
SELECT doc_id, text_digest, known.licence AS document_licence, coalesce(names, '') AS line_licences
FROM d LEFT JOIN known ON text_digest = g LEFT JOIN hit ON hit.row = d.row
"""
