"""Operator 1: licence scan by canonical digest lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.license_digests import DIGESTS

#: Spellings that count as the same; the first becomes the second wherever it occurs. Order matters.
EQUIVALENT = [
    ("licence", "license"), ("sub license", "sublicense"), ("organis", "organiz"), ("recognis", "recogniz"), ("authoris", "authoriz"),
    ("utilis", "utiliz"), ("realis", "realiz"), ("optimis", "optimiz"), ("maximis", "maximiz"), ("initialis", "initializ"),
    ("capitalis", "capitaliz"), ("categoris", "categoriz"), ("customis", "customiz"), ("favour", "favor"), ("labour", "labor"),
    ("judgement", "judgment"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("fulfill", "fulfil"), ("labelling", "labeling"), ("modelling", "modeling"), ("offence", "offense"), ("practise", "practice"),
    ("programme", "program"), ("signalling", "signaling"), ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"),
    ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("https", "http"),
]
#: What may stand before the words of a line: comment and markup signs.
_SIGNS = r"[ \t]*[*#/;%<!|-]*[ \t]*(?:portions[ \t]+)?"
#: A line that begins with the word copyright but goes on about it, and so is part of the text. Such lines are marked before statements go, as not every engine's patterns can look ahead.
ABOUT_COPYRIGHT = rf"(?m)^({_SIGNS})(copyright[ \t]+(?:notices?|holders?|owners?|laws?|licen[cs]es?|acts?|protections?|infringements?|interests?|claims?|status|disclaimers?|information|management|treaty|treaties|rights?|terms?|in|and|or|is|are|was|has|may|shall|will|must|of|as|to|for|on|under|with|that|which)\b)"
#: A line that states who holds the copyright: after signs, copyright with a year, a sign or a name, or the sign alone.
COPYRIGHT_LINE = rf"(?m)^{_SIGNS}(?:copyright(?:[ \t]*[:,]|[ \t]+|[ \t]*\(c\)|[ \t]*©)|\(c\)[ \t]|©|all rights reserved)[^\n]*"
#: Rows of digests that are broadcast at most, some 100 bytes each; more are joined by shuffle.
BROADCAST_ROWS = 200_000
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Lower case, no copyright lines, words with one space between them and one spelling; \\n between lines that have words."""
    x = F.regexp_replace(F.lower(text), "\r", "\n")
    x = F.regexp_replace(x, ABOUT_COPYRIGHT, "$1\u0001$2")
    x = F.regexp_replace(x, COPYRIGHT_LINE, "")
    x = F.regexp_replace(x, NOT_WORD, " ")
    x = F.regexp_replace(x, r" ?\n[ \n]*", "\n")
    for old, new in EQUIVALENT:
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")


def digest(lines: Column) -> Column:
    return F.sha2(F.replace(lines, F.lit("\n"), F.lit(" ")), 256)


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id): the digests that come with the library and those of further texts, by id. Of several ids with one digest the least counts."""
    rows = spark.createDataFrame(sorted(DIGESTS.items()), "digest string, license_id string")
    if not texts:
        return rows
    more = spark.createDataFrame(sorted(texts.items()), "license_id string, text string")
    return rows.unionByName(more.select(digest(canonical_lines(F.col("text"))).alias("digest"), "license_id")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts that are a known licence or notice: (doc_id, unit, line_no, license_id).

    The whole text of a document is one unit ('text', line 0); if it has several lines with words, each of them is also
    a unit of its own ('line', counted from 1 over lines with words), so a notice of one line inside a document is found.
    A unit matches if its canonical form has a known digest; nothing shorter is compared. Digests are counted first: up to BROADCAST_ROWS of them are
    broadcast, and the texts are read in one pass without a shuffle; more are joined by a shuffle of digests.
    A null or empty text, or one without letters and digits, matches nothing. A null id stays null, repeated rows give
    repeated rows, an empty table none; further columns are ignored. Long texts are digested whole.
    """
    licenses = known(docs.sparkSession) if licenses is None else licenses
    base = docs.select(docs[id_col].alias("id"), canonical_lines(docs[text_col]).alias("canon"))
    lines = F.split("canon", "\n")  # no filter on canon: pushed down, it would work out the canonical form a second time
    units = base.select("id", F.when(F.col("canon") != "", digest(F.col("canon"))).alias("whole"), lines.alias("lines")).select(
        "id",
        F.posexplode(F.concat(F.array("whole"), F.when(F.size("lines") > 1, F.transform("lines", lambda x: F.sha2(x, 256))).otherwise(F.array().cast("array<string>")))).alias("line_no", "digest"),
    )
    found = units.join(F.broadcast(licenses) if licenses.count() <= BROADCAST_ROWS else licenses, "digest")
    return found.select(F.col("id").alias(id_col), F.when(F.col("line_no") == 0, "text").otherwise("line").alias("unit"), "line_no", "license_id")


def _sql_canonical(text: str) -> str:
    x = f"regexp_replace(lower({text}), '\\r', chr(10), 'g')"
    x = f"regexp_replace({x}, '{ABOUT_COPYRIGHT}', '\\1\u0001\\2', 'g')"
    x = f"regexp_replace({x}, '{COPYRIGHT_LINE}', '', 'g')"
    x = f"regexp_replace({x}, '{NOT_WORD}', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?\\n[ \\n]*', chr(10), 'g')"
    for old, new in EQUIVALENT:
        x = f"replace({x}, '{old}', '{new}')"
    return f"regexp_replace({x}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def scan_sql() -> str:
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(DIGESTS.items()))
    return f"""
    WITH known(digest, license_id) AS (VALUES {values}),
    base AS (SELECT doc_id, {_sql_canonical("text")} AS canon FROM documents),
    cut AS (SELECT doc_id, canon, string_split(canon, chr(10)) AS lines FROM base WHERE canon <> ''),
    units AS (
        SELECT doc_id, 0 AS line_no, sha256(replace(canon, chr(10), ' ')) AS digest FROM cut
        UNION ALL
        SELECT doc_id, i AS line_no, sha256(lines[i]) AS digest
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM cut WHERE len(lines) > 1))
    SELECT doc_id, CASE WHEN line_no = 0 THEN 'text' ELSE 'line' END AS unit, CAST(line_no AS INTEGER) AS line_no, license_id
    FROM units JOIN known USING (digest)"""
