"""Documents from files: plain text, Markdown, CSV, logs, HTML, RTF and DOCX."""

from __future__ import annotations

import html
import html.entities
import io
import re
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = ("txt", "log", "csv", "tsv", "md", "markdown", "docx", "html", "htm", "rtf")
_BLANKS = r"[ \t\x{00a0}]{2,}"
_DOCX = re.compile(r"<w:(?:t(?: [^>]*)?>(?P<text>.*?)</w:t>|(?P<line>p[ >]|(?:br|cr)\b[^>]*>)|(?P<tab>tab\b[^>]*>))", re.S)


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references, in Arrow batches; applied only to texts that have one."""
    return texts.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def py_unescape_closed(text: str) -> str:
    """html.unescape() of the references that a semicolon ends; a cut-off one, which browsers take for whole, stays as it is."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0], text)


@F.pandas_udf(T.StringType())
def unescape_closed(texts: pd.Series) -> pd.Series:
    """py_unescape_closed() in Arrow batches."""
    return texts.map(lambda t: t if t is None or "&" not in t else py_unescape_closed(t))


def html_text(text: Column, closed: bool = False) -> Column:
    """Text of a page: scripts, styles and tags give way to a space, references are resolved (only those that a semicolon ends, if ``closed``), runs of blanks become one."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(?:style|script)[^>]*>.*?</(?:style|script)>", " "), r"(?s)<[^>]+>", " ")
    resolved = unescape_closed(bare) if closed else unescape(bare)
    return F.regexp_replace(F.when(bare.contains("&"), resolved).otherwise(bare), _BLANKS, " ")


def rtf_text(text: Column) -> Column:
    """Text of a rich text file: control words, escapes and braces give way to spaces."""
    bare = F.regexp_replace(text, r"\\[a-zA-Z]+-?[0-9]* ?|\\[^a-zA-Z]", " ")
    return F.regexp_replace(F.translate(bare, "{}", "  "), _BLANKS, " ")


def py_docx_text(data: bytes) -> str:
    """Text runs of a word-processor file, with breaks for paragraphs and lines, and tabs. Anything else is a ValueError."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            body = archive.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
        raise ValueError("not a docx file") from e
    except KeyError as e:
        raise ValueError("a docx file without word/document.xml") from e
    return html.unescape("".join(m["text"] if m["text"] is not None else "\n" if m["line"] else "\t" for m in _DOCX.finditer(body)))


@F.pandas_udf(T.StringType())
def docx_text(files: pd.Series) -> pd.Series:
    """py_docx_text() of each file; null for one that can't be read."""

    def one(data: bytes | None) -> str | None:
        try:
            return None if data is None else py_docx_text(data)
        except ValueError:
            return None

    return files.map(one)


def extract(extension: Column, content: Column) -> Column:
    """Text of a file's bytes by its extension, whatever its case; an unknown one is taken as text."""
    ext, text = F.lower(extension), content.cast("string")
    docx = docx_text(F.when(ext == "docx", content))
    return F.when(ext == "docx", docx).when(ext.isin("html", "htm"), html_text(text)).when(ext == "rtf", rtf_text(text)).otherwise(text)


def load(spark: SparkSession, path: str, pattern: str = "*", every: bool = True) -> DataFrame:
    """(doc_id, text, source, format, error): a document a file, its id the name without extension, its text trimmed. Files are read by tasks.

    A file that can't be read has a null text and says so in ``error``, and the others are loaded. Without ``every`` only files with one of EXTENSIONS are.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    files = files if every else files.where(F.lower(ext).isin(*EXTENSIONS))
    text = F.regexp_replace(extract(ext, F.col("content")), r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")
    rows = files.select(F.when(stem == "", name).otherwise(stem).alias("doc_id"), text.alias("text"), F.col("path").alias("source"), F.lower(ext).alias("format"))
    return rows.withColumn("error", F.when(F.col("text").isNull(), F.concat(F.lit("not a readable "), "format", F.lit(" file"))))


def sample_corpus(spark: SparkSession) -> DataFrame:
    """(doc_id, text, meta) of a few documents of our own that come with the library, for trying things out."""
    rows = [(name, f"---\nyear: {year}\ntopic: {topic}\n---\n{text}") for name, year, topic, text in SAMPLE]
    return front_matter(spark.createDataFrame(rows, "doc_id string, text string"))


SAMPLE = [
    ("harbour", 1987, "places", "The harbour lies behind two stone piers. Fishing boats leave before dawn and come back with herring at noon."),
    ("mill", 1902, "places", "An old water mill stands by the river. Its wheel turned two stones that ground rye for the whole valley."),
    ("bread", 2011, "food", "Rye bread needs a sour dough, a hot stone oven and patience. The dough rests for a day before it is baked."),
    ("herring", 1999, "food", "Herring is salted in barrels on the pier or smoked over beech wood. Smoked herring keeps for weeks."),
    ("lighthouse", 1954, "places", "The lighthouse keeper lit the lamp every evening. Ships found the harbour by its white light."),
    ("река", 2005, "places", "Река течёт мимо старой мельницы. Рыбаки ловят рыбу с лодок на рассвете."),
    ("хлеб", 2016, "food", "Хлеб пекут из ржаной муки. Тесто стоит сутки, а печь топят берёзовыми дровами."),
]


_HEAD = re.compile(r"---\n(.*?)\n---", re.S)


def py_front_matter(text: str) -> tuple[str, dict[str, str]]:
    """A text without its head of ``key: value`` lines between --- lines, and what these say; of a repeated key the last counts."""
    text = text.replace("\r\n", "\n")
    head = _HEAD.match(text)
    if head is None:
        return text, {}
    pairs = (line.partition(":") for line in head[1].split("\n") if ":" in line)
    return text[head.end() :].lstrip("\n"), {key.strip(" "): value.strip(" ") for key, _, value in pairs}


def _split(texts: pa.Array) -> pa.Array:
    parts = [("", {}) if t is None else py_front_matter(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([t for t, _ in parts], pa.string()), pa.array([list(m.items()) for _, m in parts], pa.map_(pa.string(), pa.string()))], ["text", "meta"])


def front_matter(docs: DataFrame) -> DataFrame:
    """Split Markdown with a head, see py_front_matter(): text without it, and the map ``meta``. A text without a closed head stays, with an empty map, and so does a null one."""
    split = docs.withColumn("__split", F.arrow_udf(_split, "struct<text:string,meta:map<string,string>>")("text"))
    return split.withColumns({"text": F.when(F.col("text").isNotNull(), F.col("__split")["text"]), "meta": F.col("__split")["meta"]}).drop("__split")


#: Words that example queries leave out.
EXAMPLE_STOP_WORDS = tuple("from have into that their there this used which with благодаря вместе включая которая которые который назначения обеспечивающий общего поддерживает поддержку своей".split())
NO_EXAMPLE = "type a query..."


def letters(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def word_counts(docs: DataFrame, least: int = 5) -> DataFrame:
    """(word, n) of words of at least ``least`` letters that aren't left out, the most frequent first."""
    words = docs.select(F.explode(letters(F.col("text"))).alias("word")).where(F.length("word") >= least)
    return words.where(~F.col("word").isin(*EXAMPLE_STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word")


def example_query(docs: DataFrame, order: str = "doc_id") -> str:
    """An example made of the corpus' frequent words and the first two longer words of its first document."""
    head = docs.orderBy(order).limit(1).select(F.slice(F.filter(letters(F.col("text")), lambda w: F.length(w) >= 4), 1, 2).alias("words")).head()
    if head is None:
        return NO_EXAMPLE
    top, phrase = [r.word for r in word_counts(docs).limit(4).collect()], " ".join(head.words or [])
    parts = [" ".join(top[:2])] if len(top) >= 2 else []
    parts += [f'"{phrase}"' if parts else phrase] if phrase else []
    parts += [f"{top[2]} OR {top[3]}"] if len(top) >= 4 and phrase else []
    return "   ·   ".join(parts) or NO_EXAMPLE
