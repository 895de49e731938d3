"""File sources and sinks: binary and text files, JSON dimensions, HTML turned into Markdown."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: The accepted suffixes.
SUFFIXES = (".pdf", ".epub", ".mobi", ".azw3", ".djvu", ".txt")


def collect_files(spark: SparkSession, target: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of a file or of all files below a folder; content is read only if used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(target)


def gate(files: DataFrame, most_bytes: int) -> DataFrame:
    """`status`: accepted, too_large, empty or rejected_type, from path and length alone, so that bytes stay unread.

    Spark's file sources list no files of zero bytes, so `empty` concerns tables from other sources.
    """
    ext = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1)
    return files.withColumn("status", F.when(~ext.isin(*SUFFIXES), "rejected_type").when(F.col("length") > most_bytes, "too_large").when(F.col("length") == 0, "empty").otherwise("accepted"))


def load_glyph_table(spark: SparkSession, path: str) -> DataFrame:
    """(family, codepoint, unicode) from JSON {family: {hex: text}}; bad code points and empty readings are skipped, a
    missing file is an empty table."""
    schema = "family string, codepoint int, unicode string"
    try:
        raw = spark.read.option("wholetext", "true").text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    m = raw.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("family", "codes"))
    rows = m.select("family", F.explode("codes").alias("hex", "unicode"))
    code = F.conv(F.when(F.col("hex").rlike("^(?:0x|U\\+)?[0-9A-Fa-f]{1,6}$"), F.regexp_replace("hex", "^(?:0x|U\\+)", "")), 16, 10).try_cast("int")
    return rows.select("family", code.alias("codepoint"), "unicode").where("codepoint is not null and unicode is not null and unicode <> ''")


def load_supplement(spark: SparkSession, path: str) -> DataFrame:
    """(name, unicode) from JSON {name: text}: a leading slash of a name is dropped, names and readings that are empty are
    skipped, a missing file is an empty table."""
    try:
        raw = spark.read.option("wholetext", "true").text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "name string, unicode string")
    m = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "unicode"))
    return m.select(F.regexp_replace("name", "^/", "").alias("name"), "unicode").where("name <> '' and unicode <> ''")


class _Markdown(HTMLParser):
    SKIP = {"script", "style", "head", "nav", "footer", "noscript"}
    HEAD = {f"h{i}": "#" * i + " " for i in range(1, 7)}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip.append(tag)
        if self.skip:
            return
        if tag in self.HEAD:
            self.out.append("\n\n" + self.HEAD[tag])
        elif tag in ("p", "div", "article", "section", "table", "ul", "ol", "blockquote"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "tr":
            self.out.append("\n|")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip:
            while self.skip and self.skip.pop() != tag:
                pass
            return
        if self.skip:
            return
        if tag in self.HEAD or tag in ("p", "article", "section", "table"):
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("td", "th"):
            self.out.append(" |")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(" ".join(data.split()).join([" " if data[:1].isspace() else "", " " if data[-1:].isspace() else ""]) if data.strip() else " ")


def _to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Markdown()
    p.feed(html)
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
    text = "\n".join(lines)
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.strip()


@F.pandas_udf(T.StringType())
def _markdown(s: pd.Series) -> pd.Series:
    return s.map(_to_markdown)


def html_to_markdown(c: Column) -> Column:
    """Headings, paragraphs, lists, tables, links and emphasis; scripts, styles and navigation dropped; null stays null."""
    return _markdown(c)


def write_index(docs: DataFrame, path: str) -> None:
    """Index documents as Parquet, partitioned by language; a missing id becomes a digest of the content."""
    made = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in docs.columns if c != "id"]), 256)
    docs.withColumn("id", F.coalesce(F.when(F.col("id") != "", F.col("id")), made)).write.mode("append").partitionBy("language").parquet(path)


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """An inventory as JSON lines, CSV, ORC or Parquet."""
    df.write.mode("overwrite").format(form).save(path)
