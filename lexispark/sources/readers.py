"""Readers of corpus formats. All return candidates: resource_id, partition_id, doc_id, title, url, domain, genre, quality, text.

What Spark reads itself (JSON lines in gzip or zstd, text, Parquet, CSV, XML) stays in the JVM. Other archives are opened by
tasks, which read them as streams, so their size has no limit: tar and xz in one task each, zips by member over many.
"""

from __future__ import annotations

import io
import lzma
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .writers import filesystem

FIELDS = ("doc_id", "title", "url", "domain", "genre", "quality", "text")


def _candidates(df: DataFrame, resource: str, **columns: Column) -> DataFrame:
    found = [columns.get(c, F.lit(None)).cast("string").alias(c) for c in FIELDS]
    return df.select(F.lit(resource).alias("resource_id"), partition_id(F.lit(resource), F.col("_metadata.file_path")).alias("partition_id"), *found)


def partition_id(resource: Column, path: Column) -> Column:
    """resource#shard, where shard is the file's name in safe characters."""
    return F.concat_ws("#", resource, F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[^A-Za-z0-9_-]", "_"))


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def read_jsonl(spark: SparkSession, path: str, resource: str, schema: str = "id string, title string, url string, domain string, genre string, text string") -> DataFrame:
    """JSON lines in any compression that Spark knows; quality is good; rows without text go."""
    df = spark.read.schema(schema).json(path).filter(F.col("text").isNotNull() & (F.col("text") != ""))
    domain = F.coalesce(_optional(df, "domain").cast("string"), X.url_domain(F.col("url")))
    return _candidates(df, resource, doc_id=_optional(df, "id"), title=_optional(df, "title"), url=F.col("url"), domain=domain, genre=_optional(df, "genre"), quality=F.lit("good"), text=F.col("text"))


def read_jsonl_filtered(spark: SparkSession, path: str, resource: str) -> DataFrame:
    """JSON lines with id, u (URL), crawl_id, text and filter, which is the quality; "keep" is good."""
    df = spark.read.schema("id string, u string, crawl_id string, text string, filter string").json(path).filter("text IS NOT NULL AND text <> ''")
    quality = F.when(F.col("filter") == "keep", "good").otherwise(F.col("filter"))
    return _candidates(df, resource, doc_id=F.col("id"), title=F.col("crawl_id"), url=F.col("u"), domain=X.url_domain(F.col("u")), genre=F.lit("web"), quality=quality, text=F.col("text"))


def numbered_lines(df: DataFrame, through: bool = False) -> DataFrame:
    """Lines of text files (value), with their file and their number in it from 1 on, however Spark has split the files.

    Lines are numbered within each split, of which a task reads a few; the lines before a split are a sum over the splits of its
    file. With through the numbers go on from file to file, in the order of their names; the table of splits is small.
    """
    rows = df.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    order = Window.orderBy("file", "block") if through else Window.partitionBy("file").orderBy("block")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(before, F.lit(0)).alias("earlier"))
    return own.join(blocks, ["file", "block"]).select("value", "file", (F.col("earlier") + F.col("own")).alias("line"))


def read_text_lines(spark: SparkSession, path: str, resource: str, url: str | None = None, domain: str | None = None, through: bool = False) -> DataFrame:
    """Lines of text files that have more than white space; a line's id is its number in its file, or, with through, in all files by their names."""
    df = numbered_lines(spark.read.text(path), through).filter(F.trim("value") != "")
    found = {"doc_id": F.col("line"), "url": F.lit(url), "domain": F.lit(domain), "text": F.col("value")}
    return df.select(F.lit(resource).alias("resource_id"), partition_id(F.lit(resource), F.col("file")).alias("partition_id"), *(found.get(c, F.lit(None)).cast("string").alias(c) for c in FIELDS))


def read_conllu(spark: SparkSession, path: str, resource: str) -> DataFrame:
    """Sentences of CoNLL-U by their comments; the text is one sentence already."""
    df = spark.read.option("lineSep", "\n\n").text(path)
    field = lambda name: F.regexp_extract("value", rf"(?m)^# {name} = (.*)$", 1)
    return _candidates(df.filter(field("text") != ""), resource, doc_id=F.nullif(field("sent_id"), F.lit("")), title=F.nullif(field("source"), F.lit("")), text=field("text"))


def read_tatoeba(spark: SparkSession, path: str, resource: str, languages: tuple[str, ...] = ("sqi", "sq"), member: str = "sentences_detailed.csv") -> DataFrame:
    """Tab-separated id, language and sentence, in tar archives."""

    def members(data, file: str):
        with tarfile.open(fileobj=data, mode="r|*") as t:
            for m in t:
                if m.name.endswith(member):
                    for line in _lines(t.extractfile(m)):
                        fields = line.rstrip("\r\n").split("\t", 3)
                        if len(fields) > 2 and fields[1] in languages:
                            yield fields[0], fields[2]

    found = _archives(spark, path, resource, members, "parallel")
    return found.withColumns({"title": F.lit("Tatoeba"), "url": F.concat(F.lit("https://tatoeba.org/en/sentences/show/"), "doc_id"), "domain": F.lit("tatoeba.org")})


def _strings(field: T.DataType, at: Column, path: str) -> list[Column]:
    """Arrays of (path, value) of all strings in a value: structs, lists and maps are walked."""
    if isinstance(field, T.StringType):
        return [F.array(F.struct(F.lit(path).alias("path"), at.alias("value")))]
    if isinstance(field, T.StructType):
        return [x for f in field.fields for x in _strings(f.dataType, at[f.name], f"{path}.{f.name}" if path else f.name)]
    if isinstance(field, T.MapType):
        return _strings(T.ArrayType(field.valueType), F.map_values(at), path)
    if isinstance(field, T.ArrayType):
        inner = field.elementType
        if not any(isinstance(t, T.StringType) for t in _leaves(inner)):
            return []
        return [F.flatten(F.transform(at, lambda x: F.concat(*_strings(inner, x, path))))]
    return []


def _leaves(t: T.DataType) -> Iterator[T.DataType]:
    if isinstance(t, T.StructType):
        for f in t.fields:
            yield from _leaves(f.dataType)
    elif isinstance(t, T.ArrayType):
        yield from _leaves(t.elementType)
    elif isinstance(t, T.MapType):
        yield from _leaves(t.valueType)
    else:
        yield t


def read_parquet_strings(spark: SparkSession, path: str, resource: str) -> DataFrame:
    """All useful strings of any Parquet file, however nested: doc_id says which field."""
    df = spark.read.parquet(path)
    found = [F.coalesce(x, F.array().cast("array<struct<path:string,value:string>>")) for x in _strings(df.schema, F.struct(*[F.col(f"`{c}`") for c in df.columns]), "")]
    rows = df.select(F.col("_metadata.file_path").alias("p"), F.posexplode(F.concat(*found)).alias("i", "s")).filter(X.useful_text(F.col("s.value")))
    none = F.lit(None).cast("string")
    return rows.select(F.lit(resource).alias("resource_id"), partition_id(F.lit(resource), F.col("p")).alias("partition_id"), F.concat_ws("#", "s.path", "i").alias("doc_id"), *(none.alias(c) for c in FIELDS[1:-1]), F.col("s.value").alias("text"))


Member = Callable[[BinaryIO, str], Iterator[tuple[str, str]]]
_BATCH = 2000


def _opened(file: str) -> BinaryIO:
    """A file that a task reads piece by piece, from any place on."""
    fs, path = filesystem(file)
    return fs.open_input_file(path)


def _lines(data: BinaryIO) -> Iterator[str]:
    """Lines of a member of a stream, which can't be gone back in."""
    for line in data:
        yield line.decode("utf-8", "replace")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of files. Their content isn't a column, so that Spark neither reads it nor limits it to what a row can hold."""
    return spark.read.format("binaryFile").load(path).select("path")


def _read_by_tasks(files: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that a function gives of each row of files, in batches."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        found = (row for pdf in batches for own in pdf.itertuples(index=False) for row in rows(*own))
        while some := list(islice(found, _BATCH)):
            yield pd.DataFrame(some, columns=names)

    return files.mapInPandas(run, schema)


def _candidate_rows(df: DataFrame, resource: str, genre: str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit(resource).alias("resource_id"), partition_id(F.lit(resource), F.col("path")).alias("partition_id"), "doc_id", none.alias("title"), none.alias("url"), none.alias("domain"), F.lit(genre).cast("string").alias("genre"), none.alias("quality"), "text")


def _archives(spark: SparkSession, path: str, resource: str, members: Member, genre: str | None = None) -> DataFrame:
    """(doc_id, text) of archives that are one stream, each read by one task, which holds a piece of it and a batch of rows."""

    def rows(file: str):
        with _opened(file) as data:
            for doc_id, text in members(data, file):
                yield file, doc_id, text

    return _candidate_rows(_read_by_tasks(_files(spark, path), rows, "path string, doc_id string, text string"), resource, genre)


def zip_members(spark: SparkSession, path: str, wanted: Callable[[list[str]], list[str]]) -> DataFrame:
    """path and member of what is wanted of each zip's names. Only the directories at the ends of the zips are read; members are dealt over tasks."""

    def names(file: str):
        with _opened(file) as data, zipfile.ZipFile(data) as z:
            for name in wanted(z.namelist()):
                yield file, name

    found = _read_by_tasks(_files(spark, path), names, "path string, member string")
    return found.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "member").sortWithinPartitions("path", "member")


def _from_zips(rows: Callable[[zipfile.ZipFile, str, str], Iterator[tuple]]) -> Callable[[str, str], Iterator[tuple]]:
    """Rows of a member of a zip (opened zip, path, member) for rows of zip_members(): a zip stays open until its last member, so its directory is read once in a task, not for each member."""
    opened: dict[str, zipfile.ZipFile] = {}

    def run(file: str, name: str) -> Iterator[tuple]:
        if file not in opened:
            for z in opened.values():
                z.fp.close() if z.fp else None
            opened.clear()
            opened[file] = zipfile.ZipFile(_opened(file))
        return rows(opened[file], file, name)

    return run


def read_xz_lines(spark: SparkSession, path: str, resource: str) -> DataFrame:
    def members(data: BinaryIO, file: str):
        with lzma.open(data, "rt", encoding="utf-8", errors="replace") as f:
            for n, line in enumerate(f, 1):
                if line.strip():
                    yield str(n), line.rstrip("\r\n")

    return _archives(spark, path, resource, members)


def read_moses_zip(spark: SparkSession, path: str, resource: str, suffix: str = ".sq") -> DataFrame:
    """Lines of every member with a suffix, in every zip; several tasks may read one zip, each its members."""

    def rows(z: zipfile.ZipFile, file: str, name: str):
        with io.TextIOWrapper(z.open(name), "utf-8", "replace", "\n") as lines:
            for n, line in enumerate(lines, 1):
                if line.strip():
                    yield file, f"{name}:{n}", line.rstrip("\r\n")

    members = zip_members(spark, path, lambda names: [x for x in names if x.endswith(suffix)])
    return _candidate_rows(_read_by_tasks(members, _from_zips(rows), "path string, doc_id string, text string"), resource, "parallel")


def read_tar_sentences(spark: SparkSession, path: str, resource: str, suffix: str = "-sentences.txt") -> DataFrame:
    """Members of id, tab and text."""

    def members(data: BinaryIO, file: str):
        with tarfile.open(fileobj=data, mode="r|*") as t:
            for m in t:
                if m.name.endswith(suffix):
                    for line in _lines(t.extractfile(m)):
                        i, tab, text = line.rstrip("\r\n").partition("\t")
                        if tab and text.strip():
                            yield i, text

    return _archives(spark, path, resource, members)


def read_xml_zip(spark: SparkSession, path: str, resource: str) -> DataFrame:
    """Paragraphs (p) of documents (doc) of the first .xml member of zips: the paragraph's id, or else the document's, and its quality; the document's title, URL and domain."""
    schema = "path string, doc_id string, title string, url string, domain string, quality string, text string"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def rows(z: zipfile.ZipFile, file: str, name: str):
        for paragraph in _paragraphs(z.open(name)):
            yield file, *paragraph

    df = _read_by_tasks(zip_members(spark, path, lambda found: [x for x in found if x.endswith(".xml")][:1]), _from_zips(rows), schema)
    return df.select(F.lit(resource).alias("resource_id"), partition_id(F.lit(resource), F.col("path")).alias("partition_id"), *(F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in FIELDS))


def _paragraphs(source) -> Iterator[tuple]:
    doc: dict = {}
    for event, node in ElementTree.iterparse(source, ("start", "end")):
        if event == "start" and node.tag == "doc":
            doc = dict(node.attrib)
        elif event == "end" and node.tag == "p":
            yield node.get("id") or doc.get("id") or "unknown-paragraph", doc.get("title"), doc.get("url"), doc.get("domain"), node.get("quality"), "".join(node.itertext())
            node.clear()
        elif event == "end" and node.tag == "doc":
            doc = {}
            node.clear()


_WIKI_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\||[\[\]'=]")


def plain_wiki(text: str) -> str:
    """Wiki markup off: templates go, however nested; of a link its last part stays; brackets, quotes and "=" are spaces."""
    out: list[str] = []
    link: list[str] = []
    templates = links = at = 0

    def put(s: str) -> None:
        if s and not templates:
            (link if links else out).append(s)

    for m in _WIKI_MARK.finditer(text):
        put(text[at : m.start()])
        at, mark = m.end(), m.group()
        if mark == "{{":
            templates += 1
        elif mark == "}}" and templates:
            templates -= 1
        elif templates:
            pass
        elif mark == "[[":
            links += 1
            link.clear()
        elif mark == "]]" and links:
            links -= 1
            out.append("".join(link) + " ")
            link.clear()
        elif links:
            link.clear() if mark == "|" else link.append(mark)
        else:
            out.append({"[[": "  ", "]]": "  "}.get(mark, " " if mark in "[]'=" else mark))
    put(text[at:])
    return "".join(out)


@F.pandas_udf(T.StringType())
def strip_wiki(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else plain_wiki(t))


def read_wiki(spark: SparkSession, path: str, resource: str) -> DataFrame:
    """Pages of name space 0 of a MediaWiki dump (bzip2 splits), without their markup."""
    df = spark.read.format("xml").option("rowTag", "page").schema("id string, ns int, title string, revision struct<text: struct<_VALUE: string>>").load(path).filter("ns = 0 AND trim(revision.text._VALUE) <> ''")
    return _candidates(df, resource, doc_id=F.col("id"), title=F.col("title"), domain=F.lit("wikimedia.org"), genre=F.lit("wikimedia"), text=strip_wiki(F.col("revision.text._VALUE")))


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file as selections, trimmed; empty ones and those after "#" go. An empty selection is an error."""
    rows = spark.read.text(path).select(F.trim("value").alias("selection")).filter("selection <> '' AND NOT startswith(selection, '#')")
    if not rows.limit(1).count():
        raise ValueError(f"{path} selects nothing")
    return rows


def read_lexemes(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of "-lexeme" of text files: lex, tags (of verbs), paradigm, lexref and translation."""
    blocks = spark.read.option("lineSep", "-lexeme").text(path)
    field = lambda name: F.nullif(F.regexp_extract("value", rf"(?:^|\n)\s*{name}:\s*(\S+)", 1), F.lit(""))
    gramm = F.regexp_extract("value", r"(?:^|\n)\s*gramm:\s*([^\n]+)", 1)
    tags = F.filter(F.transform(F.split(gramm, ","), lambda t: F.trim(t)), lambda t: t != "")
    trans = F.trim(F.regexp_extract("value", r"(?s)(?:^|\n)\s*trans_en:\s*(.*)$", 1))
    found = blocks.select(field("lex").alias("lex"), tags.alias("tags"), field("paradigm").alias("paradigm"), field("lexref").alias("lexref"), F.regexp_replace(trans, r"\s+$", "").alias("trans_en"))
    return found.filter(F.col("lex").isNotNull() & F.array_contains("tags", "V"))


#: Forms of an inflection template that are not forms.
TEMPLATE_TAGS = ("table-tags", "inflection-template", "class")


def read_wordforms(spark: SparkSession, path: str) -> DataFrame:
    """Forms of JSON lines of a dictionary: those of conjugation tables that have tags, without what belongs to the template: word, nth, form, tags."""
    rows = spark.read.schema("word string, forms array<struct<form:string,tags:array<string>,source:string>>").json(path)
    found = rows.select("word", F.posexplode("forms").alias("nth", "f")).select("word", "nth", F.col("f.form").alias("form"), F.col("f.tags").alias("tags"), F.col("f.source").alias("source"))
    return found.filter((F.col("source") == "conjugation") & (F.size("tags") > 0) & ~F.arrays_overlap("tags", F.array(*map(F.lit, TEMPLATE_TAGS)))).drop("source")


def read_analyses(spark: SparkSession, path: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of an analyzer (JSON lines) for targets (target_id, target_key): those that are valid, the first of each target and
    mode; and how many rows were refused why: broken, unknown target, key of another target, repeated."""
    schema = "targetId string, targetKey string, mode string, token string, analyses array<struct<wf:string,lemma:string,gramm:string,tags:array<string>>>, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    known = targets.select(F.col("target_id").alias("targetId"), F.col("target_key").alias("known"))
    rows = rows.join(known, "targetId", "left")
    why = F.when(F.col("_bad").isNotNull() | F.col("mode").isNull(), "broken").when(F.col("known").isNull(), "unknown").when(F.col("known") != F.col("targetKey"), "other key")
    rows = rows.withColumn("why", why)
    first = Window.partitionBy("targetId", "mode").orderBy("token", F.to_json("analyses"))
    valid = rows.filter("why IS NULL").withColumn("nth", F.row_number().over(first))
    refused = rows.filter("why IS NOT NULL").select("why").unionByName(valid.filter("nth > 1").select(F.lit("repeated").alias("why"))).groupBy("why").agg(F.count("*").alias("n"))
    return valid.filter("nth = 1").select("targetId", "mode", "token", "analyses"), refused


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a JSON file with tokens in lower case, without empty ones."""
    schema = "targets array<struct<id:string,targetKey:string,displayForm:string,tokens:array<string>,signature:string,verbId:string,lemma:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("targets").alias("t")).select("t.*")
    tokens = F.filter(F.transform("tokens", X.normalize_token), lambda t: t != "")
    return rows.select(F.col("id").alias("target_id"), F.col("targetKey").alias("target_key"), F.col("displayForm").alias("display_form"), tokens.alias("tokens"), "signature", F.col("verbId").alias("verb_id"), "lemma")


def ledger(spark: SparkSession, path: str, formats: DataFrame) -> DataFrame:
    """Downloaded resources with an id, a path and a format that formats (format, kind) knows; others are left out."""
    schema = "resources array<struct<id:string,status:string,localPath:string,format:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("resources").alias("r")).select("r.*")
    return rows.filter("status = 'downloaded' AND id IS NOT NULL AND localPath IS NOT NULL").join(F.broadcast(formats), "format").select("id", F.col("localPath").alias("path"), "format", "kind")


#: Kind of a source to its reader.
READERS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {
    "json lines": read_jsonl, "filtered json lines": read_jsonl_filtered, "xml zip": read_xml_zip, "xz lines": read_xz_lines, "text lines": read_text_lines, "moses zip": read_moses_zip,
    "tar sentences": read_tar_sentences, "parquet": read_parquet_strings, "wiki": read_wiki, "tatoeba": read_tatoeba, "conllu": read_conllu,
}


def open_resource(spark: SparkSession, resource: str, kind: str, path: str) -> DataFrame:
    """Candidates of a resource by the reader of its kind."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    return READERS[kind](spark, path, resource)


#: A lexicon's JSON: one entry for each file, whose name is its id.
LEXICON_JSON = """id string, lemma string, translationEn string, class int, auxiliary string, principalParts struct<present:string,aorist:string,participle:string>,
    sources array<struct<source:string,reference:string>>, flags struct<isSuppletive:boolean,hasMutation:boolean,irregularAorist:boolean,noMiddlePassive:boolean,thirdPersonOnly:boolean,middlePassiveThirdPersonOnly:boolean>,
    dialect string, notes string, cellOverrides map<string,map<string,string>>, englishForms struct<base:string,past:string,participle:string,gerund:string>, _bad string"""


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a folder of JSON files with what is wrong with each (errors, empty if nothing)."""
    rows = spark.read.schema(LEXICON_JSON).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    some = lambda test, what: F.when(test, what)
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    parts = F.col("principalParts")
    errors = F.filter(F.array(
        some(F.col("_bad").isNotNull(), "not readable"), some(~F.coalesce(F.col("id").rlike("^[a-z0-9-]+$"), F.lit(False)), "id"), some(F.col("file") != F.concat("id", F.lit(".json")), "file name"), some(empty(F.col("lemma")), "lemma"),
        some(empty(F.col("translationEn")), "translation"), some(~F.coalesce(F.col("class").isin(1, 2, 3), F.lit(False)), "class"), some(~F.coalesce(F.col("auxiliary").isin("kam", "jam"), F.lit(False)), "auxiliary"),
        some(empty(parts["present"]) | empty(parts["aorist"]) | empty(parts["participle"]), "principal parts"), some(F.coalesce(F.size("sources") < 1, F.lit(True)), "sources"), some(F.col("dialect").isNotNull() & ~F.col("dialect").isin("tosk", "geg"), "dialect"),
        some(F.col("cellOverrides").isNotNull() & F.exists(F.flatten(F.transform(F.map_values("cellOverrides"), F.map_keys)), lambda k: ~k.isin("1sg", "2sg", "3sg", "1pl", "2pl", "3pl")), "cells"),
    ), lambda e: e.isNotNull())
    rows = rows.withColumn("errors", errors)
    for name in ("id", "lemma"):
        twice = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").select(name, F.lit(True).alias("twice"))
        rows = rows.join(twice, name, "left").withColumn("errors", F.when(F.col("twice"), F.concat("errors", F.array(F.lit(f"duplicate {name}")))).otherwise(F.col("errors"))).drop("twice")
    return rows.drop("_bad")


def as_lexicon(entries: DataFrame) -> DataFrame:
    """Valid entries in the form that inflection takes; overrides are keyed mood.tense[.voice]/cell."""
    flag = lambda name: F.coalesce(F.col(f"flags.{name}"), F.lit(False))
    flat = F.flatten(F.transform(F.map_entries("cellOverrides"), lambda e: F.transform(F.map_entries(e["value"]), lambda c: F.struct(F.concat(e["key"], F.lit("/"), c["key"]).alias("key"), c["value"].alias("value")))))
    overrides = F.coalesce(F.map_from_entries(flat), F.create_map().cast("map<string,string>"))
    return entries.filter(F.size("errors") == 0).select(
        F.col("id").alias("verb_id"), "lemma", F.col("translationEn").alias("translation_en"), "class", "auxiliary", F.col("principalParts.present").alias("present"), F.col("principalParts.aorist").alias("aorist"),
        F.col("principalParts.participle").alias("participle"), flag("isSuppletive").alias("is_suppletive"), flag("noMiddlePassive").alias("no_middle_passive"), flag("thirdPersonOnly").alias("third_person_only"),
        flag("middlePassiveThirdPersonOnly").alias("mp_third_person_only"), overrides.alias("overrides"),
    )
