"""Reading corpora, rules, registries and archives; writing profiles, rules and reports. All paths are Spark's."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import time
from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.schema import PAIR, RULE_TOKEN

PROFILE_TABLES = ("bands", "segments", "metrics")


def corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc_id, path, fmt, text) of all files below the paths whose suffix is known; undecodable bytes are replaced.

    doc_id is a hash of the whole path, so files of one name in two folders stay apart.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt,tex}").format("binaryFile").load(list(paths))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.regexp_extract("path", r"\.(md|txt|tex)$", 1).alias("fmt"), text.alias("text")).orderBy("path")


def table_documents(table: DataFrame, key: str = "doc_id", text: str = "text", fmt: str = "md") -> DataFrame:
    return table.select(F.col(key).alias("doc_id"), F.lit(fmt).alias("fmt"), F.col(text).alias("text"))


def conversation_documents(conversations: DataFrame) -> DataFrame:
    """Conversations as documents with a paragraph for each turn."""
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.lit("md").alias("fmt"), F.array_join(F.transform("_t", lambda x: x["text"]), "\n\n").alias("text"))


def page_documents(pages: DataFrame) -> DataFrame:
    """Web pages as documents: their visible text, a line for each block."""
    t = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<nav\b.*?</nav>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)</(?:p|div|li|h[1-6]|tr|article|section)>|<br ?/?>", "\n"), r"<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return pages.select(F.col("page_id").alias("doc_id"), F.lit("txt").alias("fmt"), F.regexp_replace(t, r"[ \t]+", " ").alias("text"))


def rules_from_yaml(spark: SparkSession, *paths: str) -> DataFrame:
    """Rule tokens of rule files: existence rules with tokens, substitution rules with a swap map.

    Rule files are configuration, a few small ones; their number of tokens is what the driver holds.
    """
    rows = []
    for path, text in spark.sparkContext.wholeTextFiles(",".join(paths)).collect():
        rule, got = re.sub(r"\.ya?ml$", "", path.rsplit("/", 1)[-1]), yaml.safe_load(text)
        action = (got.get("action") or {}).get("name")
        head = (rule, got.get("level"), got.get("message"), action)
        rows += [(*head, str(t), None) for t in got.get("tokens") or ()]
        rows += [(*head, str(a), str(b)) for a, b in (got.get("swap") or {}).items()]
    return spark.createDataFrame(rows, RULE_TOKEN)


def rule_yaml(rule: DataFrame, source: str, licence: str, extends: str = "existence") -> str:
    """A rule's file: a head that says where it is from, then its fields and tokens in order."""
    rows = rule.orderBy("token").collect()
    head = {"extends": extends, "message": rows[0]["message"], "level": rows[0]["level"], "ignorecase": True}
    if extends == "substitution":
        head |= {"action": {"name": rows[0]["action"] or "replace"}, "swap": {r["token"]: r["replacement"] for r in rows}}
    else:
        head["tokens"] = [r["token"] for r in rows]
    return f"# Source: {source}\n# License: {licence}\n{yaml.safe_dump(head, sort_keys=False, allow_unicode=True)}"


def pairs(spark: SparkSession, path: str, models: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """(ord, name, axis, observer, performer, note) of a registry, in its order; of ``models`` (file) both must be there."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<{PAIR.simpleString()}>").alias("p"))
    all_ = text.select(F.posexplode("p").alias("ord", "p")).select("ord", "p.*")
    if not all_.limit(1).count():
        raise ValueError("the registry has no pairs")
    if models is not None:
        for side in ("observer", "performer"):
            all_ = all_.join(models.select(F.col("file").alias(side)), side, "left_semi")
        if not all_.limit(1).count():
            raise ValueError("no pair has both its models")
    if only:
        all_ = all_.where(F.col("name") == only)
        if not all_.limit(1).count():
            raise ValueError(f"there is no usable pair {only}")
    return all_.select("ord", *PAIR.fieldNames()).orderBy("ord")


def profile_name(name: str) -> str:
    return re.sub(r"[^-a-zA-Z0-9_]", "-", name)


def save_profile(root: str, name: str, **tables: DataFrame) -> None:
    for t in PROFILE_TABLES:
        tables[t].write.mode("overwrite").parquet(f"{root}/profile={profile_name(name)}/{t}")


def load_profile(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """A profile's tables; a name that isn't there raises an error that lists those that are."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = sorted(s.getPath().getName().removeprefix("profile=") for s in fs.listStatus(path)) if fs.exists(path) else []
    if profile_name(name) not in there:
        raise ValueError(f"there is no profile {name}; there are: {', '.join(there) or 'none'}")
    return {t: spark.read.parquet(f"{root}/profile={profile_name(name)}/{t}") for t in PROFILE_TABLES}


def vocabulary_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def json_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of arrays as a row for each, column ``value``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<array<string>>")).alias("value"))


def atom_entries(feeds: DataFrame) -> DataFrame:
    """(id, title, published, category, journal_ref, doi) of Atom feeds in column ``xml``."""
    entry = "struct<id:string,title:string,published:timestamp,category:string,journal_ref:string,doi:string>"
    cut = feeds.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e"))
    one = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</", 1)), F.lit(""))
    category = F.nullif(F.regexp_extract("e", r'<(?:\w+:)?primary_category[^>]*\bterm="([^"]*)"', 1), F.lit(""))
    fields = [one("id"), F.regexp_replace(one("title"), r"\s+", " "), F.try_to_timestamp(one("published")), category, one("journal_ref"), one("doi")]
    names = [f.split(":")[0] for f in entry[7:-1].split(",")]
    return cut.select(*[f.alias(n) for f, n in zip(fields, names, strict=True)])


def pages_of(fetch: Callable[[int, int], str], size: int = 100, most: int = 10_000, tries: int = 4, wait: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, str]]:
    """(start, xml) of the pages of a feed, from ``fetch(start, size)``, until a page has no entry or ``most`` are read.

    A fetch that fails with an OSError, as those of urllib do, or a page that isn't a feed is tried again, ``tries``
    times in all, with a pause that doubles; then the error is raised. Between pages there is one pause.
    """
    for start in range(0, most, size):
        pause = wait
        for attempt in range(tries):
            try:
                xml = fetch(start, min(size, most - start))
                if "<feed" not in xml:
                    raise OSError("the answer is no feed")
                break
            except OSError:
                if attempt == tries - 1:
                    raise
                sleep(pause)
                pause *= 2
        if "<entry>" not in xml:
            return
        yield start, xml
        sleep(wait)


def feed_pages(spark: SparkSession, fetch: Callable[[int, int], str], **options) -> DataFrame:
    """(start, xml) of a feed's pages, fetched by the driver one after the other, as a feed's owner asks for."""
    return spark.createDataFrame(list(pages_of(fetch, **options)), "start long, xml string")


def _projects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            files = {}
            try:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    files = {m.name: tar.extractfile(m).read().decode("utf-8", "replace") for m in tar if m.isfile() and m.name.endswith(".tex")}
            except tarfile.TarError:
                try:
                    files = {"main.tex": gzip.decompress(content).decode("utf-8", "replace")}
                except OSError:
                    continue
            mains = {n: t for n, t in files.items() if "\\begin{document}" in t}
            main = max(mains, key=lambda n: (len(mains[n]), n)) if mains else None
            rows += [(path, n, t, n == main) for n, t in sorted(files.items())]
        yield pd.DataFrame(rows, columns=["project", "name", "text", "is_main"])


def source_archives(spark: SparkSession, path: str) -> DataFrame:
    """(project, name, text, is_main) of archives of TeX projects; main is the largest file that begins a document."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_projects, "project string, name string, text string, is_main boolean")


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select("report").write.mode("overwrite").text(path)


def write_fixed(documents: DataFrame, path: str) -> None:
    """Mended documents as a table of their own; sources are never overwritten."""
    documents.write.mode("errorifexists").parquet(path)
