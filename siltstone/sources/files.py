"""File sources and sinks: text, Markdown, JSON, ZIP and DOCX to blocks; PDF and images behind optional libraries.

Files come as (path, content) of Spark's ``binaryFile`` source. Text and Markdown are parsed by expressions; JSON of unknown
depth, archives and DOCX by Arrow functions over the bytes. A file that can't be parsed gives one row with its error.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.config import DEFAULTS as D
from siltstone.config import EXTENSIONS
from siltstone.functions import folds
from siltstone.functions import text as T
from siltstone.plans.lineage import cut

BLOCKS = "path string, seq int, text string, section string, modality string, error string"


def read(spark: SparkSession, path: str, glob: str | None = None, cap: int | None = None) -> DataFrame:
    """(path, length, content); files beyond ``cap`` bytes are left out before their content is read."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return (files.where(F.col("length") <= cap) if cap else files).select("path", "length", "content")


def decoded(content: Column) -> Column:
    """UTF-8 where valid, else Windows-1252: Latin-1 with other letters for the bytes from 0x80 to 0x9F."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    known = [(a, b) for a, b in pairs if b]
    latin = F.translate(F.decode(content, "iso-8859-1"), "".join(a for a, _ in known), "".join(b for _, b in known))
    return F.coalesce(F.try_validate_utf8(content.cast("string")), latin)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"[^/]+$", 0), r"\.[^.]+$", "")


def plain_blocks(files: DataFrame) -> DataFrame:
    text = T.clean(decoded(F.col("content")))
    return files.select("path", F.lit(1).alias("seq"), text.alias("text"), F.lit(None).cast("string").alias("section"), F.lit("text").alias("modality"), F.lit(None).cast("string").alias("error")).where("text <> ''")


HEADING_NEXT = r"\n(?= *#{1,6}(?:[\t\x0B\f\r]| +[^ \n]))"


def markdown_blocks(files: DataFrame) -> DataFrame:
    """A block for each heading and each body; sections are the stack of headings above, joined by ' > '.

    A file is cut before each heading line; the fold over the cuts holds no more than the stack of headings.
    """
    cuts = F.split(F.regexp_replace(decoded(F.col("content")), r"\r\n?", "\n"), HEADING_NEXT)

    def part(cut_: Column) -> Column:
        line = F.trim(F.substring_index(cut_, "\n", 1))
        level = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
        rest = F.when(F.instr(cut_, "\n") > 0, F.substr(cut_, F.instr(cut_, "\n") + 1)).otherwise("")
        return F.struct(level.alias("level"), F.regexp_extract(line, r"^#{1,6}\s+(.*)$", 1).alias("title"), T.clean(F.when(level > 0, rest).otherwise(cut_)).alias("body"))

    def step(s: Column, p: Column) -> Column:
        above = F.slice(s["held"], F.lit(1), F.least(F.greatest(p["level"] - 1, F.lit(0)), F.size(s["held"])))
        title = F.trim(p["title"])
        stack = F.when(p["level"] == 0, s["held"]).when(title == "", above).otherwise(F.concat(above, F.array(title)))
        return folds.state(stack, folds.put(s["out"], F.when(F.size(stack) > 0, F.array_join(stack, " > "))))

    def told(p: Column, section: Column) -> Column:
        rows = F.array(F.struct(section.alias("section"), F.trim(p["title"]).alias("text")), F.struct(section.alias("section"), p["body"].alias("text")))
        return F.filter(rows, lambda r: r["text"] != "")

    held = files.select("path", F.transform(cuts, part).alias("parts"))
    held = held.withColumn("sections", folds.fold(F.col("parts"), F.array().cast("array<string>"), "string", step, lambda s: s["out"]))
    out = held.select("path", F.posexplode(F.flatten(F.zip_with("parts", "sections", told))).alias("at", "b"))
    return out.select("path", (F.col("at") + 1).alias("seq"), "b.text", "b.section", F.lit("text").alias("modality"), F.lit(None).cast("string").alias("error"))


def scalar(value) -> str:
    if value is None:
        return "null"
    return str(value).lower() if isinstance(value, bool) else " ".join(str(value).split())


def paths(node, at: str = "", most: int = D.json_depth) -> Iterator[str]:
    """Depth-first 'path = value' lines, with an explicit stack so that depth costs no recursion."""
    stack = [(node, at, 0)]
    while stack:
        node, at, depth = stack.pop()
        name = at or "root"
        if depth > most:
            yield f"{name} = [nesting too deep]"
        elif isinstance(node, dict) and node:
            stack += [(v, f"{at}.{k}" if at else str(k), depth + 1) for k, v in reversed(node.items())]
        elif isinstance(node, list) and node:
            stack += [(v, f"{at}[{i}]", depth + 1) for i, v in reversed([*enumerate(node)])]
        else:
            yield f"{name} = " + ("{}" if isinstance(node, dict) else "[]" if isinstance(node, list) else scalar(node))


def title_of(record, index: int) -> str:
    keys = ("name", "title", "id", "key", "label", "subject", "question")
    named = (str(record[k]).strip() for k in keys if isinstance(record.get(k), (str, int))) if isinstance(record, dict) else ()
    return next((n[:120] for n in named if n), f"record {index}")


def json_parts(data, name: str) -> Iterator[tuple[str, str]]:
    """(section, text): a block for each record of a long array, each key of an object with a long value, else one."""
    n = D.json_lines
    if isinstance(data, list) and len(data) >= D.json_records:
        for i, record in enumerate(data):
            yield f"{name}[{i}] ({title_of(record, i)})", "\n".join([*paths(record, f"[{i}]")][:n])
    elif isinstance(data, dict) and any(isinstance(v, (list, dict)) and len(v) >= D.json_records for v in data.values()):
        for key, value in data.items():
            yield str(key), "\n".join([*paths(value, str(key))][:n])
    else:
        yield name, "\n".join([*paths(data)][: 4 * n])


def _blocks_of(files: DataFrame, parse) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, i + 1, text, section, kind, None) for i, (section, text, kind) in enumerate(parse(path, bytes(content)))]
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "seq", "text", "section", "modality", "error"]).astype({"seq": "Int32"})

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def json_blocks(files: DataFrame) -> DataFrame:
    def parse(path: str, content: bytes):
        name = re.sub(r"\.[^.]+$", "", path.rsplit("/", 1)[-1])
        for section, text in json_parts(json.loads(content.decode("utf-8-sig")), name):
            yield section, text, "json"

    return _blocks_of(files, parse).withColumn("text", T.clean(F.col("text"))).where("text <> '' or error is not null")


WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs and tables of the body in order; heading styles make the section stack."""

    def parse(path: str, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_XML}body")
        stack: list[str] = []
        for node in body if body is not None else ():
            if node.tag == f"{WORD_XML}p":
                text = "".join(t.text or "" for t in node.iter(f"{WORD_XML}t")).strip()
                style = node.find(f"{WORD_XML}pPr/{WORD_XML}pStyle")
                level = re.match(r"(?i)heading\s*(\d)", style.get(f"{WORD_XML}val", "")) if style is not None else None
                if level and text:
                    stack[int(level[1]) - 1 :] = [text]
                if text:
                    yield " > ".join(stack) or None, text, "text"
            elif node.tag == f"{WORD_XML}tbl":
                rows = [[" ".join("".join(t.text or "" for t in c.iter(f"{WORD_XML}t")).split()) for c in r.iter(f"{WORD_XML}tc")] for r in node.iter(f"{WORD_XML}tr")]
                while rows and not any(rows[-1]):
                    rows.pop()
                width = max(map(len, rows), default=0)
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                if lines:
                    yield " > ".join(stack) or None, "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]), "table"

    return _blocks_of(files, parse)


ENTRIES = "path string, name string, depth int, content binary, reason string"
LISTED = "path string, name string, depth int, chain array<int>, at long, reason string"
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, pa.ArrowInvalid, NotImplementedError, RuntimeError)  # Arrow's: files shorter than a directory's end; the last two: unknown methods, passwords
JUNK = r"(^|/)(__MACOSX|\.DS_Store|Thumbs\.db|\.git)(/|$)|(^|/)\._|/$"


def opened(path: str):
    """A seekable file by the path Spark gives it."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) or path.startswith("file:"):
        return open(re.sub("^file:/*", "/", path), "rb")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def zip_entries(files: DataFrame, entries: int = D.zip_entries, most: int = D.zip_bytes, deepest: int = D.zip_depth, range_bytes: int = D.zip_range, opener=opened) -> DataFrame:
    """(path, name, depth, content, reason): entries of archives, nested ones too; skipped entries carry the reason.

    Only ``path`` of ``files`` is used. One task goes through an archive's directory and deals its entries by ranges of
    ``range_bytes`` unpacked bytes; other tasks seek to their ranges, so an archive is unpacked by as many tasks as it has ranges.
    A nested archive belongs to one range. ``entries``, ``most`` bytes and ``deepest`` bound what an archive may unpack to. An
    archive, nested archive or entry that can't be read is one row with the reason ``broken``, what stands beside it stays; an
    empty archive gives no row. ``opener`` gives a seekable file for a path, for storage that Arrow's file systems don't know.
    """

    def refused(info: zipfile.ZipInfo, name: str, depth: int, left: dict) -> str | None:
        if re.search(JUNK, name):
            return "junk"
        if re.search(T.LEAVES_FOLDER, info.filename.replace("\\", "/")):
            return "path"
        if info.external_attr >> 28 == 0o12:
            return "symlink"
        if "." + name.rsplit(".", 1)[-1].lower() not in EXTENSIONS:
            return "extension"
        if info.file_size > D.zip_ratio_from and info.file_size > D.zip_ratio * max(1, info.compress_size):
            return "ratio"
        if left["entries"] < 1 or left["bytes"] < info.file_size:
            return "budget"
        return "depth" if name.lower().endswith(".zip") and depth >= deepest else None

    def directory(file, prefix: str, chain: list[int], left: dict):
        with zipfile.ZipFile(file) as z:
            for i, info in enumerate(z.infolist()):
                name, depth, here = prefix + info.filename.replace("\\", "/"), len(chain) + 1, [*chain, i]
                at = left["at"] if chain else most - left["bytes"]
                left["at"] = at
                reason = refused(info, name, depth, left)
                if reason is None:
                    left["entries"] -= 1
                    left["bytes"] -= info.file_size
                    if name.lower().endswith(".zip"):
                        try:
                            yield from directory(io.BytesIO(z.read(info)), name + "/", here, left)
                        except BROKEN:
                            yield name, depth, here, at, "broken"
                        left["at"] = at
                        continue
                yield name, depth, here, at, reason

    def listed(batches):
        for batch in batches:
            for path in batch["path"]:
                rows = []
                with opener(path) as file:
                    try:
                        for name, depth, chain, at, reason in directory(file, "", [], {"entries": entries, "bytes": most, "at": 0}):
                            rows.append((path, name, depth, chain, at // range_bytes, reason))
                    except BROKEN:
                        rows = [(path, None, None, [], 0, "broken")]
                yield pd.DataFrame(rows, columns=["path", "name", "depth", "chain", "at", "reason"]).astype({"depth": "Int32", "at": "int64"})

    def unpacked(batches):
        now, stack = None, []  # the archive at hand, and the nested ones on the way to its last entry: (index, archive)
        rows, held = [], 0
        for batch in batches:
            for path, name, depth, chain, reason in zip(batch["path"], batch["name"], batch["depth"], batch["chain"], batch["reason"], strict=True):
                content = None
                if reason is None:
                    if path != now:
                        now, stack = path, [(None, zipfile.ZipFile(opener(path)))]
                    way = [None, *map(int, chain[:-1])]
                    while [i for i, _ in stack] != way[: len(stack)]:
                        stack.pop()
                    try:
                        for i in way[len(stack) :]:
                            above = stack[-1][1]
                            stack.append((i, zipfile.ZipFile(io.BytesIO(above.read(above.infolist()[i])))))
                        z = stack[-1][1]
                        content = z.read(z.infolist()[int(chain[-1])])
                        held += len(content)
                    except BROKEN:
                        reason = "broken"
                rows.append((path, name, depth, content, reason))
                if held >= range_bytes or len(rows) >= 1000:
                    yield framed(rows)
                    rows, held = [], 0
        yield framed(rows)

    def framed(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "name", "depth", "content", "reason"]).astype({"depth": "Int32"})

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as the rows say nothing of the bytes behind them
    dealt = files.select("path").mapInPandas(listed, LISTED).repartition(parts, "path", "at").sortWithinPartitions("path", "at", "chain")
    return dealt.mapInPandas(unpacked, ENTRIES)


IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif")


def image_blocks(files: DataFrame, caption: Column | None = None, ocr: Column | None = None) -> DataFrame:
    """A block for each image: its name, title, caption, text and size. ``caption`` and ``ocr`` are what models give for
    ``content``; without them an image has no more than its name and size."""
    words = F.lower(T.squeezed(F.regexp_replace(stem(F.col("path")), "[_-]+", " ")))
    size = T.image_size(F.col("content"))
    none = F.lit(None).cast("string")
    read_, told = (F.coalesce(F.when(F.trim(c) != "", F.trim(c)), none) if c is not None else none for c in (ocr, caption))
    shape = F.concat(F.lit("Size: "), size["width"].cast("string"), F.lit(" x "), size["height"].cast("string"))
    text = F.concat_ws("\n", F.concat(F.lit("Image: "), F.regexp_extract("path", "[^/]+$", 0)), F.concat(F.lit("Title: "), words), told, read_, shape)
    modality = F.when(read_.isNotNull(), "ocr").otherwise("caption")
    return files.select("path", F.lit(1).alias("seq"), text.alias("text"), none.alias("section"), modality.alias("modality"), none.alias("error"))


def blocks(files: DataFrame) -> DataFrame:
    """All formats by ending; what has no parser here gives a row with its error."""
    end = T.ending(F.col("path"))
    known = (".txt", ".md", ".markdown", ".json", ".docx", *IMAGES)
    other = files.where(~end.isin(*known)).select("path", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("modality"), F.lit("no parser").alias("error"))
    out = plain_blocks(files.where(end == ".txt"))
    for part in (markdown_blocks(files.where(end.isin(".md", ".markdown"))), json_blocks(files.where(end == ".json")), docx_blocks(files.where(end == ".docx")), image_blocks(files.where(end.isin(*IMAGES))), other):
        out = out.unionByName(part)
    return out


def store_by_content(files: DataFrame, path: str) -> DataFrame:
    """Content-addressed sink: a row a digest, partitioned by its first two digits; returns (path, sha256). What is stored stays,
    and a digest that is stored isn't written again."""
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"), "content")
    first = hashed.withColumn("n", F.row_number().over(Window.partitionBy("sha256").orderBy("path"))).where("n = 1")
    new = first.select("sha256", F.substring("sha256", 1, 2).alias("prefix"), "content")
    spark = files.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        new = new.join(spark.read.schema("sha256 string, prefix string").parquet(path), ["prefix", "sha256"], "left_anti")
    new.select("sha256", "prefix", "content").write.mode("append").partitionBy("prefix").parquet(path)
    return hashed.select("path", "sha256")


def stored_content(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, content) of ``store_by_content``, each digest once, also where two writers stored it at one time."""
    return spark.read.schema("sha256 string, content binary, prefix string").parquet(path).groupBy("sha256").agg(F.first("content").alias("content"))


def write_index(vectors: DataFrame, path: str, key: str, tenant: str, dim: int, vector: str = "embedding", at: str = "seq") -> None:
    """Vector sink, a keyed merge: a key's row of the greatest ``at`` replaces what the tenant's partition holds for it, other
    rows and other tenants stay. Rows of another dimension stop the write."""
    if vectors.where(F.size(vector) != dim).limit(1).count():
        raise ValueError(f"vectors of another dimension than {dim}")
    spark = vectors.sparkSession
    rest = [c for c in vectors.columns if c not in (key, tenant)]
    new = cut(vectors.groupBy(tenant, key).agg(F.max_by(F.struct(*rest), at).alias("row")).select(tenant, key, "row.*"))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        kept = spark.read.schema(new.schema).parquet(path).join(new.select(tenant).distinct(), tenant, "left_semi").join(new.select(tenant, key), [tenant, key], "left_anti")
        new = cut(new.unionByName(kept.select(*new.columns)))  # read whole before its partitions are replaced
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tenant).parquet(path)
