"""Other tools' formats in and out: memory exports, conversation exports, note vaults, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..functions.text import body, file_name, frontmatter, note_title, wikilinks

ITEM = "map<string,string>"


def _whole(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    return spark.read.option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("value").alias("doc"), F.input_file_name().alias("path"))


def _list(doc: Column, *keys: str) -> Column:
    """The JSON list that a document is, or has under the first key that holds one, as array of JSON texts."""
    as_items = lambda c: F.from_json(c, "array<string>")
    own = F.when(F.ltrim(doc).startswith("["), as_items(doc))
    return F.coalesce(own, *[F.when(F.get_json_object(doc, f"$.{k}").startswith("["), as_items(F.get_json_object(doc, f"$.{k}"))) for k in keys])


def read_memory_export(spark: SparkSession, path: str) -> DataFrame:
    """(content, user_id, metadata) of exports that are an array, or hold one as results, memories or data.

    Blank texts are left out; created_at, updated_at, hash and categories go to the metadata where absent there.
    """
    item = _whole(spark, path, "*.json").select(F.explode(_list(F.col("doc"), "results", "memories", "data")).alias("x"))
    m = item.select(F.from_json("x", ITEM).alias("m"))
    content = F.coalesce(F.col("m")["memory"], F.col("m")["text"], F.col("m")["content"])
    meta = F.coalesce(F.from_json(F.col("m")["metadata"], ITEM), F.create_map().cast(ITEM))
    extra = F.map_filter("m", lambda k, v: k.isin("created_at", "updated_at", "hash", "categories") & v.isNotNull())
    joined = F.map_concat(meta, F.map_filter(extra, lambda k, v: ~F.map_contains_key(meta, k)))
    return m.select(content.alias("content"), F.col("m")["user_id"].alias("user_id"), F.to_json(joined).alias("metadata")).filter(F.trim("content") != "")


def read_conversation_export(spark: SparkSession, path: str) -> DataFrame:
    """(content, user_id, metadata) of exports with facts and messages; files with neither are an error."""
    doc = _whole(spark, path, "*.json")
    facts, messages = _list(F.get_json_object("doc", "$.facts")), _list(F.get_json_object("doc", "$.messages"))
    if not doc.filter(facts.isNull() & messages.isNull()).isEmpty():
        raise ValueError("found neither facts nor messages")
    user = F.coalesce(F.get_json_object("doc", "$.user_id"), F.get_json_object("doc", "$.session_id"))
    f = doc.select(user.alias("user_id"), F.explode(facts).alias("x"))
    text = F.when(F.ltrim("x").startswith("{"), F.coalesce(F.get_json_object("x", "$.fact"), F.get_json_object("x", "$.content"))).otherwise(F.col("x"))
    f = f.select(text.alias("content"), "user_id", F.lit('{"kind":"fact"}').alias("metadata"))
    m = doc.select(user.alias("user_id"), F.explode(messages).alias("x"))
    role = F.coalesce(F.get_json_object("x", "$.role"), F.get_json_object("x", "$.role_type"), F.lit("user"))
    m = m.select(F.coalesce(F.get_json_object("x", "$.content"), F.get_json_object("x", "$.message")).alias("content"), "user_id", F.to_json(F.struct(F.lit("message").alias("kind"), role.alias("role"))).alias("metadata"))
    return f.unionByName(m).filter(F.trim("content") != "")


def parse_notes(docs: DataFrame, text: str, path: str) -> DataFrame:
    """(path, title, body, metadata, links) of notes with an optional leading block."""
    fm = frontmatter(text)
    stem = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[^.]*$", "")
    return docs.select(F.col(path).alias("path"), F.coalesce(fm["title"], F.when(stem != "", stem), F.lit("untitled")).alias("title"), body(text).alias("body"), F.to_json(fm).alias("metadata"), wikilinks(body(text)).alias("links"))


def read_vault(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(notes, edges) of a folder of Markdown notes; links become ``links_to`` edges. The .obsidian folder is skipped."""
    docs = _whole(spark, path, "*.md").filter(~F.col("path").contains("/.obsidian/"))
    notes = parse_notes(docs, "doc", "path")
    return notes, notes.select(F.col("title").alias("src"), F.lit("links_to").alias("relation"), F.explode("links").alias("dst"))


def watch_vault(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of notes: files that come or change are read again."""
    return parse_notes(spark.readStream.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.input_file_name().alias("path")), "value", "path")


def read_batch(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Events of a JSON file, one object or a list of them, for one source."""
    x = _whole(spark, path).select(F.explode(F.coalesce(_list(F.col("doc")), F.array("doc"))).alias("payload"))
    return x.select(F.lit(source).alias("source"), F.coalesce(F.get_json_object("payload", "$.event_type"), F.lit("unknown")).alias("event_type"), "payload")


def entity_events(events: DataFrame, entity: str) -> DataFrame:
    """All events whose payload holds a text, by time."""
    return events.filter(F.col("payload").contains(entity)).orderBy("ts", "id")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def render_notes(mem: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, note): one Markdown note per active memory, with its subject's outgoing links."""
    from pyspark.sql import Window

    links = edges.groupBy(F.col("src").alias("subject")).agg(F.sort_array(F.collect_set("dst")).alias("links"))
    m = mem.filter("state = 'active'").join(links, "subject", "left")
    name = file_name(note_title("subject", "id"))
    w = Window.partitionBy(name).orderBy("id")
    nth = F.row_number().over(w) - 1
    front = F.concat(F.lit("---\nid: "), F.col("id"), F.lit("\nstate: "), F.col("state"), F.lit("\nimportance: "), F.coalesce(F.format_number("importance", 2), F.lit("")), F.lit("\nmem_type: "), F.coalesce("mem_type", F.lit("semantic")), F.lit("\n---\n"))
    tail = F.when(F.size("links") > 0, F.concat(F.lit("\n\n## Links\n"), F.array_join(F.transform("links", lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n"))).otherwise(F.lit(""))
    return m.select(F.concat(name, F.when(nth == 0, F.lit("")).otherwise(F.concat(F.lit("-"), nth.cast("string"))), F.lit(".md")).alias("file"), F.concat(front, F.coalesce("content", F.lit("")), tail, F.lit("\n")).alias("note"))


def write_vault(spark: SparkSession, notes: DataFrame, root: str) -> None:
    """Write each note as a file, from the executors, to a folder that they share (file:, s3:, hdfs:, gs:).

    On a cluster a folder of the local disk is refused unless it lies below the shared folder of the session.
    """
    uri = root if "://" in root else "file://" + root
    local = spark.sparkContext.master.startswith("local")
    if uri.startswith("file:") and not local and not uri.startswith(checkpoint_dir(spark)):
        raise ValueError("notes of a cluster need a shared folder")

    def put(rows):
        from pyarrow import fs

        at, base = fs.FileSystem.from_uri(uri)
        at.create_dir(base, recursive=True)
        for r in rows:
            with at.open_output_stream(f"{base}/{r['file']}") as f:
                f.write(r["note"].encode())

    notes.foreachPartition(put)
