"""Readers of a notes vault, calendars, proposal batches and web pages; each gives rows that render to captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROPOSAL = T.StructType(
    [
        T.StructField("proposal_id", T.StringType()),
        T.StructField("source_capture_id", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField(
            "nodes_to_create",
            T.ArrayType(T.StructType([T.StructField("temp_id", T.StringType()), T.StructField("node_type", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("networks", T.ArrayType(T.StringType()))])),
        ),
        T.StructField("edges_to_create", T.ArrayType(T.StructType([T.StructField("source_id", T.StringType()), T.StructField("target_id", T.StringType()), T.StructField("edge_type", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
    ]
)


def front_matter(text: Column, name: str) -> Column:
    """A member of the block between the first two lines of dashes, '' if absent."""
    block = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    return F.regexp_extract(block, rf"(?m)^{name}\s*:\s*(.*?)\s*$", 1)


def read_notes(spark: SparkSession, path: str, since: str | None = None, excluded: tuple[str, ...] = (".git", ".obsidian", ".trash")) -> DataFrame:
    """(path, modified_at, title, category, date, kind, tags, links, body) of all .md files below ``path``.

    ``since`` is pushed to the listing of files; excluded folders are dropped by path.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    if since:
        reader = reader.option("modifiedAfter", since)
    files = reader.load(path)
    for name in excluded:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n", "\n")
    body = F.regexp_replace(F.col("text"), r"(?s)^---\s*\n.*?\n---\s*\n", "")
    listed = F.filter(F.split(F.regexp_replace(front_matter(F.col("text"), "tags"), r"[\[\]\"']", ""), r"\s*,\s*"), lambda x: F.length(x) > 0)
    return (
        files.select("path", F.col("modificationTime").alias("modified_at"), text.alias("text"))
        .select("path", "modified_at", "text", body.alias("body"))
        .select(
            "path",
            "modified_at",
            F.coalesce(F.nullif(front_matter(F.col("text"), "title"), F.lit("")), F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("title"),
            F.nullif(front_matter(F.col("text"), "category"), F.lit("")).alias("category"),
            F.nullif(front_matter(F.col("text"), "date"), F.lit("")).alias("date"),
            F.nullif(front_matter(F.col("text"), "type"), F.lit("")).alias("kind"),
            F.array_distinct(F.concat(listed, F.regexp_extract_all("body", F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), 1))).alias("tags"),
            F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\[([^\]|#]+)"), 1)).alias("links"),
            F.trim("body").alias("body"),
        )
    )


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *(F.when(F.length(v) > 0, F.concat(F.lit(f"{k}: "), v)) for k, v in pairs))


def note_captures(notes: DataFrame) -> DataFrame:
    """(raw_content, content_hash, metadata) as the connector renders a note: field lines, an empty line, the body."""
    head = _lines(("Note", F.col("title")), ("Date", F.col("date")), ("Category", F.col("category")), ("Type", F.col("kind")), ("Tags", F.concat_ws(", ", "tags")), ("Links to", F.concat_ws(", ", "links")))
    raw = F.concat_ws("\n\n", head, "body")
    return notes.select(raw.alias("raw_content"), F.sha2(raw, 256).alias("content_hash"), F.to_json(F.struct(F.lit("markdown").alias("connector"), "path")).alias("metadata"))


def ics_field(event: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(event, rf"(?m)^{name}(?:;[^:\n]*)?:(.*?)\s*$", 1), F.lit(""))


def ics_time(value: Column) -> Column:
    """Times as UTC; a value without a zone is UTC, a day is its midnight."""
    digits = F.regexp_replace(value, "[TZ]", "")
    return F.coalesce(F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


def read_calendars(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """One row for each event of the .ics files below ``path``; folded lines are joined again."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.ics").load(path)
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n", "\n"), r"\n[ \t]", "")
    events = files.select("path", F.explode(F.regexp_extract_all(text, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), 1)).alias("e"))
    e = F.col("e")
    rows = events.select(
        "path", ics_field(e, "UID").alias("uid"), ics_field(e, "SUMMARY").alias("summary"), ics_time(ics_field(e, "DTSTART")).alias("starts_at"), ics_time(ics_field(e, "DTEND")).alias("ends_at"),
        ics_field(e, "LOCATION").alias("location"), ics_field(e, "DESCRIPTION").alias("details"), ics_field(e, "RRULE").alias("recurrence"), F.regexp_extract_all(e, F.lit(r"(?m)^ATTENDEE[^\n]*?mailto:([^\s]+)"), 1).alias("participants"),
    )
    return rows.where(F.col("starts_at") >= F.lit(since).cast("timestamp")) if since else rows


def calendar_captures(events: DataFrame) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    raw = _lines(("Calendar Event", F.col("summary")), ("Date", at("starts_at")), ("End", at("ends_at")), ("Location", F.col("location")), ("Participants", F.concat_ws(", ", "participants")), ("Details", F.col("details")), ("Recurrence", F.col("recurrence")))
    return events.select(raw.alias("raw_content"), F.sha2(raw, 256).alias("content_hash"), F.to_json(F.struct(F.lit("calendar").alias("connector"), "path")).alias("metadata"))


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """Proposals from JSON files with a fixed schema; what doesn't parse keeps its text in ``broken``."""
    return spark.read.schema(T.StructType([*PROPOSAL.fields, T.StructField("broken", T.StringType())])).option("columnNameOfCorruptRecord", "broken").option("multiLine", True).json(path)


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts and styles dropped, tags as spaces, common entities decoded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def sync_all(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Captures of every connector that reads below ``path``, notes and calendars, each marked in its metadata."""
    return note_captures(read_notes(spark, path, since)).unionByName(calendar_captures(read_calendars(spark, path, since)), allowMissingColumns=True)
