"""Topic documents and evidence classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import assertion_key, content_id, escaped_markdown
from attestry.operators.joins import assign_topics
from attestry.operators.lineage import written
from attestry.operators.ordered import numbered
from attestry.operators.predicates import usable_on
from attestry.operators.windows import chain_root, ref_labels

TOPIC = ["owner", "scope", "slug"]
#: Sections of a topic's document, in order.
SECTIONS = (
    "Verified and in force",
    "Not yet reviewed",
    "Historical",
    "Rejected, kept for its sources",
    "Corrected by the owner",
    "Statements and requests",
    "Said or proposed by an assistant, not confirmed",
    "Imported summaries, not traced back yet",
)
CORRECTED, STATED, SUGGESTED, SUMMARISED = 5, 6, 7, 8
CHANGES, SOURCES = 9, 10
#: What makes two active statements one: same words, attribution and state of review.
SAME = ["status", "kind", "subject_key", "statement_key", "state"]


def section_of(day: Column) -> Column:
    """The number of a record's section: what a review says of it, else who said it; plain statements without a review are candidates."""
    said = F.when(F.col("message_id") == "correction", CORRECTED).when(F.col("status") == "agent_suggested", SUGGESTED).when(F.col("status") == "imported_summary", SUMMARISED).otherwise(STATED)
    return F.when(F.col("state") == "verified", F.when(usable_on(day), 1).otherwise(3)).when(F.col("state") == "historical", 3).when(F.col("state") == "rejected", 4).when(said == STATED, 2).otherwise(said)


def topic_records(records: DataFrame, sources: DataFrame, topics: DataFrame) -> DataFrame:
    """Records by the topics of their sources, with slug, source_key and keys of what they say."""
    placed = assign_topics(sources, topics).join(sources.select("source_id", "source_key"), "source_id")
    return records.join(placed, "source_id").withColumns({"subject_key": assertion_key("subject"), "statement_key": assertion_key("statement")})


def topic_pages(rows: DataFrame, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(rows, directories): topics with more than ``most`` statements are dealt to pages of ``most``, and a directory of pages takes their place.

    A statement stands with the one that its chain of corrections begins with, in the order of those; its page is its place among them, counted
    over ranges, so that no topic meets in one task. Rows of pages get the page's slug; directories are (owner, scope, slug, pages).
    """
    sizes = rows.where("lifecycle = 'active'").select(*TOPIC, *SAME).distinct().groupBy(*TOPIC).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most).select(*TOPIC)
    kept = written(rows, "topics")

    def here(record: str) -> Column:
        """A record's id within its topic: chains don't leave it."""
        return F.when(F.col(record).isNotNull(), content_id(*TOPIC, record))

    long = kept.join(large, TOPIC, "left_semi").withColumns({"_id": here("record_id"), "_before": here("supersedes")})
    roots = chain_root(long.select(F.col("_id").alias("record_id"), F.col("_before").alias("supersedes")).distinct()).select(F.col("record_id").alias("_id"), "root_id")
    first = long.select(F.col("_id").alias("root_id"), F.col("record_id").alias("root_record"), F.col("created").alias("root_created"), *(F.col(c).alias(f"root_{c}") for c in SAME[:4])).distinct()
    by = [f"root_{c}" for c in SAME[:4]]
    members = written(long.join(roots, "_id").join(first, "root_id"), "members")
    batches = members.groupBy(*TOPIC, *by).agg(F.min(F.struct("root_created", "root_record", "created", "record_id")).alias("f"))
    batches = batches.select(*TOPIC, *by, F.col("f.root_created").alias("o1"), F.col("f.root_record").alias("o2"), F.col("f.created").alias("o3"), F.col("f.record_id").alias("o4"))
    placed = numbered(batches, TOPIC, ["o1", "o2", "o3", "o4"], "pages").withColumn("page", (F.floor(F.col("pos") / most) + 1).cast("int")).drop("o1", "o2", "o3", "o4", "pos")
    paged = members.join(placed, [*TOPIC, *by]).withColumn("slug", F.concat("slug", F.lit("--page-"), F.col("page").cast("string")))
    directories = placed.groupBy(*TOPIC).agg(F.max("page").alias("pages"))
    return kept.join(large, TOPIC, "left_anti").unionByName(paged.select(*kept.columns)), directories


def topic_lines(rows: DataFrame, day: Column) -> DataFrame:
    """(owner, scope, slug, section, place, line) of each topic's document: head, eight sections of statements, corrections and sources.

    ``rows`` come from ``topic_records`` or ``topic_pages``. Equal active statements are one line with all their references, by the last of them; place is
    the order within a section.
    """
    rows = ref_labels(rows, TOPIC, "created", "record_id")
    own = rows.withColumn("place", F.struct(F.col("created").cast("long").alias("created"), "record_id"))
    groups = own.where("lifecycle = 'active'").withColumn("section", section_of(day)).groupBy(*TOPIC, *SAME).agg(
        F.min("place").alias("place"),
        F.max_by(F.struct("statement", "as_of", "section"), "place").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: F.concat(F.lit("["), x["label"], F.lit("]"))), " ").alias("refs"),
    )
    dated = F.concat(F.lit(" ("), F.coalesce(F.col("last.as_of").cast("string"), F.lit("no date")), F.lit(") "))
    bullets = groups.select(*TOPIC, F.col("last.section").alias("section"), "place", F.concat(F.lit("- "), escaped_markdown("last.statement"), dated, "refs").alias("line"))

    old = rows.select("record_id", F.col("statement").alias("was")).distinct().withColumnRenamed("record_id", "supersedes")
    changed = own.where("supersedes is not null").join(old, "supersedes", "left")
    change = F.concat(F.lit("- v"), F.col("revision").cast("string"), F.lit(": "), escaped_markdown(F.coalesce("was", F.lit("the version before"))), F.lit(" -> "), escaped_markdown("statement"), F.lit(" ["), "label", F.lit("]"))
    changes = changed.select(*TOPIC, F.lit(CHANGES).alias("section"), "place", change.alias("line"))

    def told(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"- {name}: "), F.coalesce(value.cast("string"), F.lit("unknown")))

    parts = [
        F.concat(F.lit("### "), F.col("label")),
        told("source", escaped_markdown("source_key")),
        told("message", escaped_markdown("message_id")),
        told("record", F.concat_ws(" / ", "record_id", F.concat(F.lit("v"), F.col("revision").cast("string")), "lifecycle")),
        told("attribution", F.col("status")),
        told("review", F.col("state")),
        told("holder", escaped_markdown("holder")),
        told("subject", escaped_markdown(F.coalesce("subject_id", "subject"))),
        told("priority", F.col("priority")),
        told("in force from", F.col("as_of")),
        told("in force until", F.col("valid_until")),
        F.concat(F.lit("> "), escaped_markdown(F.coalesce("quote", F.lit("")))),
    ]
    sources = own.select(*TOPIC, F.lit(SOURCES).alias("section"), "place", F.array_join(F.array(*parts), "\n").alias("line"))

    body = bullets.unionByName(changes).unionByName(sources)
    titles = F.element_at(F.array(*map(F.lit, (*SECTIONS, "Corrections", "Sources"))), F.col("section"))
    before = F.struct(F.lit(None).cast("long").alias("created"), F.lit(None).cast("string").alias("record_id"))
    heads = body.select(*TOPIC, "section").distinct().select(*TOPIC, "section", before.alias("place"), F.concat(F.lit("\n## "), titles).alias("line"))
    counted = rows.select(*TOPIC).distinct().join(groups.groupBy(*TOPIC).agg(F.count("*").alias("n")), TOPIC, "left")
    head = F.concat(F.lit("---\nid: "), "slug", F.lit("\nscope: "), F.to_json(F.struct("scope")), F.lit("\n---\n\n# "), escaped_markdown("slug"), F.lit("\n\nMade from records with sources; what was said once need not hold today, and nothing here grants a right. Statements: "), F.coalesce("n", F.lit(0)).cast("string"))
    return body.unionByName(heads).unionByName(counted.select(*TOPIC, F.lit(0).alias("section"), before.alias("place"), head.alias("line")))


def directory_lines(directories: DataFrame) -> DataFrame:
    """The lines of a directory: a title and a link to each page."""
    before = F.struct(F.lit(None).cast("long").alias("created"), F.lit(None).cast("string").alias("record_id"))
    head = directories.select(*TOPIC, F.lit(0).alias("section"), before.alias("place"), F.concat(F.lit("# "), escaped_markdown("slug")).alias("line"))
    pages = directories.select(*TOPIC, F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("i"))
    at = F.struct(F.col("i").cast("long").alias("created"), F.lit("").alias("record_id"))
    return head.unionByName(pages.select(*TOPIC, F.lit(1).alias("section"), at.alias("place"), F.concat(F.lit("- "), escaped_markdown("slug"), F.lit("--page-"), F.col("i").cast("string")).alias("line")))


def render_topics(lines: DataFrame) -> DataFrame:
    """(owner, scope, slug, text): each document's lines joined; pages bound a document's statements."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("section", F.col("place.created").isNotNull().alias("_b"), "place", "line"))), lambda x: x["line"])
    return lines.groupBy(*TOPIC).agg(F.array_join(ordered, "\n").alias("text"))


def evidence_class(quote: Column, blocks: Column, secondary: Column) -> Column:
    """What a quote rests on, from a message's typed blocks: visible text, a hidden block, a second-hand text, or nothing."""

    def holds(kind_visible: bool) -> Column:
        return F.exists(blocks, lambda b: ((b["type"] == "text") == F.lit(kind_visible)) & F.contains(b["text"], quote))

    found = F.when(holds(True) & secondary, "secondary_quote_present").when(holds(True), "visible_quote_present").when(holds(False), "excluded_block_quote").otherwise("quote_missing")
    return F.when(F.coalesce(quote, F.lit("")) == "", "missing_quote").otherwise(found)
