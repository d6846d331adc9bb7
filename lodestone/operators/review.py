"""The review queue as a log of events: an item's state is that of its last event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States that an event may set, and their order in the queue.
ACTIONS = ("approved", "suspected", "deleted", "pending")
ORDER = ("pending", "suspected", "approved", "deleted")


#: What the queue holds.
CATEGORIES = ("external_doc", "title_mark", "unverified", "symbol", "companion")


def checked(events: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    """``events``, refused (the query fails) where a status is none that an event may set, or a category none of ``categories``."""
    good = lambda c, names: F.when(F.col(c).isin(*names), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"no such {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("string"))
    out = events.withColumn("status", good("status", ACTIONS))
    return out.withColumn("category", good("category", categories)) if categories else out


def event(spark: SparkSession, item, status: str, at: str, order: int, reviewer: str = "") -> DataFrame:
    """One event (item, status, at, id, reviewer); a status that doesn't exist is refused at once."""
    if status not in ACTIONS:
        raise ValueError(f"no such action: {status}")
    return spark.createDataFrame([(item, status, order, reviewer)], ["item", "status", "id", "reviewer"]).withColumn("at", F.lit(at).cast("timestamp"))


def queue(items: DataFrame, category: str | None = None, status: str | None = None, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Items of a category and a status, either if given; names that don't exist are refused."""
    for value, names, column in ((category, categories, "category"), (status, ACTIONS, "status")):
        if value is not None:
            if value not in names:
                raise ValueError(f"no such {column}: {value}")
            items = items.where(F.col(column) == value)
    return items


def item(items: DataFrame, key_value, key: str = "item") -> DataFrame:
    """One item."""
    return items.where(F.col(key) == F.lit(key_value))


def without_item(items: DataFrame, key_value, key: str = "item") -> DataFrame:
    """All items but one; those without a key stay."""
    return items.where(~F.col(key).eqNullSafe(F.lit(key_value)))


def external_documents(docs: DataFrame, offset: int = 0, limit: int | None = None, own: str = "github") -> DataFrame:
    """Documents that don't come from repositories, by type and id, a page of them."""
    rows = docs.where(~F.startswith(F.coalesce("source_type", F.lit("")), F.lit(own))).orderBy("source_type", "source_id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def unverified(docs: DataFrame, key: str = "source_id") -> DataFrame:
    """category, item_ref of documents that nobody has verified."""
    return docs.where("verification = 'unverified'").select(F.lit("unverified").alias("category"), F.col(key).alias("item_ref"))


#: Fixed value: marks of titles that wait for a review.
TITLE_MARKS = "待审核|待修改"


def marked_titles(docs: DataFrame, key: str = "source_id", category: str = "title_mark") -> DataFrame:
    """category, item_ref of documents whose titles are marked for review."""
    return docs.where(F.col("title").rlike(TITLE_MARKS)).select(F.lit(category).alias("category"), F.col(key).alias("item_ref"))


def backed_up(docs: DataFrame, ids: DataFrame, key: str = "source_id") -> DataFrame:
    """key, payload: the rows of ``ids`` as JSON, to be kept before they are removed."""
    return docs.join(ids.select(key).distinct(), key, "left_semi").select(key, F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"}).alias("payload"))


def restored(docs: DataFrame, backup: DataFrame, key: str = "source_id") -> DataFrame:
    """``docs`` with the rows of a backup (key, payload) back; a row that is there again stays."""
    rows = backup.select(F.from_json("payload", docs.schema).alias("r")).select("r.*")
    return docs.unionByName(rows.join(docs.select(key), key, "left_anti"))


def deleted_chunks(chunks: DataFrame, ids: DataFrame, key: str = "doc_id", chunk: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """The chunks that stay, and the ids of those that go with documents ``ids``."""
    return chunks.join(ids.select(key).distinct(), key, "left_anti"), chunks.join(ids.select(key).distinct(), key, "left_semi").select(chunk)


def deleted_everywhere(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and vectors (chunk_id) without the documents ``ids``; files stay where they are."""
    kept, gone = deleted_chunks(chunks, ids, key)
    return docs.join(ids.select(key).distinct(), key, "left_anti"), kept, vectors.join(gone, "chunk_id", "left_anti")


def latest(events: DataFrame, key: str = "item", at: str = "at", order: str = "id") -> DataFrame:
    """key, status, at of each item's last event; of events at one time the highest ``order`` counts. Unknown states are refused."""
    last = F.max_by(F.struct("status", at), F.struct(at, order))
    return checked(events).groupBy(key).agg(last.alias("l")).select(key, "l.status", F.col(f"l.{at}").alias(at))


def undone(events: DataFrame, key: str = "item", at: str = "at", order: str = "id") -> DataFrame:
    """The items whose last event deletes them, with the status that an undo gives back."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(order))
    ranked = checked(events).withColumn("n", F.row_number().over(w)).withColumn("before", F.lead("status").over(w))
    return ranked.where("n = 1 and status = 'deleted'").select(key, F.coalesce("before", F.lit("pending")).alias("restored"))


def page(items: DataFrame, offset: int, limit: int, key: str = "item") -> DataFrame:
    """A page of the queue: pending first, then suspected, approved, deleted; newest key first."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    return items.orderBy(rank, F.desc(key)).offset(offset).limit(limit)


def statistics(items: DataFrame, category: str = "category") -> DataFrame:
    """category, pending, suspected, total."""
    return items.groupBy(category).agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "suspected").alias("suspected"), F.count("*").alias("total"))


def added(new: DataFrame, queue: DataFrame) -> DataFrame:
    """New items (category, item_ref) that the queue doesn't have in any state, once each."""
    return new.dropDuplicates(["category", "item_ref"]).join(queue.select("category", "item_ref").distinct(), ["category", "item_ref"], "left_anti")


def without_deleted(docs: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Documents less those that the queue deleted: everywhere, vectors and chunks included."""
    return docs.join(states.where("status = 'deleted'").select(key), key, "left_anti")
