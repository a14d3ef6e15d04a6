"""Conversation log queries over conversations (conversation_id, ...) and messages (conversation_id, message_id, role, content,
citations_json)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import conversation_title, squeeze

CITATION = "array<struct<document_id:string,title:string,pdf_url:string>>"


def list_conversations(conversations: DataFrame, messages: DataFrame, limit: int = 100) -> DataFrame:
    """Newest first, with their number of messages; the limit lies between 1 and 500."""
    counts = messages.groupBy("conversation_id").agg(F.count("message_id").alias("message_count"))
    rows = conversations.join(counts, "conversation_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    return rows.orderBy(F.desc("updated_at"), "conversation_id").limit(max(1, min(500, limit)))


def get_conversation(messages: DataFrame, conversation_id) -> DataFrame:
    """A conversation's messages in order; citations that are no JSON list are an empty one."""
    cited = F.coalesce(F.from_json("citations_json", CITATION), F.array().cast(CITATION))
    return messages.filter(F.col("conversation_id") == conversation_id).withColumn("citations", cited).orderBy("message_id")


def recent_turns(messages: DataFrame, exchanges: int = 4) -> DataFrame:
    """The last messages of each conversation, two an exchange, with turn_no from the oldest of them."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("message_id"))
    kept = messages.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= 2 * exchanges)
    return kept.withColumn("turn_no", F.row_number().over(Window.partitionBy("conversation_id").orderBy("message_id"))).drop("__r")


def recent_citations(messages: DataFrame, exchanges: int = 4) -> DataFrame:
    """The documents cited by the last answers of each conversation, latest first, each once."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("message_id"))
    answers = messages.filter("role = 'assistant'").withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= exchanges)
    cited = answers.select("conversation_id", "message_id", F.posexplode(F.from_json("citations_json", CITATION)).alias("pos", "c"))
    cited = cited.filter("c.document_id is not null and c.document_id != ''")
    first = Window.partitionBy("conversation_id", "c.document_id").orderBy(F.desc("message_id"), "pos")
    distinct = cited.withColumn("__r", F.row_number().over(first)).filter("__r = 1")
    order = Window.partitionBy("conversation_id").orderBy(F.desc("message_id"), "pos")
    return distinct.select("conversation_id", "c.document_id", "c.title", "c.pdf_url", F.row_number().over(order).alias("rank"))


def contextual_query(messages: DataFrame, turns: int = 2) -> DataFrame:
    """(conversation_id, query): the last user turn after the ones before it, one a line."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("message_id"))
    said = messages.filter("role = 'user'").withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= turns + 1)
    lines = F.array_sort(F.collect_list(F.struct(-F.col("__r"), F.trim("content").alias("text"))))
    return said.groupBy("conversation_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("query"))


def append_exchange(messages: DataFrame, exchange: DataFrame) -> DataFrame:
    """The log with an exchange's rows after it; conversations are derived from the log."""
    return messages.unionByName(exchange, allowMissingColumns=True)


def derived_conversations(messages: DataFrame, title_limit: int = 100) -> DataFrame:
    """One row per conversation of the log: title from its first question, times of its first and last message."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("message_id")))
    rows = messages.groupBy("conversation_id").agg(first.alias("__q"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return rows.select("conversation_id", conversation_title(F.coalesce("__q", F.lit("")), title_limit).alias("title"), "created_at", "updated_at")


def without(table: DataFrame, conversation_ids: DataFrame) -> DataFrame:
    """A table without these conversations; apply it to conversations and messages alike."""
    return table.join(conversation_ids, "conversation_id", "left_anti")


def valid_exchange(question: Column, answer: Column) -> Column:
    """Exchanges without a question or an answer are not kept."""
    return (F.trim(F.coalesce(question, F.lit(""))) != "") & (F.trim(F.coalesce(answer, F.lit(""))) != "")


def learned_notes(notes: DataFrame) -> DataFrame:
    """(line) of notes (date, note, reference) that people have confirmed, white space squeezed; blank ones are left out."""
    rows = notes.withColumn("n", squeeze(F.coalesce("note", F.lit("")))).filter("n != ''")
    source = F.when(F.trim(F.coalesce("reference", F.lit(""))) != "", F.concat(F.lit(" (réf. "), F.trim("reference"), F.lit(")"))).otherwise("")
    return rows.select(F.concat(F.lit("- ["), F.date_format("date", "yyyy-MM-dd"), F.lit("] "), "n", source).alias("line"))
