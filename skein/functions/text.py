"""Scalar text functions as Spark column expressions (JVM side, no Python per row).

Each function takes and returns ``Column``; names follow what they compute. Regular expressions use explicit ASCII
character classes so that the same pattern gives the same answer in Java regex and in RE2 (used by the SQL oracle).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the reference's regex engine defines ``\s`` (space, tab, newline, vertical tab, form feed, return).
WS = r"[ \t\n\x0B\f\r]"
# Word tokens: runs of Unicode letters and digits (used by full-text search and the hashed embedder).
TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# The reference's messages, prefixes and prompt templates.
NO_DOCUMENTS_ANSWER = "No relevant documents found in the database."
FALLBACK_ANSWER_PREFIX = "Based on the retrieved information:\n\n"
SOURCE_HEADER = "Source: "
CHUNK_JOINER = " ... "
SOURCE_JOINER = "\n\n---\n\n"
ANSWER_INSTRUCTIONS = (
    "You are a helpful assistant. Answer questions based ONLY on the provided context. "
    "If the answer is not in the context, say \"I don't have enough information to answer that question.\" "
    "Be concise and direct. /no_think"
)
REWRITE_PROMPT = (
    "Analyze the following user query and break it down for retrieval-augmented generation.\n"
    "Focus on understanding the user's intent and creating effective sub-queries for searching.\n\n"
    "User Query: {query}\n\n"
    "Provide a structured analysis that will help retrieve the most relevant documents. /no_think\n"
)
SUMMARY_PROMPT = (
    "<|system|>\n"
    "You are a helpful assistant. Summarize the following information relevant to the query.\n"
    "Focus on the most important points. Be concise.\n"
    "</s>\n"
    "<|user|>\n"
    "Query: {query}\n\n"
    "Information:\n"
    "{context}\n\n"
    "Provide a brief summary of the key information related to the query.\n"
    "</s>\n"
    "<|assistant|>\n"
)
TOPIC_SUMMARY_PROMPT = (
    "Summarize what connects these documents in 1-2 sentences:\n\n"
    "Key terms: {terms}\n\n"
    "Documents:\n"
    "{documents}\n\n"
    "Summary:\n"
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c) -> Column:
    """Remove leading and trailing whitespace (and trailing NULs), like a string ``strip``."""
    return F.regexp_replace(_c(c), rf"^{WS}+|[ \t\n\x0B\f\r\x00]+$", "")


def is_blank(c) -> Column:
    """Null, empty or whitespace only."""
    c = _c(c)
    return c.isNull() | ~c.rlike("[^" + WS[1:])


def tokens(c) -> Column:
    """Lower-cased Unicode word tokens."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_PATTERN), 0)


def words_text(c) -> Column:
    """The tokens of a text with one space between them: Python reads one string faster than a list of them. The usual
    letters are named first, as that is the order in which a character is tried."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9" + TOKEN_PATTERN[1:], " "))


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, all words) of an Arrow column of ``words_text``."""
    lists = pc.split_pattern(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts), " ")
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def clean_text(c) -> Column:
    """H2: collapse whitespace runs to one space, 4+ dots to '...', strip."""
    collapsed = F.regexp_replace(_c(c), f"{WS}+", " ")
    return F.trim(F.regexp_replace(collapsed, r"\.{4,}", "..."))


def query_terms(c) -> Column:
    """H3: lower-case, split on non-word (ASCII) runs, keep terms of 3+ characters, duplicates kept."""
    return F.filter(F.split(F.lower(_c(c)), r"\W+"), lambda t: F.length(t) >= 3)


def split_sentences(c) -> Column:
    """H4: split after '.', '!' or '?' followed by whitespace; empty pieces dropped."""
    return F.filter(F.split(_c(c), rf"(?<=[.!?]){WS}+"), lambda s: s != "")


def sentence_score(sentence, terms) -> Column:
    """H5: number of query terms (with repeats) contained in the lower-cased sentence."""
    low = F.lower(_c(sentence))
    return F.aggregate(_c(terms), F.lit(0), lambda acc, t: acc + F.when(F.instr(low, t) > 0, 1).otherwise(0))


def strip_think_tags(c) -> Column:
    """H6: drop <think>...</think> blocks across lines, then strip; null stays null."""
    return strip_ws(F.regexp_replace(_c(c), r"(?s)<think>.*?</think>", ""))


def basename(c) -> Column:
    """H7: last path component."""
    return F.regexp_extract(_c(c), r"([^/]*)/*$", 1)


def file_type(c) -> Column:
    """Lower-case extension without the dot, or 'unknown'."""
    ext = F.lower(F.regexp_extract(basename(c), r"^.+\.([^.]+)$", 1))
    return F.when(ext == "", F.lit("unknown")).otherwise(ext)


def fallback_key_terms(c) -> Column:
    """H9: whitespace-separated words longer than 3 characters."""
    return F.filter(F.split(_c(c), f"{WS}+"), lambda w: F.length(w) > 3)


def max_chars(max_tokens: int, chars_per_token: int = 4) -> int:
    """Token budget to characters."""
    return int(max_tokens) * int(chars_per_token)


def preview(c, n: int = 201) -> Column:
    """P11 (search): first ``n`` characters with whitespace collapsed, '...' appended."""
    return F.concat(F.regexp_replace(F.substring(_c(c), 1, n), f"{WS}+", " "), F.lit("..."))


def topic_sample(c, n: int = 100) -> Column:
    """P11 (topics): first n+1 characters and '...' when longer than n."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n + 1), F.lit("..."))).otherwise(c)


def size_tier(c) -> Column:
    """>=20 major, 10-19 medium, else minor."""
    c = _c(c)
    return F.when(c >= 20, "major").when(c >= 10, "medium").otherwise("minor")


def context_size(c) -> Column:
    """Documents of context by need."""
    c = _c(c)
    return F.when(c == "extensive", 5).when(c == "moderate", 4).otherwise(3)


def rrf_term(distance, k) -> Column:
    """H8: fusion term 1/(k + 100*distance)."""
    return F.lit(1.0) / (F.lit(float(k)) + F.lit(100.0) * _c(distance))


def answer_prompt(context, query) -> Column:
    """The answer prompt."""
    return F.concat(F.lit("Context:\n"), _c(context), F.lit("\n\nQuestion: "), _c(query))


def instructed_prompt(context, query) -> Column:
    """The answer instructions and prompt, as a generator hook gets them."""
    return F.concat(F.lit(ANSWER_INSTRUCTIONS + "\n\n"), answer_prompt(context, query))


def rewrite_prompt(query) -> Column:
    """The prompt of a rewriting model."""
    head, tail = REWRITE_PROMPT.split("{query}")
    return F.concat(F.lit(head), _c(query), F.lit(tail))


def metadata_fields(c) -> Column:
    """H15 (read side): metadata JSON as map<string,string>; null or unreadable JSON is an empty map."""
    fields = F.from_json(F.coalesce(_c(c), F.lit("{}")), "map<string,string>")
    return F.coalesce(fields, F.create_map().cast("map<string,string>"))


def text_of(record) -> Column:
    """The text of a JSON record by its key ``chunk_text``, else ``text``, of a plain value the value, else ''."""
    r = _c(record)
    return F.when(r.startswith("{"), F.coalesce(F.get_json_object(r, "$.chunk_text"), F.get_json_object(r, "$.text"),
                                                F.lit(""))).otherwise(F.coalesce(r, F.lit("")))


def clean_topic_summary(summary, terms) -> Column:
    """First line, strip, drop a leading 'Summary:'/'Topic:'/'Documents:'.

    An empty answer becomes 'Related documents'; an answer that is empty after clean-up, or a failed call (null),
    becomes 'Documents about <t1> and <t2>'.
    """
    whole = strip_ws(_c(summary))
    first = strip_ws(F.element_at(F.split(whole, "\n"), 1))
    first = F.when(whole == "", F.lit("Related documents")).otherwise(first)
    cleaned = strip_ws(F.regexp_replace(first, r"(?i)^(Summary:|Topic:|Documents:)", ""))
    fallback = F.concat(F.lit("Documents about "), F.array_join(F.slice(_c(terms), 1, 2), " and "))
    return F.when(cleaned.isNull() | (cleaned == ""), fallback).otherwise(cleaned)


# Extensions the indexer's directory walk collects, the extensions it lists as supported, and the
# extensions read as plain UTF-8 when parsing fails.
GLOB_EXTENSIONS = ("txt", "md", "markdown", "text", "pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "csv", "json",
                   "xml", "html", "htm", "rb", "py", "js", "rs", "go", "java", "cpp", "c", "h")
SUPPORTED_EXTENSIONS = (".txt", ".md", ".markdown", ".text", ".log", ".csv", ".json", ".xml", ".html", ".htm",
                        ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt",
                        ".rb", ".py", ".js", ".rs", ".go", ".java", ".cpp", ".c", ".h")
PLAIN_TEXT_EXTENSIONS = (".txt", ".md", ".markdown", ".text", ".log", ".rb", ".py", ".js", ".rs", ".go", ".java",
                         ".cpp", ".c", ".h")
