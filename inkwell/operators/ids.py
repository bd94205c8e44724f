"""Content-addressed ids of documents, chunks and child chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column, length: int) -> Column:
    """The first hexadecimal digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, length)


def source_doc_id(kb_id: Column, name: Column, content: Column) -> Column:
    """``kb:name:digest``; spaces of the name become underscores."""
    return F.concat_ws(":", kb_id.cast("string"), F.replace(name, F.lit(" "), F.lit("_")), digest(content, 16))


def chunk_id(doc_id: Column, index: Column, text: Column) -> Column:
    return F.concat_ws(":", doc_id, index.cast("string"), digest(text, 12))


def child_id(parent: Column, text: Column) -> Column:
    """Without an index: siblings of equal text share an id."""
    return F.concat_ws(":", parent, F.lit("sub"), digest(text, 12))


def container(base: str, kb_id: int | None) -> str:
    """The name of a knowledge base's container."""
    return f"{base}_kb{kb_id}" if kb_id else base


def same_content(file_hash: Column, indexed_hash: Column) -> Column:
    """Whether two digests name one content: equal, or the indexed one is the first 16 digits; case is ignored."""
    file_hash, indexed_hash = F.lower(F.trim(file_hash)), F.lower(F.trim(indexed_hash))
    return (file_hash == indexed_hash) | ((F.length(indexed_hash) == 16) & file_hash.startswith(indexed_hash))
