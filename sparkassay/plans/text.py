"""Chunking and feature queries over whole documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sparkassay.functions.text import SPACE_CLASS, STRIP_PATTERN, TOKEN_SPLIT
from sparkassay.operators import chunking, features
from sparkassay.plans.registry import query
from sparkassay.sources.tables import docs_from_texts


def o_strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP_PATTERN}', '', 'g')"


def o_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{TOKEN_SPLIT}'), lambda t: t <> '')"


def o_sentences(x: str) -> str:
    marked = f"regexp_replace({o_strip(x)}, '([.!?]){SPACE_CLASS}+', '\\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {o_strip('s')}), "
            f"lambda s: s <> '')")


def o_fixed(src: str, size: int, overlap: int) -> str:
    return f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_index,
      {o_strip(f'substr(text, s + 1, {size})')} AS text, CAST(s AS INT) AS start_char,
      CAST(least(s + {size}, length(text)) AS INT) AS end_char, 'fixed_size' AS strategy
    FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, {size - overlap})) AS s FROM ({src}))
    WHERE {o_strip(f'substr(text, s + 1, {size})')} <> ''"""


def o_packed(src: str, size: int, overlap: int) -> str:
    """CTE list ending in ``packed(doc_id, chunk_index, text, sentence_count)``."""
    return f"""sent AS (SELECT doc_id, {o_sentences('text')} AS s FROM ({src})),
    pk AS (
      SELECT doc_id, 1 AS i, 0 AS g, 1 AS f, length(s[1]) + 1 AS size FROM sent WHERE len(s) > 0
      UNION ALL
      SELECT doc_id, i + 1, CASE WHEN size + n + 1 > {size} THEN g + 1 ELSE g END,
        CASE WHEN size + n + 1 > {size} THEN greatest(f, i + 1 - {overlap}) ELSE f END,
        CASE WHEN size + n + 1 > {size}
          THEN n + 1 + coalesce(list_sum(list_transform(s[greatest(f, i + 1 - {overlap}):i], lambda x: length(x))), 0)
          ELSE size + n + 1 END
      FROM (SELECT pk.*, s, length(s[i + 1]) AS n FROM pk JOIN sent USING (doc_id) WHERE i < len(s))
    ),
    packed AS (
      SELECT doc_id, CAST(g AS INT) AS chunk_index,
        array_to_string(s[f:last], ' ') AS text, CAST(last - f + 1 AS INT) AS sentence_count, 'sentence' AS strategy
      FROM (SELECT doc_id, g, f, max(i) AS last FROM pk GROUP BY doc_id, g, f) JOIN sent USING (doc_id)
    )"""


def o_lines(src: str) -> str:
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    return f"""SELECT doc_id, CAST(i - 1 AS INT) AS chunk_index, {o_strip('a[i]')} AS text, 'schema' AS strategy
    FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i
          FROM (SELECT doc_id, string_split_regex(text, '{breaks}') AS a FROM ({src})))
    WHERE {o_strip('a[i]')} <> ''"""


def o_vectors(src: str, key: str, dim: int = 64, name: str = "nv") -> str:
    """CTE list ending in ``name(key, b, w)`` for a two-column source (key, text)."""
    return f"""{name}_t AS (SELECT {key}, unnest({o_tokens('text')}) AS t FROM ({src})),
    {name}_b AS (SELECT {key}, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS INT) AS b, count(*) AS c
                 FROM {name}_t GROUP BY ALL),
    {name} AS (SELECT {key}, b, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS w FROM {name}_b)"""


DOCS = "SELECT doc_id, text FROM documents"


def docs(wh):
    return wh.spread("documents").select("doc_id", "text")


@query("chunk_fixed", o_fixed(DOCS, 512, 64))
def q_chunk_fixed(wh):
    return chunking.chunk_fixed(docs(wh))


@query("split_sentences", f"""
SELECT doc_id, CAST(i - 1 AS INT) AS sentence_index, a[i] AS sentence
FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i
      FROM (SELECT doc_id, {o_sentences('text')} AS a FROM documents))""")
def q_split_sentences(wh):
    return chunking.split_sentences(docs(wh))


@query("chunk_sentence", f"WITH RECURSIVE {o_packed(DOCS, 512, 1)} SELECT * FROM packed")
def q_chunk_sentence(wh):
    return chunking.chunk_sentence(docs(wh))


@query("chunk_sentence_wide", f"WITH RECURSIVE {o_packed(DOCS, 400, 3)} SELECT * FROM packed")
def q_chunk_sentence_wide(wh):
    return chunking.chunk_sentence(docs(wh), max_size=400, overlap=3)


@query("chunk_lines", o_lines(DOCS))
def q_chunk_lines(wh):
    return chunking.chunk_lines(docs(wh))


@query("index_documents", f"""
WITH RECURSIVE {o_packed(DOCS, 400, 1)}, f AS ({o_fixed(DOCS, 400, 60)}), l AS ({o_lines(DOCS)})
SELECT 'sentence' AS chunker, source, count(*) AS n_chunks FROM packed JOIN documents USING (doc_id) GROUP BY ALL
UNION ALL SELECT 'fixed', source, count(*) FROM f JOIN documents USING (doc_id) GROUP BY ALL
UNION ALL SELECT 'schema', source, count(*) FROM l JOIN documents USING (doc_id) GROUP BY ALL""")
def q_index_documents(wh):
    tagged = docs_from_texts(wh.spread("documents").select("doc_id", "text", "source"), source=F.col("source"))
    options = {"sentence": {"max_size": 400, "overlap": 1}, "fixed": {"size": 400, "overlap": 60}, "schema": {}}
    parts = [
        chunking.index_documents(tagged.drop("source"), name, "metadata", **opt)
        .groupBy(F.lit(name).alias("chunker"), F.col("metadata")["source"].alias("source"))
        .agg(F.count("*").alias("n_chunks"))
        for name, opt in options.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def letter_embedder(texts: list[str]) -> list[list[float]]:
    """A stand-in model: sixteen numbers from a digest of the text."""
    return [[b / 255 for b in hashlib.md5(t.encode()).digest()] for t in texts]


@query("embed_distinct", """
SELECT conv_id, turn, 16 AS dim, round(list_sum(list_transform(range(16),
  lambda i: CAST(('0x' || substr(md5(text), CAST(2 * i + 1 AS INT), 2))::INT AS DOUBLE) / 255)), 6) AS total
FROM conversations""")
def q_embed_distinct(wh):
    turns = wh.conversations.select("conv_id", "turn", "text")
    return features.embed_distinct(turns, letter_embedder).select(
        "conv_id", "turn", F.size("embedding").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("hash_embed", f"WITH {o_vectors(DOCS, 'doc_id')} SELECT doc_id, b AS bucket, round(w, 6) AS weight FROM nv")
def q_hash_embed(wh):
    entries = features.vector_entries(features.hash_embed(docs(wh)), "doc_id", "embedding")
    return entries.withColumn("weight", F.round("weight", 6))


@query("sparse_terms", f"""
SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({o_tokens('text')}) AS t FROM documents)
GROUP BY ALL""")
def q_sparse_terms(wh):
    return features.sparse_terms(docs(wh), "doc_id")


@query("sparse_supplied", """
SELECT vec_id, i - 1 AS term, CAST(embedding[i] AS DOUBLE) AS weight
FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""")
def q_sparse_supplied(wh):
    lists = wh.embeddings.withColumn("term_ids", F.sequence(F.lit(0), F.size("embedding") - 1).cast("array<bigint>"))
    return features.sparse_from_lists(lists, "vec_id", "term_ids", "embedding").withColumn(
        "weight", F.col("weight").cast("double"))
