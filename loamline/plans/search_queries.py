"""Queries over the stored indexes: words, vectors and both, for many questions and callers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.postings_index import PostingsIndex
from ..operators.search import hybrid_batch
from ..operators.vector_index import VectorIndex
from ..scratch import Scratch
from .catalog import query, table
from .groups import GROUPS_SQL, with_groups

#: Indexes of this session by kind and folder of tables: they are built once and asked by several queries.
_BUILT: dict[tuple, VectorIndex | PostingsIndex] = {}


def _built(spark, sf_dir: str, kind: str, build):
    key = spark.sparkContext.applicationId, sf_dir, kind
    if key not in _BUILT:
        _BUILT[key] = build(f"{Scratch(spark, kind).root}/index")
    return _BUILT[key]


def words(spark, sf_dir) -> PostingsIndex:
    docs = with_groups(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text", "groups")
    return _built(spark, sf_dir, "words", lambda path: PostingsIndex.build(docs, path))


def vectors(spark, sf_dir) -> VectorIndex:
    """A document's vector is that of its number; who may read the document may find it."""
    docs = with_groups(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("vec_id"), "groups")
    rows = table(spark, sf_dir, "embeddings").join(docs, "vec_id", "left").select(F.col("vec_id").alias("id"), "embedding", "groups")
    return _built(spark, sf_dir, "vectors", lambda path: VectorIndex.build(rows, path))


#: What is asked: every twentieth vector with one of five wordings and one of three callers; and the counts of words that the wordings are about.
WORDINGS = ("licensed or apache", "token -license", "idiot or commons or clown", "general or apache -tokens", "the of")
CALLERS = (["all-staff"], ["hr"], ["sales", "hr"])
ASKED_SQL = f"""g AS (SELECT doc_id AS id, {GROUPS_SQL} AS groups, text FROM documents),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, vec_id // 20 % {len(WORDINGS)} AS wording, CASE vec_id // 20 % 3 {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(CALLERS))} END AS mine FROM embeddings WHERE vec_id % 20 = 0)"""
LEXICAL_SQL = ASKED_SQL + r""",
t AS (SELECT id, groups, regexp_extract_all(lower(text), '[\pL\pN_]+') AS words FROM g),
n AS (SELECT id, groups, len([w FOR w IN words IF w IN ('license', 'licensed', 'licenses', 'licensing')]) AS licens, len([w FOR w IN words IF w IN ('token', 'tokens')]) AS token, len([w FOR w IN words IF w = 'apache']) AS apach,
 len([w FOR w IN words IF w = 'general']) AS general, len([w FOR w IN words IF w IN ('common', 'commons')]) AS common, len([w FOR w IN words IF w = 'idiot']) AS idiot, len([w FOR w IN words IF w = 'clown']) AS clown FROM t),
h AS (SELECT query_id, id, round(0.1::DOUBLE * CASE wording WHEN 0 THEN greatest(licens, apach) WHEN 1 THEN CASE WHEN licens = 0 THEN token ELSE 0 END WHEN 2 THEN greatest(idiot, common, clown)
 WHEN 3 THEN greatest(general, CASE WHEN token = 0 THEN apach ELSE 0 END) ELSE 0 END, 6) AS lexical_score FROM n JOIN q ON list_has_any(groups, mine)),
lr AS (SELECT query_id, id::VARCHAR AS id, lexical_score, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, id::VARCHAR)::INT AS lexical_rank FROM h WHERE lexical_score > 0)"""
NEAR_SQL = """s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS similarity FROM embeddings JOIN g ON vec_id = id JOIN q ON list_has_any(groups, mine)),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS vector_rank FROM s)"""


def questions(spark, sf_dir) -> DataFrame:
    n = F.floor(F.col("vec_id") / 20)
    choice = lambda values: F.element_at(F.array(*values), (n % len(values) + 1).cast("int"))
    callers = choice([F.array(*map(F.lit, c)) for c in CALLERS])
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), choice([F.lit(w) for w in WORDINGS]).alias("query"), F.col("embedding").alias("vector"), callers.alias("groups"))


@query(f"WITH {ASKED_SQL}, {NEAR_SQL} SELECT query_id, id, similarity, vector_rank AS rank FROM vr WHERE vector_rank <= 8")
def filtered_vector_search(spark, sf_dir):
    """The exact answer of the stored vector index for each question among what its caller may read."""
    asked = questions(spark, sf_dir).select("query_id", F.col("vector").alias("query"), "groups")
    return vectors(spark, sf_dir).search(asked, 8, exact=True)


@query(f"WITH {LEXICAL_SQL} SELECT query_id, id, lexical_score, lexical_rank AS rank FROM lr WHERE lexical_rank <= 8")
def fulltext_search(spark, sf_dir):
    """The best matches of each question's words among what its caller may read, from the stored postings."""
    found = words(spark, sf_dir).search(questions(spark, sf_dir).select("query_id", "query", "groups"), 8)
    return found.withColumn("lexical_score", F.round("lexical_score", 6))


@query(f"""WITH {LEXICAL_SQL}, {NEAR_SQL}, f AS (SELECT query_id, id, vector_rank, lexical_rank, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS score
FROM (SELECT query_id, id::VARCHAR AS id, vector_rank FROM vr WHERE vector_rank <= 40) v FULL JOIN (SELECT query_id, id, lexical_rank FROM lr WHERE lexical_rank <= 40) l USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM f QUALIFY rank <= 8)
SELECT r.query_id, r.id, rank, round(score, 9) AS score, coalesce(round(list_cosine_similarity(embedding::DOUBLE[], e), 6), 0) AS similarity, vector_rank, lexical_rank
FROM r JOIN q ON r.query_id = q.query_id LEFT JOIN embeddings ON vec_id::VARCHAR = r.id""")
def hybrid_search(spark, sf_dir):
    """Words and vectors of all questions, fused in one plan."""
    return hybrid_batch(questions(spark, sf_dir), vectors(spark, sf_dir), words(spark, sf_dir), exact=True).withColumn("score", F.round("score", 9))
