"""The knowledge base's tables as DataFrames.

A Model gives one attribute a table. Over the supplied star-schema tables each is a view by the SQL below, which
Spark and DuckDB read alike; a caller with tables of their own passes them by name instead, as a view or a supplied table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys, one number each, that may be broadcast: a hash table of some 100 MB. They are counted first.
NEAR_ROWS = 2_000_000

#: Views of the supplied tables in the shape of the knowledge base: fixture data, no operators.
VIEWS: dict[str, str] = {
    "names": """SELECT p_partkey AS id, concat(split_part('|Dr. |The Count |Lady |that |Captain ', '|', CAST(p_partkey % 6 AS INT) + 1),
      split_part('Harry|Jonathan|Mina|Lucy|Arthur|Quincey|John|Abraham|Wilhelmina|Renfield|Vlad', '|', CAST(p_partkey % 11 AS INT) + 1), ' ',
      split_part('Potter|Harker|Murray|Westenra|Dracula', '|', CAST(p_partkey % 5 AS INT) + 1),
      split_part('| the Great|, Jr| the Elder|||||', '|', CAST(p_partkey % 9 AS INT) + 1)) AS name,
      split_part('character|location|event|concept|object', '|', CAST(p_partkey % 5 AS INT) + 1) AS kind, p_partkey % 50 AS document_id,
      CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE concat(p_type, ' changes') END AS description FROM part""",
    "name_vectors": """SELECT p_partkey AS id, embedding AS vec FROM (SELECT p_partkey, p_partkey % (SELECT count(*) FROM embeddings) AS v FROM part) AS p JOIN embeddings ON vec_id = v""",
    "users": """SELECT c_custkey AS id, c_name AS username, concat(lower(replace(c_name, '#', '.')), CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE '' END, '@mail.test') AS email,
      CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role, CAST(c_acctbal AS DECIMAL(12,2)) AS balance, c_nationkey AS nation FROM customer""",
    "media": """SELECT p_partkey AS id, p_partkey % 100 AS user_id, p_name AS name, p_type AS kind, CAST(p_size AS BIGINT) AS size, concat(p_brand, '/', CAST(p_size AS STRING)) AS hash,
      p_partkey % 11 = 0 AS deleted, CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part""",
    "document_media": """SELECT l_orderkey AS document_id, l_partkey AS media_id, l_linenumber AS line, l_quantity < 5 AS deleted, CAST(l_shipdate AS DATE) AS made,
      CAST(l_extendedprice AS DECIMAL(14,2)) AS price FROM lineitem""",
    "jobs": """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 500 AS target_id, o_orderpriority AS type, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status,
      CAST(o_orderdate AS DATE) AS made, CAST(o_orderkey % 5 AS INT) AS retries, CAST(o_totalprice AS DECIMAL(14,2)) AS cost FROM orders""",
    "activities": """SELECT o_orderkey * 10 AS id, o_orderkey AS job_id, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'running' WHEN o_orderkey % 3 = 1 THEN 'pending' ELSE 'completed' END AS status,
      CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS document_id, CAST(o_orderdate AS DATE) AS made FROM orders""",
    "usage": """SELECT event_id AS id, user_id, event_type AS operation, split_part('small|large|vision', '|', CAST(event_id % 3 AS INT) + 1) AS model, event_id % 997 AS input_tokens, event_id % 301 AS output_tokens,
      CAST(CAST(value AS DECIMAL(18,6)) AS DECIMAL(18,6)) AS cost, CAST(ts AS DATE) AS day, ts, props FROM events""",
    "nodes": """SELECT p_partkey AS id, p_partkey % 50 AS document_id, p_name AS name, split_part('character|location|event|concept|object', '|', CAST(p_size % 5 AS INT) + 1) AS kind,
      CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS INT) END AS document_order, p_partkey % 17 = 0 AS deleted, p_partkey % 7 AS user_id FROM part""",
    "edges": """SELECT min(l_orderkey) AS id, src, dst, edge_type, CAST(max(l_discount) AS DOUBLE) AS strength, min(gone) = 1 AS deleted FROM (
      SELECT l_orderkey, CASE WHEN l_orderkey % 29 = 0 THEN l_partkey + 50 * l_linenumber ELSE l_partkey END AS src, CASE WHEN l_orderkey % 29 = 0 THEN l_partkey ELSE l_partkey + 50 * l_linenumber END AS dst,
        split_part('CAUSES|ENABLES|PREVENTS|HAPPENS_BEFORE|PARTICIPATES_IN|LOCATED_AT|HAS_FACET|BELONGS_TO_THREAD', '|', CAST((l_suppkey + l_linenumber) % 8 AS INT) + 1) AS edge_type, l_discount,
        CASE WHEN l_orderkey % 19 = 0 THEN 1 ELSE 0 END AS gone FROM lineitem) AS e
      WHERE src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part) GROUP BY src, dst, edge_type""",
    "facets": """SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS node_id, split_part('name|appearance|trait|state', '|', CAST(l_suppkey % 4 AS INT) + 1) AS kind,
      concat(l_returnflag, l_linestatus, CAST(l_quantity AS INT)) AS content, CAST(l_shipdate AS DATE) AS made FROM lineitem""",
    "mentions": """SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS node_id, l_partkey % 50 AS document_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey * 8 + l_linenumber END AS facet_id, l_suppkey % 40 AS segment,
      CAST(l_quantity AS INT) AS start_at, CAST(l_quantity AS INT) + 1 + l_linenumber AS end_at, CAST(l_discount * 1000 AS INT) AS confidence, l_returnflag AS source, l_tax > 0.06 AS is_key, CAST(l_shipdate AS DATE) AS made FROM lineitem""",
    "segments": """SELECT p_partkey % 50 AS document_id, p_partkey AS id, CAST((p_partkey - p_partkey % 50) / 50 AS INT) AS idx, CAST((p_partkey - p_partkey % 50) / 50 AS INT) * 20 AS start_at,
      CAST((p_partkey - p_partkey % 50) / 50 AS INT) * 20 + 20 AS end_at, p_name AS body FROM part""",
    "states": """SELECT s_suppkey AS id, s_suppkey % 9 AS character_id, CAST(s_suppkey AS INT) * 3 AS document_order, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS reason, CASE WHEN s_acctbal > 0 THEN 'gain' ELSE 'loss' END AS phase FROM supplier""",
    "events_log": """SELECT event_id AS id, user_id % 20 AS channel, event_type AS type, ts, value FROM events""",
    "vectors": """SELECT vec_id AS id, embedding AS vec, label AS kind, label % 3 AS document_id FROM embeddings""",
    "texts": """SELECT doc_id AS id, text AS body, lang, source, n_chars FROM documents""",
    "web": """SELECT page_id AS id, url, html FROM pages""",
    "old_segments": """SELECT p_partkey AS id, md5(p_name) AS hash FROM part WHERE p_partkey % 5 <> 0""",
    "new_segments": """SELECT p_partkey AS id, md5(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END) AS hash FROM part WHERE p_partkey % 7 <> 0""",
}
SOURCES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The same views for DuckDB, as common table expressions.
PRELUDE = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql})" for name, sql in VIEWS.items())


class Model:
    """Tables by attribute: those given, else views of a folder's Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str | None = None, **tables: DataFrame) -> None:
        self.spark, self.folder, self.tables = spark, folder, tables

    def raw(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def near(self, name: str, rows: int = NEAR_ROWS) -> Model:
        """This model with a supplied table marked for broadcast, so that views that only ask whether its key is there
        shuffle nothing; as it is, if the table has more than `rows` rows."""
        found = self.raw(name)
        return Model(self.spark, self.folder, **self.tables | {name: F.broadcast(found)}) if found.count() <= rows else self

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name not in VIEWS:
            raise AttributeError(name)
        text, used = VIEWS[name], {}
        import re

        for source in SOURCES:
            text, n = re.subn(rf"\b(FROM|JOIN) {source}\b", rf"\1 {{{source}}}", text)
            if n:
                used[source] = self.raw(source)
        return self.spark.sql(text, **used)
