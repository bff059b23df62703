"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file (a parameter of the operators; never copied)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""


@query
def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.linear import fold
    from cloakframe.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return score_quality(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.secrets import with_secrets

    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode("secrets").alias("s"))
    return found.select("doc_id", F.col("s.start").alias("start"), F.length("s.value").alias("n_chars"), F.sha2("s.value", 256).alias("secret_sha256"), F.col("s.score").alias("score"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.language_id import fit_languages, identify_languages
    from cloakframe.llm.linear import fold

    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit_languages(docs.where(fold("doc_id", 4) != 2)))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op7_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.linear import fold
    from cloakframe.llm.toxicity import fit_toxicity, grade_toxicity

    docs = table(spark, sf_dir, "documents")
    found = grade_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)))
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "severity", "grade", "predicted")


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.html_wrapper import extract_text

    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.fingerprint import edited_versions, fingerprint, likeness

    rows = edited_versions(table(spark, sf_dir, "documents"))
    own, edited, after = F.col("digests"), F.col("edited_digests"), F.col("next_digests")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, after).alias("near_next"),
    )


def sample_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each: a deletion at a third, an insertion in the middle, a replacement at two thirds."""
    n, t = F.length("text"), F.col("text")
    edit = lambda a, b, s: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), s.alias("text"))
    third, half, two = F.floor(n / 3), F.floor(n / 2), F.floor(n * 2 / 3)
    return docs.withColumn(
        "edits", F.array(edit(third, third + 40, F.lit("")), edit(half, half, F.substring(t, 1, 60)), edit(two, two + 25, F.concat(F.lit(" "), F.substring(t, -30, 30))))
    )


@query
def op8_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.token_edits import count_edited

    return count_edited(sample_edits(table(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.json"))


@query
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.embedding_dedup import embedding_near_dedup

    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


SQL["op11_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r(a, b) AS (SELECT DISTINCT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.token_alignment import align_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.conversation_repair import damaged, repair_conversations

    rows = table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(rows), rows)


def _repair_sql() -> str:
    """Costs, edits and repaired text of each state go forward, row by row of a conversation."""
    none = "{'c': 1000000, 'a': '', 'r': ''}"
    row = "chr(10) || {role} || ':' || {text}"

    def more(of: str, cost: str, letter: str, line: str | None) -> str:
        return f"{{'c': {of}.c + {cost}, 'a': {of}.a || '{letter}', 'r': {of}.r" + (f" || {line}}}" if line else "}")

    def inserted(s: str) -> str:
        put = lambda i: more(f"{s}[{i}]", "3", "I", row.format(role="'assistant'" if i == 3 else "'user'", text="''"))
        return f"[{s}[1], {s}[2], list_min([{s}[3], {put(1)}, {put(2)}, {put(4)}]), list_min([{s}[4], {put(3)}])]"

    def step() -> str:
        out = []
        for to, sources, initial, name in ((1, [], "", ""), (2, [1], "s", ""), (3, [1, 2, 4], "u", "user"), (4, [3], "a", "assistant")):
            ways = [more(f"s[{to}]", "4", "D", None)]
            for i in sources:
                ways.append(f"CASE WHEN stays AND initial = '{initial}' THEN {more(f's[{i}]', 'extra', 'K', row.format(role='role', text='text'))} ELSE {none} END")
                if name:
                    ways.append(f"CASE WHEN stays THEN {more(f's[{i}]', '3 + extra', 'R', row.format(role=_quoted(name), text='text'))} ELSE {none} END")
            out.append(f"list_min([{', '.join(ways)}])")
        return f"[{', '.join(out)}]"

    start = f"[{{'c': 0, 'a': '', 'r': ''}}, {none}, {none}, {none}]"
    both = lambda s: f"list_transform([list_transform([{s}], lambda x: {inserted('x')})[1]], lambda y: {inserted('y')})[1]"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)),
      lambda z, b: list_reduce(range(8), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)), xor(z, b)), 4294967295), 4294967295) % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM k, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE kind <> 0),
o AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_matches(text, '^[\x20\x09-\x0D]*\z') AS blank, regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z') AS cut
  FROM d),
f AS (SELECT *, NOT blank AND NOT again AS stays, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS extra, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM o),
t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE extra > 0) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id),
r(conv_id, pos, s) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {both(start)} FROM t
  UNION ALL SELECT r.conv_id, f.pos, {both(step())} FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1),
b AS (SELECT t.*, list_min([s[1], s[4]]) AS x FROM t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.pos = t.n)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(substring(x.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL["op13_conversation_repair"] = _repair_sql()
