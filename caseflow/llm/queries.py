"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import (
    ann, chat, collocations, fim, fmindex, hmm, langid, merkle, mixing, neardup, packing, secrets, simhash,
)
from caseflow.llm.common import stored
from caseflow.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = tokenizer_path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window",
        "step_group",
    )


@query("op2_language_compression")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(langid.learned_from()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )


@query("op3_projection_forest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op4_simhash_trie")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query(
    "op5_merkle_audit",
    """
WITH records AS (
  SELECT page_id, md5(concat_ws('|', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''))) AS name,
    concat('WARC/1.1{nl}WARC-Type: response{nl}WARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), ''),
      '>{nl}WARC-Target-URI: ', coalesce(url, ''), '{nl}Content-Length: ') AS header, coalesce(html, '') AS html,
    CASE WHEN page_id % 101 = 7 THEN NULL WHEN page_id % 97 = 5 THEN concat('#', substr(coalesce(html, ''), 2))
      ELSE coalesce(html, '') END AS held
  FROM pages),
written AS (
  SELECT page_id, name, concat(header, strlen(html), '{nl}{nl}', html, '{nl}{nl}') AS record,
    CASE WHEN held IS NOT NULL THEN concat(header, strlen(held), '{nl}{nl}', held, '{nl}{nl}') END AS held_record
  FROM records),
placed AS (
  SELECT CAST(CAST('0x' || substr(name, 1, 3) AS INT) AS BIGINT) AS file, page_id, sha256(record) AS digest, sha256(held_record) AS held_digest,
    CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY substr(name, 1, 3) ORDER BY name, sha256(record)
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM written)
SELECT file, "offset", page_id, CASE WHEN held_digest IS NULL THEN 'missing' ELSE 'changed' END AS status,
  digest AS left_digest, held_digest AS right_digest
FROM placed WHERE held_digest IS DISTINCT FROM digest""".replace("{nl}", "', chr(13), chr(10), '"),
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The second replica is the table with damage by rule: bytes overwritten, records lost.
    html = F.coalesce("html", F.lit(""))
    damaged = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.expr("substr(coalesce(html, ''), 2)"))).otherwise(html)
    held = F.when(F.coalesce(F.col("page_id") % 101 == 7, F.lit(False)), F.lit(None)).otherwise(damaged)
    pages = _table(spark, sf_dir, "pages").withColumn("_held", held)
    placed = stored(merkle.layout(pages, "_held"), "warc-layout")
    replica = placed.filter("replica_digest is not null").withColumn("digest", F.col("replica_digest"))
    columns = ["file", "offset", "page_id", "digest"]
    return merkle.audit(placed.select(*columns), replica.select(*columns))


@query(
    "op6_source_mixing",
    """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER w AS nth, 2.0 * source_size / weight AS ratio,
    sum(2.0 * source_size) OVER w AS given, sum(weight) OVER () - sum(weight) OVER w AS open
  FROM sources WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
steps AS (
  SELECT nth, open, 1.5 * (SELECT sum(source_size) FROM sources) - given AS rest, lead(ratio) OVER (ORDER BY nth) AS following
  FROM ordered
  UNION ALL SELECT 0, (SELECT sum(weight) FROM sources), 1.5 * (SELECT sum(source_size) FROM sources), (SELECT min(ratio) FROM ordered)),
level AS (SELECT rest / open AS height FROM steps WHERE open > 0 AND rest / open < following ORDER BY nth LIMIT 1),
rated AS (
  SELECT source, source_size, least(2.0 * source_size, coalesce((SELECT height FROM level), 0) * weight) AS target FROM sources),
planned AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u
  FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM planned""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # Texts are counted once; the narrow rows are read again for the sums and for the plan.
    sized = cut_lineage(mixing.with_sizes(docs).select("doc_id", "source", "size"))
    planned = mixing.plan(sized)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _matches_sql(kind: int, pattern: str, group: int) -> str:
    """Matches of one kind, with the text between them, for every document."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT rid, doc_id, source, t, {kind} AS kind, unnest(regexp_extract_all(t, '{quoted}', 0)) AS hit,
  unnest(regexp_extract_all(t, '{quoted}', {group})) AS value, unnest(string_split_regex(t, '{quoted}')) AS gap,
  generate_subscripts(string_split_regex(t, '{quoted}'), 1) AS nth FROM docs"""


_LISTED = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
_SECRETS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
hits AS (
  {_matches_sql(0, secrets.ASSIGN, 2)}
  UNION ALL {_matches_sql(1, "AKIA[A-Z0-9]{12,}", 0)}
  UNION ALL {_matches_sql(2, "[0-9a-f]{32,}", 0)}
  UNION ALL {_matches_sql(3, "[A-Za-z+/_.=-]*[0-9][A-Za-z0-9+/_.=-]*", 0)}),
placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY nth) AS stop FROM hits WHERE hit IS NOT NULL),
spans AS (
  SELECT rid, doc_id, source, t, kind, value, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
    ['assign', 'access', 'hex', 'bare'][kind + 1] AS name
  FROM placed WHERE kind IN (1, 2) OR length(value) >= 8),
base AS (SELECT * FROM spans WHERE kind < 3),
owners AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) < 3 AND count(DISTINCT t) < 20 AS live FROM base GROUP BY value),
holders AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) < 3 AND count(DISTINCT t) < 20 AS few FROM spans GROUP BY value),
judged AS (
  SELECT base.*, live FROM base JOIN owners USING (value)
  UNION ALL SELECT bare.*, live FROM spans bare JOIN owners USING (value) JOIN holders USING (value)
  WHERE bare.kind = 3 AND live AND few
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = bare.rid AND b.start < bare.stop AND bare.start < b.stop)),
own AS (
  SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
    count(*) FILTER (WHERE kind = 2) AS n_hex, {_LISTED} AS listed FROM base GROUP BY rid),
every AS (
  SELECT rid, {_LISTED} AS spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example
  FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN own USING (rid) LEFT JOIN every USING (rid)"""


@query("op7_secret_ownership", _SECRETS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(_table(spark, sf_dir, "documents")))


_TURNS = "ORDER BY turn, role, text"


@query(
    "op8_chat_machine",
    f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, r.turn, CASE r.turn WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) AS r(turn)),
written AS (
  -- Header, text and end; a backslash is doubled, a control string gets two characters more.
  SELECT *, length('### : ') + length(role) + length(text) + length(' </turn>') + 1
    + length(text) - length(replace(text, '\\', ''))
    + 2 * (length(array_to_string(regexp_extract_all(text, '#{{3,}}'), '')) - 2 * len(regexp_extract_all(text, '#{{3,}}')))
    + length(text) - length(replace(text, ': ', ''))
    + 2 * len(regexp_extract_all(text, '</turn>')) AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_TURNS})) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_TURNS}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ',' {_TURNS}), '(system,)?user,assistant(,user,assistant)*') AS valid
FROM written GROUP BY conv_id""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One more conversation, whose texts look like control strings.
    odd = "\\### Assistant: </turn> ok"
    columns = ["conv_id", "turn", "role", "text"]
    table = _table(spark, sf_dir, "conversations").select(*columns)
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"),
    )
    return chat.read_back(chat.format_turns(table.unionByName(more)))


@query("op9_hidden_markov")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


@query(
    "op10_tiled_vectors",
    """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept
FROM reached r LEFT JOIN counted c ON r.vec_id = c.vec_id GROUP BY r.vec_id""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)
    return found.select("vec_id", "n_links", "component_id", "kept")


_LOWER = f"translate(coalesce(text, ''), '{fmindex.UPPER}', '{fmindex.LOWER}')"


@query(
    "op11_fm_index",
    f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{fmindex.WORD}') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{fmindex.WORD}') AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS phrase
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(p) WHERE len(w) > 0),
places AS (
  SELECT rid, p, size, array_to_string(w[p:p + size - 1], ' ') AS phrase
  FROM docs, (SELECT DISTINCT size FROM wanted) AS sizes, unnest(range(1, len(w) - size + 2)) AS r(p)),
hits AS (SELECT rid, p, size, item_id FROM places JOIN wanted USING (size, phrase)),
covered AS (
  SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT rid, p, size FROM hits) AS h, unnest(range(p, p + size)) AS r(x)
  GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT rid, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = fmindex.contamination(docs, benchmark)
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return found.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", words.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (words > 0).alias("contaminated"),
    )


@query(
    "op12_block_rotation",
    """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS z,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS s FROM docs),
cut AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle,
    array_to_string(u[greatest(x, y) + 1:n], '') AS suffix,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR z >= 90 THEN 'plain'
      WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restore(fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


@query(
    "op13_misra_gries",
    f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase
  FROM words, unnest(range(1, 6)) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(p)),
counts AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, array_to_string(string_split(c.phrase, ' ')[1:j], ' ') AS first,
    array_to_string(string_split(c.phrase, ' ')[j + 1:c.k], ' ') AS rest
  FROM counts c, unnest(range(1, c.k)) AS r(j)),
best AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score
  FROM cuts JOIN totals ON totals.lang = cuts.lang JOIN counts x ON x.lang = cuts.lang AND x.phrase = cuts.first
  JOIN counts y ON y.lang = cuts.lang AND y.phrase = cuts.rest
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (1000 * a * n) // (x.f * y.f), j) = 1),
kept AS (
  SELECT * FROM best WHERE NOT EXISTS (
    SELECT 1 FROM counts longer WHERE longer.lang = best.lang AND longer.phrase <> best.phrase AND longer.f >= best.a
      AND contains(' ' || longer.phrase || ' ', ' ' || best.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))
