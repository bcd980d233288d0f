"""The registered queries of this subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.llm import alignment, chat, exact_dedup, mixing, near_dedup, pieces, pii, prefix_trie, quality, sharding, toxicity, url_filter, warc
from clauseframe.llm import pipeline as corpus
from clauseframe.llm.common import materialize
from clauseframe.session import table

SHARDS = 8


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts (law ``rows``), in uniform random order."""
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)  # whole documents; what follows is read from the shards
    size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the chain's probabilities; those that are probably toxic are not kept."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), corpus.toxicity_chain(spark, sf_dir))
    toxic = F.col("p_toxic") >= toxicity.THRESHOLD
    return scored.select("doc_id", "p_low_quality", "p_toxic", toxic.alias("toxic"), (~toxic).alias("kept"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of identical texts; the largest doc_id stays."""
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")
    return groups.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids and the text read back from them."""
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.Vocabulary.load())


#: Only the production key is secret; this one serves the registered query.
PII_KEY = "the key of the registered query"


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with format-preserving pseudonyms for personal data."""
    return pii.pseudonyms(table(spark, sf_dir, "documents"), PII_KEY)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from the formatted string and its loss mask."""
    planted = "VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(f"SELECT * FROM {planted}"))
    made = chat.format_conversations(rows)
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    as_lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(as_lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_GUARD = chat.LLAMA.guard
OP4_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, lead(role) OVER w AS after FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *,
    CASE WHEN before = role THEN '[TURN]' WHEN role = 'user' THEN '[INST] ' WHEN role = 'assistant' THEN '[OUT] '
         ELSE '[ROLE] ' || regexp_replace(role, '{_GUARD}', '\1\\\2\3', 'g') || ' [BODY] ' END
    || regexp_replace(text, '{_GUARD}', '\1\\\2\3', 'g')
    || CASE WHEN after = role THEN '' WHEN role = 'user' THEN ' [/INST]' WHEN role = 'assistant' THEN '</s>' ELSE ' [/ROLE]' END AS piece
  FROM n
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       length('<s>' || string_agg(piece, '' ORDER BY k)) AS formatted_chars
FROM p GROUP BY conv_id
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the group that links of similar shingle sets put it in."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = url_filter._UPPER, url_filter._LOWER
OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.x JOIN n nb ON nb.doc_id = p.y WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
), c AS (
  SELECT doc_id, doc_id AS met FROM documents
  UNION SELECT c.doc_id, e.y FROM c JOIN e ON c.met = e.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(met) AS component_id FROM c GROUP BY doc_id) r USING (doc_id)
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and the verdict for every document."""
    return quality.repetition_quality(table(spark, sf_dir, "documents"))


_SHARES = ", ".join(f"({n}, {most})" for n, most in quality.MOST_COVERED.items())
#: Of each word and each length the window that begins there, null where the text ends before it does.
_LEADS = ", ".join(f"lead(word, {i}) OVER o AS w{i}" for i in range(1, max(quality.MOST_COVERED)))
_WINDOWS = ", ".join(f"({n}, word || " + " || ".join(f"' ' || w{i}" for i in range(1, n)) + ")" for n in quality.MOST_COVERED)
OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), base AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d
), lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), by_line AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(length(line)) FILTER (again), 0)::BIGINT AS dup_line_chars,
         sum(length(line))::BIGINT AS line_chars FROM lines GROUP BY doc_id
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d
), starts AS (
  SELECT doc_id, p, word, {_LEADS} FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), windows AS (
  SELECT doc_id, p, length(word) AS chars, n, win FROM starts CROSS JOIN LATERAL (VALUES {_WINDOWS}) AS v(n, win)
), twice AS (
  SELECT doc_id, n, p, chars, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, n, win) > 1 AS again FROM windows
), covered AS (
  SELECT doc_id, n, count(*) AS words, sum(chars)::BIGINT AS chars FROM (
    SELECT doc_id, n, chars, p, max(CASE WHEN again THEN p END) OVER (PARTITION BY doc_id, n ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM twice)
  WHERE p - last < n GROUP BY doc_id, n
), full_cover AS (
  SELECT doc_id, n, most, coalesce(c.words, 0) AS words, coalesce(c.chars, 0) AS chars
  FROM d CROSS JOIN (VALUES {_SHARES}) AS s(n, most) LEFT JOIN covered c USING (doc_id, n)
), by_n AS (
  SELECT doc_id, list(chars ORDER BY n) AS dup_ngram_chars, max(words) FILTER (n = 8) AS n_repeat_words, bool_and(100 * chars <= most * word_chars) AS fine
  FROM full_cover JOIN base USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, n_repeat_words,
       coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(line_chars, 0) AS line_chars, dup_ngram_chars,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND fine AND 100 * coalesce(dup_line_chars, 0) <= {quality.MOST_IN_LINES} * coalesce(line_chars, 0) AS kept
FROM base LEFT JOIN by_line USING (doc_id) JOIN by_n USING (doc_id)
"""


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents by source weights takes of each."""
    m = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    goals = m.sources.select(F.col("__source").alias("name"), F.col("size").alias("source_size"), "target")
    met = mixing.taken_words(m).join(goals, F.col("__source").eqNullSafe(F.col("name")))
    return met.select(F.col("__row.doc_id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", "taken")


#: The list of the contract.
URL_RULES = [
    url_filter.Rule("allow", "com"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and verdict of every page's URL; the trees are fitted on the URLs that the rules label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_by_rules(pages, URL_RULES))
    return url_filter.judge(pages, URL_RULES, model)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back from the archives."""
    read = warc.archive(table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


#: Base 32 of a hexadecimal digest, five hexadecimal digits to four letters.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
  (('0x' || substr({h}, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '')"""
OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(html) AS payload_bytes, {_BASE32.format(h="sha1(html)")} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p
"""

#: The first turns of every so many conversations come from the first of them, fewer than so many.
FAMILY, BORROWED = 20, 4


def rebuilt_conversations(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations as ``prefix_trie`` takes them, the first turns of each borrowed from its family's first."""
    convs = numbered.groupBy("conv_id").agg(F.max("pos").alias("n_own")).withColumns(
        {"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % BORROWED}
    )
    firsts = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < BORROWED)).groupBy(F.col("conv_id").alias("base"))
    firsts = firsts.agg(F.array_sort(F.collect_list(F.struct("pos", "turn_id", "words"))).alias("firsts"))  # three at most
    met = convs.join(firsts, "base", "left").withColumn("borrowed", F.slice(F.coalesce("firsts", F.array().cast(firsts.schema["firsts"].dataType)), 1, F.col("h").cast("int")))
    met = met.withColumn("n_turns", F.size("borrowed") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    met = materialize(met.select("conv_id", "h", "n_turns", "borrowed"), "trie-rebuilt")
    lent = met.select("conv_id", "n_turns", F.explode("borrowed").alias("t")).select("conv_id", "t.pos", "t.turn_id", "t.words", "n_turns")
    shift = met.select("conv_id", "h", "n_turns", F.size("borrowed").alias("n_borrowed"))
    own = numbered.join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n_borrowed")).alias("pos"), "turn_id", "words", "n_turns")
    return lent.unionByName(own), met.select("conv_id", "n_turns")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    numbered = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*rebuilt_conversations(numbered))


_TURN_ID = "sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
OP12_SQL = rf"""
WITH t AS (
  SELECT conv_id, {_TURN_ID} AS id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN_ID}) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (  -- CRC-32, a byte and eight shifts at a time
  SELECT conv_id, xor(4294967295, list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT)) % {BORROWED} AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS depth, id, words FROM (
    SELECT c.conv_id, 0 AS own, t.k, t.id, t.words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} AND t.k <= c.h
    UNION ALL SELECT t.conv_id, 1, t.k, t.id, t.words FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h)
), m AS (
  SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS words FROM c
  UNION ALL SELECT conv_id, depth, sha256(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth)), words FROM r
), l AS (
  SELECT conv_id, max(depth) AS n_turns FROM m GROUP BY conv_id
), n AS (
  SELECT depth, prefix, min(m.conv_id) AS node, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
         sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (n_turns = depth), '')) AS ends_sha256
  FROM m JOIN l USING (conv_id) GROUP BY depth, prefix
), p AS (
  SELECT m.conv_id, m.depth, n.node FROM m JOIN n USING (depth, prefix)
), o AS (
  SELECT n.*, p.node AS parent FROM n LEFT JOIN p ON p.conv_id = n.node AND p.depth = n.depth - 1
), k AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM o WHERE depth > 0 GROUP BY ALL
), f AS (
  SELECT o.*, coalesce(k.n_children, 0) AS n_children FROM o LEFT JOIN k USING (node, depth)
), s AS (
  SELECT p.node, p.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.own)::BIGINT AS saved_tokens
  FROM f JOIN p ON p.conv_id = f.node AND p.depth <= f.depth GROUP BY ALL
)
SELECT f.node AS conv_id, f.depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256 FROM f JOIN s USING (node, depth)
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of two vocabularies, aligned, with the corpus-wide counts of their links."""
    made = alignment.align(table(spark, sf_dir, "documents"), alignment.Tokenizer.byte_level(), alignment.Tokenizer.pieces())
    return made.docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of the corpus pipeline, one after the other."""
    return corpus.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding, "op2_sentencepiece": op2_sentencepiece, "op3_pii_pseudonyms": op3_pii_pseudonyms,
        "op4_chat_format": op4_chat_format, "op5_toxicity": op5_toxicity, "op6_exact_dedup": op6_exact_dedup, "op7_near_dedup": op7_near_dedup, "op8_quality_rules": op8_quality_rules,
        "op9_source_mixing": op9_source_mixing, "op10_url_filter": op10_url_filter, "op11_warc": op11_warc, "op12_prefix_trie": op12_prefix_trie, "op13_token_alignment": op13_token_alignment, "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op7_near_dedup": OP7_SQL, "op8_quality_rules": OP8_SQL, "op11_warc": OP11_SQL, "op12_prefix_trie": OP12_SQL}
