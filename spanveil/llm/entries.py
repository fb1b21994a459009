"""One query for each operator of this folder, over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.chat_format import as_streamed, fold_events, read_back, render
from spanveil.llm.decontamination import verdicts
from spanveil.llm.hard_negatives import hard_negatives, prepared
from spanveil.llm.hmm_lm import score_texts
from spanveil.llm.line_dedup import line_dedup
from spanveil.llm.packing import pack
from spanveil.llm.quality_rules import quality_rules
from spanveil.llm.shard_placement import SLOTS, place
from spanveil.llm.simhash_dedup import near_duplicates
from spanveil.llm.source_divergence import source_divergence
from spanveil.llm.suffix_dedup import substring_dedup
from spanveil.llm.token_files import read_token_files, write_token_files
from spanveil.llm.warc_zip import page_report, write_archives
from spanveil.plans.tables import fresh_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def frequent_sql(line: str, share: float, docs: int) -> str:
    """CTEs: the lines of each document, the lines that are frequent on their host."""
    return f"""
    lines AS (SELECT doc_id, source, text, raw, {line} AS line, i FROM
      (SELECT doc_id, source, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
    totals AS (SELECT source, count(DISTINCT coalesce(text, '')) AS total FROM documents GROUP BY 1),
    many AS (SELECT l.source, line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE line <> ''
      GROUP BY l.source, line, total HAVING count(DISTINCT text) >= {docs} AND count(DISTINCT text) > {share} * total)"""


@query(
    rf"""WITH {frequent_sql(f"trim(regexp_replace(raw, '[0-9]+', '0', 'g'), {SPACES_SQL})", 0.08, 3)},
    w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS words FROM documents),
    p AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8),
    r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 7], ' ')) AS c FROM p),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(8) AS o(k) WHERE c > 1 GROUP BY 1),
    x AS (SELECT doc_id, sum(len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'))) AS n
      FROM lines l JOIN many m ON l.source IS NOT DISTINCT FROM m.source AND l.line = m.line GROUP BY 1),
    e AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lines WHERE regexp_matches(raw, '[^\x20\x09-\x0D]') GROUP BY 1),
    f AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(e.n, 0) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, cast(coalesce(x.n, 0) AS bigint) AS removed_words
      FROM w LEFT JOIN e USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id))
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
      NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND removed_words <= 0.7 * n_words AS kept FROM f"""
)
def op10_quality_rules(s, sf):
    return quality_rules(table(s, sf, "documents"))


@query(
    f"""WITH {frequent_sql(f"trim(raw, {SPACES_SQL})", 0.08, 3)},
    k AS (SELECT l.doc_id, l.i, raw, m.line IS NOT NULL AS gone FROM lines l
      LEFT JOIN many m ON l.source IS NOT DISTINCT FROM m.source AND l.line = m.line)
    SELECT doc_id, coalesce(string_agg(CASE WHEN NOT gone THEN raw END, chr(10) ORDER BY i), '') AS text, count(*) AS n_lines,
      cast(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS bigint) AS n_removed FROM k GROUP BY 1"""
)
def op7_line_dedup(s, sf):
    return line_dedup(table(s, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_removed")


SHARDS = tuple(f"shard-{k:02d}" for k in range(32))
SLOT_SQL = "cast(('0x' || substr(md5({}), 1, 15))::BIGINT AS BIGINT)"


@query(
    f"""WITH RECURSIVE s AS (SELECT k, 'shard-' || lpad(cast(k AS varchar), 2, '0') AS name FROM range(32) AS t(k)),
    n AS (SELECT list({SLOT_SQL.format("'offset ' || name")} % {SLOTS} ORDER BY k) AS starts,
      list({SLOT_SQL.format("'step ' || name")} % {SLOTS - 1} + 1 ORDER BY k) AS steps FROM s),
    fill AS (SELECT 0 AS turn, starts AS spot, list_transform(range({SLOTS}), lambda x: -1) AS owner, 0 AS claimed, steps FROM n
      UNION ALL
      SELECT CASE WHEN owner[spot[turn + 1] + 1] < 0 THEN (turn + 1) % 32 ELSE turn END,
        CASE WHEN owner[spot[turn + 1] + 1] < 0 THEN spot
          ELSE list_concat(spot[1:turn], [(spot[turn + 1] + steps[turn + 1]) % {SLOTS}], spot[turn + 2:32]) END,
        CASE WHEN owner[spot[turn + 1] + 1] < 0 THEN list_concat(owner[1:spot[turn + 1]], [turn], owner[spot[turn + 1] + 2:{SLOTS}]) ELSE owner END,
        CASE WHEN owner[spot[turn + 1] + 1] < 0 THEN claimed + 1 ELSE claimed END, steps FROM fill WHERE claimed < {SLOTS}),
    done AS (SELECT owner FROM fill WHERE claimed = {SLOTS} LIMIT 1),
    t AS (SELECT unnest(range({SLOTS})) AS slot, unnest(owner) AS k FROM done)
    SELECT doc_id, t.slot, 'shard-' || lpad(cast(k AS varchar), 2, '0') AS shard
    FROM documents JOIN t ON t.slot = {SLOT_SQL.format("'k' || doc_id")} % {SLOTS}"""
)
def op6_shard_placement(s, sf):
    return place(table(s, sf, "documents").select("doc_id"), F.col("doc_id"), SHARDS)


CONTROL = r"\### Assistant: </turn> ok"


@query()
def op3_chat_format(s, sf):
    """All conversations and one, -7, whose texts are full of control strings, as logs of streamed messages."""
    more = s.range(1).select(F.explode(F.expr("array(struct(0L AS turn, 'user' AS role), struct(1L AS turn, 'assistant' AS role))")).alias("t"))
    more = more.select(F.lit(-7).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(CONTROL).alias("text"))
    rows = table(s, sf, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(more)
    return read_back(stored(render(fold_events(as_streamed(rows))), "chats"))


@query()
def op5_simhash_near_dedup(s, sf):
    return near_duplicates(table(s, sf, "documents"), words=3)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op2_simple8b_ids(s, sf):
    path = fresh_path(s, "ids")
    write_token_files(table(s, sf, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return read_token_files(s, path)


@query()
def op4_best_fit_packing(s, sf):
    return pack(table(s, sf, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query()
def op9_benchmark_decontamination(s, sf):
    return verdicts(table(s, sf, "documents"), table(s, sf, "benchmark"))


@query()
def op8_hmm_lm(s, sf):
    return score_texts(table(s, sf, "documents"))


@query()
def op1_suffix_array_dedup(s, sf):
    return substring_dedup(table(s, sf, "documents")).drop("starts", "stops")


@query(
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    f AS (SELECT html, min(page_id) AS first FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY 1)
    SELECT page_id, cast(octet_length(encode(p.html)) AS bigint) AS payload_bytes, sha256(p.html) AS payload_digest,
      CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
    FROM p LEFT JOIN f ON p.html = f.html"""
)
def op11_warc_zip(s, sf):
    """Records read back from packages by ranges."""
    report = page_report(write_archives(table(s, sf, "pages"), fresh_path(s, "warc")))
    ids = {"page_id": F.col("id").cast("long"), "refers_to": F.col("refers_to").cast("long")}
    return report.withColumns(ids).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS r,
      list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, cast(list_dot_product(a.v, b.v) AS bigint) AS score
      FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k FROM s WHERE alike QUALIFY k <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id, cast(row_number() OVER (PARTITION BY p.anchor, k ORDER BY n.score DESC, n.vec_id) AS int) AS rank,
      n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON p.anchor = n.anchor AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5"""
)
def op12_hard_negatives(s, sf):
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = prepared(table(s, sf, "embeddings"), label=label)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query(
    r"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
    l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY 1),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
    m AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(m.n, 0) + 2 * l.v) AS p,
        1 + (1000000000::hugeint * (total + 2)) // (l.n + 2 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN m USING (lang, source) LEFT JOIN c USING (lang, source, term)),
    x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, cast(coalesce(f, 0) AS bigint) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT a.lang AS lang_, a.source AS s, b.source AS o, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) ON a.lang = lang_ AND a.source = s AND b.source = o
      UNION ALL SELECT lang, source, 'term', term, cast(((p - q) * (p - q)) // (p + q) AS bigint) FROM p WHERE n > 0 AND p > q)
    SELECT *, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS int) AS rank FROM x QUALIFY part = 'pair' OR rank <= 10"""
)
def op13_source_divergence(s, sf):
    return source_divergence(table(s, sf, "documents"))
