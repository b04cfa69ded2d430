"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import interactions, mixing, multiprobe, va_file
from strandline.llm.chat import REPLY, as_calls, link_calls
from strandline.llm.langid import identify
from strandline.llm.line_dedup import line_dedup
from strandline.llm.main_text import extract
from strandline.llm.packing import pack
from strandline.llm.simhash import near_duplicates
from strandline.llm.suffix_dedup import suffix_dedup
from strandline.llm.warc import resolve_revisits
from strandline.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.search_every(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.search_every(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.described(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixing.mix(docs, mixing.LEVELS, mixing.WEIGHTS).select(*mixing.LEVELS, "doc_id", "tokens", "epoch", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return done.select("row.doc_id", "n_units", F.size("removed").alias("n_removed"), spans("removed").alias("removed"), spans("kept").alias("kept"), F.col("kept_text").alias("text"))


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return resolve_revisits(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, as_text=True).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"))


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return link_calls(as_calls(turns), {"reply": REPLY}).select("conv_id", "turn", "role", "call_id", "level", "linked_turn", "status", "errors", "json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("part"))
    return interactions.audit(interactions.mask_counts(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {
    "op1_va_file_top_k": op1_va_file_top_k,
    "op5_multiprobe_neighbours": op5_multiprobe_neighbours,
    "op2_hierarchical_mixing": op2_hierarchical_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_pigeonring": op4_simhash_pigeonring,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_tool_call_linking": op8_tool_call_linking,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_language_id": op10_language_id,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_main_text": op13_main_text,
}

_WORDS = r"[^\x20\x09-\x0D]+"


def _split_sql(children: str, parent: str) -> str:
    """SQL for the split of budgets among ``children`` (parent columns, budget, w, cap, and the rest by name)."""
    over = f"PARTITION BY {parent}" if parent else ""
    return f"""
        (SELECT * EXCLUDE (before, rest, is_full, budget, w, cap),
                CASE WHEN is_full THEN cap ELSE CAST((CAST(w AS HUGEINT) * (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({over}), 0)))
                     // sum(CASE WHEN NOT is_full THEN w END) OVER ({over}) AS BIGINT) END AS alloc
         FROM (SELECT *, CAST(cap AS HUGEINT) * rest <= CAST(w AS HUGEINT) * (budget - before) AS is_full
               FROM (SELECT *, coalesce(sum(cap) OVER ({over} ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                            sum(w) OVER ({over} ORDER BY cap / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
                     FROM {children})))"""


#: The letters of base32. SHA-1 in hex is cut into eight numbers of five digits, each of which is four letters.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = "||".join(f"substr('{_LETTERS}', CAST(1 + (CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {shift}) % 32 AS INTEGER), 1)" for k in range(8) for shift in (15, 10, 5, 0))

_WEIGH = {c: "CASE " + " ".join(f"WHEN {c} = '{v}' THEN {w}" for v, w in own.items()) + " ELSE 1 END" for c, own in mixing.WEIGHTS.items()}

ORACLE_SQL: dict[str, str] = {
    "op2_hierarchical_mixing": f"""
        WITH base AS (SELECT 'd' || CAST(ascii(right(coalesce(source, ''), 1)) % 4 AS VARCHAR) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                             doc_id, text, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS tokens FROM documents),
        leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM base GROUP BY ALL),
        d1 AS (SELECT domain, domain AS name, CAST(sum(tokens) * {mixing.EPOCHS} AS BIGINT) AS cap, {_WEIGH["domain"]} AS w, (SELECT CAST(sum(tokens) AS BIGINT) FROM leaves) AS budget FROM leaves GROUP BY ALL),
        a1 AS (SELECT domain, alloc FROM {_split_sql("d1", "")}),
        d2 AS (SELECT domain, lang, lang AS name, CAST(sum(tokens) * {mixing.EPOCHS} AS BIGINT) AS cap, {_WEIGH["lang"]} AS w, any_value(alloc) AS budget FROM leaves JOIN a1 USING (domain) GROUP BY domain, lang),
        a2 AS (SELECT domain, lang, alloc FROM {_split_sql("d2", "domain")}),
        d3 AS (SELECT domain, lang, source, source AS name, tokens, tokens * {mixing.EPOCHS} AS cap, 1 AS w, alloc AS budget FROM leaves JOIN a2 USING (domain, lang)),
        a3 AS (SELECT domain, lang, source, tokens AS size, alloc FROM {_split_sql("d3", "domain, lang")}),
        met AS (SELECT b.domain, b.lang, b.source, doc_id, text, tokens, CASE WHEN size > 0 THEN alloc // size ELSE 0 END AS passes, CASE WHEN size > 0 THEN alloc % size ELSE 0 END AS more
                FROM base b JOIN a3 USING (domain, lang, source)),
        whole AS (SELECT domain, lang, source, doc_id, tokens, CAST(unnest(range(passes)) AS INTEGER) AS epoch, tokens AS taken FROM met WHERE passes > 0),
        h AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{mixing.SEED}', passes, doc_id)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM met WHERE more > 0 AND tokens > 0)
        SELECT domain, lang, source, doc_id, CAST(tokens AS BIGINT) AS tokens, epoch, CAST(taken AS BIGINT) AS taken FROM whole
        UNION ALL SELECT domain, lang, source, doc_id, CAST(tokens AS BIGINT), CAST(passes AS INTEGER), CAST(least(tokens, more - begun) AS BIGINT) FROM h WHERE begun < more""",
    "op3_line_dedup": r"""
        WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
        o AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM u),
        w AS (SELECT *, a + length(line) AS b, norm <> '' AS long FROM o),
        f AS (SELECT *, long AND row_number() OVER (PARTITION BY norm, long ORDER BY doc_id, k) > 1 AS gone FROM w)
        SELECT doc_id, CAST(count(*) AS INTEGER) AS n_units, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
               coalesce(string_agg(a || '-' || b, ',' ORDER BY k) FILTER (gone), '') AS removed, coalesce(string_agg(a || '-' || b, ',' ORDER BY k) FILTER (NOT gone), '') AS kept,
               coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text
        FROM f GROUP BY doc_id UNION ALL SELECT doc_id, 0, 0, '', '', NULL FROM documents WHERE text IS NULL""",
    "op6_warc_revisits": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        r AS (SELECT *, CASE WHEN page_id IS DISTINCT FROM max(page_id) OVER (PARTITION BY h, n) THEN max(page_id) OVER (PARTITION BY h, n) END AS refers_to FROM p)
        SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""",
    "op11_filter_interactions": f"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '{_WORDS}') AS words FROM d),
        l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text),
                            regexp_matches(text, '[#$%&*|]'), coalesce(first < w.doc_id, false)] AS bad, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
              FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic, len(list_filter(bad, lambda x: x)) AS fails FROM m GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s AS (SELECT filter_order, step, ascii(substr(filter_order, step, 1)) - 64 AS i, [ascii(x) - 64 for x in string_split(substr(filter_order, 1, step - 1), '') if x <> ''] AS before FROM o, generate_series(1, 5) g(step))
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (NOT bad[i] AND NOT earlier), 0) AS BIGINT) AS kept,
               CAST(coalesce(sum(n) FILTER (bad[i] AND NOT earlier), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (bad[i] AND earlier), 0) AS BIGINT) AS redundant,
               CAST(coalesce(sum(n) FILTER (bad[i] AND fails = 1), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (bad[i] AND NOT earlier), 0) AS BIGINT) AS good_lost,
               CAST(coalesce(sum(toxic) FILTER (bad[i] AND NOT earlier), 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(n * (120 // greatest(fails, 1))) FILTER (bad[i]), 0) AS BIGINT) AS shapley
        FROM (SELECT *, len([1 for b in before if bad[b]]) > 0 AS earlier FROM c, s) GROUP BY part, filter_order, step""",
    "op1_va_file_top_k": """
        WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
