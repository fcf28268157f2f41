"""The registered queries of the numbered operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens.llm import chat, fingerprints, jaccard, language, lattice, lexical, packing, quality, repair, substring, token_files, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer lies, on the executors too."""
    import public_tokenizers

    return public_tokenizers.path(name)


_WORD = "[^\\x20\\x09-\\x0D]+"

# Windows of three words as one text each; words hold no blanks.
@query("op1_quality", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (
 SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)),
lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d), p AS (
 SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (
 SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2) x), r AS (
 SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) x WHERE c > 1), c AS (
 SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY 1), f AS (
 SELECT w.doc_id, t, ws, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
 FROM w LEFT JOIN c ON c.doc_id = w.doc_id), b AS (
 SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR n_symbols / greatest(word_chars, 1) > 0.02
 OR length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) / greatest(length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')), 1) > 0.3
 OR length(regexp_replace(t, '[^!?]+', '', 'g')) / greatest(word_chars, 1) > 0.05
 OR n_dup_lines / greatest(len(ls), 1) > 0.5
 OR len(list_distinct(ws)) / greatest(n_words, 1) < 0.2) AS kept FROM b""")
def _(spark, folder):
    return quality.report(table(spark, folder, "documents"))


# A window is its words with a blank between; hash values only shorten what is grouped.
@query("op2_substring_dedup", f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws
 FROM documents), p AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS g FROM (
 SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) > 12) x), m AS (
 SELECT g, min(doc_id) AS first FROM p GROUP BY g), r AS (
 SELECT DISTINCT doc_id, i + k AS j FROM p JOIN m USING (g), (SELECT unnest(range(13)) AS k) s WHERE doc_id > first), k AS (
 SELECT w.doc_id, len(ws)::BIGINT AS n_words, count(r.j)::BIGINT AS n_removed,
 string_agg(x.v, ' ' ORDER BY x.j) FILTER (WHERE r.j IS NULL) AS kept
 FROM w LEFT JOIN (SELECT doc_id, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS j FROM w) x ON x.doc_id = w.doc_id
 LEFT JOIN r ON r.doc_id = x.doc_id AND r.j = x.j GROUP BY w.doc_id, ws)
 SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k""")
def _(spark, folder):
    out = substring.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query("op3_packing")
def _(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer(), end_id=2)


@query("op4_language")
def _(spark, folder):
    return language.predictions(table(spark, folder, "documents"))


@query("op5_jaccard_join")
def _(spark, folder):
    return jaccard.classes(table(spark, folder, "documents"))


@query("op6_sentencepiece")
def _(spark, folder):
    model = tokenizer("piece_bpe_32k.model")
    out = lattice.decode(lattice.encode(table(spark, folder, "documents"), model), model)
    return out.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op7_chat", """WITH c AS (SELECT DISTINCT conv_id AS pair_id, turn, role, text FROM conversations), a AS (
 SELECT pair_id, max(turn) AS last, max(struct_pack(turn := turn, text := text)).text AS answer FROM c
 WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY 1), j AS (
 SELECT DISTINCT * FROM (SELECT c.pair_id, turn, role, text FROM c LEFT JOIN a ON a.pair_id = c.pair_id
 WHERE last IS NULL OR turn IS NULL OR turn < last
 UNION ALL SELECT a.pair_id, a.last, 'assistant', b.answer FROM a JOIN a b ON b.pair_id = xor(a.pair_id, 1)) x), t AS (
 SELECT pair_id, turn, role, text, min(side) AS low, max(side) AS high FROM (
 SELECT *, 0 AS side FROM c UNION ALL SELECT *, 1 FROM j) x GROUP BY ALL), d AS (
 SELECT pair_id, min(turn) AS first FROM t WHERE low = high GROUP BY 1), s AS (
 SELECT t.*, first IS NULL OR turn < first AS shared FROM t LEFT JOIN d ON d.pair_id = t.pair_id), p AS (
 SELECT *, 'prompt' AS part FROM s WHERE shared UNION ALL SELECT *, 'chosen' FROM s WHERE NOT shared AND low = 0
 UNION ALL SELECT *, 'rejected' FROM s WHERE NOT shared AND high = 1)
 SELECT pair_id, part, turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
 part <> 'prompt' AND role = 'assistant' AS loss FROM p""")
def _(spark, folder):
    return chat.preferences(table(spark, folder, "conversations"))


@query("op8_warc", """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), k AS (
 SELECT page_id, url, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p), f AS (
 SELECT payload_digest, min(page_id) AS original FROM k WHERE payload_bytes >= 100 GROUP BY 1)
 SELECT page_id, payload_bytes, k.payload_digest,
 CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN original <> page_id THEN original END AS refers_to, true AS resolves
 FROM k LEFT JOIN f ON f.payload_digest = k.payload_digest AND payload_bytes >= 100""")
def _(spark, folder):
    out = warc.archive(table(spark, folder, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "resolves")


@query("op9_token_files")
def _(spark, folder):
    return token_files.token_files(table(spark, folder, "documents"), tokenizer(), end_id=1)


@query("op10_fingerprints")
def _(spark, folder):
    return fingerprints.versions(table(spark, folder, "documents"))


@query("op11_toxicity")
def _(spark, folder):
    return toxicity.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")


@query("op12_lexical_search", f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS ts FROM documents),
 s AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS length FROM d),
 i AS (SELECT item_id, q, unnest(list_distinct(ts)) AS term FROM (
 SELECT item_id, row_number() OVER () AS q, {_TERMS} AS ts FROM benchmark) x), v AS (SELECT DISTINCT term FROM i), p AS (
 SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) x WHERE term IN (SELECT term FROM v) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
 m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(ts) * docs) // length) AS m FROM d, s WHERE len(ts) > 0), c AS (
 SELECT item_id, q, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
 FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, q, r, doc_id), k AS (
 SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM c WHERE score > 0)
 SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50""")
def _(spark, folder):
    return lexical.best_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _cheaper(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _way(state: str, cost: int | str, letter: str) -> str:
    """A way one edit further: nine digits of cost, then the audit, so that text order is (cost, audit)."""
    return f"(lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}')"


def _after(top: str, symbol: str, sources: list[str]) -> str:
    """The best way to a stack top over one turn: delete it there, or shift it from one of ``sources``."""
    kept = [f"CASE WHEN c <> 'x' AND lower(c) = '{symbol}' THEN {_way(s, 'x', 'K')} END" for s in sources]
    given = [f"CASE WHEN c <> 'x' THEN {_way(s, '2 + x', 'R')} END" for s in sources] if symbol != "s" else []
    return _cheaper(_way(top, 3, "D"), *kept, *given)


_CRC = ("list_reduce(list_prepend(4294967295::UBIGINT, [ascii(k)::UBIGINT FOR k IN string_split(s, '')]), lambda a, b: "
        "list_reduce(list_prepend(xor(a, b), [z::UBIGINT FOR z IN range(8)]), lambda p, z: xor(p >> 1, (p & 1) * 3988292384::UBIGINT)))")


# A recursive walk over the turns keeps the best way to each of the four stack tops.
@query("op13_repair", f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations), h AS (
 SELECT *, xor({_CRC}, 4294967295::UBIGINT) % 20 AS f FROM k), d AS (
 SELECT coalesce(CAST(conv_id AS VARCHAR), '-') AS id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
 CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
 FROM h, (SELECT unnest([0, 1]) AS copy) z WHERE f > 0 AND (copy = 0 OR f = 3)), o AS (
 SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text) AS i FROM d), q AS (
 SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY id ORDER BY i) AS before,
 CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
 WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 THEN 'duplicate'
 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault FROM o), n AS (
 SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
 count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
 count(*) FILTER (WHERE fault = 'truncated') AS truncated,
 count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS turns FROM q GROUP BY id),
 t AS (SELECT id, i, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE r END AS c,
 CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS x FROM q), walk AS (
 SELECT id, 0::BIGINT AS i, '000000000' AS e0, NULL::VARCHAR AS eh, NULL::VARCHAR AS eu, NULL::VARCHAR AS et FROM n
 UNION ALL SELECT id, i, {_way('z0', 3, 'D')}, {_after('zh', 's', ['z0'])},
 {_after('zu', 'u', ['z0', 'zh', 'zt'])}, {_after('zt', 'a', ['zu'])} FROM (
 SELECT y.*, {_cheaper('y.zt0', _way('y.zu', 2, 'I'))} AS zt FROM (
 SELECT t.*, e0 AS z0, eh AS zh, et AS zt0, {_cheaper('eu', *[_way(s, 2, 'I') for s in ('e0', 'eh', 'et')])} AS zu
 FROM walk JOIN t ON t.id = walk.id AND t.i = walk.i + 1) y) z), e AS (
 SELECT n.*, {_cheaper('e0', _way('eh', 4, 'II'), _way('eu', 2, 'I'), 'et')} AS best
 FROM walk JOIN n ON n.id = walk.id AND n.turns = walk.i), b AS (
 SELECT *, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM e), l AS (
 SELECT id, unnest(string_split(audit, '')) AS op, unnest(range(len(audit))) AS j FROM b WHERE audit <> ''), p AS (
 SELECT *, count(*) FILTER (WHERE op <> 'I') OVER g AS i, count(*) FILTER (WHERE op <> 'D') OVER g AS m
 FROM l WINDOW g AS (PARTITION BY id ORDER BY j)), v AS (
 SELECT p.*, role, text, max(CASE WHEN m = 1 AND op = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.id) AS head
 FROM p LEFT JOIN q ON q.id = p.id AND q.i = p.i AND op <> 'I'), a AS (
 SELECT id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (m - head) % 2 = 1 THEN 'user' ELSE 'assistant' END
 || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS repaired_sha256 FROM v WHERE op <> 'D' GROUP BY id)
 SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
 coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
 coalesce(repaired_sha256, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c
 LEFT JOIN b ON b.id = coalesce(CAST(c.conv_id AS VARCHAR), '-') LEFT JOIN a ON a.id = b.id""")
def _(spark, folder):
    return repair.damaged_and_repaired(table(spark, folder, "conversations"))
