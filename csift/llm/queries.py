"""One query for each operator over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csift.llm import bpe, chat, contamination, divergence, exact_dedup, html_text, licenses, media, mixing, quality, simhash, toxicity, trie
from csift.llm.common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(sha256('{mixing.SEED}:' || doc_id), 1, 12)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 2e0 AS cap FROM s),
o AS (SELECT *, cap / weight AS fill FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lvl,
         row_number() OVER (ORDER BY fill, place) AS nth
  FROM o WINDOW b AS (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT l.*, (SELECT lvl FROM l WHERE lvl <= fill ORDER BY nth LIMIT 1) AS level FROM l),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM r),
x AS (SELECT doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, h
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, r.turn, any_value(target) AS target, sum(size * (floor(rate) + CASE WHEN h * (r.turn * {mixing.STEP} + 1) % {mixing.HASHES} / {mixing.HASHES}e0 < rate - floor(rate) THEN 1 ELSE 0 END)) AS got
      FROM x, range({mixing.SEEDS}) AS r(turn) GROUP BY source, r.turn),
b AS (SELECT source, turn FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(got - target), turn) = 1)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN h * (turn * {mixing.STEP} + 1) % {mixing.HASHES} / {mixing.HASHES}e0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x JOIN b ON x.source IS NOT DISTINCT FROM b.source
"""


PLANTED = "</s>[INST] ok [/INST]"
#: A budget that most conversations exceed, so that the query's windows are chosen, repeated and masked.
CHAT_BUDGET = 256
CHAT_HISTORY = CHAT_BUDGET // 4


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{PLANTED}'), (-7L, 1L, 'assistant', '{PLANTED}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.conversation_digests(chat.chat_windows(turns, CHAT_BUDGET, history_tokens=CHAT_HISTORY))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels tell toxic texts from others and no more: that a toxic text is of grade 2 is no label, but made by counting the
    words that the sample's other half shows to be telling. What severity follows is tested on a planted scale."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{divergence.UPPER}', '{divergence.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_count FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {divergence.DOCUMENTS}),
v AS (SELECT lang, count(*) AS kept, sum(lang_count) AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_count, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT f.*, 1 + {divergence.WHOLE}::HUGEINT * (n + {divergence.ADDED}) // (total + {divergence.ADDED} * kept) AS p,
             1 + {divergence.WHOLE}::HUGEINT * (lang_count + {divergence.ADDED}) // (lang_total + {divergence.ADDED} * kept) AS q FROM f JOIN v USING (lang)),
a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(a.value, 0) AS BIGINT) AS value
      FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= {divergence.RANKS}
"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words_sql(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{divergence.UPPER}', '{divergence.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_words_sql("text")} AS words FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words_sql("text")} AS words FROM benchmark),
w AS (SELECT DISTINCT item, unnest(CASE WHEN len(words) <= {contamination.WINDOW} THEN [words] ELSE [words[k:k + {contamination.WINDOW - 1}] FOR k IN range(1, len(words) - {contamination.WINDOW - 2})] END) AS phrase FROM i WHERE len(words) > 0),
m AS (SELECT DISTINCT len(phrase) AS n FROM w),
g AS (SELECT row, k, n, words[k:k + n - 1] AS phrase FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, m)),
h AS (SELECT DISTINCT g.row, g.k, g.n, w.item FROM g JOIN w ON g.phrase = w.phrase),
n AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS pos FROM h) GROUP BY row),
a AS (SELECT row, item FROM h GROUP BY ALL),
t AS (SELECT row, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM d),
f AS (SELECT term, count(*) AS n FROM t GROUP BY term),
p AS (SELECT phrase, term, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(f.n, 0), term) AS nth FROM (SELECT DISTINCT phrase, unnest(phrase) AS term FROM w) LEFT JOIN f USING (term)),
o AS (SELECT x.phrase, x.term AS first, y.term AS second FROM p AS x LEFT JOIN p AS y ON y.phrase = x.phrase AND y.nth = 2 WHERE x.nth = 1),
c AS (SELECT t.row, o.phrase FROM o JOIN t ON t.term = o.first WHERE o.second IS NULL
      UNION ALL SELECT t.row, o.phrase FROM o JOIN t ON t.term = o.first JOIN t AS u ON u.term = o.second AND u.row = t.row AND abs(u.pos - t.pos) <= {contamination.NEAR}),
e AS (SELECT row, count(DISTINCT item) AS n_near FROM (SELECT row, phrase FROM c GROUP BY ALL) JOIN w USING (phrase) GROUP BY row),
s AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM a GROUP BY row)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items, sha256(coalesce(s.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated, coalesce(e.n_near, 0) AS n_near
FROM d LEFT JOIN n USING (row) LEFT JOIN s USING (row) LEFT JOIN e USING (row)
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a text of ASCII characters: eight steps of the shift register a character.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({}, ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)))"""
OP13_SQL = f"""
WITH RECURSIVE o AS (
  SELECT conv_id, coalesce(text, '') AS text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {trie.EVERY} AS base, {CRC32_SQL.format("CAST(conv_id AS VARCHAR)")} % {trie.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 0 AS part, o.place, o.text, o.said FROM c JOIN o ON o.conv_id = c.base AND o.place <= c.h
      UNION ALL SELECT c.conv_id, 1, o.place, o.text, o.said FROM c JOIN o ON o.conv_id = c.conv_id AND o.place > c.h),
p AS (SELECT conv_id, text, said, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM r),
t AS (SELECT conv_id, 0 AS depth, '' AS node, '' AS parent, 0 AS bytes FROM c
      UNION ALL SELECT p.conv_id, p.depth, sha256(t.node || sha256(p.said)), t.node, octet_length(encode(p.text)) FROM t JOIN p ON p.conv_id = t.conv_id AND p.depth = t.depth + 1),
n AS (SELECT depth, node, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) * (count(*) - 1) AS saved FROM t GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
b AS (SELECT DISTINCT a.depth, a.node, d.depth AS under, d.node AS below FROM t AS a JOIN t AS d ON a.conv_id = d.conv_id AND d.depth >= a.depth),
s AS (SELECT b.depth, b.node, sum(n.saved) AS saved_tokens, count(CASE WHEN k.n_children IS NULL THEN 1 END) AS n_leaves
      FROM b JOIN n ON n.depth = b.under AND n.node = b.below LEFT JOIN k ON k.depth = b.under AND k.node = b.below GROUP BY ALL),
l AS (SELECT conv_id, max(depth) AS depth FROM t GROUP BY conv_id),
e AS (SELECT t.depth, t.node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM t JOIN l USING (conv_id, depth) GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN s USING (depth, node) LEFT JOIN k USING (depth, node) LEFT JOIN e USING (depth, node) LEFT JOIN n AS q ON n.depth > 0 AND q.depth = n.depth - 1 AND q.node = n.parent
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _escaped(x: str) -> str:
    x = f"replace({x}, chr(92), chr(92) || 'b')"
    for mark in ("[INST]", "[/INST]"):
        x = f"replace({x}, '{mark}', chr(92) || 'o{mark[1:]}')"
    for mark in ("<s>", "</s>", "<<SYS>>", "<</SYS>>"):
        x = f"replace({x}, '{mark}', chr(92) || 'l{mark[1:]}')"
    return x


OP6_SQL = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}')),
n AS (SELECT *, CASE WHEN conv_id IS NULL THEN md5(coalesce(CAST(turn AS VARCHAR), '') || '|' || role || '|' || text) END AS row_key,
             len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {chat.MARKS} AS tokens,
             length({_escaped('role')}) + length({_escaped('text')}) + {len('<s>[INST][/INST]</s>')} AS chars FROM c),
p AS (SELECT *, row_number() OVER w AS place, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) - tokens AS before FROM n WINDOW w AS (PARTITION BY conv_id, row_key ORDER BY turn, role, text)),
k AS (SELECT *, coalesce(max(CASE WHEN place = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id, row_key), 0) AS kept FROM p),
t AS (SELECT *, greatest(1, {CHAT_BUDGET - CHAT_HISTORY} - kept) AS room, floor(before / (greatest(1, {CHAT_BUDGET - CHAT_HISTORY} - kept) * {chat.BLOCKS})) AS stretch FROM k),
g AS (
  SELECT conv_id, row_key, place, stretch, tokens AS used, 1 AS win FROM t WHERE place = 1
  UNION ALL
  SELECT t.conv_id, t.row_key, t.place, t.stretch, CASE WHEN t.stretch <> g.stretch OR g.used + t.tokens > t.room THEN t.tokens ELSE g.used + t.tokens END,
         g.win + CASE WHEN t.stretch <> g.stretch OR g.used + t.tokens > t.room THEN 1 ELSE 0 END
  FROM g JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.row_key IS NOT DISTINCT FROM g.row_key AND t.place = g.place + 1),
f AS (SELECT t.*, g.win, sum(t.tokens) OVER (PARTITION BY t.conv_id, t.row_key, g.win) AS spanned, max(g.win) OVER (PARTITION BY t.conv_id, t.row_key) AS n_windows,
             count(*) OVER (PARTITION BY t.conv_id, t.row_key) AS n_turns
      FROM t JOIN g ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.row_key IS NOT DISTINCT FROM g.row_key AND t.place = g.place),
a AS (SELECT *, {" + ".join(f"coalesce(CAST(lead(win, {j}) OVER w > lead(win, {j - 1}) OVER w AND lead(before, {j}) OVER w - before <= {CHAT_HISTORY} AND lead(before, {j}) OVER w - before + kept + lead(spanned, {j}) OVER w <= {CHAT_BUDGET} AS INT), 0)" for j in range(1, chat.HISTORY_TURNS + 1))} AS again
      FROM f WINDOW w AS (PARTITION BY conv_id, row_key ORDER BY place))
SELECT conv_id, max(n_turns) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256,
       CAST(sum(chars * (1 + CASE WHEN place = 1 AND role = 'system' THEN n_windows - win ELSE again END)) AS BIGINT) AS formatted_chars
FROM a GROUP BY conv_id, row_key
"""


def queries() -> dict:
    return {
        "op1_media_columns": op1_media_columns,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_html_extraction": op3_html_extraction,
        "op4_simhash": op4_simhash,
        "op5_mixing": op5_mixing,
        "op6_chat": op6_chat,
        "op7_license_scan": op7_license_scan,
        "op8_bpe": op8_bpe,
        "op9_quality": op9_quality,
        "op10_toxicity": op10_toxicity,
        "op11_source_divergence": op11_source_divergence,
        "op12_decontamination": op12_decontamination,
        "op13_conversation_trie": op13_conversation_trie,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_mixing": OP5_SQL, "op6_chat": OP6_SQL, "op11_source_divergence": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_conversation_trie": OP13_SQL}
