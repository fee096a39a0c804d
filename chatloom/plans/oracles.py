"""SQL that DuckDB runs on the same tables; each entry must equal the query of its name."""

from ..functions.fixed_values import (
    PUNCTUATION, STOP_WORDS, WEB_TOKEN, WHITESPACE, emoji_character_pattern, emoji_pattern,
)
from . import fitted_sql
from .registry import _EMOJI_TEXT


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


CHAT = """(SELECT l_suppkey AS author, l_partkey AS channel, l_shipdate AS ts,
  CASE WHEN l_quantity % 10 <> 0 THEN cast(l_quantity AS int) END AS bodylength,
  l_linestatus = 'F' AS member FROM lineitem)"""
SUPERCHAT = """(SELECT l_suppkey AS author, l_shipdate AS ts, l_discount * 100 AS significance
  FROM lineitem WHERE l_returnflag = 'R')"""
ORDERED_SUPERCHAT = """(SELECT l_suppkey AS author, o_orderdate AS ts, l_discount * 100 AS significance
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"""
CHANNELS = """(SELECT s_suppkey AS "channelId", s_name AS name, s_name AS "englishName",
  n_name AS affiliation, cast(floor(s_acctbal) AS int) AS "subscriptionCount",
  cast(0 AS int) AS "videoCount" FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
CHANNEL_CHAT = """(SELECT l_suppkey AS "channelId", strftime(l_shipdate, '%Y-%m') AS period,
  count(*) AS chats, count(*) FILTER (l_linestatus = 'F') AS "memberChats",
  count(DISTINCT l_partkey) AS "uniqueChatters",
  count(DISTINCT l_partkey) FILTER (l_linestatus = 'F') AS "uniqueMembers",
  count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS "bannedChatters",
  count(*) FILTER (l_returnflag = 'A') AS "deletedChats"
  FROM lineitem GROUP BY 1, 2)"""
CHANNEL_SUPERCHAT = """(SELECT l_suppkey AS "channelId", strftime(l_shipdate, '%Y-%m') AS period,
  count(*) AS "superChats", count(DISTINCT l_partkey) AS "uniqueSuperChatters",
  cast(sum(round(l_discount * 100)) AS bigint) AS "totalSC",
  cast(floor(sum(round(l_discount * 100)) / count(*)) AS bigint) AS "averageSC",
  cast(sum(l_quantity) AS bigint) AS "totalMessageLength",
  cast(cast(floor(sum(l_quantity) / count(*)) AS bigint) AS varchar) AS "averageMessageLength",
  max(l_linestatus) AS "mostFrequentCurrency",
  cast(max(l_linenumber) AS varchar) AS "mostFrequentColor"
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"""


def _author_stats(chat=CHAT, count="ts", extra=""):
    return f"""SELECT author, strftime(ts, '%Y-%m') AS period, count({count}) AS chats,
  count(DISTINCT cast(ts AS date)) AS "videoDays", count(DISTINCT channel) AS "uniqueChatters",
  cast(sum(bodylength) AS bigint) AS "totalBodyLength"{extra} FROM {chat} GROUP BY 1, 2"""


def _superchat_stats(superchat):
    return f"""SELECT author, strftime(ts, '%Y-%m') AS period, count(ts) AS superchats,
  round(avg(significance), 6) AS "avgSignificance" FROM {superchat} GROUP BY 1, 2"""


SUPERCHAT_STATS = _superchat_stats(SUPERCHAT)
COMBINED = f"""SELECT author, period, chats, "videoDays", "uniqueChatters", "totalBodyLength",
  superchats, "avgSignificance"
  FROM ({_author_stats()}) JOIN ({SUPERCHAT_STATS}) USING (author, period)"""
MEMBERS = f"""SELECT author, strftime(ts, '%Y-%m') AS period,
  count(DISTINCT channel) AS "uniqueMembers" FROM {CHAT} WHERE member GROUP BY 1, 2"""


def _member_stats(members):
    return f"""SELECT t.*, {members} AS "uniqueMembers"
  FROM ({_author_stats(count="bodylength")}) t
  LEFT JOIN ({MEMBERS}) m ON t.author = m.author AND t.period = m.period"""


def _series(stats, measures):
    lists = ", ".join(
        f"""array_to_string(list(coalesce(cast({c} AS varchar), 'null') ORDER BY period), ',') AS {c}"""
        for c in ["period", *(f'"{m}"' for m in measures)]
    )
    return f"""SELECT c."channelId", any_value(name) AS name, any_value("englishName") AS "englishName",
  any_value(affiliation) AS affiliation, any_value("subscriptionCount") AS "subscriptionCount",
  any_value("videoCount") AS "videoCount", {lists}
  FROM {CHANNELS} c JOIN {stats} s ON c."channelId" = s."channelId" GROUP BY 1"""


CHAT_LISTS = ["chats", "memberChats", "uniqueChatters", "uniqueMembers", "bannedChatters", "deletedChats"]
SUPERCHAT_LISTS = [
    "superChats", "uniqueSuperChatters", "totalSC", "averageSC", "totalMessageLength",
    "averageMessageLength", "mostFrequentCurrency", "mostFrequentColor",
]

FLAGGED = """(SELECT doc_id, text AS body, CASE WHEN toxic = 0 THEN 'nonflagged' ELSE 'flagged' END
  AS label FROM documents JOIN labels USING (doc_id))"""
TOKENS = r"string_split_regex(regexp_replace(lower({}), '\s+\z', ''), '\s')"
HEX = "cast('0x' || substr({}, 1, {}) AS bigint)"
IDS = "(SELECT doc_id, toxic AS label FROM labels)"
MONTHS = """(SELECT period, CASE WHEN row_number() OVER (ORDER BY md5(period || '|42'), period) * 16
  <= count(*) OVER () * 5 THEN 'test' ELSE 'train' END AS split
  FROM (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS period FROM lineitem {}))"""


def _strip(column):
    return f"trim({column}, {_text(WHITESPACE)})"


def _without_emoji(column):
    return f"regexp_replace({column}, {_text(emoji_pattern())}, '', 'g')"


def _hash_split(hex_limit, seed):
    return f"""SELECT doc_id, lang, CASE WHEN substr(md5(doc_id || '|{seed}'), 1, 8) < '{hex_limit}'
  THEN 'test' ELSE 'train' END AS split FROM documents"""


def _order(columns):
    """The hash by which samples are ordered, of rows that all differ."""
    parts = " || ".join(f"coalesce(md5(cast({c} AS varchar)), '-')" for c in columns.split())
    return f"md5(md5({parts}) || '|1|42')"


def _down(n):
    return f"""SELECT doc_id, label FROM {IDS} WHERE label = 0
  QUALIFY row_number() OVER (ORDER BY {_order("doc_id label")}) <= {n}"""


def _up(n):
    return f"""SELECT doc_id, label FROM
  (SELECT {HEX.format("md5(i || '|draw|42')", 15)} % (SELECT count(*) FROM labels WHERE toxic = 1) AS x
   FROM range({n}) r(i))
  JOIN (SELECT *, row_number() OVER (ORDER BY {_order("doc_id label")}) - 1 AS x
        FROM {IDS} WHERE label = 1) USING (x)"""


def _vectors(tokens_of, size=64):
    """Mean of +1/-1 by the leading bits of each token's md5, for (doc_id, part, token) rows; mean over parts."""
    bits = "cast('0x' || substr(md5(token), 1 + 8 * (i // 32), 8) AS bigint) >> (31 - i % 32) & 1"
    return f"""WITH t AS ({tokens_of}), p AS (
    SELECT doc_id, part, i, coalesce(avg(CASE WHEN token IS NOT NULL THEN 2 * ({bits}) - 1 END), 0) AS v
    FROM t, range({size}) r(i) GROUP BY 1, 2, 3)
  SELECT doc_id, cast(i AS int) AS i, round(coalesce(avg(v), 0) + 1e-9, 6) AS value
  FROM (SELECT doc_id, i FROM documents, range({size}) r(i)) LEFT JOIN p USING (doc_id, i) GROUP BY 1, 2"""


def _words(expression, key, table):
    return f"SELECT {key}, coalesce(array_to_string({expression}, ' '), '') AS words FROM {table}"


def _no_web(tokens):
    return f"list_filter({tokens}, lambda w: w <> '' AND NOT regexp_matches(w, {_text(WEB_TOKEN)}))"


def _letters(tokens):
    return f"""list_filter(list_transform({tokens}, lambda w: lower(regexp_replace(w, '[^a-zA-Z]+', '', 'g'))),
  lambda w: w <> '')"""


def _no_stops(tokens):
    words = ", ".join(_text(w) for w in STOP_WORDS)
    return f"list_filter({tokens}, lambda w: NOT list_contains([{words}], w))"


DOCUMENT_FREQUENCY = f"""SELECT token, count(*) AS df FROM
  (SELECT unnest(list_distinct({TOKENS.format('text')})) AS token FROM documents)
  WHERE token <> '' GROUP BY 1"""

QUALITY_RULE = "(SELECT toxic AS label, cast(quality = 0 AS int) AS prediction FROM labels)"
TARGETS = """(SELECT author, period, log10(superchats) AS label, split FROM
  (SELECT l_suppkey AS author, strftime(l_shipdate, '%Y-%m') AS period, count(*) AS superchats
   FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) JOIN """ + MONTHS.format(
    "WHERE l_returnflag = 'R'") + " USING (period))"

_HELD_OUT = MONTHS.format("WHERE l_returnflag = 'R'")
REGRESSION_ROWS = fitted_sql.rows(COMBINED, _HELD_OUT, "log10(superchats)")
COUNT_ROWS = fitted_sql.rows(COMBINED, _HELD_OUT, "cast(superchats AS double)")

GAMMA_MEAN = "CASE WHEN eta > 0 THEN 1 / eta ELSE 1e-16 END"  # means of the family are positive

SENTENCES = r"""regexp_replace(regexp_replace(text, '([.!?]+)\s+', E'\\1\n', 'g'),
  '([\x{3002}\x{FF01}\x{FF1F}]+)', E'\\1\n', 'g')"""

ORACLES = {
    "author_stats": _author_stats(),
    "author_stats_body": _author_stats(count="bodylength"),
    "author_stats_sql": _author_stats(),
    "member_filter_sql": f"""SELECT author, count(*) AS "memberChats",
  count(DISTINCT channel) AS "uniqueMembers" FROM {CHAT} WHERE member GROUP BY 1""",
    "superchat_stats": SUPERCHAT_STATS,
    "combined_stats": COMBINED,
    "combined_stats_right": f"""SELECT s.author, s.period, c.chats, c."videoDays", c."uniqueChatters",
  c."totalBodyLength", s.superchats, s."avgSignificance"
  FROM ({_author_stats()}) c
  RIGHT JOIN ({_superchat_stats(ORDERED_SUPERCHAT)}) s ON c.author = s.author AND c.period = s.period""",
    "member_stats": _member_stats('m."uniqueMembers"'),
    "member_stats_filled": _member_stats('coalesce(m."uniqueMembers", 0)'),
    "channel_stats": f'SELECT * FROM {CHANNELS} JOIN {CHANNEL_CHAT} USING ("channelId")',
    "channel_stats_superchat": f'SELECT * FROM {CHANNELS} JOIN {CHANNEL_SUPERCHAT} USING ("channelId")',
    "channel_series_chat": _series(CHANNEL_CHAT, CHAT_LISTS),
    "channel_series_superchat": _series(CHANNEL_SUPERCHAT, SUPERCHAT_LISTS),
    "cast_map": """SELECT event_id, try_cast(regexp_extract(cast(cast(value AS decimal(12,2)) AS varchar),
  '^([+-]?\\d+)', 1) AS bigint) AS whole, try_cast(cast(value AS decimal(12,2)) AS double) AS number,
  try_cast(event_type AS bigint) AS unreadable, event_type FROM events""".replace("\\\\", "\\"),
    "log_target": f"""SELECT author, period, superchats,
  CASE WHEN superchats > 0 THEN round(log2(superchats), 6) END AS log2_superchats,
  CASE WHEN superchats > 0 THEN round(log10(superchats), 6) END AS log10_superchats
  FROM ({SUPERCHAT_STATS})""",
    "label_from_source": f"""SELECT doc_id, body,
  cast(CASE WHEN contains(label, 'nonflagged') THEN 0 ELSE 1 END AS int) AS label FROM {FLAGGED}""",
    "union_all": "SELECT text AS body FROM conversations UNION ALL SELECT text FROM documents",
    "dedup_messages": "SELECT DISTINCT text, lang FROM documents",
    "class_counts": f"SELECT label, count(*) AS count FROM {FLAGGED} GROUP BY 1",
    "clean_messages": f"""SELECT translate(body, {_text(PUNCTUATION)}, '') AS body, label, count(*) AS n FROM
  (SELECT {_strip(_without_emoji("' ' || word || CASE WHEN length(word) % 8 = 0 THEN '" + chr(0x1F600) + " ' ELSE ' ' END"))} AS body, label FROM
   (SELECT unnest(string_split_regex(text, '\\s+')) AS word, toxic AS label
    FROM documents JOIN labels USING (doc_id)))
  WHERE regexp_full_match(body, '\\p{{L}}+') GROUP BY 1, 2""",
    "clean_messages_loose": f"""SELECT * FROM (SELECT doc_id,
  translate({_strip(_without_emoji("body"))}, {_text(PUNCTUATION)}, '') AS body,
  cast(CASE WHEN label = 'nonflagged' THEN 0 ELSE 1 END AS int) AS label FROM {FLAGGED})
  WHERE body <> ''""",
    "alpha_tokens": """SELECT token, count(*) AS n FROM
  (SELECT unnest(string_split_regex(text, '\\s+')) AS token FROM documents)
  WHERE regexp_full_match(token, '\\p{L}+') GROUP BY 1""",
    "strip_emoji": f"SELECT doc_id, {_without_emoji('text || ' + _text(_EMOJI_TEXT))} AS text FROM documents",
    "drop_emoji_tokens": f"""SELECT doc_id, array_to_string(list_filter(
  string_split_regex(text || {_text(_EMOJI_TEXT)}, {_text("[" + WHITESPACE + "]+")}),
  lambda w: w <> '' AND NOT regexp_matches(w, {_text(emoji_character_pattern())})), ' ') AS text FROM documents""",
    "remove_punctuation": f"SELECT doc_id, translate(text, {_text(PUNCTUATION)}, '') AS text FROM documents",
    "split_sentences": f"""SELECT doc_id, cast(i - 1 AS int) AS position, list_extract(s, i) AS sentence FROM
  (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM
   (SELECT doc_id, list_filter(list_transform(string_split_regex({SENTENCES}, '[\\r\\n]+'),
      lambda x: {_strip("x")}), lambda x: x <> '') AS s FROM documents))""",
    "token_document_frequency": DOCUMENT_FREQUENCY,
    "term_idf": f"""SELECT token, df, CASE WHEN df >= 2 THEN
  round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) ELSE 0.0 END AS idf
  FROM ({DOCUMENT_FREQUENCY})""",
    "web_token_filter": _words(_no_web(TOKENS.format("html")), "page_id", "pages"),
    "normalize_tokens": _words(_letters(TOKENS.format("html")), "page_id", "pages"),
    "remove_stopwords": _words(_no_stops(TOKENS.format("text")), "doc_id", "documents"),
    "content_words": _words(_no_stops(_letters(_no_web(TOKENS.format("text")))), "doc_id", "documents"),
    "period_split": f"""SELECT period, split, count(*) AS n, cast(sum(chats) AS bigint) AS chats
  FROM ({_author_stats()}) JOIN {MONTHS.format("")} USING (period) GROUP BY 1, 2""",
    "assembled_features": f"""SELECT author, period, split, round(log10(superchats), 6) AS log10_superchats,
  cast(chats AS double) AS f_chats, cast("videoDays" AS double) AS "f_videoDays",
  cast("uniqueChatters" AS double) AS "f_uniqueChatters",
  cast(coalesce("totalBodyLength", 0) AS double) AS "f_totalBodyLength"
  FROM ({COMBINED}) JOIN {MONTHS.format("WHERE l_returnflag = 'R'")} USING (period)""",
    "hash_split": _hash_split("4ccccccc", 1234),
    "hash_split_80_20": _hash_split("33333333", 42),
    "sample_n": f"""SELECT * FROM documents
  QUALIFY row_number() OVER (ORDER BY {_order("doc_id text lang source n_chars")}) <= 200""",
    "downsample_majority": _down(100),
    "upsample_minority": _up(500),
    "balance_classes": f"({_down(300)}) UNION ALL ({_up(300)})",
    "mean_baseline": f"""WITH y AS (SELECT *, (SELECT avg(label) FROM {TARGETS} WHERE split = 'train') AS p
  FROM {TARGETS})
  SELECT split, count(*) AS n, round(avg((label - p) * (label - p)), 6) AS mse,
  round(sqrt(avg((label - p) * (label - p))), 6) AS rmse, round(avg(abs(label - p)), 6) AS mae
  FROM y GROUP BY 1""",
    "regression_metrics": f"""SELECT count(*) AS n, round(avg((y - p) * (y - p)), 6) AS mse,
  round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
  round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2
  FROM (SELECT log10(superchats) AS y, log10(chats / 3) AS p FROM ({COMBINED}))""",
    "classification_accuracy": f"""SELECT count(*) AS n,
  round(avg(cast(label = prediction AS double)), 6) AS accuracy FROM {QUALITY_RULE}""",
    "classification_report": f"""WITH c AS (SELECT class,
    count(*) FILTER (label = class AND prediction = class) AS hits,
    count(*) FILTER (prediction = class) AS chosen, count(*) FILTER (label = class) AS support
    FROM {QUALITY_RULE}, (VALUES (0), (1)) v(class) GROUP BY 1),
  r AS (SELECT cast(class AS varchar) AS class, coalesce(hits / nullif(chosen, 0), 0) AS p,
    coalesce(hits / nullif(support, 0), 0) AS r, coalesce(2 * hits / nullif(chosen + support, 0), 0) AS f,
    support, hits FROM c WHERE chosen + support > 0)
  SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM r
  UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
    round(sum(hits) / sum(support), 6), cast(sum(support) AS bigint) FROM r
  UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
    cast(sum(support) AS bigint) FROM r
  UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
    round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
    cast(sum(support) AS bigint) FROM r""",
    "binary_auc": """WITH s AS (SELECT toxic, n_chars AS x FROM documents JOIN labels USING (doc_id)),
  r AS (SELECT toxic, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS place FROM s)
  SELECT count(*) AS n, round((sum(place) FILTER (toxic = 1)
    - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1) / 2)
    / (count(*) FILTER (toxic = 1) * count(*) FILTER (toxic = 0)), 6) AS area_under_roc FROM r""",
    "mean_pool_vectors": """SELECT label, cast(i - 1 AS int) AS i, round(avg(cast(v AS double)), 6) AS mean
  FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY 1, 2""",
    "source_select": "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1",
    "csv_headerless": f"""SELECT * REPLACE (cast(author AS varchar) AS author) FROM ({_author_stats()})""",
    "csv_header_cast": f"""SELECT * REPLACE (cast("channelId" AS varchar) AS "channelId") FROM {CHANNEL_CHAT}""",
    "csv_reviews": """SELECT cast(quality + 1 AS int) AS polarity, source AS title, text
  FROM documents JOIN labels USING (doc_id)""",
    "channel_series_positions": f"""SELECT "channelId", cast(row_number() OVER (PARTITION BY "channelId" ORDER BY period) - 1 AS int)
  AS position, period, chats, "memberChats", "uniqueChatters", "uniqueMembers", "bannedChatters", "deletedChats"
  FROM {CHANNEL_CHAT} SEMI JOIN {CHANNELS} USING ("channelId")""",
    "header_csv_typed": f"""SELECT cast("channelId" AS varchar) AS "channelId", period, chats, "memberChats",
  "uniqueChatters", "uniqueMembers", "bannedChatters", "deletedChats" FROM {CHANNEL_CHAT}""",
    "messages_csv": f"SELECT body, label FROM {FLAGGED}",
    "labelled_files": f"""SELECT doc_id, body,
  cast(CASE WHEN label = 'nonflagged' THEN 0 ELSE 1 END AS int) AS label FROM {FLAGGED}""",
    "combined_positional": f"""SELECT period, chats, "videoDays", "uniqueChatters", "totalBodyLength",
  cast(author AS varchar) AS author, cast(superchats AS double) AS superchats, "avgSignificance" FROM ({COMBINED})""",
    "numbered_files": f"""WITH c AS (SELECT author, year(ts) AS y, count(ts) AS chats,
    count(DISTINCT cast(ts AS date)) AS days, count(DISTINCT channel) AS channels,
    cast(sum(bodylength) AS bigint) AS body FROM {CHAT} GROUP BY 1, 2),
  s AS (SELECT author, year(ts) AS y, count(ts) AS superchats, round(avg(significance), 6) AS sig
    FROM {SUPERCHAT} GROUP BY 1, 2)
  SELECT cast(author AS varchar) AS author, cast(y AS varchar) AS period, chats, days AS "videoDays",
  channels AS "uniqueChatters", body AS "totalBodyLength", superchats, sig AS "avgSignificance"
  FROM c JOIN s USING (author, y)""",
    "split_files": _hash_split("4ccccccc", 1234),
    "predictions_json": QUALITY_RULE[1:-1],
    "score_documents": f"""WITH y AS (SELECT label, split, (SELECT avg(label) FROM {TARGETS} WHERE split = 'train') AS p
    FROM {TARGETS}), e AS (SELECT split, label - p AS e FROM y)
  SELECT 'baseline' AS model, 'log10_superchats' AS label_col,
  round(avg(e * e) FILTER (split = 'train'), 6) AS "Train MSE",
  round(sqrt(avg(e * e) FILTER (split = 'train')), 6) AS "Train RMSE",
  round(avg(abs(e)) FILTER (split = 'train'), 6) AS "Train MAE",
  round(avg(e * e) FILTER (split = 'test'), 6) AS "Test MSE",
  round(sqrt(avg(e * e) FILTER (split = 'test')), 6) AS "Test RMSE",
  round(avg(abs(e)) FILTER (split = 'test'), 6) AS "Test MAE" FROM e""",
    "first_annotation": f"SELECT doc_id, list_extract({TOKENS.format('text')}, 1) AS first FROM documents",
    "term_tfidf": f"""WITH t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents),
  d AS ({DOCUMENT_FREQUENCY}), i AS (SELECT token, CASE WHEN df >= 2 THEN
    ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) ELSE 0.0 END AS idf FROM d)
  SELECT doc_id, token, count(*) AS tf, round(count(*) * any_value(idf), 6) AS tfidf
  FROM t JOIN i USING (token) GROUP BY 1, 2""",
    "doc_vectors": _vectors(f"""SELECT doc_id, 0 AS part,
    unnest({_no_stops(_letters(_no_web(TOKENS.format('text'))))}) AS token FROM documents"""),
    "sentence_vectors": _vectors(f"""SELECT doc_id, part, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS token FROM
    (SELECT doc_id, part, {_no_stops(_letters(_no_web(TOKENS.format('sentence'))))} AS w FROM
    (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS part FROM
    (SELECT doc_id, list_filter(list_transform(string_split_regex({SENTENCES}, '[\\r\\n]+'),
      lambda x: {_strip("x")}), lambda x: x <> '') AS s FROM documents)))"""),
    "token_associations": f"""WITH t AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM
    (SELECT doc_id, {_no_stops(_letters(_no_web(TOKENS.format('text'))))} AS w FROM documents)),
  met AS ({" UNION ALL ".join(
    f"SELECT token AS x, lead(token, {step}) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM t" for step in range(1, 6))}),
  pairs AS (SELECT a, b, count(*) AS n FROM
    (SELECT x AS a, y AS b FROM met WHERE y IS NOT NULL UNION ALL SELECT y, x FROM met WHERE y IS NOT NULL) GROUP BY 1, 2),
  totals AS (SELECT a, sum(n) AS s FROM pairs GROUP BY 1),
  strong AS (SELECT pairs.a, n, ln(cast(n AS double) * (SELECT sum(s) FROM totals) / (cast(x.s AS double) * y.s)) AS ppmi
    FROM pairs JOIN totals x ON x.a = pairs.a JOIN totals y ON y.a = pairs.b WHERE x.s >= 20 AND y.s >= 20)
  SELECT a AS token, count(*) AS partners, cast(sum(n) AS bigint) AS meetings, round(sum(ppmi), 4) AS strength
  FROM strong WHERE ppmi > 0 GROUP BY 1""",
    "model_reload": "SELECT count(*) AS n, count(*) AS equal FROM documents JOIN labels USING (doc_id)",
    "pipeline_reload": "SELECT count(*) AS n, count(*) AS equal FROM documents JOIN labels USING (doc_id)",
    "saved_regressors": f"""SELECT model, n, n AS equal FROM (SELECT count(*) AS n FROM ({COMBINED})),
  (VALUES ('linear regression'), ('glm gaussian'), ('dtr')) v(model)""",
    "json_documents": _series(CHANNEL_CHAT, CHAT_LISTS),
    "materialized_stats": COMBINED,
    "incremental_periods": f"""SELECT *, substr(period, 1, 4) AS source_period,
  cast(substr(period, 1, 4) IN ('1995', '1998') AS int) AS rebuilt FROM ({_author_stats()})""",
    "merged_channel_sketches": f"""SELECT author, strftime(ts, '%Y') AS year, count(ts) AS chats,
  count(DISTINCT cast(ts AS date)) AS "videoDays", cast(sum(bodylength) AS bigint) AS "totalBodyLength",
  count(DISTINCT channel) AS channels, cast(1 AS int) AS within, cast(1 AS int) AS exact FROM {CHAT} GROUP BY 1, 2""",
    "model_coefficients": fitted_sql.terms(fitted_sql.standardised_ridge(REGRESSION_ROWS)),
    "model_linear": fitted_sql.scores(
        REGRESSION_ROWS, fitted_sql.elastic_net(REGRESSION_ROWS), "linear regression", "log10_superchats"),
    **{f"model_glm_{name}": fitted_sql.scores(
        REGRESSION_ROWS, fitted_sql.standardised_ridge(REGRESSION_ROWS), f"glm {name}", "log10_superchats")
        for name in ("gaussian", "tweedie")},
    "model_glm_poisson": fitted_sql.scores(
        REGRESSION_ROWS, fitted_sql.reweighted(REGRESSION_ROWS, "ln(greatest(y, 0.1))", "exp(eta)", "1 / mu", "mu"),
        "glm poisson", "log10_superchats", "exp(eta)"),
    "model_glm_gamma": fitted_sql.scores(
        COUNT_ROWS, fitted_sql.reweighted(COUNT_ROWS, "1 / y", GAMMA_MEAN, "-1 / (mu * mu)", "mu * mu"),
        "glm gamma", "superchats", GAMMA_MEAN),
    "tree_expressions": f"""SELECT model, n, n AS equal, cast(1 AS int) AS varied
  FROM (SELECT count(*) AS n FROM ({COMBINED})), (VALUES ('dtr'), ('rfr')) AS m(model)""",
    "inferred_header_csv": """SELECT t.column, t.type, count(*) AS present, cast(sum(l_orderkey) AS bigint) AS keys,
  count(DISTINCT cast(l_shipdate AS date)) AS days FROM lineitem,
  (VALUES ('l_orderkey', 'bigint'), ('l_quantity', 'double'), ('l_shipdate', 'date'), ('l_returnflag', 'string')) AS t("column", type)
  GROUP BY 1, 2""",
    "quarantined_csv": f"""SELECT period, count(*) FILTER (chats % 10 <> 0) AS n,
  cast(sum(chats) FILTER (chats % 10 <> 0) AS bigint) AS chats, count(*) FILTER (chats % 10 = 0) AS bad
  FROM {CHANNEL_CHAT} GROUP BY 1""",
}
