"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from strandweave.llm.chat_quotes import ATTRIBUTION, PART_TURNS, QUOTE
from strandweave.llm.decontamination import EVERY_MASK, MARKS, PASSAGE, SIMILARITY_PERCENT
from strandweave.llm.suffix_dedup import WINDOW

#: Windows as hex text, cut from blocks; removed bytes as islands of covered windows.
SUFFIX_DEDUP = f"""WITH h AS (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents WHERE doc_id IS NOT NULL),
blocks AS (SELECT rid, doc_id, base, least(512, n - {WINDOW - 1} - base) AS size, substr(x, 2 * base + 1, {2 * (512 + WINDOW - 1)}) AS x FROM (SELECT *, unnest(range(0, n - {WINDOW - 1}, 512)) AS base FROM h)),
starts AS (SELECT rid, doc_id, x, base, unnest(range(0, size)) AS j FROM blocks),
win AS (SELECT rid, doc_id, base + j AS i, substr(x, 2 * j + 1, {2 * WINDOW}) AS w FROM starts),
first AS (SELECT w, min(doc_id) AS least FROM win GROUP BY w HAVING min(doc_id) < max(doc_id)),
covered AS (SELECT rid, i FROM win JOIN first USING (w) WHERE least < doc_id),
marked AS (SELECT rid, i, CAST(coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + {WINDOW}, true) AS INTEGER) AS fresh FROM covered),
runs AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM marked),
spans AS (SELECT rid, run, min(i) AS a, max(i) + {WINDOW} AS b FROM runs GROUP BY rid, run),
edges AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans),
parts AS (SELECT e.rid, e.a AS pos, substr(h.x, 2 * before + 1, 2 * (e.a - before)) AS p FROM edges e JOIN h USING (rid) UNION ALL SELECT h.rid, h.n, substr(h.x, 2 * coalesce(s.b, 0) + 1) FROM h LEFT JOIN (SELECT rid, max(b) AS b FROM spans GROUP BY rid) s USING (rid)),
kept AS (SELECT rid, string_agg(p, '' ORDER BY pos) AS x FROM parts GROUP BY rid),
gone AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM h JOIN kept USING (rid) LEFT JOIN gone USING (rid)"""


def _seeds(table: str, key: str, item: bool) -> str:
    parts = []
    for n, (mask, length) in enumerate(EVERY_MASK):
        k = " || ' ' || ".join(f"h[i + {1 + j}]" for j, c in enumerate(mask) if c == "1")
        own = f" WHERE len(h) = {length}" if length and item else ""
        parts.append(f"SELECT {key}, i, '{n} ' || {k} AS k FROM (SELECT {key}, h, unnest(range(0, len(h) - {len(mask) - 1})) AS i FROM {table}{own})")
    return " UNION ALL ".join(parts)


_TOKENS = "[x for x in string_split(translate(lower(coalesce(text, '')), chr(10) || chr(9) || chr(13) || chr(11) || chr(12) || '" + MARKS.replace("'", "''") + "', '     '), ' ') if x <> '']"
#: Seeds meet as text; the best passage is a running sum less its lowest value so far.
DECONTAMINATION = f"""WITH items AS (SELECT DISTINCT item_id, {_TOKENS} AS h FROM benchmark WHERE item_id IS NOT NULL),
texts AS (SELECT doc_id, {_TOKENS} AS h FROM documents WHERE doc_id IS NOT NULL),
item_rows AS (SELECT row_number() OVER () AS irid, * FROM items), text_rows AS (SELECT row_number() OVER () AS trid, * FROM texts),
item_seeds AS ({_seeds("item_rows", "irid", True)}), text_seeds AS ({_seeds("text_rows", "trid", False)}),
hits AS (SELECT DISTINCT trid, irid, t.i - s.i AS shift FROM (SELECT * FROM text_seeds WHERE k IN (SELECT k FROM item_seeds)) t JOIN item_seeds s USING (k)),
pairs AS (SELECT trid, irid, doc_id, item_id, shift, len(a.h) AS n_tokens, a.h AS ih, b.h AS th, unnest(range(0, len(a.h))) AS j FROM hits JOIN item_rows a USING (irid) JOIN text_rows b USING (trid)),
same AS (SELECT trid, irid, doc_id, item_id, shift, n_tokens, j, CASE WHEN j + shift >= 0 AND th[j + shift + 1] = ih[j + 1] THEN 1 ELSE 0 END AS eq FROM pairs),
sums AS (SELECT *, sum(CASE WHEN eq = 1 THEN 1 ELSE -4 END) OVER (PARTITION BY trid, irid, shift ORDER BY j) AS s FROM same),
lows AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY trid, irid, shift ORDER BY j)) AS run FROM sums),
compared AS (SELECT trid, irid, doc_id, item_id, shift, n_tokens, sum(eq) AS n_equal, max(run) AS passage FROM lows GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_equal AS BIGINT) AS n_equal, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(passage AS BIGINT) AS passage, CAST(greatest(shift, 0) AS BIGINT) AS position FROM compared
WHERE 100 * n_equal >= {SIMILARITY_PERCENT} * n_tokens OR passage >= {PASSAGE} QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, passage DESC, greatest(shift, 0), n_tokens DESC) = 1"""

_MARKS = QUOTE.replace("'", "''")


def _pieces(keys: str, text: str, table: str) -> str:
    """The whole, lines, paragraphs and sentences of paragraphs of a text column, normalised; with the keys."""
    plain = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))".format
    sentences = f"string_split(regexp_replace({plain('q')}, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))"
    paragraphs = f"(SELECT {keys}, unnest(regexp_split_to_array({text}, '\\n[ \\t]*\\n')) AS q FROM {table})"
    parts = [f"SELECT {keys}, {plain(text)} AS k FROM {table}", f"SELECT {keys}, {plain('q')} FROM (SELECT {keys}, unnest(string_split({text}, chr(10))) AS q FROM {table})", f"SELECT {keys}, {plain('q')} FROM {paragraphs}", f"SELECT {keys}, unnest({sentences}) FROM {paragraphs}"]
    return f"SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}) WHERE k <> ''"


def chat_quotes(conversations: str) -> str:
    """Quote levels by pattern, passages as islands of lines, threads by recursion; over a table or subquery."""
    return f"""WITH RECURSIVE src AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM {conversations} WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
split AS (SELECT rid, conv_id, turn, unnest(range(len(p))) AS n, unnest(p) AS raw FROM (SELECT *, string_split(text, chr(10)) AS p FROM src)),
marked AS (SELECT *, regexp_replace(raw, '\r+$', '') AS bare FROM split),
lines AS (SELECT *, regexp_extract(bare, '{_MARKS}', 1) AS marks, regexp_extract(bare, '{_MARKS}', 2) AS body FROM marked),
counted AS (SELECT *, length(marks) - length(replace(marks, '>', '')) AS level FROM lines),
leveled AS (SELECT *, level = 0 AND regexp_matches(bare, '{ATTRIBUTION}') AND coalesce(lead(CASE WHEN level > 0 OR trim(raw, ' ' || chr(9) || chr(13)) <> '' THEN level END IGNORE NULLS) OVER (PARTITION BY rid ORDER BY n), 0) > 0 AS told FROM counted),
own AS (SELECT s.rid, s.conv_id, s.turn, s.role, trim(regexp_replace(coalesce(o.t, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS own
  FROM src s LEFT JOIN (SELECT rid, string_agg(raw, chr(10) ORDER BY n) AS t FROM leveled WHERE level = 0 AND NOT told GROUP BY rid) o USING (rid)),
edges AS (SELECT *, CAST(level <> coalesce(lag(level) OVER (PARTITION BY rid ORDER BY n), 0) AS INTEGER) AS fresh FROM leveled),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY n) AS run FROM edges),
passages AS (SELECT rid, conv_id, turn, level, run, string_agg(body, chr(10) ORDER BY n) AS t FROM numbered WHERE level > 0 GROUP BY ALL),
quotes AS (SELECT rid, count(*) AS n_quotes, max(level) AS max_level FROM passages GROUP BY rid),
quoted AS ({_pieces("conv_id, turn, level", "t", "passages")}),
mine AS ({_pieces("conv_id, turn", "own", "own")}),
firsts AS (SELECT conv_id, k, min(turn) AS source FROM mine GROUP BY ALL),
votes AS (SELECT u.conv_id, u.turn, u.level, f.source, sum(length(u.k)) AS weight FROM quoted u JOIN firsts f USING (conv_id, k) WHERE f.source < u.turn GROUP BY ALL),
replies AS (SELECT conv_id, turn, source AS reply_to FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, weight DESC, source) = 1),
chain AS (SELECT conv_id, turn, reply_to AS up FROM replies UNION ALL SELECT c.conv_id, c.turn, r.reply_to FROM chain c JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.up),
threads AS (SELECT conv_id, turn, min(up) AS thread FROM chain GROUP BY ALL),
messages AS (SELECT o.conv_id, o.turn, coalesce(o.role, 'user') AS role, o.own, coalesce(t.thread, o.turn) AS thread, r.reply_to, coalesce(q.n_quotes, 0) AS n_quotes, coalesce(q.max_level, 0) AS max_level
  FROM own o LEFT JOIN replies r ON r.conv_id = o.conv_id AND r.turn = o.turn LEFT JOIN threads t ON t.conv_id = o.conv_id AND t.turn = o.turn LEFT JOIN quotes q ON q.rid = o.rid)
SELECT conv_id, thread, CAST(floor(turn / {PART_TURNS}) AS BIGINT) AS part, count(*) AS n_messages, CAST(sum(n_quotes) AS BIGINT) AS n_quotes, CAST(max(max_level) AS BIGINT) AS max_level,
  string_agg(turn || ':' || coalesce(CAST(reply_to AS VARCHAR), ''), ',' ORDER BY turn, role, own) AS replies, sha256(string_agg('<|' || role || '|>' || chr(10) || own || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, own)) AS chat_sha256
FROM messages GROUP BY conv_id, thread, part"""


CHAT_QUOTES = chat_quotes("conversations")

#: Each message quotes the one before it: wrapped anew, by its first sentence, or nested with the one before that.
MADE_QUOTES = """(SELECT conv_id, turn, role, CASE WHEN before IS NULL THEN text
  WHEN turn % 3 = 1 THEN 'On some day, ' || role || ' wrote:' || chr(10) || '> ' || replace(before, chr(10), ' ') || chr(10) || text
  WHEN turn % 3 = 2 THEN '> ' || replace(split_part(before, '.', 1), ' ', '  ') || '.' || chr(10) || chr(10) || text
  ELSE '>> ' || replace(coalesce(earlier, before), chr(10), chr(10) || '>> ') || chr(10) || '> ' || replace(before, chr(10), chr(10) || '> ') || chr(10) || text END AS text
  FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM conversations)) made"""
CHAT_QUOTES_MADE = chat_quotes(MADE_QUOTES)
