"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tickerwire.llm import chat
from tickerwire.llm.queries import URL_RULES

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_FITS = "(host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)"

OP1 = f"""
WITH r(rhost, rpath, rverdict) AS (VALUES {_RULES}),
q AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM q),
f AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r WHERE {_FITS}) AS rule,
       coalesce((SELECT arg_max(rverdict, length(rhost || rpath)) FROM r WHERE {_FITS}), 'allow') AS verdict
FROM f"""

_ESCAPED = "regexp_replace({}, '" + chat.ESCAPE + r"', '\1\\\2\3', 'g')"
_ORDER = "ORDER BY turn NULLS FIRST, role, text"

OP2 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
             SELECT conv_id, turn, role, text FROM conversations
             UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('{chat.START}') + length({_ESCAPED.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")}) + 1
                + length({_ESCAPED.format('text')}) + length('{chat.END}') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


# base32 of a hexadecimal SHA-1: five digits give four letters
_GROUP = "CAST('0x' || substr(hex, {}, 5) AS BIGINT)"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_GROUP.format(5 * g + 1)} >> {shift}) & 31 AS BIGINT) + 1, 1)"
                      for g in range(8) for shift in (15, 10, 5, 0))

OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload),
h AS (SELECT page_id, payload, first, sha1(payload) AS hex FROM p JOIN f USING (payload))
SELECT page_id, strlen(payload) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM h"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM d JOIN g USING (text)"""

# h1 to h4 of the contract: hexadecimal groups of eight digits
_H = "CAST('0x' || substr(hash, {}, 8) AS BIGINT)"
_PART = "array_to_string(list_slice(units, {}, {}), '')"

OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS hash,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, {_H.format(1)} AS h1, {_H.format(9)} AS h2, {_H.format(17)} AS h3, {_H.format(25)} AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, {_PART.format('1', 'a')} AS prefix, {_PART.format('a + 1', 'b')} AS middle, {_PART.format('b + 1', 'n')} AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1, "op2_chat_format": OP2, "op5_warc": OP5, "op11_exact_dedup": OP11, "op13_fill_in_middle": OP13}
