"""SQL for those operators whose results SQL can state, for DuckDB on the same tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _reachable(words: int, share: int, columns: str) -> str:
    """All pairs of documents that share a shingle, then the least document reachable over links."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+{words - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS both_ FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT l, r FROM p JOIN n x ON x.doc_id = l JOIN n y ON y.doc_id = r WHERE 100 * both_ >= {share} * (x.n + y.n - both_)),
sym AS (SELECT l, r FROM e UNION SELECT r, l FROM e),
reach AS (SELECT DISTINCT l AS doc_id, l AS other FROM sym UNION SELECT reach.doc_id, sym.r FROM reach JOIN sym ON reach.other = sym.l),
c AS (SELECT doc_id, min(other) AS least_ FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least_, w.doc_id) AS component_id{columns}
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


NEAR_DUPLICATES = _reachable(5, 85, ", w.doc_id = coalesce(c.least_, w.doc_id) AS kept")
JACCARD_JOIN = _reachable(3, 90, "")


def _spans(kind: int, pattern: str, value: int, keep: str, kind_of: str | None = None) -> str:
    """Spans of a pattern: where a match starts is the length of all that stands before it."""
    return rf"""SELECT doc_id, {kind_of or kind} AS kind, at_ - length(hit) AS s, at_ AS e, hit FROM (
  SELECT doc_id, hit, value, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS at_ FROM (
    SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[1:len(hits)]) AS gap FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {value}) AS vals, string_split_regex(t, '{pattern}') AS gaps FROM d))) WHERE {keep}"""


_Q = "''"
ASSIGN = rf"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["{_Q}]?\x20*[:=]\x20*["{_Q}]?([A-Za-z0-9+/_.=-]+)"""
ENDPOINT = rf"""https?://[^\x00-\x20"{_Q}<>]+|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}"""
_HAS = {k: f"regexp_matches(hit, '{p}')" for k, p in (("upper", "[A-Z]"), ("lower", "[a-z]"), ("digit", "[0-9]"), ("plain", "^[A-Z0-9]+$"))}
_RUN = f"CASE WHEN {_HAS['plain']} AND {_HAS['upper']} AND length(hit) <= 40 THEN 3 WHEN {_HAS['upper']} AND {_HAS['lower']} AND length(hit) BETWEEN 20 AND 256 THEN 4 ELSE -1 END"

#: Base spans by plain scans, weak ones with a complement within 200 code points.
SECRETS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_spans(0, ASSIGN, 2, "length(value) >= 12")} UNION ALL {_spans(1, "AKIA[A-Z0-9]{14,}", 0, "true")} UNION ALL {_spans(2, "[0-9a-f]{16,}", 0, "true")}),
weak AS (SELECT * FROM ({_spans(3, "[A-Za-z0-9+/_=-]{16,}", 0, _HAS["digit"], _RUN)}) WHERE kind > 0 UNION ALL {_spans(5, ENDPOINT, 0, "true")}),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
near AS (SELECT w.doc_id, w.s, w.kind, w.e, greatest(p.s - w.e, w.s - p.e) AS gap, p.kind AS k FROM weak w JOIN parts p ON p.doc_id = w.doc_id),
kept AS (SELECT doc_id, s, kind, e FROM near GROUP BY ALL HAVING NOT bool_or(gap < 0 AND k < 3) AND bool_or(gap BETWEEN 0 AND 200 AND CASE WHEN kind = 4 THEN k IN (1, 3, 5) ELSE k IN (0, 2, 4) END)),
spans AS (SELECT doc_id, s, kind, e, true AS own FROM base UNION ALL SELECT doc_id, s, kind, e, false FROM kept),
named AS (SELECT doc_id, s, kind, e, own, ['assign', 'access', 'hex', 'weak_id', 'weak_secret', 'endpoint'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM spans),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h, string_agg(x, ',' ORDER BY s, kind, e) FILTER (own) AS b, string_agg(x, ',' ORDER BY s, kind, e) AS y FROM named GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(y, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

#: Payload digests and who repeats whom; base32 from the 20 bytes' bits, five at a time.
WARC = r"""
WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h) AS n, sha1(h) AS sha FROM d),
b AS (SELECT sha, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0b' || substr(bits, 1 + 5 * i, 5)) AS INTEGER), 1)), '') AS b32
  FROM (SELECT sha, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(sha, i, 1))]), '') AS bits FROM (SELECT DISTINCT sha FROM x))),
f AS (SELECT sha, min(page_id) AS first FROM x GROUP BY 1)
SELECT x.page_id, n AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM x JOIN b USING (sha) JOIN f USING (sha)"""

#: Lines by a regular expression, cut at the drawn ranks and joined again.
FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, list_transform(range(0, 4), lambda k: CAST('0x' || substr(x, 1 + 8 * k, 8) AS BIGINT)) AS h FROM d),
r AS (SELECT *, len(l) AS n, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, array_to_string(l[1:a], '') AS p, array_to_string(l[a+1:b], '') AS m, array_to_string(l[b+1:n], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""



def _plus(state: str, cost: str, letter: str, turn: str | None = None) -> str:
    """A state (key: nine digits of cost and the edits; turns so far) after one more edit."""
    turns = f"list_append({state}.t, {turn})" if turn else f"{state}.t"
    return f"{{'k': lpad(CAST(CAST(left({state}.k, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}.k, 10) || '{letter}', 't': {turns}}}"


def _least(*offers: str) -> str:
    return f"list_min([{', '.join(offers)}])"


def _with_insertions(*raw: str) -> str:
    """The four states (start, system, user, assistant) with insertions: the user's from all but itself, then the assistant's, then the user's again."""
    s0, s1, s2, s3 = raw
    return f"""SELECT *, {s0} AS i0, {s1} AS i1, {_least(s2, *(_plus(x, "2", "I", "'user:'") for x in (s0, s1, s3)))} AS i2 FROM"""


_ROW_STEP = {
    "d": [_plus(f"x.s{j}", "3", "D") for j in range(4)],
    "k2": [f"CASE WHEN NOT gone AND init = 'u' THEN {_plus(f'x.s{j}', 'cut', 'K', 'line')} END" for j in (0, 1, 3)] + [f"CASE WHEN NOT gone THEN {_plus(f'x.s{j}', '2 + cut', 'R', 'as_user')} END" for j in (0, 1, 3)],
    "k1": [f"CASE WHEN NOT gone AND init = 's' THEN {_plus('x.s0', 'cut', 'K', 'line')} END"],
    "k3": [f"CASE WHEN NOT gone AND init = 'a' THEN {_plus('x.s2', 'cut', 'K', 'line')} END", f"CASE WHEN NOT gone THEN {_plus('x.s2', '2 + cut', 'R', 'as_assistant')} END"],
}
_NEVER = "{'k': '500000000', 't': CAST([] AS VARCHAR[])}"

#: Damage by a crc32 in SQL, faults by windows, then all four states of each conversation row by row with the first of their cheapest edits.
REPAIR = rf"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY n) AS bytes FROM (SELECT n, list_reduce(list_prepend(n, range(0, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(0, 256)) AS n))),
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS id FROM conversations),
c AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, id), lambda c, x: xor(c >> 8, crc.bytes[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS code FROM b, crc),
m AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE code <> 0),
n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM n),
f AS (SELECT conv_id, turn, role, text, i, NOT regexp_matches(text, '[^ 	-
]') AS blank, again AND regexp_matches(text, '[^ 	-
]') AS duplicate,
  NOT again AND regexp_matches(text, '[^ 	-
]') AND NOT regexp_matches(text, '[.!?][ 	-
]*$') AS truncated, left(role, 1) AS init, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM o),
r AS (SELECT conv_id, i, blank OR duplicate AS gone, truncated::BIGINT AS cut, init, role || ':' || text AS line, 'user:' || text AS as_user, 'assistant:' || text AS as_assistant FROM f),
x AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'k': '000000000', 't': CAST([] AS VARCHAR[])}} AS s0, {_NEVER} AS s1, {{'k': '000000002I', 't': ['user:']}} AS s2, {{'k': '000000004II', 't': ['user:', 'assistant:']}} AS s3 FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, i0, i1, {_least("i2", _plus("j3", "2", "I", "'user:'"))}, j3 FROM (
    SELECT *, {_least("n3", _plus("i2", "2", "I", "'assistant:'"))} AS j3 FROM (
      {_with_insertions("n0", "n1", "n2", "n3")} (
        SELECT x.conv_id, r.i, {_ROW_STEP["d"][0]} AS n0, {_least(_ROW_STEP["d"][1], *_ROW_STEP["k1"])} AS n1, {_least(_ROW_STEP["d"][2], *_ROW_STEP["k2"])} AS n2, {_least(_ROW_STEP["d"][3], *_ROW_STEP["k3"])} AS n3
        FROM x JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i + 1)))),
e AS (SELECT conv_id, {_least("arg_max(s0, i)", "arg_max(s3, i)")} AS s FROM x GROUP BY 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(s.k, 9) AS BIGINT), 0) AS cost, coalesce(substr(s.k, 10), '') AS audit, sha256(coalesce(array_to_string(s.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""

ORACLES = {"op1_secret_scan": SECRETS, "op3_warc": WARC, "op9_minhash_dedup": NEAR_DUPLICATES, "op11_repair": REPAIR, "op12_jaccard_join": JACCARD_JOIN, "op13_fill_in_middle": FILL_IN_MIDDLE}
