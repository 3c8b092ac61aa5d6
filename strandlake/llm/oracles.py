"""DuckDB SQL for the rows of queries that SQL can state on whole tables, written from the rules of each result, not from the operators."""

from __future__ import annotations

#: Rows of a kind's matches with their places: what a pattern splits a text into gives the gaps, the matches their lengths.
_PLACES = """SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(m) AS "end", m FROM (
  SELECT doc_id, m, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
    SELECT row_id, doc_id, unnest(regexp_extract_all(body, '{pattern}')) AS m, unnest(string_split_regex(body, '{pattern}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(body, '{pattern}'), 1) AS i FROM d)
  WINDOW w AS (PARTITION BY row_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {test}"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_VALUE = """["'']?\\x20*[:=]\\x20*["'']?"""
_NAME = "(?:" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + ")"
_RULES = (
    ("assign", _NAME + _VALUE + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '{_NAME + _VALUE}([A-Za-z0-9+/_.=-]+)', 1)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("private_key", "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", "true"),
    ("vendor_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", "true"),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
)
_SAID = "coalesce(string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, rank){only}, '')"
OP2_SQL = (
    "WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body FROM documents), f AS ("
    + " UNION ALL ".join(_PLACES.format(rank=i, kind=k, pattern=p, test=t).replace("SELECT doc_id,", "SELECT row_id, doc_id,", 1).replace("FROM (\n  SELECT doc_id,", "FROM (\n  SELECT row_id, doc_id,", 1) for i, (k, p, t) in enumerate(_RULES))
    + ") SELECT d.doc_id, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    + f", sha256({_SAID.format(only=' FILTER (rank < 3)')}) AS base_sha256, {_SAID.format(only=' FILTER (kind IS NOT NULL)')} AS spans FROM d LEFT JOIN f USING (row_id) GROUP BY d.row_id, d.doc_id"
)

#: Components by spreading the least label along links until nothing changes.
_SPREAD = """reach AS (SELECT id AS node, id AS label FROM nodes UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node WHERE r.label < l.b),
classes AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node)"""

OP4_SQL = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id AND a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) >= 0.95 * a.norm * b.norm),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
{_SPREAD}
SELECT id AS vec_id, count(l.b) AS n_links, any_value(component_id) AS component_id, any_value(component_id) = id AS kept FROM nodes JOIN classes ON node = id LEFT JOIN links l ON l.a = id GROUP BY id"""

OP6_SQL = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM g GROUP BY id),
nodes AS (SELECT doc_id AS id FROM documents),
pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM g x JOIN g y ON x.shingle = y.shingle AND x.id < y.id JOIN n p ON p.id = x.id JOIN n q ON q.id = y.id
  GROUP BY x.id, y.id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
{_SPREAD}
SELECT w.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n ON n.id = w.id JOIN classes ON node = w.id"""

_LUHN = "list_sum(list_transform(string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN c > '4' THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)) % 10 = 0"
_DIGITS = "length(regexp_replace(m, '[^0-9]', '', 'g'))"
_IBAN = "replace(m, ' ', '')"
_MOD97 = (
    f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), ''), lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END AS BIGINT))),"
    " lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"
)
_PERSONAL = (
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true", 0.9, "mail|contact|write|courriel|correo"),
    ("ip", "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255)) = 0", 0.6, "\\bip\\b|address|host|server|adresse"),
    ("card", "[0-9](?:[\\x20-]?[0-9])+", f"{_DIGITS} BETWEEN 14 AND 19 AND {_LUHN}", 0.8, "card|visa|credit|payment|carte|karte|tarjeta"),
    ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", f"{_DIGITS} BETWEEN 10 AND 15", 0.6, "phone|call|tel|mobile|fax|anruf|appel"),
    ("iban", "\\b[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?\\b", f"length({_IBAN}) BETWEEN 15 AND 34 AND {_MOD97}", 0.9, "iban|bank|account|konto|compte|cuenta"),
)
_NEAR = "lower(substr(body, CAST(greatest(1, start - 39) AS BIGINT), CAST(least(40, start) AS BIGINT)))"
_SCORE = "CASE kind " + " ".join(f"WHEN '{k}' THEN CASE WHEN regexp_matches({_NEAR}, '{c}') THEN {p + 0.1:.2f} ELSE {p:.2f} END" for k, _, _, p, c in _PERSONAL) + " END"
OP8_SQL = (
    "WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body FROM documents), f AS ("
    + " UNION ALL ".join(_PLACES.format(rank=i, kind=k, pattern=p, test=t).replace("SELECT doc_id,", "SELECT row_id, doc_id,", 1).replace("FROM (\n  SELECT doc_id,", "FROM (\n  SELECT row_id, doc_id,", 1) for i, (k, p, t, _, _) in enumerate(_PERSONAL))
    + ") SELECT d.doc_id, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))
    + f", sha256({_SAID.format(only=' FILTER (rank < 4)')}) AS base_sha256, {_SAID.format(only=' FILTER (kind IS NOT NULL)')} AS spans"
    + f", coalesce(string_agg(printf('%.2f', CAST({_SCORE} AS DOUBLE)), ',' ORDER BY start, rank) FILTER (kind IS NOT NULL), '') AS scores FROM d LEFT JOIN f USING (row_id) GROUP BY d.row_id, d.doc_id"
)
