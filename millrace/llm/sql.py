"""DuckDB SQL for the queries whose whole result SQL can express, made from the operators' own tables of phrases and patterns."""

from __future__ import annotations

from millrace.llm import license_scan as L
from millrace.llm import secret_scan as S


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_sql() -> str:
    """op8: every pair of neighbouring words against every pair of each template; passages by diagonals, and every window that begins at a hit."""
    rows = ", ".join(f"({i}, {_quoted(' '.join(w))}, {_quoted(label)}, {str(exact).lower()})" for i, w, label, exact in L.templates())
    return rf"""
WITH t AS (SELECT template, string_split(said, ' ') AS words, label, exact, exact OR len(string_split(said, ' ')) <= {L.FEW} AS strict FROM (VALUES {rows}) v(template, said, label, exact)),
g AS (SELECT template, label, exact, strict, len(words) AS size, len(words) + len(words) // {L.SPARE} AS window_, i - 1 AS place, words[i] AS a, words[i + 1] AS b FROM (SELECT *, unnest(range(1, len(words))) AS i FROM t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
h AS (SELECT doc_id, template, label, exact, strict, size, window_, pos, place, pos - place AS diagonal FROM p JOIN g USING (a, b)),
v AS (SELECT DISTINCT doc_id, template, strict, diagonal FROM h),
f AS (SELECT *, CASE WHEN strict OR diagonal - lag(diagonal) OVER w > {L.NEAR} THEN 1 ELSE 0 END AS fresh FROM v WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
m AS (SELECT doc_id, template, diagonal, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS passage FROM f),
q AS (SELECT h.*, passage FROM h JOIN m USING (doc_id, template, diagonal)),
e AS (SELECT a.doc_id, a.template, a.label, a.exact, a.strict, a.size, a.passage, a.pos AS first, count(DISTINCT b.word)::DOUBLE AS covered FROM (SELECT DISTINCT * EXCLUDE (place, diagonal) FROM q) a JOIN (SELECT doc_id, template, passage, pos, unnest([place, place + 1]) AS word FROM q) b ON a.doc_id = b.doc_id AND a.template = b.template AND a.passage = b.passage AND b.pos BETWEEN a.pos AND a.pos + a.window_ - 2 GROUP BY ALL),
c AS (SELECT doc_id, template, label, exact, strict, size, passage, max(covered) AS covered, arg_min(first, (-covered, first)) AS first FROM e GROUP BY ALL),
r AS (SELECT *, covered / size AS share FROM c WHERE CASE WHEN strict THEN covered = size ELSE covered >= {L.LEAST} * size END),
s AS (SELECT doc_id, count_if(exact) AS n_base, min(first) FILTER (WHERE exact) AS first_word, max(first) FILTER (WHERE exact) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM r GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN s USING (doc_id)"""


def _re2(pattern: str) -> str:
    """The same matches without what a linear matcher has no need of: possessive repetition, and looking back for where a part begins."""
    return pattern.replace("++", "+").replace("*+", "*").replace("*?", "*").replace("(?<![A-Za-z0-9])", "")


def secret_sql() -> str:
    """op2: positions from the lengths of the pieces between matches; what base spans and marked parts cover is blanked character by character;
    entropy of every window of the candidates that are left, counted afresh."""

    def parts(kinds: list[tuple[int, str]]) -> str:
        return " UNION ALL ".join(
            f"SELECT doc_id, {k} AS kind, m, (list_sum([length(x) FOR x IN pieces[1:i]]) + coalesce(list_sum([length(x) FOR x IN found[1:i - 1]]), 0))::BIGINT AS start FROM (SELECT doc_id, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS i, found, pieces FROM (SELECT doc_id, regexp_extract_all({source}, {_quoted(_re2(p))}) AS found, string_split_regex({source}, {_quoted(_re2(p))}) AS pieces FROM {table}))"
            for k, p, source, table in kinds
        )

    known = parts([(0, S.ASSIGN, "text", "d"), (1, S.ACCESS, "text", "d"), (2, S.HEX_LONG, "text", "d"), (9, S.MARKED, "text", "d")])
    cut = parts([(S.KINDS.index(k), c[0], "text", "x") for k, c in S.CLASSES.items()])
    limits = ", ".join(f"({S.KINDS.index(k)}, {w}, {h}::DOUBLE)" for k, (_, w, h) in S.CLASSES.items())
    allowed = " OR ".join(f"regexp_matches(m, {_quoted(_re2(a))})" for a in S.ALLOW)
    names = "[" + ", ".join(map(_quoted, S.KINDS)) + "]"
    joined = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT *, (start + length(m))::BIGINT AS stop FROM ({known})),
b AS (SELECT * FROM a WHERE (kind = 0 AND length(regexp_extract(m, {_quoted(S.ASSIGN)}, 2)) >= 6) OR (kind = 1 AND length(m) >= 20) OR kind = 2 OR kind = 9),
p AS (SELECT DISTINCT doc_id, unnest(range(start, stop)) AS at_ FROM b),
g AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch, unnest(range(0, length(text))) AS at_ FROM d WHERE doc_id IN (SELECT doc_id FROM b)),
h AS (SELECT g.doc_id, string_agg(CASE WHEN p.at_ IS NULL THEN ch ELSE ' ' END, '' ORDER BY g.at_) AS text FROM g LEFT JOIN p USING (doc_id, at_) GROUP BY g.doc_id),
x AS (SELECT d.doc_id, coalesce(h.text, d.text) AS text FROM d LEFT JOIN h USING (doc_id)),
n AS (SELECT doc_id, kind, m, start, start + length(m) AS stop FROM ({cut}) WHERE NOT ({allowed})),
w AS (SELECT n.*, least, size, unnest(range(1, length(m) - size + 2)) AS at_ FROM n JOIN (VALUES {limits}) l(kind, size, least) USING (kind)),
e AS (SELECT doc_id, kind, start, at_, any_value(least) AS least, log2(any_value(size)) - sum(c * log2(c)) / any_value(size) AS h FROM (SELECT doc_id, kind, start, at_, least, size, ch, count(*) AS c FROM (SELECT *, unnest(string_split(substr(m, at_, size), '')) AS ch FROM w) GROUP BY ALL) GROUP BY doc_id, kind, start, at_),
k AS (SELECT doc_id, kind, start FROM e GROUP BY doc_id, kind, start HAVING max(h) >= any_value(least)),
y AS (SELECT doc_id, kind, start, stop FROM b WHERE kind < 9 UNION ALL SELECT n.doc_id, n.kind, n.start, stop FROM n JOIN k USING (doc_id, kind, start)),
z AS (SELECT *, {names}[kind + 1] AS name FROM y)
SELECT d.doc_id, coalesce(count_if(kind = 0), 0)::BIGINT AS n_assign, coalesce(count_if(kind = 1), 0)::BIGINT AS n_access, coalesce(count_if(kind = 2), 0)::BIGINT AS n_hex, sha256(coalesce({joined} FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce({joined}, '') AS spans FROM d LEFT JOIN z USING (doc_id) GROUP BY d.doc_id"""
