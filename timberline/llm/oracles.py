"""DuckDB SQL of ``op11_licenses``, ``op12_vector_codes`` and ``op13_spelling``, from the definitions."""

from __future__ import annotations

from timberline.llm import licenses, spelling, vectorcodes

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def licenses_sql() -> str:
    """The same votes, spans and islands as joins, groups and windows."""
    g = licenses.GRAM

    def words(text: str) -> str:
        return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{licenses.SEPARATORS}'), lambda x: x <> '')"

    given = [(t, label, "true") for t, label in licenses.PHRASES] + [(t, label, "false") for t, label in licenses.NOTICES]
    values = ", ".join(f"({k}, '{label}', {whole}, '{text}')" for k, (text, label, whole) in enumerate(given))
    gram = ", ".join(f"w[nth + {k + 1}] AS w{k}" for k in range(g))
    on = ", ".join(f"w{k}" for k in range(g))
    return f"""WITH t AS (SELECT template, label, whole, {words("text")} AS w FROM (VALUES {values}) v(template, label, whole, text)),
tg AS (SELECT template, label, whole, len(w) AS size, nth AS q, {gram} FROM (SELECT *, unnest(range(len(w) - {g - 1})) AS nth FROM t) u),
d AS (SELECT row_number() OVER () AS k, doc_id, {words("text")} AS w FROM documents),
dg AS (SELECT k, nth AS p, {gram} FROM (SELECT k, w, unnest(range(greatest(len(w) - {g - 1}, 0))) AS nth FROM d) u),
v AS (SELECT k, template, label, whole, size, p - q AS diagonal, list_sort(list(DISTINCT q)) AS ats FROM dg JOIN tg USING ({on}) GROUP BY ALL),
places AS (SELECT k, label, true AS base, diagonal AS s, diagonal + size AS e, 1.0::DOUBLE AS score FROM v WHERE whole AND len(ats) = size - {g - 1}),
n0 AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY k, template ORDER BY diagonal) > {licenses.SHIFT})::INT, 0) AS apart FROM v WHERE NOT whole AND len(ats) >= {licenses.MIN_VOTES}),
n1 AS (SELECT *, sum(apart) OVER (PARTITION BY k, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM n0),
n2 AS (SELECT k, template, label, size, span, min(diagonal + ats[1]) AS s, max(diagonal + ats[-1] + {g}) AS e, len(list_distinct(flatten(list_transform(flatten(list(ats)), lambda x: range(x, x + {g}))))) AS verified FROM n1 GROUP BY ALL),
n3 AS (SELECT *, verified::DOUBLE / greatest(size, e - s) AS score FROM n2 WHERE verified::DOUBLE / greatest(size, e - s) >= {licenses.MIN_SCORE}),
n4 AS (SELECT *, coalesce((s >= max(e) OVER (PARTITION BY k ORDER BY s, e, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 0) AS opens FROM n3),
n5 AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY s, e, template ROWS UNBOUNDED PRECEDING) AS island FROM n4),
n6 AS (SELECT *, max(score) OVER (PARTITION BY k, island) AS best FROM n5),
f AS (SELECT * FROM places UNION ALL SELECT k, label, false, s, e, score FROM n6 WHERE score = best),
r AS (SELECT k, count(CASE WHEN base THEN 1 END) AS n_base, min(CASE WHEN base THEN s END) AS first_word, max(CASE WHEN base THEN s END) AS last_word, string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(max(score), 9) AS score, string_agg(CASE WHEN NOT base THEN label || ':' || s || ':' || e END, ',' ORDER BY s, e, label) AS notices FROM f GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score, coalesce(notices, '') AS notices FROM d LEFT JOIN r USING (k)"""


def vector_codes_sql(rounds: int = vectorcodes.ROUNDS) -> str:
    """Every part against every entry, in whole numbers; for tables whose vectors are of one length, a multiple of the parts."""
    m, n = vectorcodes.PARTS, vectorcodes.ENTRIES
    far = "list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT"
    sql = [
        f"kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: floor({vectorcodes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS (SELECT k, p, v[p * (len(v) // {m}) + 1 : (p + 1) * (len(v) // {m})] AS x FROM kept, range({m}) r(p))",
        f"b0 AS (SELECT p, k - 1 AS j, x AS c FROM parts WHERE k <= {n})",
    ]
    for r in range(rounds + 1):
        sql.append(f"a{r} AS (SELECT k, p, m.j AS j, m.e AS e FROM (SELECT k, p, min({{'e': {far}, 'j': j}}) AS m FROM parts JOIN b{r} USING (p) GROUP BY k, p) q)")
        if r < rounds:
            sql += [
                f"s{r} AS (SELECT p, j, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} JOIN (SELECT k, p, x, unnest(range(1, len(x) + 1)) AS i FROM parts) u USING (k, p) GROUP BY p, j, i)",
                f"m{r} AS (SELECT p, j, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY p, j)",
                f"b{r + 1} AS (SELECT p, j, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, j))",
            ]
    last = f"(SELECT k, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(e)::BIGINT AS error FROM a{rounds} GROUP BY k)"
    digest = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM b{rounds})"
    return f"WITH {', '.join(sql)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {digest} AS codebooks_sha256 FROM kept JOIN {last} l USING (k)"


def spelling_sql() -> str:
    """CRC-32 from its polynomial; near words by equal strings with one letter masked or left out."""
    table = "list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    bytes_ = "list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295], {bytes_}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    s = spelling
    return f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT {table} AS tab),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
long AS (SELECT id, run, id || ':' || run AS s, count(*) AS times FROM runs WHERE length(run) >= {s.MIN_LENGTH} GROUP BY id, run),
hashed AS (SELECT run, times, {crc} AS h FROM long, tab),
said AS (SELECT times, CASE WHEN h % {s.DROPS} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
v AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM said WHERE length(word) >= {s.MIN_LENGTH} GROUP BY word HAVING sum(times) >= {s.MIN_COUNT}),
cuts AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM v) u),
changed AS (SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.i = b.i AND a.less = b.less AND a.word <> b.word AND length(a.word) = length(b.word)),
cut AS (SELECT DISTINCT c.word, v.word AS near FROM cuts c JOIN v ON c.less = v.word),
pairs AS (SELECT * FROM changed UNION SELECT * FROM cut UNION SELECT near, word FROM cut),
best AS (SELECT p.word, count(*) AS n_near, min({{'less': -v.n, 'near': p.near}}) AS b FROM pairs p JOIN v ON v.word = p.near GROUP BY p.word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {s.RATIO} * v.n THEN b.near END AS form, CASE WHEN -b.less >= {s.RATIO} * v.n THEN -b.less END AS form_n FROM v LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root, form FROM forms UNION ALL SELECT w.word, f.word, f.form FROM way w JOIN forms f ON f.word = w.form)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN way w ON w.word = f.word AND w.form IS NULL"""
