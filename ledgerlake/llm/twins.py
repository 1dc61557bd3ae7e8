"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?(?:SYS|ROLE|TURN)>>)"

CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), safe AS (
  SELECT *, regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g') AS escaped,
         regexp_replace(role, '{_CONTROL}', '\1\\\2\3', 'g') AS escaped_role
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
                                  ELSE 27 + length(escaped_role) END) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id
"""

#: ``docs`` names the table of documents to mix.
MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM {{docs}}
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per_source
), filled AS (
  SELECT *, sum(source_size) OVER () * 3 AS halves,
         coalesce(sum(source_size) OVER before, 0) * 2 AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight,
         row_number() OVER (ORDER BY source_size / weight, place) AS step
  FROM weighed
  WINDOW before AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, min(CASE WHEN weight * (halves - capped * 2) <= source_size * 4 * open_weight THEN step END) OVER () AS first
  FROM filled
), goals AS (
  SELECT l.source, l.source_size,
         CAST(CASE WHEN l.step >= l.first THEN l.weight * (f.halves - f.capped * 2) ELSE l.source_size * 4 * f.open_weight END AS BIGINT) AS top,
         CAST(f.open_weight * 2 AS BIGINT) AS bottom, l.step >= l.first AS open
  FROM levels l JOIN levels f ON f.step = f.first
), words AS (
  SELECT source, source_size, CASE WHEN open THEN CAST(top AS DOUBLE) / bottom ELSE CAST(source_size * 2 AS DOUBLE) END AS target,
         CASE WHEN open THEN top // bottom ELSE source_size * 2 END AS target_words
  FROM goals
), laid AS (
  SELECT s.doc_id, s.source, s.size, w.source_size, w.target, w.target_words,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN words w ON s.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(greatest(least(start + size, target_words) - start, 0)
          + greatest(least(start + size, target_words - source_size) - start, 0) AS BIGINT) AS taken
FROM laid
"""

_FOLDED = rf"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

#: Exact containment of every benchmark item; ``docs`` names the table of documents to search.
LEAKS = rf"""
WITH item_words AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
item_runs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
  FROM item_words WHERE len(w) >= 5
), items AS (SELECT item_id, count(*) AS n FROM item_runs GROUP BY item_id),
doc_words AS (SELECT doc_id, {_FOLDED} AS w FROM {{docs}}),
doc_runs AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
  FROM doc_words WHERE len(w) >= 5
), met AS (
  SELECT doc_id, item_id, count(DISTINCT shingle) AS shared
  FROM doc_runs JOIN item_runs USING (shingle) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, shared, n AS item_shingles, shared / n AS containment
FROM met JOIN items USING (item_id) WHERE shared / n >= 0.75
"""

TOP_K = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


NEGATIVES = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM whole a JOIN whole c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""

# zlib's checksum, bit by bit; its polynomial is a fixed value
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""
_BYTES = """list_transform(range(1, CAST(octet_length(encode({text})) AS BIGINT) + 1), lambda k: CAST(
  16 * (strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * k - 1, 1)) - 1)
  + strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * k, 1)) - 1 AS BIGINT))"""

VARIANTS = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), grouped AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, {_CRC.format(bytes=_BYTES.format(text="(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)"))} AS h FROM grouped
), spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words),
cut AS (
  SELECT DISTINCT word, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS replaced,
         substr(word, 1, k - 1) || substr(word, k + 1) AS deleted
  FROM places
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.replaced = b.replaced AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.deleted = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.deleted = w.word
), counted AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS best, max(w.n) AS best_n
  FROM near JOIN words w ON w.word = near.other GROUP BY near.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form,
         CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN counted USING (word)
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


def _level(k: int) -> str:
    """The variable nodes of level ``k`` become ``*``."""
    parents = ", ".join(["host", *[f"s{i}" for i in range(1, k)]])
    on = " AND ".join(f"r.{c} = v.{c}" for c in parents.split(", "))
    rest = ", ".join(f"r.s{i}" for i in range(1, 5) if i != k)
    return f"""l{k} AS (
  SELECT r.host, r.path, r.n, r.labelled, r.blocked, r.tail, {rest},
         CASE WHEN v.host IS NOT NULL AND r.s{k} <> '' THEN '*' ELSE r.s{k} END AS s{k}
  FROM l{k - 1} r LEFT JOIN (
    SELECT {parents} FROM l{k - 1} GROUP BY {parents}
    HAVING sum(n) >= 20 AND count(DISTINCT s{k}) > sum(n) * 0.5) v ON {on}
)"""


def _segment(k: int) -> str:
    seg = f"coalesce(parts[{k}], '')"
    return rf"""CASE WHEN (regexp_full_match({seg}, '[0-9A-Za-z_-]{{12,}}') AND regexp_matches({seg}, '[0-9]'))
      OR regexp_full_match({seg}, '[0-9a-fA-F-]{{16,}}') THEN '<id>'
    ELSE regexp_replace({seg}, '^[0-9]+($|\.[A-Za-z0-9]{{1,5}}$)', '<num>\1') END AS s{k}"""


def _fits(rule: str) -> str:
    host, slash, rest = rule.partition("/")
    return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash}{rest}')"


URLS = rf"""
WITH split AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), decided AS (
  SELECT *, CASE WHEN {_fits("example.net/en/")} THEN 'example.net/en/' WHEN {_fits("example.com/de/")} THEN 'example.com/de/'
                 WHEN {_fits("org/fr/")} THEN 'org/fr/' WHEN {_fits("net/")} THEN 'net/' END AS rule
  FROM split
), counted AS (
  SELECT host, path, count(*) AS n, count(rule) AS labelled,
         count(*) FILTER (WHERE rule IN ('example.com/de/', 'net/')) AS blocked
  FROM decided WHERE host <> '' GROUP BY host, path
), parted AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM counted),
l0 AS (
  SELECT host, path, n, labelled, blocked, CASE WHEN len(parts) > 4 THEN '**' ELSE '' END AS tail,
    {", ".join(_segment(k) for k in range(1, 5))}
  FROM parted
), {", ".join(_level(k) for k in range(1, 5))},
spread AS (
  SELECT host, s1, concat_ws('/', s2, s3, s4, tail) AS below, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked
  FROM l4 GROUP BY 1, 2, 3
), pool AS (SELECT host, below, sum(n) AS pool_n FROM spread GROUP BY 1, 2),
branch AS (SELECT host, s1, sum(n) AS b_n, sum(labelled) AS b_l, sum(blocked) AS b_b FROM spread GROUP BY 1, 2),
whole AS (SELECT host, sum(b_n) AS h_n, sum(b_l) AS h_l, sum(b_b) AS h_b, count(*) AS branches FROM branch GROUP BY 1),
alike AS (
  SELECT s.host, s.s1 FROM spread s JOIN pool USING (host, below) JOIN branch b USING (host, s1) JOIN whole w USING (host)
  GROUP BY s.host, s.s1
  HAVING max(branches) > 1 AND sum(greatest(s.n / b_n - pool_n / h_n, 0)) <= 0.2
     AND max(abs(b_b / b_n - h_b / h_n)) <= 0.1 AND max(abs(b_l / b_n - h_l / h_n)) <= 0.1
), merged AS (SELECT host, s1 FROM alike WHERE host IN (SELECT host FROM alike GROUP BY host HAVING count(*) > 1)),
shaped AS (
  SELECT r.host, r.path, r.n, r.labelled, r.blocked,
         regexp_replace('/' || concat_ws('/', CASE WHEN m.host IS NOT NULL AND r.s1 <> '' THEN '*' ELSE r.s1 END, s2, s3, s4, tail), '/+$', '') AS template
  FROM l4 r LEFT JOIN merged m ON m.host = r.host AND m.s1 = r.s1
), known AS (
  SELECT host, template, (sum(blocked) + 0.4::DOUBLE) / (sum(labelled) + 2.0::DOUBLE) AS purity,
         sum(labelled) >= sum(n) * 0.5 AS supported
  FROM shaped GROUP BY 1, 2
), found AS (SELECT s.host, s.path, s.template, purity, supported FROM shaped s JOIN known USING (host, template))
SELECT page_id, d.host, d.path, rule,
       CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN purity >= 0.7 AND supported THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(template, '') AS template, CAST(purity AS DOUBLE) AS purity
FROM decided d LEFT JOIN found f ON f.host = d.host AND f.path = d.path
"""

ORACLES = {
    "op9_url_filter": URLS,
    "op1_top_k": TOP_K,
    "op4_chat_format": CHAT,
    "op11_hard_negatives": NEGATIVES,
    "op12_spelling_variants": VARIANTS,
    "op8_decontamination": LEAKS.format(docs="documents"),
    "op7_mixing": MIXING.format(docs="documents"),
}
