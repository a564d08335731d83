"""DuckDB SQL of the operators that SQL can express, over the same whole tables."""

from __future__ import annotations

from . import secrets_scan, weak_quality

_REACH = """
both_ways AS MATERIALIZED (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT r, r AS far FROM {nodes}
  UNION SELECT reach.r, l.y FROM reach JOIN both_ways l ON l.x = reach.far
), named AS (
  SELECT reach.r, min(other.{id}) AS component_id FROM reach JOIN {nodes} other ON other.r = reach.far GROUP BY 1
)"""

MINHASH = (
    r"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM docs
), sizes AS MATERIALIZED (
  SELECT r, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS both_have FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * both_have >= 80 * (a.n + b.n - both_have)
),"""
    + _REACH.format(nodes="docs", id="doc_id")
    + """
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
       doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS kept
FROM docs LEFT JOIN sizes USING (r) LEFT JOIN named USING (r)
"""
)

EMBEDDINGS = (
    """
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e,
         coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS good
  FROM embeddings
), links AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y FROM rows a JOIN rows b ON a.good AND b.good AND a.r < b.r AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95
),"""
    + _REACH.format(nodes="rows", id="vec_id")
    + """
SELECT vec_id, (SELECT count(*) FROM both_ways WHERE x = rows.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN named USING (r)
"""
)

SHARDING = """
WITH bits AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce([b::BIGINT] || range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of
), sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
         xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
             lambda c, byte: xor(c >> 8, crc_of[(xor(c, byte) & 255) + 1]))) AS text_crc32
  FROM documents, bits
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS LAST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total,
         row_number() OVER (ORDER BY doc_id NULLS LAST, size, text_crc32) AS place
  FROM sized
), cut AS (
  SELECT *, least(23, ((2 * before + size) * 24) // (2 * total))::INT AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard FROM cut
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secrets() -> str:
    words = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
    assign = rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    patterns = [assign, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", secrets_scan.KEY]
    least = [6, 20, 24, 0]
    quoted = [p.replace("'", "''") for p in patterns]
    each = "\n  UNION ALL ".join(
        f"SELECT r, {k} AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS gaps FROM docs" for k, p in enumerate(quoted)
    )
    kinds = "[" + ", ".join(f"'{k}'" for k in secrets_scan.KINDS) + "]"
    return rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), found AS (
  {each}
), placed AS (
  SELECT r, kind, m[i] AS whole, (list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0)
), spans AS (
  SELECT r, kind, start, start + length(whole) AS stop, CASE WHEN kind = 0 THEN regexp_extract(whole, '{quoted[0]}', 2) ELSE whole END AS value FROM placed
), kept AS MATERIALIZED (
  SELECT * FROM spans WHERE length(value) >= {least}[kind + 1]
), counted AS (
  SELECT value, count(DISTINCT source) + max((source IS NULL)::INT) AS owners, count(DISTINCT md5(text)) AS repositories FROM kept JOIN docs USING (r) GROUP BY 1
), judged AS (
  SELECT kept.*, owners >= {secrets_scan.EXAMPLE_OWNERS} OR repositories >= {secrets_scan.EXAMPLE_REPOSITORIES} AS example,
         length(value) >= 8 AND NOT regexp_matches(value, '(?i){secrets_scan.DULL}')
         AND -list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: len(list_filter(string_split(value, ''), lambda d: d = c)) / length(value)
             * log2(len(list_filter(string_split(value, ''), lambda d: d = c)) / length(value)))) >= 2.5 AS shaped
  FROM kept JOIN counted USING (value)
), shown AS (
  SELECT r, {kinds}[kind + 1] || ':' || start || ':' || stop AS span, kind, start, example, shaped AND NOT example AS live FROM judged
)
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3 OR live), '') AS spans,
       count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE example) AS n_example
FROM docs LEFT JOIN shown USING (r) GROUP BY r, doc_id
"""


def _quality() -> str:
    rules, window = len(weak_quality.RULES), weak_quality.WINDOW

    def number(x: float) -> str:
        return "1e300" if x == float("inf") else repr(float(x))

    vote = ", ".join(f"CASE WHEN {m} < {number(low)} OR {m} > {number(high)} THEN -1 WHEN {m} >= {number(a)} AND {m} <= {number(b)} THEN 1 ELSE 0 END" for _, m, low, high, a, b in weak_quality.RULES)
    start = weak_quality._start()
    joint = f"""list_transform(range(1, {rules + 2}), lambda c: share[c] * list_aggregate(list_transform(range(1, {rules + 1}), lambda k:
      CASE WHEN {{v}}[k] < 0 THEN bad[c][k] WHEN {{v}}[k] > 0 THEN 1 - bad[c][k] ELSE 1.0 END), 'product'))"""
    weight = f"((CASE WHEN c = 1 OR k = c - 1 THEN {weak_quality.WEIGHT} ELSE {weak_quality.WEAK} END) * list_sum(list_transform(seen, lambda x: x.p[c])) + 1)"
    return rf"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), thirds AS MATERIALIZED (
  SELECT r, i, w[i:i + 2] AS three FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, three) AS k FROM thirds) WHERE k > 1) GROUP BY 1
), inside AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM
    (SELECT *, count(*) OVER (PARTITION BY r, three, (i - 1) // {window}) AS k FROM thirds WHERE (i - 1) % {window} <= {window - 3}) WHERE k > 1) GROUP BY 1
), words AS (
  SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs)
), distinct_words AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, (i - 1) // {window}, word FROM words) GROUP BY 1
), lines AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS different FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), measured AS (
  SELECT docs.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.n - different, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         greatest(len(w), 1)::DOUBLE AS per, coalesce(lines.n, 1)::DOUBLE AS per_line, coalesce(inside.n, 0) AS n_inside, coalesce(distinct_words.n, 0) AS n_distinct,
         len(regexp_extract_all(text, '!')) AS n_bangs, len(regexp_extract_all(text, '[.!?]')) AS n_stops
  FROM docs LEFT JOIN covered USING (r) LEFT JOIN inside USING (r) LEFT JOIN distinct_words USING (r) LEFT JOIN lines USING (r)
), shares AS (
  SELECT *, word_chars / per AS mean_word, (CASE WHEN n_words > 0 THEN n_symbols ELSE 0 END) / per AS symbol_share, n_dup_lines / per_line AS dup_line_share, n_inside / per AS repeat_share,
         n_distinct / per AS distinct_share, (CASE WHEN n_words > 0 THEN n_bangs ELSE 0 END) / per AS bang_share, (CASE WHEN n_words > 0 THEN n_stops ELSE 0 END) / per AS stop_share
  FROM measured
), voted AS MATERIALIZED (
  SELECT *, [{vote}] AS votes FROM shares
), patterns AS MATERIALIZED (
  SELECT list({{'votes': votes, 'n': n}}) AS all_ FROM (SELECT votes, count(*)::DOUBLE AS n FROM voted GROUP BY 1 ORDER BY 1)
), em AS (
  SELECT 0 AS round, {start["share"]}::DOUBLE[] AS share, {start["bad"]}::DOUBLE[][] AS bad
  UNION ALL
  SELECT round + 1,
    list_transform(range(1, {rules + 2}), lambda c: (list_sum(list_transform(seen, lambda x: x.p[c])) + 0.001 * total) / (total * {1 + 0.001 * (rules + 1)!r}::DOUBLE)),
    list_transform(range(1, {rules + 2}), lambda c: list_transform(range(1, {rules + 1}), lambda k:
      (list_sum(list_transform(seen, lambda x: CASE WHEN x.v[k] < 0 THEN x.p[c] ELSE 0 END)) + {weight} * CASE WHEN c = 1 THEN 0.01::DOUBLE WHEN k = c - 1 THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END)
      / (list_sum(list_transform(seen, lambda x: CASE WHEN x.v[k] <> 0 THEN x.p[c] ELSE 0 END)) + {weight})))
  FROM (
    SELECT round, list_transform(joined, lambda x: {{'v': x.v, 'p': list_transform(x.j, lambda y: x.n * y / list_sum(x.j))}}) AS seen, list_sum(list_transform(joined, lambda x: x.n)) AS total
    FROM (SELECT round, list_transform(all_, lambda p: {{'v': p.votes, 'n': p.n, 'j': {joint.format(v="p.votes")}}}) AS joined FROM em, patterns WHERE round < {weak_quality.ROUNDS})
  )
), model AS (
  SELECT share, bad FROM em WHERE round = {weak_quality.ROUNDS}
), judged AS (
  SELECT voted.*, {joint.format(v="votes")} AS j, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM voted, model
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND j[1] / list_sum(j) >= 0.5 AS kept, round(j[1] / list_sum(j), 6) AS quality FROM judged
"""


MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS text_md5,
         row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, ''))) - 1 AS nth FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sources
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
         , row_number() OVER (ORDER BY source_size / weight, rank) AS place
  FROM ranked
), water AS (
  SELECT arg_min(level, place) FILTER (WHERE level * weight <= 3 * source_size) AS level FROM levels
), targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, water.level * weight) AS target FROM levels, water
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || text_md5 || ':' || nth), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken FROM rated
"""

CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
), clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said
), parts AS (
  SELECT *, length('<turn >') + length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g'))
            + length(replace(replace(replace(text, '\', '\s'), '<', '\l'), '>', '\g')) + length('</turn>') + 1 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM clean
), sums AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM parts
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(so_far) FILTER (WHERE role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM sums GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_near_dedup": MINHASH,
        "op3_sharding": SHARDING,
        "op4_source_mixing": MIXING,
        "op5_secret_scan": _secrets(),
        "op6_embedding_near_dedup": EMBEDDINGS,
        "op7_quality_rules": _quality(),
        "op10_chat_format": CHAT,
    }
