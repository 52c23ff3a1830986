"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i + 1 : i + 35], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 34, 0))) AS i FROM words)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, list(DISTINCT i) AS s FROM windows JOIN again USING (h) GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(35)) AS p FROM (SELECT doc_id, unnest(s) AS i FROM starts)),
gone_list AS (SELECT doc_id, list(p) AS p FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS k, count(*) AS n FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

ORACLES["op7_near_duplicates"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
texts AS (SELECT min(doc_id) AS id, t, any_value(w) AS w FROM words GROUP BY t),
sh AS (
  SELECT DISTINCT id, hash(array_to_string(w[i + 1 : i + 5], ' ')) AS h
  FROM (SELECT id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [0] ELSE range(len(w) - 4) END) AS i FROM texts)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
links AS (
  SELECT a.id AS u, b.id AS v
  FROM sh a JOIN sh b ON a.h = b.h AND a.id <> b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id
  GROUP BY a.id, b.id, na.n, nb.n HAVING count(*) >= 0.8 * (na.n + nb.n - count(*))),
reach AS (SELECT id AS u, id AS v FROM texts UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
class AS (SELECT u AS id, min(v) AS class_id FROM reach GROUP BY u)
SELECT words.doc_id, class.class_id FROM words JOIN texts USING (t) JOIN class USING (id)
"""

ORACLES["op9_chat_format"] = r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
spelt AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') AS er,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') AS et
  FROM own)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(er) + length(et) + length('<s>[INST][/INST]</s>'))::BIGINT AS formatted_chars
FROM spelt GROUP BY conv_id
"""

ORACLES["op3_voronoi_knn"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLES["op4_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT *, octet_length(encode(html))::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last,
    list_transform(range(8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::INT) AS fives
  FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((fives[(1 + i // 4)::INT] >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""


def _quality_sql() -> str:
    from .quality import RULES

    tries = len(next(iter(RULES.values()))[2])
    value = lambda r: f"CASE WHEN {RULES[r][1]} > 0 THEN {RULES[r][0]} / {RULES[r][1]} ELSE 0 END"
    grid = ", ".join(f"('{r}', {j}, {c}::DOUBLE)" for r, (_, _, cuts) in RULES.items() for j, c in enumerate(cuts))
    measures = " UNION ALL ".join(f"SELECT doc_id, lang, good, '{r}' AS rule, {value(r)} AS v FROM labelled" for r in RULES)
    above = " OR ".join(f"coalesce({value(r)} > c.cut_{r}, false)" for r in RULES)
    cuts = ", ".join(f"max(cut) FILTER (WHERE rule = '{r}') AS cut_{r}" for r in RULES)
    rate = 0.05 / len(RULES)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 0))) AS i FROM w)),
twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(5)) AS p FROM windows SEMI JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(regexp_extract_all(t, '\p{{Lu}}{{3,}}'))::BIGINT AS n_capital_words, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
good AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT * FROM m JOIN good USING (doc_id)),
v AS ({measures}),
grid(rule, j, cut) AS (VALUES {grid}),
strata AS (SELECT count(DISTINCT coalesce(lang, chr(0))) AS s FROM labelled),
tests AS (
  SELECT lang, v.rule, j, cut, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND v > cut) AS k, count(*) FILTER (WHERE NOT good AND v > cut) AS b
  FROM v JOIN grid ON v.rule = grid.rule GROUP BY lang, v.rule, j, cut),
passed AS (
  SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY b DESC, j) AS place FROM tests, strata
  WHERE b > 0 AND k < n * {rate} AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate})))) <= 0.05 / {len(RULES) * tries} / s),
c AS (SELECT lang, {cuts} FROM passed WHERE place = 1 GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ({above}) AS kept
FROM m LEFT JOIN c ON m.lang IS NOT DISTINCT FROM c.lang
"""


ORACLES["op10_quality_rules"] = _quality_sql()


def _hilbert_steps(table: str, bits: int) -> tuple[str, str]:
    """CTEs that turn the coordinates x0, x1, x2 of ``table`` into their Hilbert place, one step each; and the last one's name."""
    steps = []

    def add(replaced: str) -> None:
        steps.append(f"h{len(steps)} AS (SELECT * REPLACE ({replaced}) FROM {f'h{len(steps) - 1}' if steps else table})")

    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(3):
            is_set = f"(x{i} >> {level}) & 1 = 1"
            if i == 0:
                add(f"CASE WHEN {is_set} THEN xor(x0, {low}) ELSE x0 END AS x0")
            else:
                add(f"CASE WHEN {is_set} THEN xor(x0, {low}) ELSE xor(x0, xor(x0, x{i}) & {low}) END AS x0, CASE WHEN {is_set} THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {low}) END AS x{i}")
    add("xor(x1, x0) AS x1, xor(x2, xor(x1, x0)) AS x2")
    turn = "0"
    for level in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN (x2 >> {level}) & 1 = 1 THEN {(1 << level) - 1} ELSE 0 END)"
    add(", ".join(f"xor(x{i}, {turn}) AS x{i}" for i in range(3)))
    place = " + ".join(f"((x{i} >> {level}) & 1) * {1 << (3 * level + 2 - i)}" for level in range(bits) for i in range(3))
    last = f"h{len(steps)}"
    steps.append(f"{last} AS (SELECT *, {place} AS place FROM h{len(steps) - 1})")
    return ",\n".join(steps), last


def _crc_table() -> list[int]:
    """The table of CRC-32 by bytes, from its polynomial."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
        table.append(byte)
    return table


def _sharding_sql(shards: int = 8) -> str:
    from .sharding import BITS, BUCKETS

    steps, last = _hilbert_steps("cells", BITS)
    side = 1 << BITS
    crc = f"list_reduce(list_transform(range(octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), (2 * i + 1)::INT, 2))::BIGINT), lambda a, b: xor(a >> 8, ({_crc_table()})[(xor(a, b) & 255) + 1]), 4294967295)"
    rank = lambda d: f"SELECT {d}, floor((row_number() OVER (ORDER BY {d} NULLS FIRST) - 1) * {side}.0 / greatest(count(*) OVER (), {side}))::BIGINT AS c FROM (SELECT DISTINCT {d} FROM g)"
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, md5(t) AS key, min(source) AS d0, min(lang) AS d1, octet_length(encode(t)) + 1 AS each, count(*) AS members FROM d GROUP BY t),
r0 AS ({rank("d0")}), r1 AS ({rank("d1")}),
cells AS (
  SELECT t, key, each * members AS bytes, r0.c AS x0, r1.c AS x1, least(2 * (length(bin(each)) - 1) + (substr(bin(each), 2, 1) = '1')::INT, {side - 1})::BIGINT AS x2
  FROM g JOIN r0 ON g.d0 IS NOT DISTINCT FROM r0.d0 JOIN r1 ON g.d1 IS NOT DISTINCT FROM r1.d1),
{steps},
placed AS (
  SELECT t, place, key, least(floor((2 * (sum(bytes) OVER w - bytes) + bytes)::BIGINT * {shards} / (2.0 * sum(bytes) OVER ())::DOUBLE), {shards - 1})::INT AS shard
  FROM {last} WINDOW w AS (ORDER BY place, key)),
crc AS (SELECT t, xor({crc}, 4294967295)::BIGINT AS text_crc32 FROM g)
SELECT doc_id, (octet_length(encode(t)) + 1)::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY place, key, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {BUCKETS}, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN placed USING (t) JOIN crc USING (t)
"""


ORACLES["op8_hilbert_shards"] = _sharding_sql()


def _url_sql(levels: int = 12, many: int = 8, rare: float = 0.05, similar: float = 0.2, z: float = 2.58, smoothing: float = 4.0, reject: float = 0.5) -> str:
    """The template tree, unrolled for paths of at most ``levels`` segments."""
    from .queries import URL_RULES

    host = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"
    shape = lambda x: f"substr(regexp_replace(regexp_replace({x}, '\\p{{N}}+', '0', 'g'), '\\p{{L}}+', 'a', 'g'), 1, 8)"
    likely = lambda b, n: f"(CASE WHEN {b} > 0 THEN {b} * ln({b} / ({n})::DOUBLE) ELSE 0.0 END + CASE WHEN ({n}) - ({b}) > 0 THEN (({n}) - ({b})) * ln((({n}) - ({b})) / ({n})::DOUBLE) ELSE 0.0 END)"
    others, other_bad = "(all_seen - seen)", "(all_bad - bad)"
    rounds, done = [], ["SELECT host, path, template, seen, bad FROM rows0 WHERE len(segments) = 0"]
    for i in range(levels):
        rounds.append(f"""
now{i} AS (SELECT *, coalesce(segments[{i + 1}], '') AS segment, {shape(f"coalesce(segments[{i + 2}], '')")} AS next FROM rows{i} WHERE len(segments) > {i}),
shapes{i} AS (SELECT host, template, segment, next, sum(n) AS n, sum(seen) AS seen, sum(bad) AS bad, count(*) AS paths FROM now{i} GROUP BY ALL),
branch{i} AS (SELECT host, template, segment, sum(n) AS n, sum(seen) AS seen, sum(bad) AS bad, sum(paths) AS paths FROM shapes{i} GROUP BY ALL),
node{i} AS (SELECT host, template, count(*) AS children, sum(n) AS all_n, sum(seen) AS all_seen, sum(bad) AS all_bad FROM branch{i} GROUP BY ALL),
pool{i} AS (SELECT host, template, next, sum(n) AS pool_n FROM shapes{i} GROUP BY ALL),
alike{i} AS (SELECT host, template, segment, sum(sqrt(n * pool_n / all_n::DOUBLE)) AS common FROM shapes{i} JOIN pool{i} USING (host, template, next) JOIN (SELECT host, template, all_n FROM node{i}) USING (host, template) GROUP BY ALL),
judged{i} AS (
  SELECT *, sqrt(greatest(0.0, 1 - common / sqrt(n))) AS distance, CASE WHEN all_seen > 0 THEN all_bad / all_seen::DOUBLE ELSE 0.0 END AS pooled,
    CASE WHEN seen > 0 AND {others} > 0 THEN abs(bad / seen::DOUBLE - {other_bad} / {others}::DOUBLE) ELSE 0.0 END AS gap,
    {others} > 0 AND {likely("bad", "seen")} + {likely(other_bad, others)} - {likely("all_bad", "all_seen")} > {z * z / 2} + ln(children) AS telling
  FROM branch{i} JOIN node{i} USING (host, template) JOIN alike{i} USING (host, template, segment)),
named{i} AS (
  SELECT host, template, segment, paths,
    (children > {many} AND n < {rare}::DOUBLE * all_n AND NOT telling)
    OR (children > 1 AND distance <= {similar} AND gap <= {z}::DOUBLE * sqrt(pooled * (1 - pooled) * (CASE WHEN seen > 0 THEN 1 / seen::DOUBLE ELSE 0.0 END + CASE WHEN {others} > 0 THEN 1 / {others}::DOUBLE ELSE 0.0 END))) AS wild
  FROM judged{i}),
all{i} AS (
  SELECT host, path, n, seen, bad, segments, NOT wild AND paths = 1 AS alone, template || '/' || CASE WHEN wild THEN '*' ELSE segment END
    || CASE WHEN NOT wild AND paths = 1 AND len(segments) > {i + 1} THEN '/' || array_to_string(segments[{i + 2} :], '/') ELSE '' END AS template
  FROM now{i} JOIN named{i} USING (host, template, segment)),
rows{i + 1} AS (SELECT host, path, n, seen, bad, segments, template FROM all{i} WHERE NOT alone AND len(segments) > {i + 1})""")
        done.append(f"SELECT host, path, template, seen, bad FROM all{i} WHERE alone OR len(segments) = {i + 1}")
    fits = sorted(URL_RULES, key=lambda r: -len(r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{value(w, r)}'" for w, r in fits) + " END"
    return f"""
WITH p AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
known AS (
  SELECT host, path, (quality = 0 OR toxic = 1)::INT AS bad FROM (SELECT *, try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) AS BIGINT) AS doc_id FROM p) JOIN labels USING (doc_id)
  WHERE (quality = 0 OR toxic = 1) IS NOT NULL),
u AS (SELECT host, path, NULL::INT AS bad FROM p UNION ALL SELECT * FROM known),
rows0 AS (SELECT host, path, count(*) AS n, count(bad) AS seen, coalesce(sum(bad), 0) AS bad, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments, '' AS template FROM u GROUP BY host, path),
{",".join(rounds)},
tree AS ({" UNION ALL ".join(done)}),
by_template AS (SELECT host, template, sum(seen) AS seen, sum(bad) AS bad FROM tree GROUP BY ALL),
by_host AS (SELECT host, sum(seen) AS host_seen, sum(bad) AS host_bad FROM by_template GROUP BY ALL),
whole AS (SELECT CASE WHEN sum(host_seen) > 0 THEN sum(host_bad) / sum(host_seen)::DOUBLE ELSE 0.0 END AS prior FROM by_host),
part AS (SELECT host, template, (bad + {smoothing}::DOUBLE * (host_bad + {smoothing}::DOUBLE * prior) / (host_seen + {smoothing}::DOUBLE)) / (seen + {smoothing}::DOUBLE) AS part FROM by_template JOIN by_host USING (host), whole)
SELECT page_id, host, path, {case(lambda w, r: r)} AS rule, coalesce({case(lambda w, r: w)}, CASE WHEN part >= {reject} THEN 'block' ELSE 'allow' END) AS verdict, template, round(part, 6) AS bad_part
FROM p JOIN tree USING (host, path) JOIN part USING (host, template)
"""


ORACLES["op5_url_filter"] = _url_sql()
