"""The registered queries of this subpackage and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, decontaminate, licenses, minhash, quality, repair, rules, sharding, spelling, tokens, topk, toxicity, warc
from panelspark.llm.common import Scratch, read

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingle_sql(table: str, key: str, lower: str = _LOWER) -> str:
    """Distinct (key, shingle) rows of a table with a text."""
    return f"""
  SELECT DISTINCT id, unnest(CASE
           WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
           ELSE []::VARCHAR[] END) AS s
  FROM (SELECT {key} AS id,
               list_filter(regexp_split_to_array({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM {table} WHERE text IS NOT NULL)"""


SQL_OP1 = f"""
WITH RECURSIVE sh AS ({_shingle_sql('documents', 'doc_id')}),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pairs AS (
  SELECT a.id AS a, b.id AS b, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.id = a JOIN n y ON y.id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
       least(doc_id, coalesce(low, doc_id))::BIGINT AS component_id,
       doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN low ON low.a = doc_id"""

SQL_OP2 = f"""
WITH d AS ({_shingle_sql('documents', 'doc_id', 'lower(text)')}),
i AS ({_shingle_sql('benchmark', 'item_id', 'lower(text)')}),
n AS (SELECT id, count(*) AS q FROM i GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(q)::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_contained,
       count(*)::DOUBLE / any_value(q)::DOUBLE AS containment
FROM d JOIN i ON d.s = i.s JOIN n ON n.id = i.id GROUP BY d.id, i.id HAVING 100 * count(*) >= 75 * any_value(q)"""

SQL_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""

SQL_OP9 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT d, n, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN response IS DISTINCT FROM page_id AND response IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN response IS DISTINCT FROM page_id THEN response END::BIGINT AS refers_to
FROM p LEFT JOIN r ON r.d = p.d AND r.n = p.n"""

_WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_RULES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS_SQL} AS w FROM documents),
win AS (SELECT r, i, w[i:i + 2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM win QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
rep AS (SELECT r, count(DISTINCT pos) AS n FROM again GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
f AS (
  SELECT * EXCLUDE (l), (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
         + 8 * (100 * n_dup_lines > 40 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
         + 32 * (word_chars > 20 * n_words)::BIGINT AS failed FROM m)"""

SQL_OP11 = f"""{_RULES_SQL}
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, 'prose-2' AS policy FROM f"""

SQL_ABLATIONS = f"""{_RULES_SQL},
r(rule, bit) AS (VALUES ('few_words', 0), ('repeated_words', 1), ('many_symbols', 2), ('repeated_lines', 3), ('short_words', 4), ('long_words', 5))
SELECT rule, bit::INTEGER AS bit, count(*) FILTER (WHERE failed & (1 << bit) <> 0) AS failed,
       count(*) FILTER (WHERE failed = 1 << bit) AS decisive,
       coalesce(sum(n_words) FILTER (WHERE failed = 1 << bit), 0)::BIGINT AS decisive_words,
       count(*) FILTER (WHERE failed & (63 - (1 << bit)) = 0) AS kept_without,
       coalesce(bit_and(failed) FILTER (WHERE failed & (1 << bit) <> 0), 63)::BIGINT AS always_with,
       (63 - coalesce(bit_or(failed) FILTER (WHERE failed & (1 << bit) <> 0), 0))::BIGINT AS never_with
FROM r LEFT JOIN f ON true GROUP BY rule, bit"""


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text of code points below U+0100, a byte at a time."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    units = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)"
    units = f"flatten(list_transform({units}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
    step = f"xor(a >> 8, ({table}::BIGINT[])[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {units}), lambda a, b: {step}), 4294967295)"


def _repair_sql() -> str:
    """The cheapest edits by going through each conversation row by row, with the cheapest and least edits up to each state."""

    def least(options: list[tuple[str, int, str]]) -> str:
        """Of ``(cost and edits so far, cost, edit)`` the cheapest, then least in ASCII."""
        made = [f"CASE WHEN {c} IS NOT NULL THEN struct_pack(c := {c}.c + {n}, e := {c}.e || '{e}') END" for c, n, e in options]
        return f"list_min(list_filter([{', '.join(made)}], lambda x: x IS NOT NULL))"

    def edit(s: str) -> str:
        """A row's step from the states after it may have had inserts before it."""
        keep = {1: ("s", ["s0"]), 2: ("u", ["s0", "s1", "s3"]), 3: ("a", ["s2"])}
        state = int(s[1])
        stay = [(s, 3, "D")]
        change = {2: [(x, "2 + t", "R") for x in ("s0", "s1", "s3")], 3: [("s2", "2 + t", "R")]}.get(state, [])
        kept = [(x, "t", "K") for x in keep[state][1]] if state in keep else []
        initial = keep[state][0] if state in keep else ""
        return f"""CASE WHEN must THEN {least(stay)} WHEN initial = '{initial}' THEN {least(stay + change + kept)}
                   ELSE {least(stay + change)} END"""

    insert_u = least([("s2", 0, ""), ("s0", 2, "I"), ("s1", 2, "I"), ("s3", 2, "I")])
    insert_a = least([("s3", 0, ""), ("s2", 2, "I")])
    key = _crc32_sql("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} % 20 AS kind FROM conversations),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM k WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
  FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again)),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM o),
f AS (
  SELECT *, left(role, 1) AS initial, trimmed = '' OR dup AS must, trimmed = '' AS blank,
         trimmed <> '' AND NOT dup AND right(trimmed, 1) NOT IN ('.', '!', '?') AS cut, CASE WHEN cut THEN 1 ELSE 0 END AS t FROM d),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE dup AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
         count(*) FILTER (WHERE i > 1 AND left(before, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
run AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, struct_pack(c := 0, e := '') AS s0, NULL::STRUCT(c INTEGER, e VARCHAR) AS s1,
         NULL::STRUCT(c INTEGER, e VARCHAR) AS s2, NULL::STRUCT(c INTEGER, e VARCHAR) AS s3 FROM f
  UNION ALL
  SELECT conv_id, i, {edit('s0')}, {edit('s1')}, {edit('s2')}, {edit('s3')} FROM (
    SELECT conv_id, f.i, initial, must, t, s0, s1, s2, {insert_a} AS s3 FROM (
      SELECT conv_id, i, s0, s1, s3, {insert_u} AS s2 FROM run) r JOIN (SELECT conv_id AS conv, i, initial, must, t FROM f) f
      ON conv IS NOT DISTINCT FROM conv_id AND f.i = r.i + 1)),
ends AS (SELECT conv_id, s0, s1, s2, s3 FROM run QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
best AS (
  SELECT conv_id, list_min(list_filter([s0, {insert_a}], lambda x: x IS NOT NULL)) AS b
  FROM (SELECT conv_id, s0, s1, s3, {insert_u} AS s2 FROM ends)),
edits AS (
  SELECT conv_id, pos, substr(e, pos, 1) AS edit, count(*) FILTER (WHERE edit <> 'I') OVER p AS i,
         count(*) FILTER (WHERE edit <> 'D') OVER p AS place
  FROM (SELECT conv_id, b.e AS e, unnest(range(1, length(b.e) + 1)) AS pos FROM best)
  WINDOW p AS (PARTITION BY conv_id ORDER BY pos)),
made AS (
  SELECT e.conv_id, pos, place, edit, role, text, initial, max(CASE WHEN edit = 'K' AND place = 1 AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN (SELECT conv_id AS conv, i, role, text, initial FROM f) f ON conv IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND edit <> 'I'
  WHERE edit <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END END
                             || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS text FROM made GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(lines.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM c.conv_id"""


SQL_OP12 = _repair_sql()

SQL_OP13 = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL)
  WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, {_crc32_sql("concat(coalesce(doc_id::VARCHAR, ''), ':', run)")} AS h FROM r),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
one AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM one GROUP BY word),
form AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
         CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (
  SELECT word, word AS root FROM form
  UNION ALL SELECT up.word, form.form FROM up JOIN form ON form.word = up.root WHERE form.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM form
JOIN (SELECT word, root FROM up WHERE root IN (SELECT word FROM form WHERE form IS NULL)) USING (word)"""


def _licence_sql() -> str:
    """Lines, whole texts and runs of as many words as a template, against every template.

    Runs are listed for the pairs of text and template that any run can reach the threshold for, which is exact.
    """
    vectors, idf, other, _ = licenses.template_vectors()
    lengths = [(name, number, length) for (name, number), (length, _) in licenses._by_template(licenses.TEMPLATES).items()]
    least = licenses.THRESHOLD

    def rows(values: list[tuple]) -> str:
        return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in values)

    words = "list_filter(regexp_split_to_array(lower(unit), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""
WITH t(licence, template, word, t) AS (VALUES {rows(vectors)}),
lengths(licence, template, n) AS (VALUES {rows(lengths)}),
idf(word, idf) AS (VALUES {rows(sorted(idf.items()))}),
f AS (SELECT doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), doc_id::VARCHAR) AS path, text FROM documents),
fw AS (SELECT path, {words.replace('unit', 'text')} AS ws FROM f WHERE text IS NOT NULL),
likely AS (
  SELECT path, licence, template FROM (SELECT DISTINCT path, unnest(ws) AS word FROM fw) JOIN t USING (word)
  GROUP BY ALL HAVING sum(t * t) >= {least * least - 1e-6!r}::DOUBLE),
starts AS (
  SELECT path, s.licence, s.template, pos, list_slice(ws, pos, pos + n - 1) AS ws
  FROM (SELECT path, licence, template, n, ws, unnest(range(1, len(ws) + 1)) AS pos FROM likely JOIN fw USING (path) JOIN lengths USING (licence, template)) s
  JOIN t ON t.licence = s.licence AND t.template = s.template AND t.word = ws[pos]),
run AS (
  SELECT path, licence, template, pos FROM (SELECT path, licence, template, pos, unnest(ws) AS word FROM starts)
  LEFT JOIN idf USING (word) LEFT JOIN t USING (licence, template, word)
  GROUP BY ALL HAVING sum(coalesce(idf * t, 0)) >= {least - 1e-6!r}::DOUBLE * sqrt(sum(coalesce(idf, {other!r}::DOUBLE) * coalesce(idf, {other!r}::DOUBLE)))),
u AS (
  SELECT DISTINCT path, whole, {words} AS ws FROM (
    SELECT path, false AS whole, unnest(regexp_split_to_array(text, '\r?\n')) AS unit FROM f
    UNION ALL SELECT path, true, text FROM f)
  UNION SELECT path, false, ws FROM starts JOIN run USING (path, licence, template, pos)),
tf AS (SELECT path, whole, ws, word, count(*) AS tf FROM (SELECT path, whole, ws, unnest(ws) AS word FROM u) GROUP BY ALL),
w AS (SELECT path, whole, ws, tf.word, tf * coalesce(idf, {other!r}::DOUBLE) AS w FROM tf LEFT JOIN idf ON idf.word = tf.word),
norms AS (SELECT path, whole, ws, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dots AS (SELECT path, whole, ws, licence, template, sum(w * t) AS dot FROM w JOIN t ON t.word = w.word GROUP BY ALL),
s AS (
  SELECT path, whole, licence, round(dot / norm, 6) AS score FROM dots JOIN norms USING (path, whole, ws)
  WHERE round(dot / norm, 6) >= {licenses.THRESHOLD}),
own AS (
  SELECT path, arg_min(licence, (-score, licence)) AS licence, max(score) AS score, bool_or(whole) AS whole FROM s GROUP BY path),
dir AS (
  SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, arg_min(licence, (-score, path)) AS from_dir,
         arg_min(path, (-score, path)) AS licence_path
  FROM own WHERE whole OR regexp_matches(path, '{licenses.LICENCE_NAMES}') GROUP BY 1),
near AS (
  SELECT path, from_dir, licence_path FROM f JOIN dir ON starts_with(path, CASE WHEN dir = '' THEN '' ELSE dir || '/' END)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(dir) DESC) = 1)
SELECT doc_id, coalesce(own.licence, from_dir) AS licence,
       CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN from_dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS found,
       score, CASE WHEN own.licence IS NULL THEN near.licence_path END AS licence_path
FROM f LEFT JOIN own USING (path) LEFT JOIN near USING (path)"""


def _licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(licenses.document_files(read(spark, folder, "documents")))
    doc_id = F.element_at(F.split("path", "/"), -1).cast("bigint")
    return found.select(doc_id.alias("doc_id"), "licence", "found", "score", "licence_path")


def _pages_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = Scratch(spark, "archives").path("warc")
    warc.write_warc(read(spark, folder, "pages"), path)
    return warc.archive_index(spark, path)


def _token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("files")
    tokens.write_tokens(read(spark, folder, "documents"), tokenizer(), path)
    rows = tokens.read_tokens(spark, path)
    return tokens.global_starts(tokens.checksums(rows), rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations")
    return repair.repair(repair.damage(rows), rows.select("conv_id"))[1]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": lambda s, d: minhash.near_duplicates(read(s, d, "documents")),
        "op2_contaminated": lambda s, d: decontaminate.contaminated(read(s, d, "documents"), read(s, d, "benchmark")),
        "op3_bpe_round_trip": lambda s, d: bpe.round_trip_digests(read(s, d, "documents"), tokenizer()),
        "op4_quality_sample": lambda s, d: quality.quality(read(s, d, "documents"), read(s, d, "labels")).drop("draw"),
        "op5_exact_top_k": lambda s, d: topk.exact_top_k(read(s, d, "embeddings"), F.col("vec_id") % 50 == 0),
        "op6_toxicity": lambda s, d: toxicity.toxicity(read(s, d, "documents"), read(s, d, "labels")),
        "op7_licences": _licences,
        "op8_kd_shards": lambda s, d: sharding.kd_shards(read(s, d, "documents")),
        "op9_warc_round_trip": _pages_round_trip,
        "op10_token_files": _token_files,
        "op11_rule_ledger": lambda s, d: rules.judged(read(s, d, "documents")),
        "op12_conversation_repair": _repaired,
        "op13_spelling_variants": lambda s, d: spelling.spelling_variants(read(s, d, "documents")),
        "rule_ablations": lambda s, d: rules.ablations(rules.ledger(read(s, d, "documents")), rules.POLICIES["prose"]),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": SQL_OP1,
        "op2_contaminated": SQL_OP2,
        "op5_exact_top_k": SQL_OP5,
        "op7_licences": _licence_sql(),
        "op9_warc_round_trip": SQL_OP9,
        "op11_rule_ledger": SQL_OP11,
        "op12_conversation_repair": SQL_OP12,
        "op13_spelling_variants": SQL_OP13,
        "rule_ablations": SQL_ABLATIONS,
    }
