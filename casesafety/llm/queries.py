"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, html, language, licenses, manifest, mixing, nearest, quality, simhash, tokens, topk, toxicity
from .common import table


#: A public vocabulary, by its place on this machine; read by the driver only.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _remainder(by: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str, model_file: str = TOKENIZER) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.read_pieces(model_file))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: of ten neighbours one directory, of ten directories one above, and so on; the first file of a directory is its LICENSE."""
    up = lambda by: F.floor(F.col("doc_id") / by).cast("string")
    top, middle, low = F.concat_ws("/", F.coalesce("source", F.lit("none")), up(1000)), F.concat_ws("/", F.lit(""), up(100)), F.concat_ws("/", F.lit(""), up(10))
    first = lambda by: F.pmod(F.col("doc_id"), F.lit(by)) == 0
    path = F.when(first(1000), F.concat(top, F.lit("/LICENSE"))).when(first(100), F.concat(top, middle, F.lit("/LICENSE"))).when(first(10), F.concat(top, middle, low, F.lit("/LICENSE"))).otherwise(F.concat(top, middle, low, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), path.alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("key", "doc_id")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("id % 50 = 0"), 5).withColumnRenamed("id", "vec_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels.where(_remainder(3) != 1))
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    return quality.quality_scores(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(_remainder(4) != 2))
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    return toxicity.toxicity_scores(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), manifest.without_newlines())


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = nearest.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest.nearest(vectors, vectors.where("id % 100 = 0"), 10).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language": op2_language,
    "op3_html_extraction": op3_html_extraction,
    "op4_token_counts": op4_token_counts,
    "op5_license_scan": op5_license_scan,
    "op6_top_k": op6_top_k,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_nearest": op13_nearest,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_TEMPLATES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(licenses.TEMPLATES))
_TELLING = ", ".join(f"({k}, '{term}')" for k, mine in enumerate(licenses.telling_terms()) for term in sorted(mine))
_FILES = """SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN top || '/LICENSE' WHEN doc_id % 100 = 0 THEN top || middle || '/LICENSE' WHEN doc_id % 10 = 0 THEN top || middle || low || '/LICENSE'
                  ELSE top || middle || low || '/' || doc_id || '.txt' END AS path
  FROM (SELECT *, coalesce(source, 'none') || '/' || doc_id // 1000 AS top, '/' || doc_id // 100 AS middle, '/' || doc_id // 10 AS low FROM documents)"""



def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters."""
    byte = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte}), lambda a, b: {bits}), 4294967295)"


#: States: 0 nothing, 1 a first s, 2 a u, 3 an a stands in front. What is inserted before a row, and the state then.
_INSERTED = "(0, 0, '', 0, ''), (0, 2, 'I', 5, 'user:' || chr(10) || ''), (0, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10) || ''), (1, 1, '', 0, ''), (1, 2, 'I', 5, 'user:' || chr(10) || ''), (1, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10) || ''), (2, 2, '', 0, ''), (2, 3, 'I', 5, 'assistant:' || chr(10) || ''), (3, 3, '', 0, ''), (3, 2, 'I', 5, 'user:' || chr(10) || '')"


def _leaf(text: str) -> str:
    values = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')" for x in values) + ")"


def _rising(name: str, first: str) -> str:
    """Every level of the trees over ``first`` (tree, level, place, node, n)."""
    return f"""{name} AS ({first} UNION ALL SELECT tree, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, place // 3, n)"""


def _falling(name: str, first: str, nodes: str) -> str:
    """From each of ``first`` (id, tree, level, place, now, proof) up to its tree's root."""
    return f"""{name} AS ({first} UNION ALL SELECT id, f.tree, f.level + 1, f.place // 3, sha256(string_agg(CASE WHEN s.place = f.place THEN now ELSE node END, '' ORDER BY s.place)), proof || coalesce(string_agg(node, '' ORDER BY s.place) FILTER (s.place <> f.place), '')
  FROM {name} f JOIN {nodes} s ON s.tree = f.tree AND s.level = f.level AND s.place // 3 = f.place // 3 AND s.n > 1 GROUP BY id, f.tree, f.level, f.place, f.now, f.proof)"""


ORACLE_SQL: dict[str, str] = {
    "op13_nearest": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, d.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT *, coalesce('s' || source, 'n') AS tree, row_number() OVER () AS id, {_leaf("text")} AS leaf FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE leaf END AS other FROM d),
{_rising("low", "SELECT tree, 0 AS level, place, leaf AS node, n FROM leaves")},
{_rising("high", "SELECT '' AS tree, 0 AS level, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, node, count(*) OVER () AS n FROM low WHERE n = 1")},
{_falling("inside", "SELECT id, tree, 0 AS level, place, other AS now, '' AS proof FROM leaves", "low")},
tops AS (SELECT tree, node, level, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM low WHERE n = 1),
{_falling("outside", "SELECT id, '' AS tree, 0 AS level, t.place, now, proof FROM inside i JOIN tops t ON i.tree = t.tree AND i.level = t.level", "high")},
whole AS (SELECT level, node FROM high WHERE n = 1)
SELECT doc_id, leaf, tops.node AS subroot, whole.node AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = whole.node AS verified
FROM leaves l JOIN tops ON l.tree = tops.tree JOIN outside o ON o.id = l.id JOIN whole ON o.level = whole.level""",
    "op11_conversation_repair": f"""
WITH RECURSIVE fate AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations),
spoilt AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fate),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM spoilt),
rows AS (SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered),
inserted(s, t, edits, cost, lines) AS (VALUES {_INSERTED}),
edit(letter) AS (VALUES ('D'), ('K'), ('R')),
best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'out': ''}} AS b FROM conversations
  UNION ALL
  SELECT conv_id, n, t, min(b) FROM (
    SELECT best.conv_id, r.n, CASE WHEN letter = 'D' THEN i.t WHEN letter = 'R' THEN CASE i.t WHEN 2 THEN 3 ELSE 2 END
        WHEN initial = 's' AND i.t = 0 THEN 1 WHEN initial = 'u' AND i.t <> 2 THEN 2 WHEN initial = 'a' AND i.t = 2 THEN 3 END AS t,
      {{'cost': CAST(best.b.cost + i.cost + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS BIGINT), 'audit': best.b.audit || i.edits || letter,
        'out': best.b.out || i.lines || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE CASE i.t WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || text || chr(10) END}} AS b
    FROM best JOIN rows r ON best.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = best.n + 1 JOIN inserted i ON i.s = best.s, edit
    WHERE letter = 'D' OR fault NOT IN ('blank', 'duplicate')) WHERE t IS NOT NULL GROUP BY ALL),
size AS (SELECT c.conv_id, count(n) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rows r ON c.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY c.conv_id),
pairs AS (SELECT a.conv_id, count(*) AS illegal FROM rows a JOIN rows b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.n = a.n + 1 WHERE a.initial || b.initial NOT IN ('su', 'ua', 'au') GROUP BY a.conv_id),
ended AS (SELECT conv_id, n, min({{'cost': b.cost + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': b.audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'out': b.out || CASE s WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END}}) AS b FROM best GROUP BY ALL)
SELECT size.conv_id, gaps, blank, duplicate, truncated, coalesce(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit, sha256(left(b.out, greatest(0, length(b.out) - 1))) AS repaired_sha256
FROM size JOIN ended e ON size.conv_id IS NOT DISTINCT FROM e.conv_id AND e.n = size.size LEFT JOIN pairs ON size.conv_id IS NOT DISTINCT FROM pairs.conv_id""",
    "op5_license_scan": f"""
WITH f AS (SELECT *, row_number() OVER () AS r, path LIKE '%/LICENSE' AS marked, regexp_replace(path, '/[^/]*$', '') AS dir FROM ({_FILES})),
cut AS (SELECT r, list_transform(string_split(text, chr(10)), lambda l: {_TERMS.format("l")}) AS w FROM f WHERE text IS NOT NULL),
lines AS (SELECT r, i, w[i] AS words FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM cut) WHERE len(w[i]) > 0),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lines),
t AS (SELECT template, license, term, count(*) AS k FROM (SELECT template, license, unnest({_TERMS.format("text")}) AS term FROM (VALUES {_TEMPLATES}) v(template, license, text)) GROUP BY ALL),
units AS (SELECT * FROM (
  SELECT r, i * {licenses.MOST_LINES} + k AS unit, flatten(w[i:i + k]) AS words FROM (SELECT r, i, w, unnest(range({licenses.MOST_LINES})) AS k FROM lines JOIN cut USING (r)) WHERE i + k <= len(w) AND len(w[i + k]) > 0 AND (k = 0 OR len(flatten(w[i:i + k])) <= {licenses.MOST_WORDS})
  UNION ALL SELECT r, 0, {_TERMS.format("text")} FROM f WHERE marked) WHERE list_has_any(words, (SELECT list(DISTINCT term) FROM t))),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT r, i, unnest(words) AS term FROM lines) GROUP BY term),
idf AS (SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT term FROM t UNION SELECT term FROM df) LEFT JOIN df USING (term), n),
w AS (SELECT template, license, term, k * idf AS w, sqrt(sum(k * idf * k * idf) OVER (PARTITION BY template)) AS norm, sum(k) OVER (PARTITION BY template) AS length FROM t JOIN idf USING (term)),
tf AS (SELECT r, unit, term, count(*) AS tf FROM (SELECT r, unit, unnest(words) AS term FROM units) GROUP BY ALL),
v AS (SELECT r, unit, tf.term, tf * idf AS v FROM tf JOIN idf ON tf.term = idf.term),
unit_norm AS (SELECT r, unit, sqrt(sum(v * v)) AS u FROM v GROUP BY ALL),
telling(template, term) AS (VALUES {_TELLING}),
c AS (SELECT r, unit, template, license, any_value(length) AS length, round(sum(v * w) / (any_value(norm) * any_value(u)), 6) AS cosine FROM v JOIN w ON v.term = w.term JOIN unit_norm USING (r, unit) GROUP BY r, unit, template, license),
told AS (SELECT r, unit, template, count(*) AS told FROM tf JOIN telling USING (term) GROUP BY ALL),
must AS (SELECT template, count(*) AS must FROM telling GROUP BY template),
named AS (SELECT c.*, bool_or(license = 'BSD-2-Clause') OVER (PARTITION BY r, unit) AS less FROM c LEFT JOIN must USING (template) LEFT JOIN told USING (r, unit, template) WHERE cosine >= 0.6 AND coalesce(told, 0) = coalesce(must, 0) QUALIFY row_number() OVER (PARTITION BY r, unit ORDER BY cosine DESC, length DESC, license) = 1),
led AS (SELECT *, first_value(license) OVER (PARTITION BY r ORDER BY cosine DESC, length DESC, license) AS top FROM named),
own AS (SELECT r, license, cosine FROM led QUALIFY row_number() OVER (PARTITION BY r ORDER BY top = 'BSD-2-Clause' AND license = 'BSD-3-Clause' AND NOT less DESC, cosine DESC, length DESC, license) = 1),
given AS (SELECT dir AS up, min(license) AS dir_license FROM f JOIN own USING (r) WHERE marked GROUP BY dir),
nearest AS (SELECT dir, up, dir_license FROM (SELECT DISTINCT dir FROM f) JOIN given ON dir = up OR starts_with(dir, up || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1)
SELECT doc_id, path, coalesce(license, dir_license) AS license, cosine, CASE WHEN license IS NOT NULL THEN 'file' WHEN dir_license IS NOT NULL THEN 'directory' END AS origin,
       CASE WHEN license IS NULL THEN up END AS origin_dir
FROM f LEFT JOIN own USING (r) LEFT JOIN nearest USING (dir)""",
    "op1_mix_sources": f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|1'), 1, 13) AS BIGINT) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
shares AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3 AS most, sum(source_size) OVER () AS total FROM per),
levels AS (SELECT *, CAST(total - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                     / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM shares),
targets AS (SELECT source, rank, source_size, least(CAST(most AS DOUBLE), max(CASE WHEN level * weight <= most THEN level END) OVER () * weight) AS target FROM levels),
queued AS (
  SELECT s.*, rank, source_size, target, sum(size) OVER (PARTITION BY rank ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT q.*, k, (k * source_size + upto) / target AS finish FROM queued q, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND k * source_size + upto - size < target),
placed AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, k, upto ROWS UNBOUNDED PRECEDING) AS place FROM passes),
got AS (SELECT rank, upto, sum(greatest(0, least(size, (SELECT sum(size) FROM sized) - (place - size)))) AS taken FROM placed GROUP BY rank, upto)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS BIGINT) AS taken
FROM queued LEFT JOIN got USING (rank, upto)""",
    "op6_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op7_decontaminate": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS n, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT n, count(*) AS total FROM bs GROUP BY n)
SELECT doc_id, item_id, count(*) / CAST(any_value(total) AS DOUBLE) AS containment
FROM ds JOIN bs USING (s) JOIN size ON size.n = bs.n
GROUP BY doc_id, ds.n, item_id, bs.n HAVING count(*) >= ceil(0.8 * any_value(total) - 1e-9)""",
}
