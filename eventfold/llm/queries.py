"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file of the installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    found = score(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_store, write_store

    docs = table(spark, sf_dir, "documents")
    folder = write_store(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_store(docs, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import END_OF_TEXT, count_tokens, write_flat

    folder, order = write_flat(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=END_OF_TEXT)
    return count_tokens(spark, folder, separator=END_OF_TEXT).join(order, ["file", "doc_no"]).select("doc_id", "n_tokens")


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import compare_with_edits

    found = compare_with_edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs, fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["likeness"])), F.lit(0.0)).alias("score"),
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import mine

    return mine(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: sizes and targets."""
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def syncmer_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: lengths and edited texts."""
    return op7_syncmers(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def licence_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: base places."""
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


#: Groups of nodes by links, both ways and each with itself, named by their least node.
_GROUPS = """reach(node, other) AS (SELECT DISTINCT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
groups AS (SELECT node, min(other) AS least FROM reach GROUP BY node)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = "list_filter(regexp_split_to_array(" + _LOWER + ", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL = {
    "op4_embeddings": f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT x.vec_id a, y.vec_id b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  AND list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.98),
{_GROUPS}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) n_links, coalesce(least, vec_id) component_id, vec_id = coalesce(least, vec_id) kept
FROM embeddings LEFT JOIN groups ON node = vec_id""",
    "op10_minhash": f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END s FROM words),
classes AS (SELECT s, min(doc_id) node FROM sets WHERE len(s) > 0 GROUP BY s),
flat AS (SELECT node, len(s) n, unnest(s) x FROM classes),
links AS (SELECT p.node a, q.node b FROM flat p JOIN flat q ON p.x = q.x AND p.node <> q.node GROUP BY p.node, q.node, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
{_GROUPS}
SELECT doc_id, CAST(len(sets.s) AS BIGINT) n_shingles, coalesce(least, classes.node, doc_id) component_id, doc_id = coalesce(least, classes.node, doc_id) kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN groups ON groups.node = classes.node""",
    "op11_collocations": f"""WITH pieces AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) p FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) total FROM words GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase FROM words, range(1, 6) lengths(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) times FROM grams GROUP BY ALL),
c AS (SELECT lang, k, phrase, times a, string_split(phrase, ' ') w FROM f WHERE k > 1 AND times >= 100),
cuts AS (SELECT c.lang, c.phrase, a, x.times l, y.times r, total, 1000 * a * total // (x.times * y.times) score, j FROM c JOIN totals ON totals.lang = c.lang JOIN range(1, 5) places(j) ON j < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:c.k], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM lowest ANTI JOIN (SELECT s.lang, s.phrase FROM c s JOIN c t ON s.lang = t.lang AND t.k > s.k AND 100 * t.a >= 100 * s.a AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')) USING (lang, phrase)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) rank, phrase, CAST(a AS BIGINT) a, CAST(l AS BIGINT) l, CAST(r AS BIGINT) r, CAST(total AS BIGINT) n, CAST(score AS BIGINT) score FROM placed WHERE rank <= 2000""",
    "op12_importance": f"""WITH docs AS (SELECT doc_id, {_LETTERS} w FROM documents), goal AS (SELECT {_LETTERS} w FROM benchmark),
spelled AS (SELECT DISTINCT unnest(w) x FROM docs UNION SELECT DISTINCT unnest(w) FROM goal),
steps AS (SELECT list(v ORDER BY b) t FROM (SELECT b, list_reduce(range(8), lambda crc, k: CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, b) v FROM range(256) bytes(b))),
bucketed AS (SELECT x, xor(list_reduce(list_transform(range(0, octet_length(encode(x))), lambda i: CAST('0x' || substr(hex(encode(x)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda crc, b: xor(crc >> 8, t[xor(crc & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM spelled, steps),
s AS (SELECT bucket, count(*) n FROM (SELECT unnest(w) x FROM docs) JOIN bucketed USING (x) GROUP BY bucket), t AS (SELECT bucket, count(*) n FROM (SELECT unnest(w) x FROM goal) JOIN bucketed USING (x) GROUP BY bucket),
gains AS (SELECT x, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) gain FROM bucketed LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(gain) weight FROM (SELECT doc_id, unnest(w) x FROM docs) JOIN gains USING (x) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) n_features, CAST(coalesce(weight, 0) AS BIGINT) weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) score FROM docs LEFT JOIN weights USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) place FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) n_features, weight, score, CAST(CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS BIGINT) rank FROM placed""",
    "op13_quality": """WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') x, coalesce('=' || source, '') host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') w FROM t),
windows AS (SELECT row_no, unnest(list_transform(range(1, len(w) - 6), lambda i: {'place': i, 'g': array_to_string(w[i:i + 7], ' ')}), recursive := true) FROM w WHERE len(w) >= 8),
again AS (SELECT row_no, place FROM windows QUALIFY count(*) OVER (PARTITION BY row_no, g) > 1),
repeated AS (SELECT row_no, count(DISTINCT word) n FROM (SELECT row_no, unnest(range(place, place + 8)) word FROM again) GROUP BY row_no),
raw AS (SELECT row_no, host, x, unnest(string_split(x, chr(10))) line FROM t),
doubled AS (SELECT row_no, count(*) - count(DISTINCT line) n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no),
normal AS (SELECT row_no, host, x, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') line FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT host, count(DISTINCT x) n_texts FROM t GROUP BY host),
frequent AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT x) n FROM normal GROUP BY host, line) JOIN hosts USING (host) WHERE n > 10 AND n * 100 > n_texts * 5),
sums AS (SELECT row_no, sum(length(line)) n_chars, coalesce(sum(length(line)) FILTER (gone IS NULL), 0) n_left FROM (SELECT n.*, f.line AS gone FROM normal n LEFT JOIN frequent f ON f.host = n.host AND f.line = n.line) GROUP BY row_no),
told AS (SELECT doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(doubled.n, 0) n_dup_lines, coalesce(repeated.n, 0) n_repeat_words, coalesce(n_chars, 0) n_chars, coalesce(n_left, 0) n_left
  FROM w LEFT JOIN repeated USING (row_no) LEFT JOIN doubled USING (row_no) LEFT JOIN sums USING (row_no))
SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(word_chars AS BIGINT) word_chars, CAST(n_symbols AS BIGINT) n_symbols, CAST(n_dup_lines AS BIGINT) n_dup_lines, CAST(n_repeat_words AS BIGINT) n_repeat_words,
n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_left * 100 >= n_chars * 30 kept FROM told""",
    "mixing_targets": """WITH sized AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END weight FROM sources),
levels AS (SELECT *, 2.0 * source_size / weight AS fill, 1.5 * sum(source_size) OVER () AS total FROM weighed),
filled AS (SELECT *, (total - coalesce(sum(2.0 * source_size) OVER (ORDER BY fill, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY fill, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM levels),
shared AS (SELECT (SELECT total FROM levels LIMIT 1) - coalesce(sum(2.0 * source_size) FILTER (fill <= level), 0) AS left_over, sum(weight) FILTER (fill > level) AS open FROM filled)
SELECT doc_id, size, source_size, round(CASE WHEN fill <= level THEN 2.0 * source_size ELSE weight * left_over / open END, 4)::DOUBLE target
FROM sized JOIN filled ON sized.source IS NOT DISTINCT FROM filled.source CROSS JOIN shared""",
    "syncmer_edits": """WITH t AS (SELECT doc_id, coalesce(text, '') x FROM documents), n AS (SELECT *, coalesce(lead(x) OVER (ORDER BY doc_id), first_value(x) OVER (ORDER BY doc_id)) y FROM t)
SELECT doc_id, length(x) n_chars, sha256(substr(x, 1, length(x) - length(x) // 4) || substr(y, 1, length(x) // 4)) edited_sha256 FROM n""",
    "licence_base_places": """WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM documents),
placed AS (SELECT doc_id, len(w) n, list_filter(range(1, len(w)), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') a, list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') b, list_filter(range(1, len(w) - 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') c FROM words)
SELECT doc_id, CAST(n AS BIGINT) n_words, CAST(len(a) + len(b) + len(c) AS BIGINT) n_base, list_min(a || b || c) - 1 first_word, list_max(a || b || c) - 1 last_word,
concat_ws(',', CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END) base_labels FROM placed""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sentencepiece, op2_mixing, op3_toxicity, op4_embeddings, op5_token_store, op6_token_counts, op7_syncmers, op8_language, op9_licenses, op10_minhash, op11_collocations, op12_importance, op13_quality)
    return {f.__name__: f for f in (*own, mixing_targets, syncmer_edits, licence_base_places)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
