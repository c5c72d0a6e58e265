"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import rotate_perspectives
from .decontamination import decontaminate
from .filter_audit import filter_audit
from .fingerprints import fingerprints
from .license_scan import scan_licenses
from .ngram_join import ngram_join
from .packing import pieces, place
from .prefix_trie import prefix_trie, sequences, with_ends
from .quality import quality
from .simhash import simhash_join
from .substring_dedup import substring_dedup
from .tables import stored
from .token_counts import token_counts
from .toxicity import toxicity


def word_tokenizer() -> str:
    """The vocabulary file that the packing query names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    """The vocabulary file that the token counts name."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def license_tree(documents: DataFrame) -> DataFrame:
    """Documents as files of a tree: /source/lang/block of 1024/block of 64/doc_id."""
    slash = F.lit("/")
    path = F.concat(slash, F.col("source"), slash, F.col("lang"), slash, F.shiftright("doc_id", 10), slash, F.shiftright("doc_id", 6), slash, F.col("doc_id"))
    return documents.select("doc_id", path.alias("path"), "text")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(license_tree(_table(spark, sf_dir, "documents")), threshold=0.6, carry=("doc_id",), any_header=True)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least=4, threshold=0.5)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), piece_model())


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(_table(spark, sf_dir, "documents"), window=50)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def held_out(doc_id: str = "doc_id"):
    """The fold that no label may be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_restored")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), n=5, threshold=0.75)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=~held_out())
    return scored.withColumn("held_out", held_out()).withColumn("keep", (F.col("score") >= 0.5).cast("int"))


def op10_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(_table(spark, sf_dir, "documents"), word_tokenizer(), width=2048, end_id=1)
    return place(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), width=2048)


def op11_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_join(_table(spark, sf_dir, "documents"), shingle=3, seed=42, most=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def rebuilt(every: DataFrame) -> DataFrame:
    """Sequences (conv_id, ids, sizes) of which each begins with the first h turns of the first conversation of its hundred, h from 0 to 5 by its id."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    heads = every.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("ids", 1, 5).alias("head_ids"), F.slice("sizes", 1, 5).alias("head_sizes"))
    rows = every.withColumn("h", h).withColumn("base", F.expr("conv_id - conv_id % 100")).join(heads, "base", "left")

    def column(name: str, kind: str):
        head = F.coalesce(F.slice(f"head_{name}", F.lit(1), F.col("h")), F.array().cast(kind))
        return F.concat(head, F.slice(name, F.col("h") + 1, F.size(name))).alias(name)

    return rows.select("conv_id", column("ids", "array<binary>"), column("sizes", "array<int>"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, members = prefix_trie(rebuilt(stored(sequences(_table(spark, sf_dir, "conversations")))))
    return with_ends(nodes, members).drop("turn")


QUERIES = {
    "op1_license_scans": op1_license_scans,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_shortest_pack_first": op10_shortest_pack_first,
    "op11_simhash_anchors": op11_simhash_anchors,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op4_chat_formatting": """
        WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
        speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
        seen AS (SELECT t.*, perspective, CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user ' || replace(role, '<|', '< |') || '|>' END || chr(10) AS head,
            replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
        placed AS (SELECT *, row_number() OVER w - 1 AS position, (sum(length(head) + length(body)) OVER w)::BIGINT AS upto FROM seen
            WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, perspective, position, turn, role, head || body AS segment, upto - length(head) - length(body) AS begin, upto AS "end",
            CASE WHEN role = perspective THEN upto - length(body) END AS loss_begin, CASE WHEN role = perspective THEN upto - 1 END AS loss_end FROM placed""",
    "op6_substring_dedup": rf"""
        WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM docs WHERE len(ws) >= 50),
        windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS k FROM starts),
        owners AS (SELECT k, min(doc_id) AS owner FROM windows GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM windows JOIN owners USING (k) WHERE doc_id > owner),
        words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs),
        kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept USING (doc_id)""",
    "op8_ngram_jaccard_join": rf"""
        WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        grams AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS s FROM docs WHERE len(ws) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        often AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
        shared AS (SELECT doc_id, g FROM grams SEMI JOIN often USING (g)),
        both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shared a JOIN shared b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM both_have JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
        reach(x, y) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
        FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)""",
    "op12_filter_audit": rf"""
        WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
        least AS (SELECT t, min(doc_id) AS d FROM words GROUP BY t),
        fails AS (SELECT w.doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * len(regexp_extract_all(w.t, '[A-Z]')) > 2 * length(w.t) AS c,
            regexp_matches(w.t, '[#$%&*|]') AS d, coalesce(least.d < w.doc_id, false) AS e,
            coalesce((SELECT max(quality) FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1), 0) AS good, coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1), 0) AS toxic
            FROM words w JOIN least ON least.t = w.t),
        masks AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT v.x || w.x || x.x || y.x || z.x AS filter_order FROM letters v, letters w, letters x, letters y, letters z WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5),
        steps AS (SELECT filter_order, step, list_sum(list_transform(range(1, step::BIGINT), lambda i: (1 << (ascii(filter_order[i]) - 65)))) AS before, 1 << (ascii(filter_order[step]) - 65) AS bit
            FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
        counted AS (SELECT part, filter_order, step, any_value(bit) AS bit,
            coalesce(sum(n) FILTER (mask & (coalesce(before, 0)::INT | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0), 0) AS removed,
            coalesce(sum(n) FILTER (mask & coalesce(before, 0)::INT > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
            coalesce(sum(good) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0), 0) AS toxic_lost
            FROM masks, steps GROUP BY ALL)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
            toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted""",
    "op13_prefix_trie": r"""
        WITH own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        heads AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b:
            list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) % 6 AS h FROM own),
        rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.ts, [])[1:c.h], c.ts[c.h + 1:]) AS ts FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
        starts AS (SELECT conv_id, len(ts) AS turns, d, ts[1:d] AS p FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
        nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = d), '') AS ends FROM starts GROUP BY p, d),
        families AS (SELECT b.p, b.d, a.d AS ad, a.conv_id AS ac, a.p AS ap FROM nodes b JOIN nodes a ON a.d <= b.d AND a.p = b.p[1:a.d]),
        kids AS (SELECT ap, ad, count(*) FILTER (d = ad + 1) AS n_children FROM families GROUP BY ALL),
        sums AS (SELECT f.ap, f.ad, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((x.n - 1) * CASE WHEN x.d = 0 THEN 0 ELSE length(x.p[x.d].t) END) AS saved
            FROM families f JOIN kids k ON k.ap = f.p AND k.ad = f.d JOIN nodes x ON x.p = f.p AND x.d = f.d GROUP BY ALL)
        SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM nodes n JOIN kids k ON k.ap = n.p AND k.ad = n.d JOIN sums s ON s.ap = n.p AND s.ad = n.d LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]""",
}
