"""The registered queries: each applies its operator, with its default parameters, to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, jaccard, licenses, lines, packing, pieces, quality, ranking, simhash, spelling, suffixes, toxicity, windows
from .registry import query, table
from .storage import stored


@query(
    "op4_exact_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS size,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
    """,
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", F.col("sha").alias("text_sha256"))


@query("op5_simhash")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hexadecimal("fingerprint").alias("fingerprint"), F.col("component").alias("component_id"))


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    measured = stored(quality.measures(table(spark, folder, "documents")))
    forest = quality.fit_measures(measured, table(spark, folder, "labels"))
    return quality.judged_measures(measured, forest).withColumnRenamed("id", "doc_id")


@query(
    "op8_substring_dedup",
    r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    places AS (SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS p FROM words WHERE len(w) >= 35),
    wins AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM places JOIN words USING (doc_id)),
    twice AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 34)) AS i FROM wins JOIN twice USING (h)),
    single AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0),
    kept AS (
        SELECT doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS k
        FROM single e LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
    FROM words LEFT JOIN kept USING (doc_id)
    """,
)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = windows.remove_repeated_windows(docs, one_space=True)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op1_toxicity")
def toxicity_grades(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.graded(docs, toxicity.fit(docs, table(spark, folder, "labels"))).withColumnRenamed("id", "doc_id")


def _license_sql() -> str:
    def listed(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    phrases = " OR ".join(
        f"(list_slice(w, i, i + {len(words) - 1}) = {listed(words)})" for words in map(licenses.words_of, licenses.PHRASES)
    )
    named = " ".join(
        f"WHEN list_slice(w, i, i + {len(words) - 1}) = {listed(words)} THEN '{label}'"
        for words, label in ((licenses.words_of(t), x) for t, x in licenses.PHRASES.items())
    )
    templates = ", ".join(
        f"({listed(sorted(set(licenses.words_of(t))))}, '{label}')" for t, label in licenses.TEMPLATES.items()
    )
    return rf"""
    WITH t AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    words AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
    places AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM words),
    base AS (SELECT doc_id, i - 1 AS p, CASE {named} END AS label FROM places WHERE {phrases}),
    split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM t),
    lines AS (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM split),
    counted AS (SELECT doc_id, i, len(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS c FROM lines),
    summed AS (SELECT doc_id, c, sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM counted),
    templates(words, label) AS (VALUES {templates}),
    ends AS (SELECT doc_id, label, words, upto - c + 1 AS a, max(upto) OVER (PARTITION BY doc_id, label ORDER BY upto
                    RANGE BETWEEN CURRENT ROW AND greatest({licenses.BLOCK_SHARE} * len(words) - c, 0) FOLLOWING) AS e FROM summed, templates WHERE c > 0),
    sets AS (SELECT doc_id, label, ends.words, list_distinct(list_slice(w, CAST(a AS BIGINT), CAST(e AS BIGINT))) AS s
             FROM ends JOIN words USING (doc_id)),
    found AS (
        SELECT doc_id, label, len(list_intersect(s, words)) AS common, len(words) AS n
        FROM sets WHERE len(list_intersect(s, words)) >= ceil({licenses.CONTAINMENT} * len(words) - 1e-9)),
    b AS (
        SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
        FROM base GROUP BY doc_id),
    f AS (SELECT doc_id, max(common / n) AS score FROM found GROUP BY doc_id),
    every AS (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM found),
    l AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM words LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id)
    """


@query("op3_license_scan", _license_sql())
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("blocks").withColumnRenamed("id", "doc_id")


@query("op9_sentencepiece")
def sentencepiece_codes(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.encode_documents(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.size("pieces").alias("n_pieces"), "pieces", "lossless")


def _line_sql() -> str:
    """Runs of every length up to ``LEAST_LINES``, the shorter ones only if they hold ``LEAST_WORDS`` words."""
    runs = "\n        UNION ALL\n        ".join(
        f"""SELECT doc_id, p, {d} AS d, md5(array_to_string(list_slice(l, p, p + {d - 1}), chr(10))) AS h
        FROM (SELECT doc_id, l, c, unnest(generate_series(1, len(l) - {d - 1})) AS p FROM counted)
        WHERE {'true' if d == lines.LEAST_LINES else f'list_sum(list_slice(c, p, p + {d - 1})) >= {lines.LEAST_WORDS}'}"""
        for d in range(1, lines.LEAST_LINES + 1)
    )
    return rf"""
    WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    counted AS (SELECT doc_id, l, list_transform(l, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS c FROM t),
    runs AS (
        {runs}),
    later AS (SELECT doc_id, p, d, row_number() OVER (PARTITION BY d, h ORDER BY doc_id, p) AS n FROM runs),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + d - 1)) AS p FROM later WHERE n > 1),
    single AS (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS p FROM t),
    marked AS (SELECT doc_id, p, line, g.p IS NOT NULL AS gone FROM single LEFT JOIN gone g USING (doc_id, p)),
    edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS head FROM marked)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_runs,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
    FROM edges GROUP BY doc_id
    """


@query("op2_line_dedup", _line_sql())
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.line_dedup(table(spark, folder, "documents"), words=lines.LEAST_WORDS)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_suffix_dedup")
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeated_bytes(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op11_spelling_variants",
    r"""
    WITH RECURSIVE powers AS (
        SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
        FROM (SELECT unnest(generate_series(0, 255)) AS i)),
    runs AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)),
    counted AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
    spelt AS (
        SELECT run, times, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
               lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END)) AS bytes
        FROM counted),
    hashed AS (
        SELECT run, times, xor(list_reduce(list_prepend(4294967295, bytes),
               lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
        FROM spelt, powers),
    results AS (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word,
               times FROM hashed),
    words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
    places AS (SELECT word, unnest(generate_series(1, length(word))) AS i FROM words),
    masks AS (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS mask FROM places),
    shorter AS (SELECT DISTINCT p.word AS a, w.word AS b FROM places p JOIN words w ON substr(p.word, 1, i - 1) || substr(p.word, i + 1) = w.word),
    near AS (SELECT a.word AS a, b.word AS b FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
             UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter),
    ranked AS (SELECT a, b, w.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS r
               FROM near JOIN words w ON w.word = near.b),
    forms AS (SELECT w.word, CASE WHEN r.n >= 10 * w.n THEN r.b END AS form, w.n, coalesce(r.n_near, 0) AS n_near,
                     CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.r = 1),
    paths AS (SELECT word, word AS root, form AS next FROM forms
              UNION ALL SELECT p.word, f.word, f.form FROM paths p JOIN forms f ON f.word = p.next)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM paths WHERE next IS NULL) USING (word)
    """,
)
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query(
    "op12_ranked_search",
    r"""
    WITH terms AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
        FROM documents),
    sizes AS (SELECT r, doc_id, len(t) AS n FROM terms WHERE len(t) > 0),
    sums AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
    held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM terms) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM held GROUP BY term),
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    weights AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN dfs USING (term), sums),
    scored AS (
        SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM weights JOIN held USING (term) JOIN sizes USING (r), sums GROUP BY ALL),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 50
    """,
)
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op13_ngram_jaccard",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
               ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
        FROM words),
    tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n AS n, count(*) AS c
                 FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (m + n - c)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b.b FROM reached r JOIN ways b ON r.other = b.a)
    SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id
    FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id)
    """,
)
def ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.similar_groups(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
